"""Registered queries against their SQL on rows that the small tables lack."""

import duckdb
import pytest

from verbamill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def compared(spark, tmp_path):
    """The rows of a query, once they are found to be those of its SQL, over tables given as rows and a schema."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        told = lambda rows: sorted(map(str, rows))
        rows = [tuple(r) for r in df.select(*columns).collect()]
        assert told(rows) == told(con.sql(SQL[name]).select(*columns).fetchall())
        return rows

    return run


LONG = " ".join(["word"] * 217)


@pytest.mark.parametrize(
    ("text", "passages", "chars"),
    [
        (f"{LONG}. 1 b c d 1. 2 b c d 22", 3, 1084 + 9 + 10),  # digits that are the sentences' own positions
        (f"{LONG} x y. a b c d e\u1680. \u205f f g h i j ", 3, 1088 + 9 + 9),  # separators that no pattern squeezes
        (f"{LONG} x y z.\x0b a b c d e. \x0bf g h i j", 1, 10),
        ("\u1680 one\x0btwo \u00a0\t three \u205f", 1, 13),
    ],
)
def test_passages(compared, text, passages, chars):
    assert compared("mixed_passages", documents=([(1, text), (2, None), (3, "\n")], "doc_id long, text string")) == [(chars, 1, passages)]


@pytest.mark.parametrize(
    ("text", "sentences", "chars"),
    [
        ("0 is a digit here 0. 1 is another 1. 22 is two of 2", 3, 20 + 15 + 14),
        ("Somewhere in. 19.37.233.111", 2, 13 + 13),
        ("\u00a0of nine ch\u2003! \u1680tenletters\u3000 ", 2, 12 + 10),
        ("of one part.\x0bof one part", 1, 24),
        ("of two parts\x01of two parts.\x01 of three parts", 3, 12 + 13 + 14),
    ],
)
def test_sentences(compared, text, sentences, chars):
    assert set(compared("sentence_split", documents=([(1, text), (2, None), (3, "")], "doc_id long, text string"))) == {(chars, 1, sentences), (0, 2, 0), (0, 3, 0)}


def scored(texts, quality):
    """documents and labels of these texts."""
    return {
        "documents": ([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"),
        "labels": ([(i, q, 0) for i, q in enumerate(quality)], "doc_id long, quality int, toxic int"),
    }


TIE = " ".join([f"w{i}" for i in range(57)] + ["w0"] * 743)  # 0.07125, whose scaled double lies below the half


def test_thresholds_round_and_keep_what_has_no_score(compared):
    rows = compared("threshold_table", **scored([TIE, None, "a b"], [1, 1, 0]))
    assert {r[3]: (r[4], r[0], r[1], r[2]) for r in rows} == {1.0: (0, 1, 0.0, 0.0), 0.0712: (1, 1, 0.5, 0.5), None: (2, 1, 0.666667, 1.0)}


def test_thresholds_without_any_correct(compared):
    assert [str(r) for r in compared("threshold_table", **scored(["a", "a"], [0, None]))] == ["(2, 0.0, nan, 1.0, 0)"]


def test_thresholds_round_precision(compared):
    assert compared("threshold_table", **scored(["a"] * 640, [1] * 41 + [0] * 599)) == [(599, 0.064062, 1.0, 1.0, 41)]


def test_a_missing_score_is_no_threshold(compared):
    assert sorted(compared("confidence_thresholds", **scored([TIE, None, "a b"], [1, 1, 1]))) == [("auto", 1.0, 0.666667, 0.0712), ("review", 1.0, 0.666667, 0.0712)]

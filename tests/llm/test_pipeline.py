"""The pipeline's stages, one after another, against plain versions of their decisions."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests_llm_plain import linked
from verbamill.llm import quality_classifier, secret_scan, toxicity
from verbamill.llm.common import written

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@tables
def test_stages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(written(stage(spark, held[-1], SF), name).cache())
    rows = [{r["doc_id"]: r.asDict() for r in x.collect()} for x in held[:-1]]
    assert all(x.columns == columns for x in held[:-1]) and all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    # quality: the operator's own scores, on the metadata of the table
    good = quality_classifier.score(docs, quality_classifier.fit(docs, labels, metadata=("n_chars",)), metadata=("n_chars",)).filter("predicted = 1")
    assert set(rows[1]) == {r["doc_id"] for r in good.collect()} and 0 < len(rows[1]) < len(rows[0])
    known = {r["doc_id"]: r["quality"] for r in labels.filter("quality IS NOT NULL").collect()}
    assert np.mean([(i in rows[1]) == bool(y) for i, y in known.items() if i in rows[0]]) > 0.9
    # toxicity
    clean = toxicity.score(held[1], toxicity.fit(held[1], labels)).filter("predicted = 0")
    assert set(rows[2]) == {r["doc_id"] for r in clean.collect()}
    # near copies: all pairs
    ids = sorted(rows[2])
    root = linked([rows[2][i]["text"] for i in ids], 5, 80)
    assert set(rows[3]) == {i for k, i in enumerate(ids) if root[k] == k} and all(rows[3][i] == rows[2][i] for i in rows[3])
    # secrets: every span of every text replaced
    scan = secret_scan.Scanner().scan
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        before, spans = rows[3][i]["text"], scan(rows[3][i]["text"])[1]
        covered = {p for a, _, b in spans for p in range(a, b)}
        outside = "".join(c for p, c in enumerate(before) if p not in covered)
        assert r["text"].replace("[SECRET]", "") == outside.replace("[SECRET]", "") and ("[SECRET]" in r["text"]) == bool(spans) and r["n_chars"] == len(r["text"])
    # packing: the library's ids, each in one place
    whole, at, laid = Tokenizer.from_file(P.path("word_bpe_49k.json")), defaultdict(int), defaultdict(list)
    ids = {i: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for i, r in rows[4].items()}
    for r in held[5].orderBy("doc_id", "start").collect():
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
        laid[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(at) == {i: len(x) for i, x in ids.items()}
    for found in laid.values():
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(n for _, n in found) <= 4096


@tables
def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def prose(seed, n=80):
    return " ".join(f"w{zlib.crc32(f'{seed}/{k}'.encode()) % 900}" for k in range(n))


def test_odd_rows(spark, docs_of, tmp_path):
    """Nulls, repeated ids, empty and very long texts, ties, clashing columns; no labels, so nothing is rejected."""
    one, two = prose("a"), prose("b")
    texts = [one, one, two, two + " more", None, "", one, prose("c", 60_000), "x"]
    ids = [5, 5, 5, 7, 1, 2, None, 3, None]
    docs = docs_of(texts, ids=ids).withColumn("component", F.lit("c")).withColumn("bands", F.lit(1)).withColumn("times", F.lit(None).cast("string")).withColumn("others", F.lit(2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, held, str(tmp_path)), name)
        assert after.columns == docs.columns and after.filter("component <> 'c' OR bands <> 1 OR times IS NOT NULL OR others <> 2 OR score <> 'x'").count() == 0
        held = after
    # each text of id 5 stays once; 7 is a near copy of one; rows without an id stay
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in held.collect()) == sorted([(5, one), (5, two), (1, ""), (2, ""), (0, one), (3, texts[7]), (0, "x")])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r["sequence_id"] for r in pieces}) and {r["doc_id"] for r in pieces} == {None, 1, 2, 3, 5}


def test_no_rows(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

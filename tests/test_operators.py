"""Operators on hand-checked rows."""

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbamill.functions import python_text
from verbamill.functions.distance import cer, lengths_close, longest_common_substring, similarity, wer, word_edits
from verbamill.functions.text import words
from verbamill.operators import evaluation, gates, joins, lexicon, lm, sampling, spans
from verbamill.plans import strategies
from verbamill.sources import manifests, sinks
from verbamill.streaming import events


@pytest.mark.parametrize(("r", "h", "expected"), [("a b c d", "a x c d e", 0.5), ("", "", 0.0), ("", "x", 1.0), ("a b", "b", 0.5), ("مريض عنده", "مريض", 0.5)])
def test_wer(spark, r, h, expected):
    assert spark.range(1).select(wer(F.lit(r), F.lit(h))).first()[0] == expected


def test_cer_with_and_without_spaces(spark):
    row = spark.range(1).select(cer(F.lit("ab c"), F.lit("abc")), cer(F.lit("ab c"), F.lit("abc"), spaces=True), similarity(F.lit(""), F.lit("")), lengths_close(F.lit("abcd"), F.lit("abcdefg"))).first()
    assert tuple(row) == (0.0, 0.25, 1.0, False)
    assert spark.range(1).select(longest_common_substring(F.lit("paracetamol"), F.lit("cetamin"))).first()[0] == 5


def test_word_edits_over_long_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(600)), " ".join(f"w{i}" for i in range(0, 600, 2))
    assert spark.createDataFrame([(a, b)], "a string, b string").select(word_edits(words("a"), words("b"))).first()[0] == 300


def test_corpus_rate_is_a_ratio_of_sums(spark):
    scored = spark.createDataFrame([("x", 1, 10), ("x", 1, 1), ("x", 3, 0)], "s string, edits long, ref_words long")
    assert evaluation.corpus_rate(scored, ["s"]).first()["wer"] == 2 / 11
    assert evaluation.corpus_rate(scored, ["s"], "mark").first()["wer"] == 5 / 12


def test_gate_names_the_first_reason(spark):
    df = spark.createDataFrame([(0.5, ""), (5.0, ""), (5.0, "x"), (None, "x")], "d double, t string")
    out = gates.gate(df, [("too_short", F.col("d") < 1), ("empty", F.col("t") == "")])
    assert [r["reason"] for r in out.collect()] == ["too_short", "empty", None, None]
    assert gates.accepted(out).count() == 2 and gates.rejected(out).count() == 2


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.2,), (None,)], "x double")
    assert [r[0] for r in df.select(gates.bucket(F.col("x"), [0, 0.05, 0.1])).collect()] == [1, 2, 4, None]


@pytest.mark.parametrize(("n", "expected"), [(1, 0), (10, 1), (30, 2), (50, 2)])
def test_validation_sizes(spark, n, expected):
    out = sampling.held_out(spark.range(n).withColumn("s", F.lit("a")), ["s"], 0.05, "7", "id")
    assert out.filter("split = 'val'").count() == expected


def test_budget_keeps_the_row_that_crosses(spark):
    df = spark.createDataFrame([(i, "a", 3.0) for i in range(4)] + [(9, "a", 0.0)], "id long, s string, d double")
    assert sampling.budget(df, ["s"], "d", F.lit(7.0), "7", "id").count() == 3


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(300).select((F.col("id") % 30).alias("g"), F.lit("a").alias("s"), F.lit(1.0).alias("d"))
    out = sampling.group_split(df, "s", "g", "d", {"train": 0.8, "validation": 0.1, "test": 0.1}, "7").collect()
    assert len(out) == 30 and sum(r["split"] == "train" for r in out) in range(22, 27) and {r["split"] for r in out} == {"train", "validation", "test"}


def test_weighted_draws_follow_weights(spark):
    df = spark.createDataFrame([(1, 9.0), (2, 1.0), (3, 0.0)], "id long, w double")
    got = {r["id"]: r["count"] for r in sampling.weighted_draws(df, "w", 2000, "7", "id").groupBy("id").count().collect()}
    assert sum(got.values()) == 2000 and 3 not in got and 1700 < got[1] < 1900


def test_islands_and_overlaps(spark):
    df = spark.createDataFrame([(1, 3, 3, 4), (1, 4, 4, 5), (1, 6, 8, 9)], "k int, i int, a int, b int")
    assert [tuple(r) for r in spans.split_at(df.withColumn("at", F.col("i").cast("long")), ["k"], "at", F.lit(False)).orderBy("start").collect()] == [(1, 3, 4, 2), (1, 6, 6, 1)]
    assert [tuple(r) for r in spans.merged_overlaps(df, ["k"], "a", "b", "i").orderBy("start").collect()] == [(1, 3, 5, 2), (1, 8, 9, 1)]


def test_best_spans_do_not_overlap(spark):
    df = spark.createDataFrame([(1, 0, 3, 1.0), (1, 2, 5, 2.0), (1, 6, 7, 0.5)], "k int, a int, b int, s double")
    assert sorted((r["a"], r["b"]) for r in spans.best_spans(df, ["k"], "a", "b", "s").collect()) == [(2, 5), (6, 7)]


def test_leak_guards(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, seg string")
    held = spark.createDataFrame([("y",)], "seg string")
    assert sorted(r["id"] for r in joins.leak_guard(df, F.array("seg"), held, F.array("seg"), "id").collect()) == [1, 3]
    texts = spark.createDataFrame([(1, "a b c d"), (2, "x b c y"), (3, "")], "id long, t string")
    bench = spark.createDataFrame([("q b c d",)], "t string")
    assert [r["id"] for r in joins.shared_ngrams(texts, words("t"), bench, words("t"), 3, "id").collect()] == [1]


def test_language_model_backs_off(spark):
    taught = [["a", "b", "a", "b", "c"], ["a", "b"], []]
    asked = [["a", "b", "c"], ["z", "b", "c"], ["q"], ["a", "q"], []]
    df, new = (spark.createDataFrame(list(enumerate(x)), "id long, t array<string>") for x in (taught, asked))
    table = lm.counts(df, "t", 3)
    full = [["<s>", "<s>", *t, "</s>"] for t in taught if t]
    grams = Counter(tuple(s[i : i + n]) for s in full for n in (1, 2, 3) for i in range(len(s) - n + 1))
    assert {tuple([*r["context"].split(), r["word"]]): r["count"] for r in table.collect()} == dict(grams)
    follows = Counter(g[-1] for g in grams if len(g) > 1)

    def p(word, *context):
        if not context:
            return follows[word] / sum(follows.values())
        total, kinds = sum(n for g, n in grams.items() if g[:-1] == context), sum(g[:-1] == context for g in grams)
        below = p(word, *context[1:])
        return max(grams[(*context, word)] - 0.75, 0) / total + 0.75 * kinds / total * below if total else below

    got = {r["id"]: r for r in lm.sentence_scores(new, "id", "t", table, 3).collect()}
    assert set(got) == {0, 1, 2, 3}
    for i, t in enumerate(asked[:4]):
        s = ["<s>", "<s>", *t, "</s>"]
        want = sum(math.log10(p(s[k], *s[k - 2 : k]) or 1e-10) for k in range(2, len(s)))
        assert got[i]["words"] == len(t) and abs(got[i]["log10_p"] - want) < 1e-9 and abs(got[i]["perplexity"] - 10 ** (-want / len(t))) < 1e-6 * got[i]["perplexity"]


def test_windows_and_edits(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>")
    assert spans.token_windows(df.withColumn("k", F.lit(1)), "w", 3).count() == 6
    edits = F.array(F.struct(F.lit("ab").alias("old"), F.lit("x").alias("new")))
    assert spark.range(1).select(spans.apply_edits(F.lit("ab ab"), edits)).first()[0] == "x ab"


def test_corrected_by_sound(spark):
    known = spark.createDataFrame([(w,) for w in ("صداع", "ضغط", "مريض", "سلام", "نظيف")], "term string")
    said = spark.createDataFrame([(w,) for w in ("سداع", "الدغط", "المرد", "صداع", "الصداع", "نزيف", "قل", "xyz")], "word string")
    got = {r["word"]: (r["term"], round(r["confidence"], 4)) for r in lexicon.corrected(said, "word", known, "term").collect()}
    assert got["سداع"] == ("صداع", round(1 - 1 / 12, 4)) and got["المرد"] == ("المريض", 0.85)
    assert got["نزيف"] == ("نظيف", 0.875) and set(got) <= {"سداع", "المرد", "نزيف", "الدغط"}


def test_alias_rewrite(spark):
    rows = [(1, "the red ring of red rings".split()), (2, "redring".split()), (3, "a b".split()), (4, []), (None, ["red"])]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    known = spark.createDataFrame([("redring", "X"), ("redring", "Y"), ("red", "r"), ("ringofred", "Z")], "key string, value string")
    got = {r["id"]: r["w"] for r in spans.alias_rewrite(df, "id", "w", known).collect()}
    assert got == {1: ["the", "X", "of", "r", "rings"], 2: ["X"], 3: ["a", "b"], 4: [], None: ["red"]}


def test_threshold_and_auc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1)], "s double, y int")
    t = evaluation.threshold_table(df, "s", "y")
    assert evaluation.lowest_threshold(t, "s", 0.95).first()["s"] == 0.8
    assert evaluation.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(2 / 3)
    assert evaluation.lowest_threshold(t.filter("s < 0"), "s", 0.95).count() == 0


def test_lexicon_merges(spark):
    a, b = spark.createDataFrame([("x", "old", 2)], "term string, type string, tier int"), spark.createDataFrame([("x", "new", 3), ("y", "new", 1)], "term string, type string, tier int")
    assert {tuple(r) for r in lexicon.first_wins([a, b], "term").collect()} == {("x", "old", 2), ("y", "new", 1)}
    assert {tuple(r) for r in lexicon.overridden([a, b], "term", "tier").collect()} == {("x", "new", 2), ("y", "new", 1)}
    near = lexicon.spelling_candidates(spark.createDataFrame([("aspirn",)], "w string"), "w", spark.createDataFrame([("aspirin",), ("insulin",)], "t string"), "t")
    assert [tuple(r) for r in near.collect()] == [("aspirn", "aspirin", 1)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "text": "x"}\n\n{"id": \n')
    rows = manifests.jsonl(spark, str(tmp_path / "m.jsonl"), "id string, text string", "keep").cache()
    assert rows.filter("_bad IS NOT NULL").count() == 1
    assert manifests.jsonl(spark, str(tmp_path / "m.jsonl"), "id string, text string", "skip").filter("id IS NOT NULL").count() == 1
    for model in ("m1", "m2"):
        (tmp_path / "p" / model).mkdir(parents=True)
        (tmp_path / "p" / model / "c.json").write_text('{"id": "c",\n "pred": "y"}')
    assert sorted(r["model"] for r in manifests.documents(spark, str(tmp_path / "p"), "id string, pred string").collect()) == ["m1", "m2"]
    (tmp_path / "g.csv").write_text("﻿file,text\na.wav,x\n", encoding="utf-8")
    assert manifests.csv(spark, str(tmp_path / "g.csv"), "file string, text string").first()["file"] == "a.wav"
    subs = spark.createDataFrame([(1, 1, "00:05"), (1, 2, "hello"), (1, 3, "there"), (1, 4, "00:09"), (1, 5, "lost")], "f int, n int, line string")
    assert [tuple(r) for r in manifests.subtitles(subs, ["f"], "n", "line").collect()] == [(1, 5, 9, "hello there")]
    df = spark.createDataFrame([("train", 1), ("val", 2)], "split string, id long")
    sinks.splits(df, str(tmp_path / "out"), "split", "id")
    assert (tmp_path / "out" / "split=train").exists()
    assert sinks.markdown(df.orderBy("id"), ["split", "id"]).splitlines()[2] == "| train | 1 |"


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\nbroken\n{"id": 5}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 9}\n')
    rows = manifests.with_provenance(spark, str(tmp_path), "id long").collect()
    assert sorted((r["_manifest"][-7:], r["_line_no"], r["id"]) for r in rows if r["id"]) == [("a.jsonl", 1, 1), ("a.jsonl", 3, 2), ("a.jsonl", 5, 5), ("b.jsonl", 1, 9)]
    assert [r["_line_no"] for r in rows if not r["id"]] == [4]
    assert manifests.any_root(spark, [str(tmp_path / "none"), str(tmp_path)], "*.jsonl") == str(tmp_path) and manifests.any_root(spark, [str(tmp_path / "none")]) is None
    (tmp_path / "set.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert manifests.eval_set(spark, str(tmp_path / "set.json"), "id long").count() == 2 and manifests.eval_set(spark, str(tmp_path / "b.jsonl"), "id long").count() == 1


def test_skipping_scans_and_models_by_folder(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n{"id": \n\n{"id": 3}\n')
    assert sorted(r["id"] for r in manifests.jsonl(spark, str(tmp_path / "x.jsonl"), "id long", "skip").collect()) == [1, 3]
    for model, text in (("m1", '{"id": "a",\n "wer": 0.5}'), ("m2", '{"id": "b"}')):
        (tmp_path / "root" / model).mkdir(parents=True)
        (tmp_path / "root" / model / "one.json").write_text(text)
    (tmp_path / "root" / "m1" / "bad.json").write_text("{")
    got = manifests.documents(spark, str(tmp_path / "root"), "id string, wer double")
    assert sorted((r["model"], r["id"]) for r in got.filter("id IS NOT NULL").collect()) == [("m1", "a"), ("m2", "b")]
    stems = spark.createDataFrame([("x/A.wav", 1), ("y/a.mp3", 2), ("b", 3)], "path string, at int")
    assert {r["stem"]: r["path"] for r in manifests.keyed_by_stem(stems, "path", "at").collect()} == {"a": "y/a.mp3", "b": "b"}


def test_reports_and_vocabularies(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5), ("a", None), ("c", 0.25), ("d", 0.5)], "model string, wer double")
    table = sinks.leaderboard(df, "wer", "model", ["model", "wer"]).split("\n")
    assert [row.split(" | ")[0] for row in table[2:]] == ["| c", "| b", "| d", "| a"]
    sinks.vocabulary(spark.createDataFrame([(["b", "a"],), (["a"],)], "w array<string>"), "w", f"{tmp_path}/v")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/v").collect()] == ["a", "b"]
    sinks.summary(df, f"{tmp_path}/s", {"rows": F.count("*"), "mean": F.round(F.avg("wer"), 2)})
    assert spark.read.json(f"{tmp_path}/s").first().asDict() == {"rows": 4, "mean": 0.42}


def test_times_are_dealt_out():
    words = [{"text": t, "start": float(k), "end": k + 1.0} for k, t in enumerate("a b c d".split())]
    got = python_text.timed_of(words, ["a", "x", "y", "z", "d", "e"])
    assert [w["text"] for w in got] == ["a", "x", "y", "z", "d", "e"] and [round(w["start"], 3) for w in got] == [0, 1, 1.667, 2.333, 3, 4]
    assert python_text.timed_of([], ["q"]) == [{"text": "q", "start": 0.0, "end": 0.0}] and python_text.timed_of(words, []) == []


def test_phrases_by_skeleton(spark):
    rows = spark.createDataFrame([(1, "the blod sugr of blood sugar is".split()), (2, ["x"])], "id long, t array<string>")
    known = spark.createDataFrame([("blood sugar",), ("high fever",)], "p string")
    got = {(r["at"], r["width"]): (r["phrase"], r["score"]) for r in spans.phrase_matches(rows, "id", "t", known, "p").collect()}
    assert got[1, 2][0] == "blood sugar" and got[4, 2] == ("blood sugar", 100.0)


def test_pluggable_backends(spark):
    class Shout:
        def prepare(self):
            self.mark = "!"

        def answer(self, batch):
            return [None if x is None else x.upper() + self.mark for x in batch.column(0).to_pylist()]

    backends = strategies.Backends()
    backends.register("shout", Shout)
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert sorted(map(str, (r["answer"] for r in backends.run("shout", df).collect()))) == ["A!", "None"]
    with pytest.raises(ValueError):
        backends.register("shout", Shout)
    terms = spark.createDataFrame([("red ring",), ("blue bolt",)], "term string")
    said = spark.createDataFrame([("red rings",)], "term string")
    assert [r["other"] for r in strategies.NEIGHBOURS["ngram"](said, terms).collect()] == ["red ring"] == [r["other"] for r in strategies.NEIGHBOURS["spelling"](said, terms).collect()]


def test_progress_can_be_polled(spark, tmp_path):
    seen = events.Progress()
    spark.streams.addListener(seen)
    spark.range(5).write.json(f"{tmp_path}/in")
    events.run_once(events.trace(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/c", f"{tmp_path}/out")
    for _ in range(50):
        if any(x["rows"] == 5 and not x["running"] for x in seen.seen.values()):
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert any(x["rows"] == 5 for x in seen.seen.values())


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    folder, source = f"{tmp_path}/dim", f"{tmp_path}/edits"
    for batch in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]):
        spark.createDataFrame(batch, "k long, v long, x string").write.mode("append").json(source)
        got = events.upserted(events.trace(spark, source, "k long, v long, x string"), folder, "k", "v")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, "c"), (2, 1, "b")]


def test_guards_stop_a_run(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, s string")
    held = spark.createDataFrame([("x",), (None,)], "h string")
    assert joins.asserted_apart(df, F.col("s"), held, F.col("h")).count() == 3 and joins.refused(df, "s", ["b"]).count() == 3
    with pytest.raises(Exception, match="held-out row"):
        joins.asserted_apart(df, F.col("s"), spark.createDataFrame([("c",)], "h string"), F.col("h")).collect()
    with pytest.raises(Exception, match="blocked data set"):
        joins.refused(df, "s", ["c"]).collect()

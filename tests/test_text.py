"""Normalisers, splitters and predicates on inline fixtures, Arabic ones included."""

import random

import pytest
from pyspark.sql import functions as F

from verbamill.functions import distance
from verbamill.functions import phonetics as H
from verbamill.functions import python_text as P
from verbamill.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (X.leaderboard, "a-b, c", "ab c"),
        (X.basic, "a-b, C", "a b c"),
        (X.leaderboard, "أحمد، ٣ مستشفى؟", "احمد 3 مستشفى"),
        (X.leaderboard, "پاراسيتامول مدرسة", "باراسيتامول مدرسة"),
        (X.script_aware, "مدرسةٌ أولى", "مدرسه اولي"),
        (X.aggressive, "البنادول ال", "بنادول ال"),
        (X.basic, None, ""),
        (X.dedup_key, "  A \t b ", "a b"),
        (X.alias_key, " A b ", "ab"),
        (X.compact, "azithro and-mycin", "azithromycin"),
        (X.split_scripts, "خذABCيوم 5يوم", "خذ ABC يوم 5يوم"),
        (X.strip_html, "<p>a&amp;b</p><script>x<y</script> c", "a&b c"),
        (X.clean_transcript, "See http://x.y/z <b>دواء</b>ABC ٥", "see دوا abc 5"),
        (X.consonants, "quetiapine", "ktbn"),
        (X.skeleton, "efferalgan", "frlgn"),
        (X.skeleton, "paracetamol", "brktml"),
        (X.skeleton, "appeal", "bl"),
        (X.vowels, "historie", "sssss"[:3]),
        (X.vowels, "hīstory", "ls"),
        (X.basic, "ＡＢＣ ﬁne ﻣﺮﺣﺒﺎ", "abc fine مرحبا"),
        (X.script_aware, "ﺃﻭﻟﻰ", "اولي"),
        (X.dedup_key, "Ａ  Ⅷ", "a viii"),
        (X.alias_key, "Ｒｅｄ Ring", "redring"),
        (X.clean_transcript, "ＡＢＣ &eacute; انشالله", "abc ان شاء الله"),
        (lambda c: X.clean_transcript(c, say_numbers=True), "خذ 500mg و ٢٥ حبة", "خذ خمسمايه مليغرام و خمسه و عشرون حبة"),
        (X.set_phrases, "انشالله ماشاءالله اللو", "ان شاء الله ما شاء الله الله"),
        (X.term_form, " Red\u200b  Ring ", "red ring"),
        (X.latin_of, "أَدْوِية", "adwyh"),
        (X.latin_of, "البنادول", "bnadwl"),
        (lambda c: X.latin_of(c, clitics=False), "ﺃ ئؤءى Ab1", "aywaab1"),
        (X.arabic_consonants, "hstwry", "stry"),
        (lambda c: X.consonants(c, merged=True), "diazepam", "tsbm"),
        (H.arabic_skeleton, "وَدوليبران", "dwlybran"),
        (H.arabic_skeleton, "أموكسيسيلين", "amwksysylyn"),
        (H.latin_skeleton, "Doxycycline phosph", "dokykykline fosf"),
        (lambda c: H.sound_classes(H.latin_skeleton(c)), "panadol", "BANATOL"),
        (X.latin_of, "هستوري", "hstwry"),
        (X.source_name, "/data/sada/train/", "train"),
        (X.source_name, "a/b/casablanca.jsonl", "casablanca"),
        (X.json_body, '```json\n{"a": {"b": 1}}\n```', '{"a": {"b": 1}}'),
    ],
)
def test_normal_forms(spark, f, given, expected):
    assert one(spark, f(F.lit(given))) == expected


def test_predicates(spark):
    assert one(spark, X.has_arabic(F.lit("abc"))) is False
    assert one(spark, X.is_code_switched(F.lit("خذ panadol"))) is True
    assert one(spark, X.latin_tokens(F.lit("the dose of a mg"), 2, ("the",))) == 3
    assert one(spark, X.broken_reference(F.lit("ال مريض"))) is True
    assert one(spark, X.length_outlier(F.lit(6), F.lit(0))) is True
    assert one(spark, X.chars_per_second(F.lit("a b c"), F.lit(0.0))) == float("inf")
    assert one(spark, X.strip_clitic(F.lit("وبنادول"))) == "بنادول"
    assert one(spark, X.strip_clitic(F.lit("ولد"))) == "ولد"


def test_splitters(spark):
    assert one(spark, X.sentences(F.lit("First one here. Tiny. Another one here!"))) == ["First one here.", "Another one here!"]
    assert one(spark, X.tokens(F.lit("Don't take 2.5 mg, خذ!"))) == ["don't", "take", "2.5", "mg", "خذ"]
    assert [tuple(t) for t in one(spark, X.offset_tokens(F.lit("  ab c")))] == [("ab", 2, 4), ("c", 5, 6)]
    assert one(spark, X.offset_tokens(F.lit(""))) == []
    assert one(spark, X.timestamp_seconds(F.lit("٠١:٣٠"))) == 90
    assert one(spark, X.timestamp_seconds(F.lit("x"))) is None
    assert one(spark, X.choice_letter(F.lit("Answer: (B)"), 4)) == 1


def test_resolve_takes_the_first_that_is_not_blank(spark):
    df = spark.createDataFrame([(" ", "x"), ("y", "z"), (None, None)], "text string, sentence string")
    assert [r[0] for r in df.select(X.resolve(df.columns, ["transcript", "text", "sentence"])).collect()] == ["x", "y", None]


def test_python_measures():
    assert P.jaro_winkler_of("abcd", "axyz") == pytest.approx(0.55)
    assert P.jaro_of("", "") == 1.0 and P.jaro_of("a", "") == 0.0
    assert P.indel_ratio_of("abc", "abd") == pytest.approx(4 / 6)
    assert H.class_similarity_of("BAT", "FAT") == pytest.approx(0.6 * (1 - 0.5 / 3) + 0.4 * P.jaro_winkler_of("BAT", "FAT"))
    assert H.class_similarity_of("", "B") == 0.0 and H.class_similarity_of("KAM", "KAM") == 1.0
    assert P.partial_ratio_of("ring", "a ring b") == 1.0
    assert P.folded_numbers_of("take twenty five mg and one hundred and two") == "take 25 mg and 102"
    assert P.word_operations_of("a b", "b") == {"substitutions": 0, "deletions": 1, "insertions": 0}
    assert P.diff_blocks_of("a b c", "a x c") == [{"start": 1, "end": 2, "old": "b", "new": "x"}]


def test_more_python_measures():
    assert P.joined_compounds_of("blood sugar high", "bloodsugar high") == {"ref": "bloodsugar high", "hyp": "bloodsugar high"}
    assert P.verbalised_of("take 125mg or 2.5 ml", {"mg": "milligrams"}) == "take one hundred twenty five milligrams or two point five ml"
    assert H.metaphone_of("phone") == H.metaphone_of("fone") == "FN" and H.metaphone_of("knight")[:1] == "N" and H.metaphone_of("dollprane") == H.metaphone_of("doliprane") == "TLPRN"
    assert H.composite_score_of("panadol", "panadol") == pytest.approx(100) and H.composite_score_of("panadol", "insulin") < 50
    assert H.composite_score_of("doll a brain", "doliprane") > H.composite_score_of("open", "openaisomething")
    assert H.merger_similarity_of("سداع", "صداع") == pytest.approx(1 - 1 / 12) and H.merger_similarity_of("ab", "ba") == pytest.approx(0.5) and H.merger_similarity_of("", "x") == 0
    assert H.skeleton_score_of("hstwry", "history") == pytest.approx(100 * 8 / 9, abs=30) and H.skeleton_score_of("aa", "b") == 0
    assert H.cross_script_score_of("hstwry", "history") >= 60 > H.cross_script_score_of("dktwr", "dextrose") and H.cross_script_score_of("sft", "saturation") == 0
    assert H.set_ratio_of("a b", "b a c") == 1.0 and H.sorted_ratio_of("b a", "a b") == 1.0 and H.set_ratio_of("a", "") == 0.0
    assert P.folded_numbers_of("خمسه و عشرين حبة واحد الف 5 12 34", P.arabic_number_of) == "25 حبة 1 1005 1234"
    assert [P.arabic_words_of(n) for n in (0, 7, 11, 20, 25, 100, 125, 1000, 3250)] == ["صفر", "سبعه", "احد عشر", "عشرون", "خمسه و عشرون", "مائه", "مائه و خمسه و عشرون", "الف", "ثلاثه الاف و مئتان و خمسون"]
    assert P.said_in_arabic_of("12345 2,5 ml") == " 12345   2.5 مليلتر "
    import numpy as np

    frames = np.log(np.array([[0.6, 0.4], [0.5, 0.5]]))
    assert np.exp(P.ctc_log_probability(frames, [1])) == pytest.approx(0.4 * 0.5 + 0.6 * 0.5 + 0.4 * 0.5)
    assert P.ctc_log_probability(frames, []) == P.ctc_log_probability(frames, [1, 1, 1]) == -1e9
    assert np.exp(2 * P.ctc_log_probability(np.log(np.array([[0.2, 0.5, 0.3], [0.1, 0.3, 0.6]])), [1, 2])) == pytest.approx(0.5 * 0.6)


def test_predicates_of_spans_and_words(spark):
    rows = [("the ring", 0, True), ("ring", 0, False), ("bp", 0, True), ("aws", 0, False), ("a w s", 0, False), ("red. Ring", 0, True), ("...", 0, True), ("دواء الصداع", 2, True), ("دواء بنادول", 1, False), ("دواء a b c", 0, True), ("next", 0, True)]
    df = spark.createDataFrame(rows, "t string, f int, want boolean").withColumn("got", H.bad_span(F.col("t"), F.col("f"), ("aws",)))
    assert [(r["t"], r["got"]) for r in df.collect()] == [(t, w) for t, _, w in rows]
    words = [("في", True), ("", True), ("،من.", True), ("الصداع", True), ("صداع", True), ("دوا", False), ("بنادول", False)]
    df = spark.createDataFrame(words, "w string, want boolean").withColumn("got", H.is_filler("w", ("في", "من"), ("صداع",)))
    assert [(r["w"], r["got"]) for r in df.collect()] == words
    scores = [("كتب", 0.9), ("يكتبون", 1.0), ("بنادولات", 1.0), ("مرضقطع", 0.6), ("بريلوستكزمقط", 0.2), ("abc", 0.0), ("و", 1.0), ("", 0.0)]
    df = spark.createDataFrame(scores, "w string, want double").withColumn("got", H.plausibility("w"))
    assert {r["w"]: r["got"] for r in df.collect()} == pytest.approx(dict(scores))
    assert one(spark, X.is_term(F.lit("a-b (c)"))) and not one(spark, X.is_term(F.lit("a"))) and not one(spark, X.is_term(F.lit("naïve")))


def test_spelled_codes(spark):
    assert one(spark, X.spelled_codes(F.lit("code a b-1 2 then x y"))) == ["ab12"]


def test_word_edits_of_many_distinct_words(spark):
    a, b = [f"w{k}" for k in range(60_000)], [f"w{k}" for k in range(60_000) if k % 10_000]
    rows = spark.createDataFrame([(a[:1500], b[:1500]), (a[:3], []), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(distance.word_edits(F.col("a"), F.col("b"))).collect()] == [P.edits_of(a[:1500], b[:1500]), 3, 0]
    far = spark.createDataFrame([(a[55_000:55_400] + a[:50], a[:55_000])], "a array<string>, known array<string>")
    codes = far.select(F.length(distance._coded(F.col("a"), F.concat("known", "a"))), F.size(F.array_distinct(F.split(distance._coded(F.col("a"), F.concat("known", "a")), "")))).first()
    assert codes[0] == 450 and codes[1] == 450  # beyond the surrogates too, one character each
    assert P.edits_of(a, b) == 6


def test_edits_as_bits_match_the_table():
    rng = random.Random(5)
    for _ in range(400):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row = row, [i]
            for j, q in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != q)))
        assert P.edits_of(x, y) == row[-1]

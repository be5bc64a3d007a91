"""Exact search and near duplicates against brute force."""

import math
import random

import numpy as np
import pytest

from tests_llm_plain import linked, shingles
from verbamill.llm import exact_topk, neardup


def test_bit_sliced_search(spark):
    random.seed(2)
    rows = [(i, [random.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(9001, None), (9002, [float("nan")] * 8), (9003, [None, *[0.5] * 7]), (None, rows[0][1]), (9004, [float("inf")] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "x")
    got = {}
    for r in exact_topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows[:420]}
    assert set(got) == {i for i in good if i % 50 == 0}
    for q, found in got.items():
        best = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q)[:5]
        assert sorted(found) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


def test_search_of_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(one, one).count() == 0
    none = one.filter("vec_id < 0")
    assert exact_topk.top_k(none, none).count() == 0


def test_search_of_large_components_and_other_lengths(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e8, -3e8, 2.0**40, -1e-3, 0.5, 0.0]) * rng.random() for _ in range(4)]) for i in range(120)]
    odd = [(500, [1.0] * 3), (501, [1.0] * 9), (502, [1e300] * 4), (503, []), (50, rows[50][1])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in exact_topk.top_k(vectors, vectors.filter("vec_id % 50 = 0").dropDuplicates(["vec_id"])).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows + odd[-1:]]
    assert set(got) == {0, 50, 100}
    for q, found in got.items():
        query = dict(good)[q]
        best = sorted((-sum(a * b for a, b in zip(v, query)), i) for i, v in good if i != q)[:5]
        assert sorted(found) == [(k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best, 1)]


def test_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    monkeypatch.setattr(exact_topk, "QUERIES", 3)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(1000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()}
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = {}
    for q in range(0, 1000, 50):
        best = sorted((-sum(a * b for a, b in zip(v, good[q])), i) for i, v in good.items() if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want


def brute(texts, words, percent):
    return [(len(shingles(t, words)), k) for t, k in zip(texts, linked(texts, words, percent))]


@pytest.mark.parametrize("words", [4, 5])
def test_near_copies(docs_of, hard, words):
    random.seed(words)
    texts = list(hard)
    for size in (3, 12, 40, 120):  # families whose similarity runs through the threshold
        base = [f"w{random.randint(0, 500)}" for _ in range(size)]
        for k in range(25):
            copy = list(base)
            for _ in range(k % 6):
                copy[random.randrange(size)] = f"v{random.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    texts += [texts[30]] * 60 + [" ".join(f"u{random.randint(0, 10**6)}" for _ in range(30)) for _ in range(40)]
    got = neardup.near_duplicates(docs_of(texts), words=words).collect()
    want = brute(texts, words, 80)
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])


def test_null_and_repeated_ids(docs_of):
    rows = neardup.near_duplicates(docs_of(["a b c d e f", "a b c d e f", "a b c d e f", "x"], ids=[None, 5, 5, 2])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [(2, 2, True), (5, 5, True), (5, 5, True)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert neardup.near_duplicates(docs_of([])).count() == 0


def test_versions_of_an_id_keep_their_links(docs_of):
    one, two = ([f"{x}{k}" for k in range(60)] for x in "uv")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = neardup.near_duplicates(docs_of([" ".join(one), " ".join(two), near(one), near(two), "x y z"], ids=[5, 5, 7, 9, 3])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_every_coordinate_fills_and_estimates():
    random.seed(1)
    for n in (1, 3, 50, 2000):
        a = np.unique(np.array([random.getrandbits(64) for _ in range(n)], np.uint64))
        assert (neardup.sketch(a) == neardup.sketch(a)).all() and len(neardup.bands(neardup.sketch(a))) == neardup.BANDS
    base = np.array([random.getrandbits(64) for _ in range(1100)], np.uint64)
    a, b = np.unique(base[:1000]), np.unique(base[100:])
    assert abs((neardup.sketch(a) == neardup.sketch(b)).mean() - 900 / 1100) < 0.08


@pytest.mark.parametrize("met", [False, True])
def test_pairs_are_left_only_to_bands_where_they_met(spark, met):
    """Two sets whose marks agree throughout meet in band 1; only equal hashes of band 0 would have settled them there."""
    marks, shingles = bytes(2 * neardup.COORDINATES), list(range(100))
    first = [7, 7 if met else 8]
    sets = [(i, shingles, bytearray(marks), bytearray(np.array([first[i], *range(1, neardup.BANDS)], "<u8").tobytes())) for i in (0, 1)]
    sets = spark.createDataFrame(sets, "node long, shingles array<long>, marks binary, bands binary")
    members = spark.createDataFrame([(1, 1, i, i) for i in (0, 1)], "band int, key long, node long, component long")
    assert [tuple(sorted(r)) for r in neardup.settle(members, sets, 80).collect()] == ([] if met else [(0, 1)])

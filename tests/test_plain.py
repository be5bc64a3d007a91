"""Queries that no SQL expresses, against plain versions over the smallest tables."""

import difflib
import hashlib
import html
import os
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from verbamill.functions import phonetics, python_text
from verbamill.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    return [r.asDict(recursive=True) for r in registry.queries()[name](spark, SF).collect()]


def edits(a, b):
    """The whole table, a row at a time."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in s], int) for s in (a, b))
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for k, w in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(np.concatenate([[k], best]) - steps) + steps
    return int(row[-1])


def plain_words(text):
    t = unicodedata.normalize("NFKC", text or "")
    t = re.sub("[ً-ٰٟـ]", "", t).lower()
    return "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" or c.isspace() else " " for c in t).split()


def test_document_wer_by_lang(spark):
    docs = {r["doc_id"]: r for r in rows_of("documents")}
    want = defaultdict(lambda: [0, 0, 0])
    for i, r in docs.items():
        if i + 1 in docs and (ref := plain_words(r["text"])):
            w = want[r["lang"]]
            w[0], w[1], w[2] = w[0] + 1, w[1] + edits(ref, plain_words(docs[i + 1]["text"])), w[2] + len(ref)
    assert {r["lang"]: [r["clips"], r["edits"], r["ref_words"]] for r in run(spark, "document_wer_by_lang")} == dict(want)


def clips():
    part = {r["p_partkey"]: r for r in rows_of("part")}
    told = {k: f"{r['p_name']} {r['p_type']} {r['p_brand'].replace('#', ' ')}" for k, r in part.items()}
    return [(part[k]["p_type"], told[k].split(), told[k + 1].split()) for k in part if k + 1 in part]


def test_word_operations(spark):
    want = defaultdict(Counter)
    for category, r, h in clips():
        want[category]["n"] += edits(r, h)
        want[category]["growth"] += len(h) - len(r)
    for r in run(spark, "word_operations"):
        assert r["substitutions"] + r["deletions"] + r["insertions"] == want[r["category"]]["n"] and r["insertions"] - r["deletions"] == want[r["category"]]["growth"]


def test_turn_differences(spark):
    turns = {(r["conv_id"], r["turn"]): r["text"].split() for r in rows_of("conversations")}
    blocks = defaultdict(list)
    for r in run(spark, "turn_differences"):
        blocks[r["conv_id"], r["turn"]].append(r)
    for (conv, turn), new in turns.items():
        if (old := turns.get((conv, turn - 1))) is None:
            continue
        out, at = [], 0
        for b in sorted(blocks[conv, turn], key=lambda b: (b["start"], b["end"])):
            assert old[b["start"] : b["end"]] == b["old"].split()
            out += old[at : b["start"]] + b["new"].split()
            at = b["end"]
        assert out + old[at:] == new


def test_html_unescaped(spark):
    letters = str.maketrans("أإآٱىؤئ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "اااايوي01234567890123456789", "ء")

    def clean(t):
        t = unicodedata.normalize("NFKC", html.unescape(t or ""))
        t = re.sub(r"(?i)https?://[^ \t\n\x0b\f\r]+|www\.[^ \t\n\x0b\f\r]+", " ", t)
        t = re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", re.sub(r"<[^>]+>", " ", t))
        t = re.sub("[ؐ-ًؚ-ٰٟۖ-ۭـ]", "", t).translate(letters)
        return re.sub(r"\s+", " ", re.sub(r"[^0-9A-Za-z\s؀-ۿ]", " ", t.lower())).strip()

    want = {r["page_id"]: len(clean(r["html"])) for r in rows_of("pages")}
    assert {r["page_id"]: r["chars"] for r in run(spark, "html_unescaped")} == want


def test_compounds_joined(spark):
    for r in run(spark, "compounds_joined"):
        assert r["ref"] == r["hyp"] or difflib.SequenceMatcher(None, r["ref"].split(), r["hyp"].split()).ratio() < 1


def test_capped_draw(spark):
    got = defaultdict(set)
    for r in run(spark, "capped_draw"):
        got[r["source"]].add(r["doc_id"])
    by = defaultdict(list)
    for r in rows_of("documents"):
        by[r["source"]].append(r)
    for source, rows in by.items():
        want, have, kept = sum(r["n_chars"] or 0 for r in rows) * 0.1, 0, set()
        for r in sorted(rows, key=lambda r: (hashlib.md5(f"7{r['doc_id']}".encode()).hexdigest(), r["doc_id"])):
            if have >= want:
                break
            if have + r["n_chars"] <= 1.05 * want:
                have += r["n_chars"]
                kept.add(r["doc_id"])
        assert got[source] == kept


def test_spans_selected(spark):
    first = min(r["ts"] for r in rows_of("events")).replace(year=2024, month=1, day=1, hour=0, minute=0, second=0, microsecond=0)
    by = defaultdict(list)
    for r in rows_of("events"):
        a = int((r["ts"] - first).total_seconds())
        by[r["user_id"]].append((-r["value"], a, int(r["value"] * 60 // 1), r["event_id"], r["value"]))
    want = set()
    for spans in by.values():
        taken = []
        for _, a, n, i, v in sorted(spans):
            b = a + n
            hit = [t for t in taken if t[0] < b and a < t[1]]
            if not hit or (all(a <= t[0] and t[1] <= b for t in hit) and v > max(t[2] for t in hit) + 5.0):
                taken = [t for t in taken if t not in hit] + [(a, b, v, i)]
        want |= {t[3] for t in taken}
    assert {r["event_id"] for r in run(spark, "spans_selected")} == want


def names():
    return sorted({r["p_name"] for r in rows_of("part")})


def test_composite_scores(spark):
    got = defaultdict(list)
    for r in run(spark, "composite_scores"):
        got[r["term"]].append((r["rank"], r["other"], round(r["score"], 9)))
    for term in names():
        found = sorted((-phonetics.composite_score_of(term, o), o) for o in names() if o != term and min(len(o), len(term)) >= 0.5 * max(len(o), len(term)))[:3]
        assert sorted(got[term]) == [(k, o, round(-s, 9)) for k, (s, o) in enumerate(found, 1)]


def test_phonetic_scores(spark):
    for r in run(spark, "phonetic_scores"):
        a, b = r["term"], r["other"]
        both = {a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1)} & {b[i:j] for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        assert r["shared"] == max(map(len, both), default=0) and r["prefix"] == len(os.path.commonprefix([a, b]))
        kept = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert 2 * kept / (len(a) + len(b)) - 1e-9 <= r["ratio"] <= r["partial"] + 1e-9 or r["ratio"] <= 1
        assert r["skeleton"] == pytest.approx(phonetics.skeleton_score_of(a, b)) and 0 <= r["blend"] <= 1 and r["jaro_winkler"] == pytest.approx(python_text.jaro_winkler_of(a, b))


def test_cross_script_matches(spark):
    best = {r["arabic"]: r["other"] for r in run(spark, "cross_script_matches") if r["rank"] == 1}
    arabic = {t: t.lower().translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "ابكديفغهيجكلمنوبقرستوفوسيز")) for t in names()}
    assert set(best) <= set(arabic.values()) and np.mean([best.get(a) == t for t, a in arabic.items()]) > 0.6


def test_merger_corrections(spark):
    letters = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ابكديفغهيجكلمنوبقرستوفوسيز")
    known = {w for t in names() for w in t.lower().translate(letters).split()}
    for r in run(spark, "merger_corrections"):
        assert r["word"] not in known and r["term"] in known and edits(r["word"], r["term"]) <= 1 and r["confidence"] >= (0.75 if len(r["word"]) <= 5 else 0.6)


def test_group_split(spark):
    groups = defaultdict(set)
    for r in run(spark, "group_split"):
        keys = [v for k, v in sorted(r.items()) if k != "split"]
        groups[tuple(map(str, keys))].add(r["split"])
    assert groups and all(len(x) == 1 for x in groups.values()) and len({next(iter(x)) for x in groups.values()}) >= 2


def test_logistic_calibration(spark):
    rows = run(spark, "logistic_calibration")
    right, wrong = ([r["confidence"] for r in rows if r["gold"] == y] for y in (1, 0))
    assert all(0 <= r["confidence"] <= 1 for r in rows) and (not right or min(right) > np.mean(wrong))


def test_weighted_draws(spark):
    import struct

    import xxhash

    rows = sorted((r["doc_id"], r["n_chars"]) for r in rows_of("documents") if (r["n_chars"] or 0) > 0)
    buckets = defaultdict(list)
    for i, w in rows:
        buckets[xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() % 1024 if xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() < 2**63 else (xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() - 2**64) % 1024].append((i, w))
    line = [(i, w) for b in sorted(buckets) for i, w in buckets[b]]
    ends = np.cumsum([w for _, w in line])
    got = {r["draw"]: r["id"] for r in run(spark, "weighted_draws")}
    for d in range(1000):
        u = int(hashlib.md5(f"7{d}".encode()).hexdigest()[:12], 16) / 2.0**48
        assert got[d] == line[int(np.searchsorted(ends, u * ends[-1], "right"))][0]

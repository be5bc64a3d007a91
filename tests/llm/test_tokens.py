"""Token counts, byte-level BPE and packing against the libraries, on hard texts."""

import hashlib
import os
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from verbamill.llm import bpe, packing, token_counts
from verbamill.llm.ragged import Ragged

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(hard):
    random.seed(3)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "123", "é", "!!", "aaa", "日本", "\x1c", "\xa0", " ", "'", "<|endoftext|>"]
    return hard + ["".join(random.choice(parts) for _ in range(random.randint(0, 60))) for _ in range(300)]


def test_token_counts(docs_of, texts):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs_of(texts)).collect()}
    assert got == {i: (len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}


def test_rare_pretokens_are_joined(docs_of, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "frequent_band", lambda v: 1 << 30)  # none is frequent
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs_of(texts)).collect()}
    assert got == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_byte_bpe_round_trip(docs_of, texts):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_documents(docs_of(texts)).collect():
        text = texts[r["doc_id"]] or ""
        ids = np.array(own.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r["ids"]) == ids and r["n_tokens"] == len(ids) // 4
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_merge_replay_matches_one_by_one():
    replay = bpe.replay_of(P.path("byte_bpe_50k.tiktoken"))
    random.seed(5)
    words = [bytes(random.choice(b"aabt he\xc3\xa9") for _ in range(random.randint(1, 30))) for _ in range(500)]
    found = replay.encode(Ragged.of(words, np.uint8))
    assert [found.run(k).tolist() for k in range(len(words))] == [replay.one_by_one(w) for w in words]
    own = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=replay.ranks, special_tokens={})
    assert [replay.one_by_one(w) for w in words if w not in replay.ranks] == [own._encode_single_piece(w) for w in words if w not in replay.ranks]


def test_a_long_word_takes_no_quadratic_time():
    replay, word = bpe.replay_of(P.path("byte_bpe_50k.tiktoken")), bytes(random.Random(1).choice(b"abcdefgh") for _ in range(200_000))
    began = time.perf_counter()
    assert bytes().join(replay.names[k] for k in replay.one_by_one(word)) == word and time.perf_counter() - began < 20


SCRIPTS = ["abcdefghij ABC", "éàüßñçÉÀÜ  ", "абвгд жзи", "العربية  ", "日本語テキスト", "😀🎉 ‍️", "0123456789 ", ".,;:!?-_'\"()[]{}#$%&*+/<=>@\\^`|~", "\t\n\r\x0b\x0c\x1c\x85\xa0\u2003 ", "the and ing tion 's 'll "]


def mixed_texts(n):
    rng = random.Random(11)
    return ["".join(rng.choice(rng.choice(SCRIPTS)) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def all_texts():
    if not os.path.isdir(SF):
        return mixed_texts(6000)
    return mixed_texts(6000) + pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()


def test_packed_ids_equal_the_library_on_documents_and_mixed_scripts():
    texts, whole = all_texts(), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    found = packing.PartTokenizer(P.path("word_bpe_49k.json")).encode(texts)
    want = whole.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert all(found.run(k).tolist() == w.ids for k, w in enumerate(want))


def test_byte_ids_equal_the_library_on_documents_and_mixed_scripts():
    texts = all_texts()
    encoder = bpe.BlockEncoder(P.path("byte_bpe_50k.tiktoken"), (pa.array([" the"]), Ragged.of([[bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))[b" the"]]], np.uint32)))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.vocabulary.replay.ranks, special_tokens={})
    found = encoder.encode(texts)
    assert all(found.run(k).tolist() == own.encode_ordinary(t or "") and encoder.vocabulary.decode(found.run(k)).decode() == (t or "") for k, t in enumerate(texts))


def test_packing(docs_of, texts):
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(docs_of(texts)).collect()
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    covered, laid = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]].append((r["start"], r["length"]))
        laid[r["sequence_id"]].append((r["offset"], r["length"]))
    for found, total in [(sorted(covered[i]), len(x)) for i, x in ids.items()]:
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(n for _, n in found) == total
    for found in laid.values():
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(n for _, n in found) <= 4096


@pytest.mark.parametrize("seed", range(20))
def test_fill_comes_as_close_as_any(seed):
    random.seed(seed)
    counts, room = {random.randint(1, 40): random.randint(1, 4) for _ in range(6)}, random.randint(5, 90)
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1)}
    chosen = packing.fill(counts, room)
    assert all(n <= counts[x] for x, n in chosen.items()) and sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece():
    random.seed(1)
    histogram: dict = {}
    for _ in range(20_000):
        x = 1 + int(random.expovariate(1 / 700)) % 4095
        histogram[x] = histogram.get(x, 0) + 1
    used: dict = {}
    windows = packing.plan(histogram)
    for chosen, times in windows:
        assert sum(x * n for x, n in chosen.items()) <= 4096
        for x, n in chosen.items():
            used[x] = used.get(x, 0) + n * times
    assert used == histogram
    total = sum(x * n for x, n in histogram.items())
    assert sum(t for _, t in windows) <= -(-total // 4096) * 1.005 + 1


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert token_counts.token_counts(empty).count() == 0 and bpe.encode_documents(empty).count() == 0 and packing.pack(empty).count() == 0

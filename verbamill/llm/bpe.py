"""Byte-level BPE encoding and decoding by merge replay.

The merges are replayed over distinct pre-tokens in bulk: an index from each merged pair to the positions where it
stands is worked off in rank order, and a merge touches only the pairs with its two neighbours. The frequent
pre-tokens of the whole corpus (at most MOST_FREQUENT) are replayed once, and their ids go to every task. Rarer ones
are replayed by the same function in each slice of documents where they stand (SLICE_BYTES of text), so that no text
is shuffled: to bring ids that a join finds back to their places would shuffle every document.

Null and empty texts have no ids and the digests of no bytes, and an empty table gives no rows; a very long text is a
slice of its own. Repeated rows each give a row, null ids stay null. Other columns, whatever their names, are not read."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, written
from .ragged import Ragged, bytes_of, slices
from .vocabulary import Pretokens, distinct_parts, frequent_band, is_frequent, pretoken_counts


def load_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Ids of many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.names = {v: k for k, v in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.last_ids = self.byte_ids
        self.index_pairs({ranks[w[:k]] << 17 | ranks[w[k:]]: r for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks})

    def index_pairs(self, found: dict[int, int]) -> None:
        """found: for every pair of tokens that has a merge, the merge's id, which is also its rank."""
        self.found = found
        self.keys = np.sort(np.fromiter(found, np.int64, len(found)))
        self.merges = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, -1 where there is none."""
        key = left << 17 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merges[at], -1)

    def one_by_one(self, word: bytes) -> list[int]:
        """The merges of a single word, lowest rank first and leftmost first: a heap of pairs over linked tokens."""
        raw = np.frombuffer(word, np.uint8)
        ids = [*self.byte_ids[raw[:-1]].tolist(), int(self.last_ids[raw[-1]])]
        n, rank_of = len(ids), self.found.get
        after, before = [*range(1, n), None], [None, *range(n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := rank_of(ids[k] << 17 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            q = after[k]
            if ids[k] is None or q is None or rank_of(ids[k] << 17 | ids[q]) != rank:
                continue  # one of the two has been merged since
            r = after[q]
            ids[k], ids[q], after[k] = rank, None, r
            if r is not None:
                before[r] = k
                if (x := rank_of(rank << 17 | ids[r])) is not None:
                    heapq.heappush(heap, (x, k))
            if (p := before[k]) is not None and (x := rank_of(ids[p] << 17 | rank)) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in ids if x is not None]

    def encode(self, words: Ragged) -> Ragged:
        """Ids of words, none of them empty, by merges alone."""
        sizes, ends, n = words.sizes, words.sizes.cumsum(), len(words.values)
        if not n:
            return Ragged(np.zeros(0, np.uint32), sizes)
        # position n stands for "none" on either side; no pair with it has a merge
        token = np.append(self.byte_ids[words.values], (1 << 17) - 1)
        token[ends - 1] = self.last_ids[words.values[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], after[n] = n, n
        before[ends - sizes], before[n] = n, n
        alive = np.ones(n, bool)
        where = np.append(self.pair_ranks(token[:-1], token[after[:-1]]), -1)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = where[places]
            order = ranks.argsort(kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for k, rank in enumerate(ranks[cuts[:-1]].tolist()):
                some = places[cuts[k] : cuts[k + 1]]
                if rank in index:
                    index[rank].append(some)
                else:
                    index[rank] = [some]
                    heapq.heappush(queue, rank)

        if len(places := np.flatnonzero(where >= 0)):
            enter(places)
        odd: set[int] = set()
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            p = np.sort(np.concatenate(places)) if len(places) > 1 else places[0]
            p = p[where[p] == rank]
            if len(p) > 1:
                if len(places) > 1:
                    p = p[np.append(True, p[1:] != p[:-1])]
                # of pairs that overlap, the leftmost goes first, so every other one of a run
                joined = np.append(False, after[p[:-1]] == p[1:])
                if joined.any():
                    k = np.arange(len(p))
                    p = p[(k - np.maximum.accumulate(np.where(joined, 0, k))) % 2 == 0]
            if not len(p):
                continue
            q = after[p]
            r = after[q]
            token[p], where[q], alive[q] = rank, -1, False
            after[p], before[r] = r, p
            left = before[p]
            touched = np.concatenate([p, left[left < n]])
            where[touched] = new = self.pair_ranks(token[touched], token[after[touched]])
            where[n] = -1
            if (sooner := (new >= 0) & (new < rank)).any():  # bulk order would differ from rank order in these words
                odd.update(np.searchsorted(ends, touched[sooner], "right").tolist())
            if len(touched := touched[new >= 0]):
                enter(touched)
        out = Ragged(token[:n][alive].astype(np.uint32), np.add.reduceat(alive, ends - sizes, dtype=np.int64))
        if not odd:
            return out
        again = sorted(odd)
        others = Ragged.of([self.one_by_one(words.run(k).tobytes()) for k in again], np.uint32)
        codes = np.arange(len(sizes))
        codes[again] = len(sizes) + np.arange(len(again))
        return Ragged.joined([out, others]).take(codes)


@functools.lru_cache(2)
def replay_of(rank_file: str) -> MergeReplay:
    """One for each Python worker, which serves many tasks."""
    return MergeReplay(load_ranks(rank_file))


class Vocabulary:
    """Ids of pre-tokens: of those that are tokens themselves their own, of others by a replay of the merges."""

    def __init__(self, rank_file: str):
        self.replay = replay_of(rank_file)
        names = self.replay.names
        self.tokens = pa.array(list(self.replay.ranks), pa.binary())
        self.token_ids = np.fromiter(self.replay.ranks.values(), np.uint32, len(names))
        self.names = Ragged.of([names.get(k, b"") for k in range(max(names) + 1)], np.uint8)

    def encode(self, pretokens: pa.Array) -> Ragged:
        """pretokens: distinct strings, none empty."""
        own = pc.index_in(pretokens.cast(pa.binary()), value_set=self.tokens)
        whole = pc.is_valid(own).to_numpy(zero_copy_only=False)
        codes, n = np.empty(len(whole), np.int64), int(whole.sum())
        codes[whole], codes[~whole] = np.arange(n), np.arange(n, len(whole))
        tokens = Ragged(self.token_ids[own.drop_null().to_numpy()], np.ones(n, np.int64))
        rest = self.replay.encode(bytes_of(pretokens.filter(pa.array(~whole))))
        return Ragged.joined([tokens, rest]).take(codes)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return self.names.take(ids).values.tobytes()


@functools.lru_cache(2)
def vocabulary_of(rank_file: str) -> Vocabulary:
    """One for each Python worker, which serves many tasks."""
    return Vocabulary(rank_file)


def pretoken_ids(vocabulary: DataFrame, rank_file: str) -> DataFrame:
    """(pretoken, freq, ids): ids as little-endian unsigned 32-bit integers; merges are replayed over a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(rank_file)
        for part in slices(batches, "pretoken"):
            ids = words.encode(part.column(0))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([ids.run(k).astype("<u4").tobytes() for k in range(part.num_rows)], pa.binary())], ["pretoken", "freq", "ids"])

    return in_arrow(vocabulary.select("pretoken", "freq"), run, "pretoken string, freq long, ids binary")


class BlockEncoder:
    """Ids of whole texts, a block of them at a time; frequent: pre-tokens and their ids."""

    def __init__(self, rank_file: str, frequent: tuple[pa.Array, Ragged]):
        self.vocabulary, (self.frequent, self.frequent_ids), self.pretokens = vocabulary_of(rank_file), frequent, Pretokens()

    def part_ids(self, parts: pa.Array) -> Ragged:
        words, runs = self.pretokens.split(parts)
        known = pc.index_in(words, value_set=self.frequent)
        rare = pc.is_null(known).to_numpy(zero_copy_only=False)
        where = np.empty(len(rare), np.int64)
        where[~rare] = known.drop_null().to_numpy()
        where[rare] = len(self.frequent) + np.arange(int(rare.sum()))
        table = Ragged.joined([self.frequent_ids, self.vocabulary.encode(words.filter(pa.array(rare)))])
        return table.take(where[runs.values]).regrouped(runs.sizes)

    def encode(self, texts: list[str | None]) -> Ragged:
        """A run of ids for each text."""
        parts, codes, counts = distinct_parts(texts)
        return self.part_ids(parts).take(codes).regrouped(counts)


def encode_documents(docs: DataFrame, rank_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids binary]): the ids of each text, and the digest of the bytes
    that decoding them gives."""
    spark = docs.sparkSession
    rank_file = rank_file or path("byte_bpe_50k.tiktoken")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = written(pretoken_counts(docs.select("text")), "pretokens")
    lowest = frequent_band(vocabulary)
    found = pretoken_ids(vocabulary.filter(is_frequent(lowest)), rank_file).select("pretoken", "ids").collect()
    known = pa.array([r[0] for r in found], pa.string()), Ragged(np.frombuffer(b"".join(bytes(r[1]) for r in found), "<u4"), np.array([len(r[1]) // 4 for r in found], np.int64))
    frequent = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder(rank_file, frequent.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in slices(batches, "text"):
            found = encoder.encode(part.column("text").to_pylist())
            packed = [found.run(k).astype("<u4").tobytes() for k in range(part.num_rows)]
            columns = [part.column("doc_id"), pa.array(found.sizes), pa.array([sha(x) for x in packed], pa.string()), pa.array([sha(encoder.vocabulary.decode(found.run(k))) for k in range(part.num_rows)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(packed, pa.binary())] * ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return in_arrow(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids).withColumnRenamed("doc_id", id_col)

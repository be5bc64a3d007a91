"""Packing of tokenised documents into sequences of a fixed capacity by minimum bin slack.

A document's tokens are cut at every `capacity` ids from its start; its whole windows are sequences of their own, and
what remains is shorter than a window. How many remainders there are of each length is at most capacity - 1 counts, so
the plan is made on the driver whatever the corpus holds: each step takes the longest remainder left and, by
subset-sum over a bitset of reachable sums, the multiset of others that fills the window closest to its capacity;
that multiset is used as often as the counts allow. Pieces then find their places from their rank among the pieces of
their length, which needs no pass over them in order and no group.

Null and empty texts are a document of the end id alone; a very long text is a slice of its own, and many windows.
Repeated rows are packed as documents of their own, null ids stay null, and an empty table gives no rows. Pieces of
equal length take places in order of their task and row. Other columns, whatever their names, are not read."""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import path
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import MergeReplay
from .common import in_arrow, written
from .ragged import Ragged, bytes_of, slices

CAPACITY, END_ID = 4096, 2
#: Latin-1 by kind: full stops and commas, letters with digits and white space, other marks.
_KINDS = bytes(ord(",") if chr(b) in ".," else ord("a") if chr(b).isalnum() or chr(b) in " \t\n\r\x0b\x0c\x85\xa0" else ord("!") for b in range(256))


def simplified(text: str) -> str:
    """The text with fewer distinct parts, and the same tokens: lower case, full stops and commas set apart. Texts
    beyond Latin-1, in which lower case and normal form are the characters' own, and texts that may hold a special
    token stay as they are."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return text
    if "<|" in text:
        return text
    text = text.lower()
    if b",," in kinds or b"!," in kinds or b",!" in kinds:  # beside another mark they may be one token with it
        return text
    return text.replace(",", " , ").replace(".", " . ")


class WordReplay(MergeReplay):
    """The merges of a vocabulary whose words end in a mark of their own, for words alone."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, vocabulary, merges = model["end_of_word_suffix"], model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # bytes that print stand for themselves in the file, others for the code points from 256 on
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        char = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.ranks: dict[bytes, int] = {}
        self.byte_ids = np.array([vocabulary[char[b]] for b in range(256)], np.int64)
        self.last_ids = np.array([vocabulary[char[b] + end] for b in range(256)], np.int64)
        made = [vocabulary[a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("ids of merges must rise with their rank")
        self.index_pairs({vocabulary[a] << 17 | vocabulary[b]: i for (a, b), i in zip(merges, made)})


@functools.lru_cache(2)
def word_replay_of(tokenizer_file: str) -> WordReplay:
    return WordReplay(tokenizer_file)


#: A word of Latin letters that no normal form changes, and marks after it that are tokens apart from it.
_PLAIN = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"


class PartTokenizer:
    """Ids of whole texts, a block of them at a time. The vocabulary drops white space and joins nothing across it, so
    each distinct part between spaces is encoded once: plain words by a replay of the merges over all of them, marks
    and anything else by the library itself."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.replay = Tokenizer.from_file(tokenizer_file), word_replay_of(tokenizer_file)

    def by_library(self, parts: pa.Array) -> Ragged:
        found = self.tokenizer.encode_batch_fast(parts.to_pylist(), add_special_tokens=False) if len(parts) else []
        return Ragged.of([x.ids for x in found], np.uint32)

    def part_ids(self, parts: pa.Array) -> Ragged:
        split = pc.extract_regex(parts, _PLAIN)
        plain = pc.is_valid(split)
        whole = split.drop_null()
        words, marks = pc.utf8_lower(pc.struct_field(whole, "word")).dictionary_encode(), pc.struct_field(whole, "marks").dictionary_encode()
        rest = self.by_library(parts.filter(pc.invert(plain)))
        table = [self.replay.encode(bytes_of(words.dictionary)), self.by_library(marks.dictionary), rest, Ragged(np.zeros(0, np.uint32), np.zeros(1, np.int64))]
        ends = np.cumsum([len(x.sizes) for x in table])
        plain = plain.to_numpy(zero_copy_only=False)
        codes = np.empty((len(parts), 2), np.int64)
        codes[plain, 0], codes[plain, 1] = words.indices.to_numpy(), ends[0] + marks.indices.to_numpy()
        codes[~plain, 0], codes[~plain, 1] = np.arange(ends[1], ends[2]), ends[2]
        return Ragged.joined(table).take(codes.ravel()).regrouped(np.full(len(parts), 2))

    def encode(self, texts: list[str | None]) -> Ragged:
        """A run of ids for each text."""
        cut = pc.split_pattern(pa.array([simplified(x).replace("\n", " ") if x else "" for x in texts], pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        return self.part_ids(coded.dictionary).take(coded.indices.to_numpy()).regrouped(cut.value_lengths().to_numpy())


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, nth, doc_id, start, length, ids_crc32, doc_tokens): each document cut at multiples of the capacity.
    nth counts the pieces of a length within a block, which is what one task read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        tokenizer, end = PartTokenizer(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "text"):
            out, found = [], tokenizer.encode(part.column("text").to_pylist())
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                ids = found.run(k).astype("<u4").tobytes() + end
                total, view = len(ids) // 4, memoryview(ids)
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    out.append((seen[length], doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*out))], ["block", "nth", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(rows, run, "block int, nth long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum comes closest to room without passing it; longer ones
    are tried first. Reachable sums are the bits of one integer; the copies of a length go in by powers of two."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            some = min(copies, left)
            steps.append((length, some, reach))
            reach |= (reach << (length * some)) & full
            left, copies = left - some, copies * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> at & 1:  # this sum was first reached by these copies
            chosen[length] = chosen.get(length, 0) + some
            at -= length * some
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(multiset of lengths, how many windows it fills)] that uses every piece of the histogram once."""
    left, out = dict(histogram), []
    while left:
        longest = max(left)
        others = left | {longest: left[longest] - 1}
        chosen = fill(others, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        out.append((chosen, times))
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


#: In a lookup key, the length stands above the rank.
RANKS = 1 << 48


def places(windows: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Arrays sorted by key = length * RANKS + first rank: for the ranks from there on, the first window, the copies
    of the length in a window, and the offset of the first copy."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for chosen, times in windows:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            first = used.get(length, 0)
            rows.append((length * RANKS + first, window, n, offset))
            used[length] = first + n * times
            offset += n * length
        window += times
    rows.sort()
    return dict(zip(("key", "window", "copies", "offset"), (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4))


def pack(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_file or path("word_bpe_49k.json"), capacity, end_id, id_col, text_col), "pieces")
    sizes = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(sizes.select("block", "length", F.coalesce(before, F.lit(0)).alias("before")), ["block", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = where.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(at["key"], length * RANKS + rank, "right") - 1
            inside = rank - (at["key"][k] - length * RANKS)
            sequence = at["window"][k] + inside // at["copies"][k]
            offset = at["offset"][k] + inside % at["copies"][k] * length
            kept = [batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    return in_arrow(ranked, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

"""The corpus's distinct pre-tokens with their frequencies, and the frequent ones among them as a bounded dictionary.

Pre-tokens are the matches of public_tokenizers.PATTERN. Task-side counting is combined before one shuffle on the
pre-token, so a pre-token found everywhere costs one row for each map task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, parts_of
from .ragged import Ragged, slices

#: Most entries of a dictionary that is sent to all tasks, and the most characters of an entry.
MOST_FREQUENT, LONGEST = 1 << 17, 64
#: A special token's string; texts are split at it first. None: such strings are ordinary text.
END = "<|endoftext|>"
#: Parts that are pre-tokens as they stand.
_PLAIN = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def pieces_of(texts: list[str | None], special: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What lies between the special strings, none of it empty; whose text each piece is of, and how often the special
    string stands in each text."""
    pieces, owners, found = [], [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if not text:
            continue
        own = [text]
        if special is not None and special in text:
            cut = text.split(special)
            own, found[k] = [x for x in cut if x], len(cut) - 1
        pieces += own
        owners += [k] * len(own)
    return pieces, np.array(owners, np.int64), found


def distinct_parts(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct parts, the parts of all texts by their number, how many each text has); a part that a space precedes
    has it in front."""
    parts = parts_of(texts)
    counts, flat = parts.value_lengths().to_numpy(), parts.flatten()
    ends = counts.cumsum()
    later = np.ones(len(flat), bool)
    later[ends - counts] = False  # every text has a first part, which no space precedes
    first, others = (flat.filter(pa.array(x)).dictionary_encode() for x in (~later, later))
    distinct = pa.concat_arrays([first.dictionary, pc.binary_join_element_wise(pa.scalar(" "), others.dictionary, pa.scalar(""))])
    codes = np.empty(len(flat), np.int64)
    codes[~later], codes[later] = first.indices.to_numpy(), others.indices.to_numpy().astype(np.int64) + len(first.dictionary)
    return distinct, codes, counts


class Pretokens:
    def __init__(self):
        self.find = regex.compile(PATTERN).findall

    def split(self, parts: pa.Array) -> tuple[pa.Array, Ragged]:
        """(distinct pre-tokens, a run of their numbers for each of the distinct parts)."""
        plain = pc.match_substring_regex(parts, _PLAIN)
        found = [self.find(x) for x in parts.filter(pc.invert(plain)).to_pylist()]
        plain = plain.to_numpy(zero_copy_only=False)
        n = int(plain.sum())
        # plain parts first, then the others; their runs go back to the order of the parts
        words = pa.concat_arrays([parts.filter(pa.array(plain)), pa.array([y for x in found for y in x], pa.string())]).dictionary_encode()
        order = np.empty(len(plain), np.int64)
        order[plain], order[~plain] = np.arange(n), np.arange(n, len(plain))
        sizes = np.concatenate([np.ones(n, np.int64), np.fromiter(map(len, found), np.int64, len(found))])
        return words.dictionary, Ragged(words.indices.to_numpy().astype(np.int64), sizes).take(order)


def pretoken_counts(texts: DataFrame, special: str | None = None) -> DataFrame:
    """(pretoken, freq) for the string column `text`; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = Pretokens()
        for part in slices(batches, "text"):
            pieces, _, _ = pieces_of(part.column("text").to_pylist(), special)
            if not pieces:
                continue
            parts, codes, _ = distinct_parts(pieces)
            words, runs = pretokens.split(parts)
            times = np.repeat(np.bincount(codes, minlength=len(parts)), runs.sizes)
            freq = np.bincount(runs.values, times, len(words)).astype(np.int64)  # exact below 2 ** 53
            yield pa.RecordBatch.from_arrays([words, pa.array(freq)], ["pretoken", "freq"])

    return in_arrow(texts.select("text"), run, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))


def band() -> Column:
    """Eight steps to a doubling of the frequency."""
    return F.floor(F.log2(F.col("freq")) * 8).cast("int")


def frequent_band(vocabulary: DataFrame, most: int = MOST_FREQUENT) -> int:
    """The lowest band from which upward at most `most` pre-tokens lie: a few hundred counts decide, never the rows."""
    sizes = sorted((r["b"], r["n"]) for r in vocabulary.groupBy(band().alias("b")).agg(F.count("*").alias("n")).collect())
    total, lowest = 0, 1 << 30
    for b, n in reversed(sizes):
        total += n
        if total > most:
            break
        lowest = b
    return lowest


def is_frequent(lowest: int) -> Column:
    return (band() >= lowest) & (F.length("pretoken") <= LONGEST)

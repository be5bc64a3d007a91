"""Runs of values laid end to end, so that whole blocks of words and texts are looked up and joined as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


class Ragged:
    """Run k is values[starts[k] : starts[k] + sizes[k]]."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, np.asarray(sizes, np.int64)
        self.starts = self.sizes.cumsum() - self.sizes

    def take(self, codes: np.ndarray) -> Ragged:
        """The runs of those numbers, one after another."""
        sizes = self.sizes[codes]
        ends = sizes.cumsum()
        narrow = np.int32 if max(len(self.values), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
        at = np.repeat((self.starts[codes] - (ends - sizes)).astype(narrow), sizes)
        at += np.arange(len(at), dtype=narrow)
        return Ragged(self.values[at], sizes)

    def regrouped(self, counts: np.ndarray) -> Ragged:
        """The same values, each counts[k] neighbouring runs made one; a count may be 0."""
        ends = np.append(0, self.sizes.cumsum())[np.append(0, np.cumsum(counts))]
        return Ragged(self.values, np.diff(ends))

    def run(self, k: int) -> np.ndarray:
        return self.values[self.starts[k] : self.starts[k] + self.sizes[k]]

    @staticmethod
    def of(runs: list, dtype) -> Ragged:
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        values = np.fromiter((x for r in runs for x in r), dtype, int(sizes.sum()))
        return Ragged(values, sizes)

    @staticmethod
    def joined(parts: list[Ragged]) -> Ragged:
        return Ragged(np.concatenate([x.values for x in parts]), np.concatenate([x.sizes for x in parts]))


def bytes_of(strings: pa.Array) -> Ragged:
    """The bytes of an array of strings or binaries without nulls."""
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    _, ends, data = strings.buffers()
    ends = np.frombuffer(ends, kind)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, kind)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Ragged(raw[ends[0] : ends[-1]], np.diff(ends))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `most` bytes of that column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, end - at)
            at, done = end, int(ends[end - 1])

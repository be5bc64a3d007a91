"""Token counts of whole documents without their ids.

Pieces are counted once for each distinct pre-token of the corpus. A document's count is the sum over its pre-token
frequencies: those of the frequent pre-tokens are looked up in a dictionary of at most MOST_FREQUENT entries, the
others are joined to the table of counts by pre-token.

Null and empty texts have 0 bytes and 0 tokens, and an empty table gives no rows; a very long text is counted as a
whole. Repeated rows each give a row, null ids stay null. Other columns, whatever their names, are not read."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, written
from .ragged import Ragged, slices
from .vocabulary import END, Pretokens, distinct_parts, frequent_band, is_frequent, pieces_of, pretoken_counts


def piece_counts(vocabulary: DataFrame, tokenizer_file: str) -> DataFrame:
    """Adds n_pieces, by the tokenizers library, once for each pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) for x in found], pa.int32())], ["pretoken", "freq", "n_pieces"])

    return in_arrow(vocabulary.select("pretoken", "freq"), run, "pretoken string, freq long, n_pieces int")


class SliceCounter:
    """Tokens of whole texts, a slice of them at a time; known: frequent pre-tokens and their counts of pieces."""

    def __init__(self, known: tuple[pa.Array, np.ndarray]):
        (self.known, self.counts), self.pretokens = known, Pretokens()

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """For each text its special tokens and the pieces of its known pre-tokens; and of the others, one for each text
        and pre-token: (text, pre-token, times)."""
        pieces, owners, totals = pieces_of(texts, END)
        if not pieces:
            return totals, np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
        parts, codes, counts = distinct_parts(pieces)
        words, runs = self.pretokens.split(parts)
        at = pc.index_in(words, value_set=self.known)
        rare = pc.is_null(at).to_numpy(zero_copy_only=False)
        each = np.where(rare, 0, self.counts[pc.fill_null(at, 0).to_numpy()]) if len(self.known) else np.zeros(len(words), np.int64)
        sums = lambda values, sizes: np.diff(np.append(0, values.cumsum())[np.append(0, sizes.cumsum())])
        of_pieces = sums(sums(each[runs.values], runs.sizes)[codes], counts)
        np.add.at(totals, owners, of_pieces)
        missing = rare[runs.values]
        found = Ragged(runs.values[missing], sums(missing.astype(np.int64), runs.sizes)).take(codes).regrouped(counts)
        key, times = np.unique(np.repeat(owners, found.sizes) * len(words) + found.values, return_counts=True)
        return totals, key // len(words), words.take(pa.array(key % len(words))), times


def token_counts(docs: DataFrame, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens), a row for each row of docs."""
    spark = docs.sparkSession
    tokenizer_file = tokenizer_file or path("byte_bpe_50k.json")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = written(piece_counts(pretoken_counts(docs.select("text"), END), tokenizer_file), "pieces")
    lowest = frequent_band(vocabulary)
    held = vocabulary.filter(is_frequent(lowest)).select("pretoken", "n_pieces").collect()
    frequent = spark.sparkContext.broadcast((pa.array([r[0] for r in held], pa.string()), np.array([r[1] for r in held], np.int64)))
    rare = vocabulary.filter(~is_frequent(lowest)).select("pretoken", "n_pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SliceCounter(frequent.value)
        for part in slices(batches, "text"):
            totals, owner, words, times = counter.count(part.column("text").to_pylist())
            rids, ids, at = part.column("rid"), part.column("doc_id"), pa.array(owner)
            # the row of the document itself, under a key that no pre-token has
            heads = pc.binary_join_element_wise(pa.scalar("\x00row"), rids.cast(pa.string()), pa.scalar(""))
            columns = [(rids, rids.take(at)), (ids, ids.take(at)), (part.column("n_bytes"), pa.array(np.zeros(len(owner), np.int64))), (heads, words), (pa.array(totals), pa.array(times))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], ["rid", "doc_id", "n_bytes", "pretoken", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = in_arrow(rows, run, "rid long, doc_id long, n_bytes long, pretoken string, times long").join(rare, "pretoken", "left")
    return (
        counted.groupBy("rid", "doc_id")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("times") * F.coalesce("n_pieces", F.lit(1))).alias("n_tokens"))
        .select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens")
    )

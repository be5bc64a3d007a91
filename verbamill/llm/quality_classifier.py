"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The interactions of all pairs of a document's features cost one pass over them, as half the difference between the
square of the sum and the sum of the squares of each factor. It is fitted by Adam on at most `most` labelled rows
outside the held-out fold. Words are hashed to WORDS buckets, each statistic falls into one of BINS bins.

Null and empty texts are scored by their statistics, null metadata by a bin of its own. Without labels of both kinds
every score is 0.5 (predicted 1), and tables without rows give none. Labels, lang, source and doc_id are never inputs;
rows with null labels or ids teach nothing, and of rows that repeat an id one does. Repeated rows each give a row.
Other columns, whatever their names, are not read."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, in_arrow, map_rows, rows_of
from .labelled import MOST_LABELLED, fold, labelled_sample

WORDS, BINS, FACTORS = 1 << 14, 16, 8
SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?"
_HIGH = bytes(range(128, 256))
STATISTICS = 16


def statistics(text: str) -> tuple[Counter, list[float]]:
    """Counts of the lower-cased words and STATISTICS numbers from 0 to 1, over the whole text."""
    raw = text.encode()
    words = raw.lower().split()
    n, m = max(len(raw), 1), max(len(words), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    log = lambda x, most: min(1.0, np.log1p(x) / most)
    return counts, [
        log(len(raw), 14.0), log(len(words), 12.0), len(counts) / m, max(counts.values(), default=0) / m, share(SYMBOLS), share(_UPPER), share(_DIGITS), share(_MARKS), share(_HIGH),
        raw.count(b"!!") / m, raw.count(b" | ") / m, sum(map(eq, words, words[1:])) / m, 1 - len(set(lines)) / max(len(lines), 1), min(1.0, len(raw) / m / 24), min(1.0, raw.count(b".") / m * 4), log(len(lines), 10.0),
    ]


def features(text: str | None, extra: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values). Words weigh by the logarithm of their count, to a length of 1; a statistic's bin weighs 1;
    each metadata value falls into a bin of its own by its logarithm if it is a number, else by its hash."""
    counts, stats = statistics(text or "")
    n = len(counts)
    index = np.fromiter(map(zlib.crc32, counts), np.int64, n) % WORDS
    value = np.log1p(np.fromiter(counts.values(), np.float64, n))
    value /= max(np.sqrt((value**2).sum()), 1e-9)
    bins = np.minimum(np.sqrt(np.array(stats)) * BINS, BINS - 1).astype(np.int64) + BINS * np.arange(STATISTICS)
    more = [0 if x is None else 1 + (min(int(np.log2(1 + max(x, 0))), BINS - 2) if isinstance(x, (int, float)) else zlib.crc32(str(x).encode()) % (BINS - 1)) for x in extra]
    more = np.array(more, np.int64) + BINS * (STATISTICS + np.arange(len(extra)))
    index = np.concatenate([index, WORDS + bins, WORDS + more])
    return index, np.concatenate([value, np.ones(STATISTICS + len(extra))])


class FactorisationMachine:
    def __init__(self, size: int, factors: int = FACTORS, seed: int = 7):
        random = np.random.default_rng(seed)
        self.bias, self.weights, self.vectors = 0.0, np.zeros(size), random.normal(0, 0.02, (size, factors))

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of rows that begin at starts, and each row's sum of factors."""
        scaled = self.vectors[index] * value[:, None]
        sums, squares = np.add.reduceat(scaled, starts), np.add.reduceat((scaled**2).sum(1), starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + ((sums**2).sum(1) - squares) / 2, sums

    def score(self, index, value, starts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, starts)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        random, size, factors = np.random.default_rng(seed), len(self.weights), self.vectors.shape[1]
        held = np.concatenate([self.weights[:, None], self.vectors], 1)
        first, second, step = np.zeros_like(held), np.zeros_like(held), 0
        self.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                index, value = (np.concatenate([rows[k][x] for k in some]) for x in (0, 1))
                counts = np.array([len(rows[k][0]) for k in some])
                starts = np.append(0, counts.cumsum()[:-1])
                self.weights, self.vectors = held[:, 0], held[:, 1:]
                raw, sums = self.raw(index, value, starts)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
                each = np.repeat(error, counts) * value
                slope = np.empty_like(held)
                slope[:, 0] = np.bincount(index, each, size)
                by_value = each * value
                for f in range(factors):
                    slope[:, f + 1] = np.bincount(index, each * np.repeat(sums[:, f], counts) - by_value * self.vectors[index, f], size)
                slope += decay * held
                step += 1
                first += 0.1 * (slope - first)
                second += 0.001 * (slope**2 - second)
                held -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                self.bias -= rate * float(error.sum())
        self.weights, self.vectors = held[:, 0].astype(np.float32), held[:, 1:].astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", of: int = 3, held_out: int = 1, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", metadata: tuple = ()) -> FactorisationMachine | None:
    sample = labelled_sample(docs, labels, label, of, held_out, most, id_col, (text_col, *metadata))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            found = [features(text, extra) for _, text, *extra in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([i.astype("<u2").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["label", "index", "value"])

    # at most `most` rows
    found = in_arrow(sample, run, "label int, index binary, value binary").collect()
    known = np.array([r["label"] for r in found], float)
    if len({*known}) < 2:
        return None
    order = sorted(range(len(found)), key=lambda k: (bytes(found[k]["index"]), bytes(found[k]["value"])))  # as the rows may arrive in any order
    rows = [(np.frombuffer(found[k]["index"], "<u2").astype(np.int64), np.frombuffer(found[k]["value"], "<f4").astype(float)) for k in order]
    return FactorisationMachine(WORDS + BINS * (STATISTICS + len(metadata))).fit(rows, known[order])


def score(docs: DataFrame, model: FactorisationMachine | None, of: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", metadata: tuple = ()) -> DataFrame:
    """(id_col, held_out, score, predicted), a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        machine = sent.value

        def each(rows):
            if machine is None:
                return [[r[0] for r in rows], [r[1] for r in rows], [0.5] * len(rows), [1] * len(rows)]
            found = [features(text, extra) for _, _, text, *extra in rows]
            starts = np.append(0, np.cumsum([len(i) for i, _ in found])[:-1])
            scores = machine.score(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts).astype(float)
            return [[r[0] for r in rows], [r[1] for r in rows], scores, (scores >= 0.5).astype(np.int32)]

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("id", pa.int32() if kind == "int" else pa.int64() if kind == "bigint" else pa.string()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(of, id_col) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), *[F.col(c) for c in metadata])
    return map_rows(rows, start, schema, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: FactorisationMachine | None, text_col: str = "text", metadata: tuple = ()) -> DataFrame:
    """The rows of docs that are predicted to be good, all columns as they are: each row decides for itself, so
    nothing is joined or shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        machine = sent.value

        def good(rows: list[tuple]) -> list[bool]:
            found = [features(text, tuple(extra)) for text, *extra in rows]
            starts = np.append(0, np.cumsum([len(i) for i, _ in found])[:-1])
            return (machine.score(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts) >= 0.5).tolist()

        return good

    return docs if model is None else filter_rows(docs, (text_col, *metadata), start)

"""Toxicity by maximum-scoring segments of token log-odds.

A token's log-odds of standing in a toxic rather than a clean document come from how many labelled documents of each
kind hold it, with a Dirichlet prior whose mean is the log-odds of the token's prefix, itself held near even odds.
Less a drift, these are scores with a negative mean in clean text. One scan finds every maximal-scoring segment, in
time linear in the text. Under clean text the best of n tokens follows an extreme-value law; its scale solves
E[exp(scale * score)] = 1 over the clean tokens, its place is fitted to the clean documents. A document's statistic
is its segments' scores on that scale, summed over those that are significant, and a logistic curve turns it into a
probability.

Null and empty texts have no segments. Without labels of both kinds every score is 0 (predicted 0), and tables without
rows give none. Labels, lang, source and doc_id are never inputs; rows with null labels or ids teach nothing, and of
rows that repeat an id one does. Repeated rows each give a row. Tables are hashed, so their size does not grow. Other
columns, whatever their names, are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, filter_rows, in_arrow, map_rows, rows_of
from .labelled import MOST_LABELLED, fold, labelled_sample

TOKENS, PREFIXES = 1 << 18, 1 << 16
#: Bytes of a prefix, weights of the priors (in documents), drift, and the expected number of segments as good in
#: clean text from which a segment counts.
PREFIX, TOKEN_PRIOR, PREFIX_PRIOR, DRIFT, EXPECTED = 4, 5.0, 5.0, 1.5, 0.05
#: Bytes that end a token: ASCII but for letters, digits and the apostrophe.
_TO_SPACE = bytes(32 if b < 128 and not chr(b).isalnum() and b != 39 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_TO_SPACE).split() if text else []


def bucket(token: bytes) -> int:
    return zlib.crc32(token) % TOKENS


def prefix_bucket(token: bytes) -> int:
    return zlib.crc32(token[:PREFIX], len(token[:PREFIX])) % PREFIXES


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), by one scan over the positive scores."""
    total = np.append(0.0, scores.cumsum())
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    for k in np.flatnonzero(scores > 0).tolist():
        start, before, through = k, float(total[k]), float(total[k + 1])
        at = len(kept) - 1
        while True:
            while at >= 0 and kept[at][2] >= before:
                at -= 1
            if at < 0 or kept[at][3] >= through:
                kept.append((start, k + 1, before, through))
                break
            start, before = kept[at][0], kept[at][2]  # the segment grows back over all since that one
            del kept[at:]
            at -= 1
    return [(a, b, through - before) for a, b, before, through in kept]


class ToxicSegments:
    """The fitted tables and curve."""

    def __init__(self, by_token: np.ndarray, by_prefix: np.ndarray, documents: np.ndarray):
        """by_token, by_prefix: documents of each kind (clean, toxic) that hold a token of the bucket."""
        even = documents.sum() / 2 / np.maximum(documents, 1)  # both kinds weigh the same
        t, p = by_token * even, by_prefix * even
        self.share = ((p[:, 1] + PREFIX_PRIOR) / (p.sum(1) + 2 * PREFIX_PRIOR)).astype(np.float32)
        self.clean, self.toxic = t[:, 0].astype(np.float32), t[:, 1].astype(np.float32)
        self.clean_weight, self.toxic_weight = (float(x) for x in even)
        self.scale, self.place, self.slope, self.offset = 1.0, 0.0, 1.0, 0.0

    def token_score(self, token: bytes) -> float:
        k, share = bucket(token), float(self.share[prefix_bucket(token)])
        return float(np.log((self.toxic[k] + TOKEN_PRIOR * share) / (self.clean[k] + TOKEN_PRIOR * (1 - share)))) - DRIFT

    def cache(self) -> Bounded:
        return Bounded(self.token_score)

    def segments(self, text: str | None, scored: Bounded) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        scores = np.fromiter(map(scored.__getitem__, words), np.float64, len(words))
        return len(words), segments(scores) if len(words) and scores.max() > 0 else []

    def statistic(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Log of how much better than the best of n clean tokens, over the significant segments; at least -20."""
        each = [self.scale * s - np.log(max(n, 1)) - self.place for _, _, s in found]
        if not each:
            return -20.0
        good = [x for x in each if x >= -np.log(EXPECTED)]
        return float(max(-20.0, sum(good) if good else max(each)))

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(statistic) + self.offset, -30, 30)))

    def fit_law(self, scores: np.ndarray, weights: np.ndarray) -> None:
        """scale: the positive root of E[exp(scale * score)] = 1 over clean tokens."""
        weights = weights / weights.sum()
        low, high = 1e-3, 8.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (weights * np.exp(np.minimum(mid * scores, 50))).sum() < 1 else (low, mid)
        self.scale = low

    def fit_place(self, n: np.ndarray, best: np.ndarray) -> None:
        """n, best: tokens and best segment's score of each clean text that has a segment."""
        found = self.scale * best - np.log(np.maximum(n, 1))
        self.place = float(found.mean()) - 0.5772 if len(found) else 0.0

    def fit_curve(self, statistics: np.ndarray, labels: np.ndarray) -> None:
        x = np.minimum(statistics, 30.0)
        a, b = 1.0, 0.0
        for _ in range(200):  # Newton steps of a logistic regression, lightly held to a slope of 1
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - labels) * x).sum() + 0.1 * (a - 1), (p - labels).sum() + 0.01 * b])
            h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
            a, b = a - step[0], b - step[1]
        self.slope, self.offset = float(max(a, 0.05)), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", of: int = 5, held_out: int = 0, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> ToxicSegments | None:
    sample = labelled_sample(docs, labels, label, of, held_out, most, id_col, (text_col,))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = {k: np.zeros((2, size), np.int32) for k, size in ((0, TOKENS), (1, PREFIXES))}, np.zeros(2, np.int64)
        for rows in rows_of(batches):
            for y, text in rows:
                words, y = set(tokens(text)), int(y > 0)
                documents[y] += 1
                held[0][y][np.fromiter({bucket(w) for w in words}, np.int64)] += 1
                held[1][y][np.fromiter({prefix_bucket(w) for w in words}, np.int64)] += 1
        for kind, y, found in [(2, 0, documents[:1]), (2, 1, documents[1:]), *((k, y, held[k][y]) for k in held for y in (0, 1))]:
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(np.full(len(at), y), pa.int32()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], ["kind", "label", "bucket", "n"])

    # at most 2 * (TOKENS + PREFIXES + 1) sums, of a bounded sample
    counts = in_arrow(sample, count, "kind int, label int, bucket long, n long").groupBy("kind", "label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    tables = [np.zeros((size, 2)) for size in (TOKENS, PREFIXES, 1)]
    for k, x in enumerate(tables):
        some = counts[counts.kind == k]
        x[some.bucket.to_numpy(), some.label.to_numpy()] = some.n.to_numpy()
    if not tables[2].all():
        return None
    model = ToxicSegments(tables[0], tables[1], tables[2][0])
    law, best = best_segments(sample, model)
    model.fit_law((LAW_BINS[1:] + LAW_BINS[:-1]) / 2, np.maximum(law, 1e-9))
    clean = best[(best.label == 0) & (best.best > 0)]
    model.fit_place(clean.n.to_numpy(), clean.best.to_numpy())
    found = statistics(sample, model)
    model.fit_curve(found.statistic.to_numpy(), found.label.to_numpy().astype(float))
    return model


def own_segments(model: ToxicSegments, text: str | None, label: int) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Scores and segments of a labelled text, its own document taken out of its tokens' counts, or it would vouch for
    itself."""
    words = tokens(text)
    own = {w: left_out(model, w, label) for w in set(words)}
    scores = np.fromiter(map(own.__getitem__, words), np.float64, len(words))
    return scores, segments(scores) if len(words) and scores.max() > 0 else []


def best_segments(sample: DataFrame, model: ToxicSegments) -> tuple[np.ndarray, pd.DataFrame]:
    """How many clean tokens have a score in each of LAW_BINS; and (label, n, best) of each text of the sample."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            law, out = np.zeros(len(LAW_BINS) - 1, np.int64), []
            for y, text in rows:
                scores, found = own_segments(sent.value, text, int(y > 0))
                if not y > 0:
                    law += np.histogram(scores, bins=LAW_BINS)[0]
                out.append((int(y > 0), len(scores), max((s for _, _, s in found), default=0.0)))
            laws = pa.array([law.tolist(), *[None] * (len(rows) - 1)], pa.list_(pa.int64()))  # one for all rows
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.float64()))), laws], ["label", "n", "best", "law"])

    # four numbers for each of at most `most` rows
    found = in_arrow(sample, run, "label int, n long, best double, law array<long>").toPandas()
    return np.sum([*found.law.dropna(), np.zeros(len(LAW_BINS) - 1)], axis=0), found


def statistics(sample: DataFrame, model: ToxicSegments) -> pd.DataFrame:
    """(label, statistic) of each text of the sample."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            found = [own_segments(sent.value, text, int(y > 0)) for y, text in rows]
            yield pa.RecordBatch.from_arrays([pa.array([int(y > 0) for y, _ in rows], pa.int32()), pa.array([sent.value.statistic(len(x), f) for x, f in found], pa.float64())], ["label", "statistic"])

    return in_arrow(sample, run, "label int, statistic double").toPandas()


#: Bins of the clean tokens' scores.
LAW_BINS = np.linspace(-12, 12, 97)


def left_out(model: ToxicSegments, token: bytes, label: int) -> float:
    """The token's score without one document of that label."""
    k, share = bucket(token), float(model.share[prefix_bucket(token)])
    toxic, clean = float(model.toxic[k]), float(model.clean[k])
    if label:
        toxic = max(0.0, toxic - model.toxic_weight)
    else:
        clean = max(0.0, clean - model.clean_weight)
    return float(np.log((toxic + TOKEN_PRIOR * share) / (clean + TOKEN_PRIOR * (1 - share)))) - DRIFT


def score(docs: DataFrame, model: ToxicSegments | None, of: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted, segments): segments are [start, end) in tokens of the significant passages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = sent.value
        scored = model.cache() if model else None

        def each(rows):
            head = [[r[0] for r in rows], [r[1] for r in rows]]
            if model is None:
                return [*head, [0.0] * len(rows), [0] * len(rows), [[] for _ in rows]]
            found = [model.segments(text, scored) for _, _, text in rows]
            scores = model.probability([model.statistic(n, f) for n, f in found])
            passages = [[{"start": a, "end": b, "score": s} for a, b, s in f if model.scale * s - np.log(max(n, 1)) - model.place >= -np.log(EXPECTED)] for n, f in found]
            return [*head, scores, (scores >= 0.5).astype(np.int32), passages]

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    schema = pa.schema([("id", pa.int32() if kind == "int" else pa.int64() if kind == "bigint" else pa.string()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("segments", passage)])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(of, id_col) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return map_rows(rows, start, schema, f"id {kind}, held_out boolean, score double, predicted int, segments array<struct<start:int,end:int,score:double>>").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: ToxicSegments | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted to be toxic, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = sent.value
        scored = model.cache()
        return lambda rows: (model.probability([model.statistic(*model.segments(text, scored)) for (text,) in rows]) < 0.5).tolist()

    return docs if model is None else filter_rows(docs, (text_col,), start)

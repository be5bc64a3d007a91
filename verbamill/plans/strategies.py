"""What a caller may plug in: back ends that answer rows, ways to look up neighbours, and correctors of one result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbamill.functions.text import clean_transcript, dedup_key
from verbamill.operators import joins, lexicon, spans
from verbamill.session import ship


class Backend(Protocol):
    """prepare() is called once in each task; answer() gets a batch and gives one answer a row."""

    def prepare(self) -> None: ...

    def answer(self, batch: pa.RecordBatch) -> list[str | None]: ...


@dataclass
class Backends:
    """Back ends by name, made anew in each task that uses them."""

    makers: dict[str, Callable[[], Backend]] = field(default_factory=dict)

    def register(self, name: str, make: Callable[[], Backend]) -> None:
        if name in self.makers:
            raise ValueError(f"there is a back end {name} already")
        self.makers[name] = make

    def run(self, name: str, rows: DataFrame, column: str = "answer") -> DataFrame:
        """rows with the back end's answers; which tasks run it is Spark's choice, so answers must come from the row alone."""
        make, ddl = self.makers[name], ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, (column, "string")])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            backend = make()
            backend.prepare()
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(backend.answer(b), pa.string())], [*b.schema.names, column])

        ship(rows.sparkSession)
        return rows.mapInArrow(each, ddl)


#: Ways to find a term's neighbours: (left, right) with a column `term` each, to (term, other, score).
NEIGHBOURS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "ngram": lambda a, b: joins.ngram_cosine(a, b, "term", "term", "term", "term", 3, 0.3).toDF("term", "other", "score"),
    "spelling": lambda a, b: lexicon.spelling_candidates(a, "term", b.select(F.col("term").alias("other")), "other").select("term", "other", (1 - F.col("distance") / F.greatest(F.length("term"), F.length("other"))).alias("score")),
}

#: Correctors: (rows with id and text, lexicon with term) to (id, text, corrected).
CORRECTORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def corrector(name: str):
    def put(f):
        CORRECTORS[name] = f
        return f

    return put


def _by_word(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """Words of the texts replaced by what fixes (word, fixed) say."""
    each = rows.select("id", "text", F.posexplode(F.split("text", " ")).alias("at", "word")).join(fixes, "word", "left")
    told = F.array_sort(F.collect_list(F.struct("at", F.coalesce("fixed", "word").alias("word"))))
    return each.groupBy("id", "text").agg(F.array_join(F.transform(told, lambda x: x["word"]), " ").alias("corrected"))


@corrector("clean")
def cleaned(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The ingestion cleaner alone."""
    return rows.select("id", "text", clean_transcript("text").alias("corrected"))


@corrector("spelling")
def spelled(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Words that the lexicon does not know, by the nearest term within one edit."""
    said = rows.select(F.explode(F.split("text", " ")).alias("word")).distinct().join(terms.select(F.col("term").alias("word")), "word", "left_anti")
    near = lexicon.spelling_candidates(said, "word", terms, "term")
    return _by_word(rows, near.groupBy("word").agg(F.min_by("term", F.struct("distance", "term")).alias("fixed")))


@corrector("aliases")
def aliased(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Runs of words that are a term once their spaces are gone."""
    known = terms.select(F.regexp_replace(dedup_key("term"), " ", "").alias("key"), F.col("term").alias("value"))
    found = spans.alias_rewrite(rows.select("id", "text", F.split("text", " ").alias("w")), "id", "w", known)
    return found.select("id", "text", F.array_join("w", " ").alias("corrected"))


def corrected(name: str, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, text, corrected) by the corrector of that name; all give the same columns."""
    return CORRECTORS[name](rows.select("id", "text"), terms.select("term")).select("id", "text", "corrected")

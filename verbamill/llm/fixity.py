"""WARC fixity audit by Merkle trees.

Every record is hashed; records fall into ranges of RANGE bytes by their offset in a file, a range's hash covers its
records in order of offset, and FAN neighbouring nodes make one of the next level up to a single root for each file.
Two replicas are compared root by root; only below nodes that differ are children compared, and only in ranges that
differ are records. So of an intact replica no more than the roots is compared.

Records whose payload or URL is null are records with an empty one. Records without an id are dealt by a hash into
NAMELESS files of their own. Files that one side lacks are reported record by record. Repeated rows are records of
their own, in order of their hashes. Replicas without rows agree; an empty one lacks every record of the other. Other
columns, whatever their names, are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Records of a file, bytes of a leaf, and children of a node; files for records without an id.
PER_FILE, RANGE, FAN, NAMELESS = 1000, 1 << 16, 16, 1 << 20


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(warc_file, length, id_col, record): pages as records of WARC files of ids that follow each other."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    nameless = F.pmod(F.xxhash64(url_col, body_col), F.lit(NAMELESS)) - F.lit(1 << 62)
    rows = pages.select(F.coalesce(F.floor(F.col(id_col) / per_file), nameless).cast("long").alias("warc_file"), F.col(id_col), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))
    return rows.select("warc_file", F.octet_length("record").cast("long").alias("length"), id_col, "record")


def fixed(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def placed(hashed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Adds each record's offset in its file, from the lengths of those before it by id and hash; records are known by
    their hashes here, so none of their bytes are shuffled."""
    before = F.sum("length").over(Window.partitionBy("warc_file").orderBy(id_col, "sha256").rowsBetween(Window.unboundedPreceding, -1))
    return hashed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def digests(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """The records' offsets and hashes in place of their bytes."""
    return placed(records.withColumn("sha256", fixed(F.col(record_col))).drop(record_col), id_col)


def _hash(*order: Column) -> Column:
    """One hash of a group's hashes in order; a group has the children of one node or the records of one range."""
    keys = [f"k{i}" for i in range(len(order))]
    held = F.array_sort(F.collect_list(F.struct(*[c.alias(k) for k, c in zip(keys, order)], "sha256")))
    return F.sha2(F.array_join(F.transform(held, lambda x: F.concat_ws(":", *[x[k].cast("string") for k in keys], x["sha256"])), ","), 256).alias("sha256")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the ranges up to the roots: (warc_file, node, sha256)."""
    node = F.floor(F.col("offset") / RANGE).cast("long")
    levels = [written(records.groupBy("warc_file", node.alias("node")).agg(_hash(F.col("offset"), F.col("length"))), "ranges")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(written(levels[-1].groupBy("warc_file", F.floor(F.col("node") / FAN).cast("long").alias("parent")).agg(_hash(F.col("node"))).withColumnRenamed("parent", "node"), "level"))
    return levels


def differing(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes whose hashes differ or that one side lacks."""
    a, b = ours.select(*keys, F.col("sha256").alias("ours")), theirs.select(*keys, F.col("sha256").alias("theirs"))
    return a.join(b, keys, "full").filter(~F.col("ours").eqNullSafe(F.col("theirs"))).select(*keys)


def audit(ours: DataFrame, theirs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(warc_file, offset, length, id_col, status, expected, found): the records in which the second replica is changed,
    missing or extra. Both are (warc_file, offset, length, id_col, sha256)."""
    columns = ["warc_file", "offset", "length", id_col, "sha256"]
    ours, theirs = written(ours.select(*columns), "ours"), written(theirs.select(*columns), "theirs")
    a, b = tree(ours), tree(theirs)
    while len(a) < len(b):  # a higher tree's upper levels have no partner: both begin at the same height
        a.append(a[-1].groupBy("warc_file", F.floor(F.col("node") / FAN).cast("long").alias("parent")).agg(_hash(F.col("node"))).withColumnRenamed("parent", "node"))
    while len(b) < len(a):
        b.append(b[-1].groupBy("warc_file", F.floor(F.col("node") / FAN).cast("long").alias("parent")).agg(_hash(F.col("node"))).withColumnRenamed("parent", "node"))
    keys = ["warc_file", "node"]
    wrong = written(differing(a[-1], b[-1], keys), "wrong")
    for x, y in zip(reversed(a[:-1]), reversed(b[:-1])):
        below = wrong.select("warc_file", F.col("node").alias("parent"))
        under = lambda level, below=below: level.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).join(below, ["warc_file", "parent"], "left_semi")
        wrong = written(differing(under(x), under(y), keys), "wrong")
    within = lambda df: df.withColumn("node", F.floor(F.col("offset") / RANGE).cast("long")).join(wrong, keys, "left_semi")
    x = within(ours).select("warc_file", "offset", F.col("length").alias("l1"), F.col(id_col).alias("i1"), F.col("sha256").alias("expected"))
    y = within(theirs).select("warc_file", "offset", F.col("length").alias("l2"), F.col(id_col).alias("i2"), F.col("sha256").alias("found"))
    both = x.join(y, ["warc_file", "offset"], "full").filter(~F.col("expected").eqNullSafe(F.col("found")))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return both.select("warc_file", "offset", F.coalesce("l1", "l2").alias("length"), F.coalesce("i1", "i2").alias(id_col), status.alias("status"), "expected", "found")

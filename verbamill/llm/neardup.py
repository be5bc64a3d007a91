"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. Each document's words (bytes but for white space, A-Z lowered) give a set of hashed shingles. Documents of equal sets
   are one class, known by the digest of the set; a class of any size costs one row for each task.
2. A class is sketched in rounds: a round hashes every shingle to a bin and a value; a bin keeps the least of the first
   round that reached it, and from round COORDINATES on a round serves one bin alone, so all fill. BANDS bands of
   WIDTH coordinates are hashed; classes that share a band are candidates. At a similarity of 0.8 a pair is missed
   with a chance of about (1 - 0.8^6)^42 = 3e-6, and a link is lost only if no chain of others makes it good.
3. In each band's bucket every class is checked against the first one alone: as many pairs as members, never all.
   The pairs are confirmed on full sets, and linked classes are joined into components.
4. Buckets that still hold several components are settled: members that a sketch comparison leaves a chance to link
   across components are compared on full sets, block by block, each pair in the first band where it meets, and only
   links that join components are kept. The sketch may fall short of the threshold by SLACK, which is 4.8 standard
   deviations at a similarity of 0.8: a chance of some 1e-6 for a pair.
5. Components come from alternating large-star and small-star steps on tables in the shared folder.

Documents without words (null, empty or blank texts) have an empty set and are linked with nothing. Null ids are
linked with nothing either: their component is null and they are kept. Rows that repeat an id with other texts keep
their own sets and links, and are linked with each other. An empty table gives no rows. Other columns, whatever their
names, are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, in_arrow, rows_of, written

COORDINATES, WIDTH, BANDS = 256, 6, 42
#: Members of a block when a bucket is settled, and by how much of 1 a sketch may fall short of the threshold.
SETTLED, SLACK = 512, 0.12
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int = 5):
        self.words, self.hashes = words, Bounded(word_hash)

    def __call__(self, text: str | None) -> np.ndarray:
        found = text.encode().lower().split() if text else []  # bytes: A-Z alone are lowered, white space is ASCII
        if not found:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)  # a shorter sequence differs from any full shingle
        for k in range(n):
            total = mixed(total + h[k : len(h) - n + 1 + k] * _WORD[k % len(_WORD)])
        return np.unique(total)


_ROUNDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _WORD[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES values. As many rounds at a time as make about three hashes for each coordinate; a value holds the
    bin, the round and the hash in that order, so that sorting brings each bin's first round and least hash forward."""
    out, filled = np.zeros(COORDINATES, np.uint64), np.zeros(COORDINATES, bool)
    at = 0
    while not filled.all():
        some = np.arange(at, min(2 * COORDINATES, at + max(1, 3 * COORDINATES // len(shingles))), dtype=np.uint64)
        h = mixed(shingles[None, :] ^ _ROUNDS[some.astype(np.int64)][:, None])
        bins = h >> np.uint64(56)
        late = some >= COORDINATES
        if late.any():
            bins[late] = (some[late] - np.uint64(COORDINATES))[:, None]
        value = np.sort(((bins << np.uint64(56)) | (some[:, None] << np.uint64(47)) | (h & np.uint64((1 << 47) - 1))).ravel())
        bins = (value >> np.uint64(56)).astype(np.int64)
        first = np.append(True, bins[1:] != bins[:-1])
        value, bins = value[first], bins[first]
        new = ~filled[bins]
        out[bins[new]], filled[bins] = value[new], True
        at += len(some)
    return mixed(out)


def bands(values: np.ndarray) -> np.ndarray:
    part = values[: WIDTH * BANDS].reshape(BANDS, WIDTH)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _WORD[1]
    for k in range(WIDTH):
        total = mixed(total + part[:, k])
    return total


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, version, n_shingles, digest, bands) of (doc_id, text, version): bands is null where the set is empty.
    Copies within a slice of rows are sketched once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        known = Bounded(None, 20_000)
        for rows in rows_of(batches):
            sizes, digests, found = [], [], []
            for _, _, text in rows:
                s = shingles(text)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if len(s) and digest not in known:
                    if len(known) >= known.limit:
                        known.clear()
                    known[digest] = bands(sketch(s)).view(np.int64)
                sizes.append(len(s))
                digests.append(digest)
                found.append(known[digest] if len(s) else None)
            heads = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "version", "n_shingles", "digest", "bands"])

    return in_arrow(docs.select("doc_id", "version", "text"), run, "doc_id long, version long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles, marks, bands) of (node, text): marks are two bytes of each coordinate of the sketch, bands the
    bytes of its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for rows in rows_of(batches):
            found = [shingles(text) for _, text in rows]
            values = [sketch(s) if len(s) else None for s in found]
            marks = [b"" if v is None else v.astype("<u2").tobytes() for v in values]
            hashes = [b"" if v is None else bands(v).astype("<u8").tobytes() for v in values]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(hashes, pa.binary())], ["node", "shingles", "marks", "bands"])

    return in_arrow(docs.select("node", "text"), run, "node long, shingles array<long>, marks binary, bands binary")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): the smallest node reachable. Stars alternate until nothing
    changes; every step's edges are at most the links, and no neighbourhood is gathered in one row."""
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    told = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = told(edges)
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.filter("a <> b").distinct(), "edges")
        now = told(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, n) with 100 * common >= percent * union, on full sets. A set `a` that meets up to n
    others is sent to one task for each SETTLED of them, so that no task gets all that it meets."""
    lots = lambda n: F.ceil(F.col(n) / SETTLED).cast("int")
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), lots("n")).cast("int").alias("lot"))
    met = pairs.groupBy("a").agg(F.max("lot").alias("lots"))
    one = met.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").select("a", F.explode(F.sequence(F.lit(0), "lots")).alias("lot"), "s_a")
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    full = pairs.join(two, "b").join(one, ["a", "lot"]).withColumn("common", common)
    return full.filter(100 * F.col("common") >= percent * (F.size("s_a") + F.size("s_b") - F.col("common"))).select("a", "b")


def joined(count: int, linked: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links (pairs of ids) that join different labels, one for each join."""
    root = {x: x for x in set(labels.tolist())}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = top(labels[i].item()), top(labels[j].item())
        if a != b:
            root[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows whose first `keys` columns agree."""
    held, key = [], None
    for rows in rows_of(batches):
        for r in rows:
            if r[:keys] != key:
                if held:
                    yield key, held
                held, key = [], r[:keys]
            held.append(r[keys:])
    if held:
        yield key, held


def settle(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within buckets; members: (band, key, node, component).

    A bucket is dealt into blocks of about SETTLED members by a hash of their ids; each pair of blocks is one group."""
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2")
    blocks = F.ceil(F.col("n") / SETTLED).cast("int")
    dealt = members.join(sizes.select("band", "key", blocks.alias("blocks")), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    grouped = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "component")
    groups = written(grouped, "groups")
    least = percent / 100 - SLACK
    keys = ["band", "key", "p", "q"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for key, rows in by_group(batches, 4):
            rows.sort(key=lambda r: r[1])
            own, ids, labels, sizes = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 4))
            marks = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(len(rows), COORDINATES)
            earlier = np.frombuffer(b"".join(r[5] for r in rows), "<u8").reshape(len(rows), key[0])
            hit = np.zeros(len(rows), bool)
            for i in range(len(rows)):
                j = np.flatnonzero((labels != labels[i]) & ((own != own[i]) | (key[2] == key[3])) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
                if len(j):
                    same = marks[j] == marks[i]
                    # a pair that met in an earlier band is settled there; the marks alone cannot tell that it met
                    met = (earlier[j] == earlier[i]).any(1)
                    hit[i] = ((same.mean(1) >= least) & ~met).any()
            if not hit.any():
                continue
            # the same members meet in many bands; within a task they are settled once
            digest = hashlib.blake2b(ids[hit].tobytes() + own[hit].tobytes(), digest_size=16).digest()
            if digest in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(digest)
            n = int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array([digest] * n, pa.binary()), pa.array([key[2] == key[3]] * n, pa.bool_()), *(pa.array(x[hit], pa.int64()) for x in (own, ids, labels))], ["digest", "alone", "own", "node", "component"])

    marked = groups.join(sets.select("node", "marks", "bands", F.size("shingles").cast("long").alias("size")), "node").select(*keys, "own", "node", "component", "marks", "size", F.expr("substring(bands, 1, 8 * band)").alias("earlier"))
    spread = marked.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    # one group of those with the same members, whatever bands they met in
    chosen = in_arrow(spread, near, "digest binary, alone boolean, own long, node long, component long").distinct()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, alone), rows in by_group(batches, 2):
            rows.sort(key=lambda r: (r[0], r[1]))
            own, ids, labels = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            sets_ = [np.array(r[3], np.int64) for r in rows]
            sizes = np.array([len(s) for s in sets_])
            # shingles of one member alone add nothing to an intersection
            values, where = np.unique(np.concatenate(sets_), return_inverse=True)
            common = np.flatnonzero(np.bincount(where) > 1)
            place = np.full(len(values), -1)
            place[common] = np.arange(len(common))
            row = np.repeat(np.arange(len(rows)), sizes)
            column = place[where.ravel()]
            row, column = row[column >= 0], column[column >= 0]
            both = np.zeros((len(rows), len(rows)), np.float32)
            for at in range(0, len(common), 4096):
                part = (column >= at) & (column < at + 4096)
                held = np.zeros((len(rows), min(4096, len(common) - at)), np.float32)
                held[row[part], column[part] - at] = 1
                both += held @ held.T
            linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
            linked &= labels[:, None] != labels[None, :]
            if not alone:
                linked &= own[:, None] != own[None, :]
            found = joined(len(rows), np.triu(linked), labels, ids)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    full = chosen.join(sets.select("node", "shingles"), "node").select("digest", "alone", "own", "node", "component", "shingles")
    return in_arrow(full.repartition("digest").sortWithinPartitions("digest"), exact, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row for each row of docs."""
    # an id that is repeated with other texts has several versions
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    base = written(sketched(docs, words), "sketched")
    members = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class's band hashes are the same in every row of it; numbers are settled as the table is written
    classes = members.groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("rep.doc_id").alias("rep"), F.col("rep.version").alias("version"), "bands"), "classes")
    held = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = held.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    buckets = written(held.join(buckets, ["band", "key"]).select("band", "key", "node", "pivot", "n"), "buckets")
    pairs = buckets.filter("pivot <> node").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n"))
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "version")
    sets = written(shingle_sets(docs.join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]), words), "sets")
    links = written(confirmed(pairs, sets, percent), "links")
    first = written(components(links), "components")
    label = lambda df, found: df.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = settle(label(buckets.select("band", "key", "node"), first), sets, percent)
    placed = written(base.drop("bands").join(classes.select("digest", "node", "rep"), "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "rep"), "placed")
    # the versions of an id are linked
    versions = placed.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b <> last")
    versions = placed.join(versions.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    linked = written(components(links.unionAll(written(more, "settled")).unionAll(versions)), "linked")
    least = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    least = linked.join(least, "component").select("node", "component_id")
    out = placed.join(least, "node", "left").withColumn("component_id", F.when(F.col("node").isNotNull(), F.coalesce("component_id", "rep")).otherwise(F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

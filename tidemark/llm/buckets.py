"""Similarity joins from buckets: shuffle by bucket, split hot buckets, count each linked pair once.

Shared by the n-gram Jaccard join (buckets are MinHash bands) and the embedding join (buckets are
spherical caps). Rows that are equal form a class, which goes on as one row with its number of
rows; a bucket is a value that two classes or more share.

- Buckets of exactly the same classes count once (compared by size and two hashes of the members).
- A bucket of more than `tile` classes is split into pairs of tiles. Each pair of tiles is a group
  of its own, so no task gets a whole hot bucket.
- A pair of classes is counted in the first bucket that both have, so nothing is counted twice.
- A group returns one row per linked class (links, and the least class that it hangs together
  with), not one per pair, so that groups of near copies don't flood the shuffle.
- A class's name begins with its least row id, in an order that bytes have too: a component's root
  tells its id without another join. Joins on classes go by broadcast for the few of very many rows.
- Exact counts of links need each pair of a bucket compared: of a bucket of n classes each payload
  is sent n / tile times, so what is shuffled for it grows with n * n / tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytesoup import trimmed
from tidemark.llm.common import connected_components, cut, hot_from, join_hot

#: Payloads of a group's classes to the table of which pairs link.
Near = Callable[[list[np.ndarray]], np.ndarray]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of all pairs of sorted sets: products of blocks of the 0/1 table of sets and values."""
    k = len(sets)
    if k == 2:
        both = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[ids] > 1
    owner, ids = owner[keep], ids[keep]
    dense = np.cumsum(counts > 1) - 1
    ids = dense[ids]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    out, width = np.zeros((k, k), np.float32), max(64, 4_000_000 // k)
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        a, b = np.searchsorted(ids, (lo, lo + width))
        block = np.zeros((k, width), np.float32)
        block[owner[a:b], ids[a:b] - lo] = 1
        out += block @ block.T
    return out


def _verify(keys: list[bytes], rows: np.ndarray, sides: np.ndarray, buckets: list[np.ndarray], bucket: int, near: np.ndarray) -> Iterator[tuple[bytes, int, bytes]]:
    """sides: the tile (0 or 1) of each class; if both occur, only pairs across count."""
    np.fill_diagonal(near, False)
    if sides.min() != sides.max():
        near &= sides[:, None] != sides[None, :]
    if not near.any():
        return
    count = near
    earlier = [b[b < bucket] for b in buckets]
    if any(map(len, earlier)):
        count = near & ~(shared_counts(earlier) > 0)
    links = count @ rows
    rank = np.argsort(np.argsort(np.array(keys, object)))
    root = rank.copy()
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(keys)).min(1))
        if (new == root).all():
            break
        root = new
    by_rank = np.argsort(rank)
    for i in np.flatnonzero(near.any(1)):
        yield keys[i], int(links[i]), keys[by_rank[root[i]]]


def _verifier(near: Near, kind: type):
    """Groups come whole and one after another; a group may go over several batches."""

    def done(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) > 1:
            _, bucket, sides, keys, sizes, buckets, payload = zip(*rows, strict=True)
            yield from _verify(list(keys), np.array(sizes, np.int64), np.array(sides), list(buckets), bucket[0], near(list(payload)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = [], []

        def flush() -> pa.RecordBatch:
            columns, out[:] = list(zip(*out, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["cls", "links", "root"])

        for batch in batches:
            flat = [batch.column(x).to_pylist() for x in ("g", "bucket", "side", "cls", "n_rows")]
            lists = []
            for c, of in ((batch.column("buckets"), np.int64), (batch.column("payload"), kind)):
                edge, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).view(of)
                lists.append([values[edge[i] : edge[i + 1]].copy() for i in range(len(c))])
            for row in zip(*flat, *lists, strict=True):
                if rows and rows[0][0] != row[0]:
                    out += done(rows)
                    rows = []
                if not rows or rows[-1][3] != row[3]:  # a repeated row brings its class twice
                    rows.append(row)
            if len(out) > 2000:
                yield flush()
        out += done(rows)
        if out:
            yield flush()

    return verify


def named(classes: DataFrame) -> DataFrame:
    """classes (cls, class_id, ...) with `hash`, the cls it had, and as cls a name that sorts by class_id (null last), then hash."""
    none, least = F.col("class_id").isNull(), F.lit(1 - 2**63) - 1
    number = F.unhex(F.lpad(F.hex(F.coalesce("class_id", F.lit(0)).bitwiseXOR(least)), 16, "0"))
    return classes.withColumnRenamed("cls", "hash").withColumn("cls", F.concat(F.unhex(F.when(none, "01").otherwise("00")), number, "hash"))


def class_id_of(name):
    """The class_id within a name."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number.cast("long"))


def shared(classes: DataFrame, values: str, tile: int) -> DataFrame:
    """cls, bucket, tiles: which classes are in which buckets. classes: cls and an array of values."""
    member = classes.select("cls", F.explode(values).alias("bucket"))
    sums = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"))
    buckets = sums.where("size > 1").groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket"))
    tiles = F.ceil(F.col("size") / tile).cast("int").alias("tiles")
    return cut(member.join(buckets.select("bucket", tiles), "bucket").select("cls", "bucket", "tiles"))


def linked(classes: DataFrame, placed: DataFrame, payload: DataFrame, near: Near, kind: type) -> DataFrame:
    """cls, links, root for every class: linked rows of other classes, and the component's least class.

    classes: cls, n_rows. placed: from shared(). payload: cls, buckets, payload (an array that
    numpy reads as `kind`) for the classes that are in buckets.
    """
    mine = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("tiles")).cast("int")
    place = placed.withColumn("mine", mine).select("cls", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    place = place.select(
        "cls",
        "bucket",
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"),
    )
    dealt = place.join(payload, "cls").repartition(F.col("g")).sortWithinPartitions("g", "bucket", "cls")
    dealt = dealt.select("g", "bucket", "side", "cls", "n_rows", "buckets", "payload")
    found = cut(dealt.mapInArrow(trimmed(_verifier(near, kind)), "cls binary, links bigint, root binary"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("cls", "root"), "cls", "root").withColumnRenamed("node", "cls")
    out = classes.select("cls", "n_rows").join(roots, "cls", "left").join(links, "cls", "left")
    return out.select("cls", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"))


def buckets_of(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cls").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))


def with_class(rows: DataFrame, classes: DataFrame, found: DataFrame, *extra) -> DataFrame:
    """rows (with cls, a class's hash or null) left-joined with class_id, links, root, n_rows, name and extra columns of their class."""
    total = classes.agg(F.sum("n_rows")).first()[0] or 0
    one = classes.join(found, "cls").select(F.col("hash").alias("cls"), "class_id", "links", "root", F.col("cls").alias("name"), "n_rows", *extra, F.col("n_rows").alias("n"))
    return join_hot(rows, one, "cls", hot_from(total))


def per_row(rows: DataFrame, classes: DataFrame, found: DataFrame, row_id: str) -> DataFrame:
    """All columns of rows (which has row_id and a cls, null for what links with nothing), class_id, n_links, component_id, kept.

    classes: from named(), with n_rows.
    """
    out = with_class(rows, classes, found)
    component = F.when(F.col("cls").isNull(), F.col(row_id)).otherwise(class_id_of(F.col("root")))
    out = out.withColumn("component_id", component)
    return out.select(
        *rows.columns,
        "class_id",
        F.coalesce(F.col("n_rows") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        (F.col("cls").isNull() | F.col(row_id).eqNullSafe(F.col("component_id"))).alias("kept"),
    )

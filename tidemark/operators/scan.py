"""The read path: bounds, cursors, visibility, capacity, offsets, missing blobs and where offsets came from.

An index row is a batch: topic, vp, window_start, snowflake_id, seq_start, seq_end (inclusive),
byte_start, byte_end (half-open), payload_bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.log import VP
from tidemark.plans.windows import shared_floor


def window_scan(index: DataFrame, topic: str, windows: list[int], min_snowflake: int | None = None) -> DataFrame:
    """One scan of a topic's windows with literal bounds, so that partitions are pruned and filters reach the files."""
    out = index.where((F.col("topic") == topic) & F.col("window_start").isin(windows))
    return out if min_snowflake is None else out.where(F.col("snowflake_id") >= min_snowflake)


def valid_rows(index: DataFrame) -> DataFrame:
    """Index rows that make sense; others are left out and the scan goes on."""
    return index.where((F.col("seq_start") <= F.col("seq_end")) & (F.col("byte_start") < F.col("byte_end")) & (F.col("vp") >= 0) & F.col("snowflake_id").isNotNull())


def bounded_scan(index: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows at or after their partition's own bound, with the floor of the scan that the partitions share.

    bounds: topic, vp, min_snowflake (null: from the beginning). Partitions without a row aren't wanted.
    """
    floors = shared_floor(bounds, ["topic"])
    out = index.join(F.broadcast(bounds), VP).join(F.broadcast(floors), "topic")
    out = out.where(F.col("floor").isNull() | (F.col("snowflake_id") >= F.col("floor")))
    return out.where(F.col("min_snowflake").isNull() | (F.col("snowflake_id") >= F.col("min_snowflake")))


def after_cursor(index: DataFrame, cursors: DataFrame) -> DataFrame:
    """Batches with something after the cursor, and from which offset on to deliver. An unknown cursor keeps all.

    Adds cursor, deliver_from and suffix (the batch is cut). cursors: topic, vp, cursor.
    """
    out = index.join(cursors, VP, "left").where(F.col("cursor").isNull() | (F.col("seq_end") > F.col("cursor")))
    begin = F.greatest(F.col("seq_start"), F.coalesce(F.col("cursor") + 1, F.col("seq_start")))
    return out.withColumn("deliver_from", begin).withColumn("suffix", begin > F.col("seq_start"))


def exploded(batches: DataFrame, begin: str = "deliver_from") -> DataFrame:
    """A row for each offset from `begin` to seq_end."""
    return batches.withColumn("offset", F.explode(F.sequence(F.col(begin), F.col("seq_end"))))


def visibility(index: DataFrame, cutoff_ms: int) -> DataFrame:
    """Adds visible: published at the cutoff or before; the rest is deferred, not lost."""
    return index.withColumn("visible", F.col("published_ms") <= cutoff_ms)


def capacity_prefix(batches: DataFrame, capacity: int | Column, by: list[str], order: list[str]) -> DataFrame:
    """Adds admitted: in order, all before the first that doesn't fit; the very first fits whatever its size.

    A capacity may be a column that is the same for all rows of a `by`.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    upto = F.sum("payload_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return batches.withColumn("admitted", (upto <= capacity) | (F.row_number().over(w) == 1))


def next_batch(records: DataFrame, most_records: int, most_bytes: int, by: list[str], order: list[str]) -> DataFrame:
    """The records of one delivery: the first always, then while number and bytes fit."""
    w = Window.partitionBy(*by).orderBy(*order)
    n, upto = F.row_number().over(w), F.sum("payload_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = records.withColumn("__n", n).withColumn("__b", upto)
    return kept.where((F.col("__n") == 1) | ((F.col("__n") <= most_records) & (F.col("__b") <= most_bytes))).drop("__n", "__b")


def lost(batches: DataFrame, blobs: DataFrame) -> DataFrame:
    """Batches whose blob is missing: counted, skipped by cursors, never delivered. blobs: blob_key."""
    return batches.join(blobs.select("blob_key").distinct(), "blob_key", "left_anti")


def read_spans(batches: DataFrame) -> DataFrame:
    """One enclosing range for each segment, so that each blob is opened once; and how much of it nobody asked for."""
    out = batches.groupBy("topic", "window_start", "snowflake_id").agg(
        F.min("byte_start").alias("span_start"), F.max("byte_end").alias("span_end"), F.sum(F.col("byte_end") - F.col("byte_start")).cast("long").alias("wanted"), F.count(F.lit(1)).alias("ranges")
    )
    return out.withColumn("overfetch", F.col("span_end") - F.col("span_start") - F.col("wanted"))


def frontier(batches: DataFrame) -> DataFrame:
    """The greatest id admitted for each partition and window."""
    return batches.groupBy(*VP, "window_start").agg(F.max("snowflake_id").alias("frontier"))


def offset_sources(offsets: DataFrame, batches: DataFrame, stride: int = 1024) -> DataFrame:
    """Which batch each offset came from: an interval join dealt out by stretches of offsets.

    A batch goes to every stretch that it touches, an offset to its own, so it is an equi-join on
    topic, partition and stretch; a hot partition is spread over its stretches. Offsets outside
    all batches get nulls.
    """
    wide = batches.withColumn("__stretch", F.explode(F.sequence(F.floor(F.col("seq_start") / stride), F.floor(F.col("seq_end") / stride))))
    o, b = offsets.withColumn("__stretch", F.floor(F.col("offset") / stride)).alias("o"), wide.alias("b")
    cond = [F.col(f"o.{k}") == F.col(f"b.{k}") for k in (*VP, "__stretch")]
    inside = (F.col("b.seq_start") <= F.col("o.offset")) & (F.col("o.offset") <= F.col("b.seq_end"))
    joined = o.join(b, [*cond, inside], "left")
    return joined.select(*[F.col(f"o.{c}") for c in offsets.columns], F.col("b.window_start").alias("source_window"), F.col("b.snowflake_id").alias("source_snowflake"))


def deduplicated(index: DataFrame) -> DataFrame:
    """Rows read twice (from a cache and again) once: rows never change after they are written."""
    return index.dropDuplicates([*VP, "window_start", "snowflake_id"])


def newest(batches: DataFrame, keep: int) -> DataFrame:
    """The last so many batches of each partition by id."""
    rank = F.row_number().over(Window.partitionBy(*VP).orderBy(F.desc("snowflake_id")))
    return batches.withColumn("__r", rank).where(F.col("__r") <= keep).drop("__r")


def cached_windows(windows: DataFrame, most_bytes: int, most_entries: int) -> DataFrame:
    """Windows that stay in a cache which drops the oldest until bytes and entries fit. windows: topic, window_start, bytes, entries."""
    w = Window.partitionBy("topic").orderBy(F.desc("window_start")).rowsBetween(Window.unboundedPreceding, 0)
    out = windows.withColumn("__b", F.sum("bytes").over(w)).withColumn("__e", F.sum("entries").over(w))
    return out.withColumn("kept", (F.col("__b") <= most_bytes) & (F.col("__e") <= most_entries)).drop("__b", "__e")


def hold(candidates: DataFrame, now_ms: int, horizon_ms: int, size_s: int) -> DataFrame:
    """Adds held and matures_ms: batches that leave a gap after the cursor while their window may still get what is missing.

    candidates: cursor, seq_start, window_start. A gap in a window that is over is accepted.
    """
    gap = F.col("seq_start") > F.col("cursor") + 1
    matures = (F.col("window_start") * 1000 + horizon_ms).cast("long")
    held = gap & (F.col("window_start") * 1000 > now_ms - horizon_ms)
    return candidates.withColumn("held", F.coalesce(held, F.lit(False))).withColumn("matures_ms", F.when(held, matures))


def cursor_relation(seq_start: Column, seq_end: Column, cursor: Column) -> Column:
    return F.when(seq_end <= cursor, "before_or_at").when(seq_start <= cursor + 1, "crosses").otherwise("after")


def rotation(partitions: DataFrame, last: str = "last_vp") -> DataFrame:
    """Adds turn: 0 for the least partition after the last one served, around the ring. Columns: topic, vp, last_vp."""
    w = Window.partitionBy("topic").orderBy((F.col("vp") <= F.col(last)).cast("int"), "vp")
    return partitions.withColumn("turn", F.row_number().over(w) - 1)


def query_violations(rows: DataFrame, bounds: DataFrame, floor: int) -> DataFrame:
    """What a served window may not hold: ids twice, partitions nobody asked for, rows before a bound or the floor."""
    twice = Window.partitionBy(*VP, "window_start", "snowflake_id")
    out = rows.withColumn("__n", F.count(F.lit(1)).over(twice)).join(bounds.withColumn("__asked", F.lit(True)), VP, "left")
    kind = (
        F.when(F.col("__n") > 1, "duplicate_id")
        .when(F.col("__asked").isNull(), "partition_not_requested")
        .when(F.col("snowflake_id") < F.col("min_snowflake"), "below_bound")
        .when(F.col("snowflake_id") < floor, "below_floor")
    )
    return out.withColumn("violation", kind).where(F.col("violation").isNotNull()).drop("__n", "__asked", "min_snowflake")

"""Reports on the index: gaps, overlaps and order after a cursor, delivery, lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.log import VP
from tidemark.operators.scan import cursor_relation


def continuity(index: DataFrame, cursors: DataFrame, order: list[str], name: str) -> DataFrame:
    """Issues of each partition's batches after its cursor, in an order: gap, overlap, out_of_order.

    The frontier is the greatest end before a row, its start the start of the row that first
    raised it so far; both come from one running aggregate. Columns: topic, vp, order_name, kind,
    issue_start, issue_end, expected_at_least (for out_of_order).
    """
    rows = index.join(F.broadcast(cursors), VP)
    place = F.row_number().over(Window.partitionBy(*VP).orderBy(*order))
    rows = rows.withColumn("__pos", place)
    before = Window.partitionBy(*VP).orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    end, c = F.max("seq_end").over(before), F.col("cursor")
    start = F.max_by("seq_start", F.struct("seq_end", -F.col("__pos"))).over(before)
    rows = rows.withColumn("__pe", end).withColumn("__ps", start)
    expected = F.greatest(c, F.coalesce("__pe", c)) + 1
    high = F.when(F.col("__pe").isNull() | (F.col("__pe") <= c), c + 1).otherwise(F.col("__ps"))
    rows = rows.withColumn("__ne", expected).withColumn("__hs", high)
    ne, s, e = F.col("__ne"), F.col("seq_start"), F.col("seq_end")
    kind = F.when(e < ne, F.when(s >= F.col("__hs"), "overlap").otherwise("out_of_order")).when(s > ne, "gap").otherwise("overlap")
    begin = F.when(e < ne, s).when(s > ne, ne).otherwise(F.greatest(s, c + 1))
    stop = F.when(e < ne, e).when(s > ne, s - 1).otherwise(ne - 1)
    keep = ((e < ne) & (e > c)) | (s > ne) | ((e >= ne) & (s <= ne) & (F.greatest(s, c + 1) < ne))
    rows = rows.where(keep).withColumn("kind", kind)
    return rows.select(
        *VP, F.lit(name).alias("order_name"), "kind", begin.alias("issue_start"), stop.alias("issue_end"), F.when(F.col("kind") == "out_of_order", ne).alias("expected_at_least")
    )


def order_divergence(index: DataFrame, source: list[str], sequence: list[str]) -> DataFrame:
    """Whether a partition's source order is its sequence order."""
    a = F.row_number().over(Window.partitionBy(*VP).orderBy(*source))
    b = F.row_number().over(Window.partitionBy(*VP).orderBy(*sequence))
    out = index.withColumn("__a", a).withColumn("__b", b)
    return out.groupBy(*VP).agg(F.bool_and(F.col("__a") == F.col("__b")).alias("same_order"), F.count(F.lit(1)).alias("batches"))


def cursor_context(index: DataFrame, cursors: DataFrame, around: int) -> DataFrame:
    """The batches around the first that ends after the cursor (or the last ones), with their relation to it."""
    rows = index.join(F.broadcast(cursors), VP)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(*VP).orderBy("seq_start", "snowflake_id")) - 1)
    all_ = Window.partitionBy(*VP)
    first = F.min(F.when(F.col("seq_end") > F.col("cursor"), F.col("position"))).over(all_)
    rows = rows.withColumn("__first", F.coalesce(first, F.max("position").over(all_) + 1))
    rows = rows.where(F.col("position").between(F.col("__first") - around, F.col("__first") + around))
    return rows.withColumn("relation", cursor_relation(F.col("seq_start"), F.col("seq_end"), F.col("cursor"))).drop("__first")


def delivery_gaps(delivered: DataFrame) -> DataFrame:
    """Where a partition's delivered offsets leave some out. delivered: topic, vp, delivery_idx, offset."""
    before = F.lag("offset").over(Window.partitionBy(*VP).orderBy("delivery_idx"))
    out = delivered.withColumn("previous", before).where(F.col("offset") > F.col("previous") + 1)
    return out.select(*VP, "delivery_idx", "previous", "offset", (F.col("offset") - F.col("previous") - 1).alias("missing"))


def delivered_ranges(delivered: DataFrame) -> DataFrame:
    """Runs of consecutive offsets of one source. delivered: topic, vp, delivery_idx, offset, window_start."""
    w = Window.partitionBy(*VP, "window_start").orderBy("delivery_idx")
    runs = delivered.withColumn("__run", F.col("offset") - F.row_number().over(w))
    out = runs.groupBy(*VP, "window_start", "__run").agg(F.min("offset").alias("range_start"), F.max("offset").alias("range_end"), F.count(F.lit(1)).alias("delivered"))
    return out.drop("__run")


def lagging(checkpoints: DataFrame, current_window: int) -> DataFrame:
    """Partitions without a checkpoint, or whose checkpoint is from another window than the current. checkpoints: topic, vp, ckpt_window."""
    reason = F.when(F.col("ckpt_window").isNull(), "no_checkpoint").when(F.col("ckpt_window") != current_window, "behind")
    out = checkpoints.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return out.withColumn("behind_s", F.lit(current_window) - F.col("ckpt_window"))


def stress_validation(expected: DataFrame, observed: DataFrame, run: str) -> DataFrame:
    """One row: how many of the expected ids were seen once, more often or never, and records of other runs.

    expected: producer, sequence. observed: run, producer, sequence; a row each record. Counts are
    per id, so a duplicate can't hide a missing one.
    """
    key = ["producer", "sequence"]
    seen = observed.where(F.col("run") == run).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    joined = expected.withColumn("__want", F.lit(True)).join(seen, key, "full")
    want, n = F.col("__want").isNotNull(), F.coalesce("n", F.lit(0))
    out = joined.agg(
        F.count_if(want).alias("expected"),
        F.count_if(want & (n > 0)).alias("unique_seen"),
        F.coalesce(F.sum(F.when(want & (n > 1), n - 1)), F.lit(0)).cast("long").alias("duplicates"),
        F.count_if(want & (n == 0)).alias("missing"),
        F.count_if(~want).alias("unexpected"),
    )
    other = observed.agg(F.count_if(F.col("run") != run).alias("other_runs"))
    return out.join(other)


def parse_payload(payload):
    """run, producer, sequence of a 32-byte header "BSS1", run id, producer and sequence (big endian); nulls if it is none."""
    text = F.hex(payload)
    ok = (F.octet_length(payload) >= 32) & (F.substring(text, 1, 8) == "42535331")
    number = lambda at, n: F.conv(F.substring(text, at, n), 16, 10).cast("long")
    return F.struct(F.when(ok, F.lower(F.substring(text, 9, 32))).alias("run"), F.when(ok, number(41, 8)).alias("producer"), F.when(ok, number(49, 16)).alias("sequence"))


def inspect_metadata(index: DataFrame, cursors: DataFrame, checkpoints: DataFrame, latest: int) -> DataFrame:
    """One report for each topic: topic, segments, batches, records, gaps, overlaps, out_of_order, same_order, lagging.

    index: topic, vp, window_start, snowflake_id, seq_start, seq_end, record_count. Issues are those
    past the cursors, in order of ids. checkpoints: topic, vp, ckpt_window; latest: the window that
    readers should have come to.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    sizes = index.groupBy("topic").agg(F.count_distinct("snowflake_id").alias("segments"), F.count(F.lit(1)).alias("batches"), F.sum("record_count").cast("long").alias("records"))
    issues = continuity(index, cursors, ["snowflake_id", "seq_start"], "source").groupBy("topic").agg(of("gap").alias("gaps"), of("overlap").alias("overlaps"), of("out_of_order").alias("out_of_order"))
    order = order_divergence(index, ["snowflake_id", "seq_start"], ["seq_start", "snowflake_id"]).groupBy("topic").agg(F.bool_and("same_order").alias("same_order"))
    late = lagging(checkpoints, latest).groupBy("topic").agg(F.count(F.lit(1)).alias("lagging"))
    out = sizes.join(issues, "topic", "left").join(order, "topic", "left").join(late, "topic", "left")
    return out.fillna(0, ["gaps", "overlaps", "out_of_order", "lagging"])

"""Where readers stand: resuming from checkpoints, seeking, modes, and what sealed metadata spares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import id_floor, id_time_ms
from tidemark.operators.log import VP
from tidemark.plans.windows import floor_s


def _window(ms: Column, size_s: int) -> Column:
    s = F.floor(ms / 1000)
    return s - F.pmod(s, F.lit(size_s))


def hydrate(cursors: DataFrame, now_ms: int, size_s: int, retention_s: int, horizon_ms: int) -> DataFrame:
    """Adds mode, next_window, cutover_window and first_bound to committed cursors.

    cursors: topic, vp, cursor, ckpt_window, ckpt_snowflake, committed_ms. The source window is the
    checkpoint's, else that of the commit, else the retention's floor, and never before the floor.
    From a window up to the current one a reader recovers, with a bound in the first window if the
    checkpoint is in it; from a later one it reads fast. No cursor: fresh, at the current window.
    """
    cutover = floor_s(now_ms, size_s)
    floor = floor_s(cutover * 1000 - retention_s * 1000, size_s)
    source = F.greatest(F.coalesce(F.col("ckpt_window"), _window(F.col("committed_ms"), size_s), F.lit(floor)), F.lit(floor))
    fresh, recovers = F.col("cursor").isNull(), source <= cutover
    at = id_time_ms(F.col("ckpt_snowflake")) - horizon_ms
    bound = F.when(~fresh & recovers & (F.col("ckpt_window") == source), id_floor(F.greatest(at, source * 1000)))
    mode = F.when(fresh, "fresh").when(recovers, "recovering").otherwise("fast")
    out = cursors.withColumns({"mode": mode, "next_window": F.when(fresh, F.lit(cutover)).when(recovers, source), "first_bound": bound})
    return out.withColumn("cutover_window", F.lit(cutover).cast("long"))


def seek(requests: DataFrame, now_ms: int, size_s: int, retention_s: int) -> DataFrame:
    """Adds start_window and start_bound: the window aligned, within retention and not after the current one; the id counts only in that window.

    requests: topic, vp, offset, window_start, snowflake_id (null: none).
    """
    cutover = floor_s(now_ms, size_s)
    floor = floor_s(cutover * 1000 - retention_s * 1000, size_s)
    aligned = F.col("window_start") - F.pmod("window_start", F.lit(size_s))
    start = F.least(F.greatest(aligned, F.lit(floor)), F.lit(cutover))
    return requests.withColumn("start_window", start).withColumn("start_bound", F.when(F.col("start_window") == aligned, F.col("snowflake_id")))


def fast_debt(states: DataFrame, now_ms: int, size_s: int, horizon_ms: int, retention_floor: int) -> DataFrame:
    """Adds plan: what a fast reader owes for windows before the ones still open.

    states: topic, vp, coverage_floor_ms. Nothing if its floor's window is open, a tail scan if it
    is the one before, else recovery from that window.
    """
    first = floor_s(now_ms - horizon_ms, size_s)
    window = F.greatest(_window(F.col("coverage_floor_ms"), size_s), F.lit(retention_floor))
    plan = F.when(window >= first, "none").when(window + size_s == first, "tail").otherwise("recover")
    return states.withColumn("coverage_window", window).withColumn("plan", plan)


def fast_bound(states: DataFrame, now_ms: int, horizon_ms: int) -> DataFrame:
    """Adds bound: from which id a fast reader scans a window: its start, or the safe time or coverage floor if later, or its frontier.

    states: topic, vp, window_start, coverage_floor_ms, frontier (null: none).
    """
    safe = F.least(F.lit(now_ms - horizon_ms), F.col("coverage_floor_ms"))
    start = id_floor(F.greatest(F.col("window_start") * 1000, safe))
    return states.withColumn("bound", F.greatest(start, F.coalesce("frontier", start)))


def after_pass(states: DataFrame, size_s: int) -> DataFrame:
    """Adds new_mode and new_window after a pass of reading.

    states: topic, vp, mode, scanned_window, deferred (something wasn't visible or didn't fit),
    cutover_window. A fresh reader that saw its whole window turns fast; a recovering one moves on
    by one window, back to the deferred one, and turns fast beyond its cutover.
    """
    on = F.when(F.col("deferred"), F.col("scanned_window")).otherwise(F.col("scanned_window") + size_s)
    done = (F.col("mode") == "fresh") & ~F.col("deferred") | (F.col("mode") == "recovering") & (on > F.col("cutover_window"))
    mode = F.when(done, "fast").otherwise(F.col("mode"))
    return states.withColumn("new_mode", mode).withColumn("new_window", F.when(mode == "fast", F.lit(None)).otherwise(on))


def seal(participants: DataFrame, bounds: DataFrame) -> DataFrame:
    """sealed_before, reusable for each topic and window: what cached metadata is complete up to for all that share it.

    participants: topic, window_start, vp, sealed_before (null: not covered). The least seal
    counts; a partition without one whose bound is before it makes the cache useless. bounds:
    topic, vp, min_snowflake.
    """
    low = participants.groupBy("topic", "window_start").agg(F.min("sealed_before").alias("least"))
    rows = participants.join(F.broadcast(bounds), VP, "left").join(low, ["topic", "window_start"])
    owes = F.col("sealed_before").isNull() & (F.col("min_snowflake").isNull() | (F.col("min_snowflake") < F.col("least")))
    out = rows.groupBy("topic", "window_start").agg(F.first("least").alias("sealed_before"), (F.count_if(owes) == 0).alias("reusable"))
    return out.withColumn("reusable", F.col("reusable") & F.col("sealed_before").isNotNull())


def merged(cached: DataFrame, fresh: DataFrame, seals: DataFrame) -> DataFrame:
    """Cached rows before the seal and freshly read ones from it on, each id once, by partition and id.

    cached, fresh: index rows. seals: topic, window_start, sealed_before.
    """
    key = ["topic", "window_start"]
    old = cached.join(F.broadcast(seals), key).where(F.col("snowflake_id") < F.col("sealed_before"))
    new = fresh.join(F.broadcast(seals), key, "left").where(F.col("sealed_before").isNull() | (F.col("snowflake_id") >= F.col("sealed_before")))
    return old.unionByName(new).drop("sealed_before").dropDuplicates([*VP, "window_start", "snowflake_id"])


def membership_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """topic, vp, change of assignments that came or went."""
    came = after.join(before, VP, "left_anti").select(*VP, F.lit("added").alias("change"))
    return came.unionByName(before.join(after, VP, "left_anti").select(*VP, F.lit("removed").alias("change")))


def response_projection(index: DataFrame, requested: DataFrame, most_rows: int) -> DataFrame:
    """What a served window holds for a request: its partitions' rows at or after their bounds, the first so many by id.

    requested: topic, vp, min_snowflake (null: all). Segments without a requested partition drop out by themselves.
    """
    rows = index.join(F.broadcast(requested), VP).where(F.col("min_snowflake").isNull() | (F.col("snowflake_id") >= F.col("min_snowflake")))
    rank = F.row_number().over(Window.partitionBy("topic", "window_start").orderBy("snowflake_id", "vp"))
    return rows.withColumn("__r", rank).where(F.col("__r") <= most_rows).drop("__r", "min_snowflake")


def request_violation(requests: DataFrame, size_s: int, most: int = 1024) -> DataFrame:
    """Adds violation to window requests by the first rule broken: alignment, coverage, partitions.

    requests: window_start, tail (array of vps or null), full (array or null), partitions.
    """
    wanted = F.coalesce("tail", "full")
    bad = (
        F.when(F.pmod("window_start", F.lit(size_s)) != 0, "unaligned_window")
        .when(F.col("tail").isNull() == F.col("full").isNull(), "one_coverage_needed")
        .when(F.size(wanted) == 0, "no_partitions")
        .when(F.size(wanted) > most, "too_many_partitions")
        .when(F.size(F.array_distinct(wanted)) != F.size(wanted), "partition_twice")
        .when(F.exists(wanted, lambda v: (v < 0) | (v >= F.col("partitions"))), "invalid_partition")
    )
    return requests.withColumn("violation", bad)

"""What clients and coordinators decide: one result per produced record, members, repairs, revocations, drains, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import varint_size
from tidemark.operators.log import VP, append_status, assign_offsets

#: The most bytes of an encoded record.
MOST_BYTES = 16 * 2**20


def encoded_bytes(key_bytes: Column, payload_bytes: Column) -> Column:
    """Size of a record: key and payload, each with its length as a varint, and eight bytes of time."""
    return key_bytes + varint_size(key_bytes) + payload_bytes + varint_size(payload_bytes) + 8


def too_large(size: Column, most: int = MOST_BYTES) -> Column:
    """Whether a record of that encoded size is rejected before it is batched. A null size isn't."""
    return F.coalesce(size > most, F.lit(False))


def produce(records: DataFrame, topics: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """input_idx, status, offset: one result for each record, whatever becomes of the others.

    records: input_idx, topic, vp, window_start, arrival, encoded_bytes, overloaded, assigned,
    draining. topics: topic, partition_count, num_writers (few rows, joined by shuffle or broadcast
    as their size tells). Only accepted records get an offset, contiguous in their partition.
    """
    told = append_status(records.withColumn("record_count", F.lit(1)).join(topics, "topic", "left"))
    status = F.when((F.col("status") != "UNKNOWN_TOPIC") & too_large(F.col("encoded_bytes"), most), "TOO_LARGE").otherwise(F.col("status"))
    told = told.withColumn("status", status).select("input_idx", *VP, "window_start", "arrival", "status")
    accepted = assign_offsets(told.where("status = 'OK'")).select("input_idx", "status", "offset")
    return accepted.unionByName(told.where("status <> 'OK'").select("input_idx", "status", F.lit(None).cast("long").alias("offset")))


def active_members(members: DataFrame, now_ms: int) -> DataFrame:
    """Members whose lease has not expired (at its very instant it has), each once, in order. members: topic, member_id, expiry_ms."""
    return members.where(F.col("expiry_ms") > now_ms).select("topic", "member_id").distinct().orderBy("topic", "member_id")


def repair_gate(members: DataFrame, plan: DataFrame, violations: DataFrame, now_ms: int) -> DataFrame:
    """topic, joined, left, valid, repair: a plan is repaired only if it is invalid or its members aren't the active ones.

    plan: topic, vp, member_id. violations: topic, ... (of the accepted plan; no row: valid).
    """
    active = active_members(members, now_ms).withColumn("a", F.lit(True))
    planned = plan.select("topic", "member_id").distinct().withColumn("p", F.lit(True))
    both = active.join(planned, ["topic", "member_id"], "full").groupBy("topic")
    out = both.agg(F.count_if(F.col("p").isNull()).alias("joined"), F.count_if(F.col("a").isNull()).alias("left"))
    bad = violations.select("topic").distinct().withColumn("bad", F.lit(True))
    out = out.join(bad, "topic", "left").withColumn("valid", F.col("bad").isNull()).drop("bad")
    return out.withColumn("repair", ~F.col("valid") | (F.col("joined") > 0) | (F.col("left") > 0))


def revocations(before: DataFrame, after: DataFrame, buffered: DataFrame) -> DataFrame:
    """topic, vp, member_id, dropped, fence: partitions that a member lost, told before any of its records.

    What it holds of them (buffered: topic, vp, offset, delivered) is dropped unless delivered;
    fence is the last delivered offset, which alone may still be committed (null: none).
    """
    lost = before.join(after, [*VP, "member_id"], "left_anti").select(*VP, "member_id")
    held = buffered.groupBy(*VP).agg(F.count_if(~F.col("delivered")).alias("dropped"), F.max(F.when(F.col("delivered"), F.col("offset"))).alias("fence"))
    return lost.join(held, VP, "left").select(*VP, "member_id", F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"), "fence")


def drain_violations(events: DataFrame) -> DataFrame:
    """topic, vp, seq, violation: steps of a lease that come out of turn.

    Turns: admit, stop (no more admission), drained, release, and admit again. events: topic, vp,
    seq, step. One partition's log is one window; steps are few beside records.
    """
    before = F.lag("step").over(Window.partitionBy(*VP).orderBy("seq"))
    due = F.create_map(*map(F.lit, ("admit", "release", "stop", "admit", "drained", "stop", "release", "drained")))
    name = F.create_map(*map(F.lit, ("admit", "admitted_before_release", "stop", "stopped_without_admission", "drained", "drained_while_admitting", "release", "released_before_drain")))
    told = events.withColumn("before", before)
    wrong = (F.element_at(due, F.col("step")) != F.col("before")) | (F.col("before").isNull() & (F.col("step") != "admit"))
    return told.where(wrong).select(*VP, "seq", F.element_at(name, F.col("step")).alias("violation"))


def histogram(values: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """by, bucket (upper bound, null: above all), n, upto: how many values are in each bucket, and in it or a lower one. Null values count nowhere."""
    place = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        place = F.when(F.col(value) <= bounds[k], k).otherwise(place)
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    slim = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # a row for each bucket
    upper = F.get(F.array(*[F.lit(float(b)) for b in bounds]), F.col("place"))
    return counts.select(*by, upper.alias("bucket"), "n", F.sum("n").over(slim).alias("upto"))


def oldest_cache_age(entries: DataFrame, now_ms: int, by: list[str]) -> DataFrame:
    """by, oldest_ms: the greatest age of cached entries (observed_ms); an entry from the future has age 0."""
    return entries.groupBy(*by).agg(F.max(F.greatest(F.lit(0), F.lit(now_ms) - F.col("observed_ms"))).cast("long").alias("oldest_ms"))


def capacity_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, calls, units, pages: what calls to the store consumed (units: null counts as 0)."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("units", F.lit(0.0))).alias("units"), F.sum("pages").cast("long").alias("pages"))

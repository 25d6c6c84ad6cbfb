"""When a writer flushes what it holds, and how batches are grouped for brokers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flush_trigger(draining: Column, age_ms: Column, buffered_bytes: Column, delay_ms: int, most_bytes: int) -> Column:
    """Why a partition's buffer is flushed now, null if it isn't: a drain, then its age, then its bytes."""
    due = F.when(draining, "lease_drain").when(age_ms >= delay_ms, "max_delay").when(buffered_bytes >= most_bytes, "max_bytes")
    return F.when(buffered_bytes > 0, due)


def flush_plan(buffers: DataFrame, delay_ms: int, most_bytes: int, last_topic: str | None = None, fenced: int | None = 99) -> DataFrame:
    """The partitions of the next flush: topic, vp, trigger, turn.

    buffers: topic, vp, draining, age_ms, buffered_bytes (one scheduler's, so a small table). Once
    any partition is due by age, all that aren't draining join one shared flush, up to `fenced`
    of each topic. Otherwise the first partition after the last served topic that has reached its
    bytes or drains goes alone.
    """
    b = buffers.withColumn("trigger", flush_trigger(F.col("draining"), F.col("age_ms"), F.col("buffered_bytes"), delay_ms, most_bytes)).where("buffered_bytes > 0")
    after = F.lit(0) if last_topic is None else (F.col("topic") <= last_topic).cast("int")
    b = b.withColumn("shared", F.max((F.col("trigger") == "max_delay").cast("int")).over(Window.partitionBy(F.lit(1))) == 1)
    place = F.row_number().over(Window.partitionBy("topic").orderBy("vp"))
    shared = b.where("shared and not draining").withColumn("place", place)
    shared = shared.where(F.col("place") <= (fenced or 2**31 - 1)).select("topic", "vp", F.lit("max_delay").alias("trigger"), after.alias("wrap"))
    alone = b.where("not shared and trigger is not null").select("topic", "vp", "trigger", after.alias("wrap")).orderBy("wrap", "topic", "vp").limit(1)
    out = shared.unionByName(alone)
    return out.withColumn("turn", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("wrap", "topic")) - 1).drop("wrap")


def prefix_split(records: DataFrame, budget: int) -> DataFrame:
    """Adds in_prefix: the most of a batch's records from its front whose encoded sizes fit. records: batch, pos, encoded_bytes."""
    upto = F.sum("encoded_bytes").over(Window.partitionBy("batch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("in_prefix", upto <= budget)


def broker_groups(batches: DataFrame, most_bytes: int) -> DataFrame:
    """Adds part and group: a broker's batches in order packed into requests; one that is too large is cut into parts.

    batches: broker, pos, sizes (encoded sizes of its records in order, each within the limit).
    Where a request ends depends on the one before, so a broker's queue is folded in order.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, group, used = [], 0, 0
        for pos, sizes in zip(rows["pos"], rows["sizes"], strict=True):
            part = records = size = 0
            for s in sizes:
                if used + s > most_bytes:
                    if records:
                        out.append((pos, part, group, records, size))
                        part += 1
                    group, used, records, size = group + 1, 0, 0, 0
                used, records, size = used + int(s), records + 1, size + int(s)
            if records:
                out.append((pos, part, group, records, size))
        frame = pd.DataFrame(out, columns=["pos", "part", "group", "records", "bytes"])
        frame.insert(0, "broker", rows["broker"].iloc[0])
        return frame

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return run(rows.sort_values("pos"))

    return batches.select("broker", "pos", "sizes").groupBy("broker").applyInPandas(ordered, "broker string, pos long, part int, group int, records int, bytes long")


def plan_summary(flushed: DataFrame) -> DataFrame:
    """Flushes by topic and trigger: partitions, records, bytes. flushed: topic, vp, trigger, record_count, payload_bytes."""
    return flushed.groupBy("topic", "trigger").agg(F.count(F.lit(1)).alias("partitions"), F.sum("record_count").cast("long").alias("records"), F.sum("payload_bytes").cast("long").alias("payload_bytes"))


def retry_summary(attempts: DataFrame, samples: int) -> DataFrame:
    """Retries by topic and reason, with the ids of the last few. attempts: topic, reason, at, id."""
    rank = F.row_number().over(Window.partitionBy("topic", "reason").orderBy(F.desc("at"), F.desc("id")))
    total = attempts.groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("retries"))
    last = attempts.withColumn("r", rank).where(F.col("r") <= samples).groupBy("topic", "reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"].cast("string")), ",").alias("newest"))
    return total.join(last, ["topic", "reason"])


def buffered_stats(open_: DataFrame, sealed: DataFrame) -> DataFrame:
    """What waits for each topic, in open and sealed buffers together. Both: topic, record_count, payload_bytes."""
    both = open_.select("topic", "record_count", "payload_bytes", F.lit(0).alias("s")).unionByName(sealed.select("topic", "record_count", "payload_bytes", F.lit(1).alias("s")))
    return both.groupBy("topic").agg(F.sum("record_count").cast("long").alias("records"), F.sum("payload_bytes").cast("long").alias("payload_bytes"), F.sum("s").cast("long").alias("sealed_batches"))

"""The write path of the log as DataFrame operators: admission, offsets, batches, segments, byte layout, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import EPOCH_MS, LOW_BITS, STEP_MS

VP = ["topic", "vp"]


def assign_offsets(records: DataFrame) -> DataFrame:
    """Adds offset: contiguous from 0 for each topic and virtual partition, in order of window and arrival.

    Two levels, so that no task sorts a whole hot partition: counts by window make each window's
    first offset (a running sum over slim rows); rows are numbered within their window only.
    """
    key = [*VP, "window_start"]
    counts = records.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*VP).orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    row = F.row_number().over(Window.partitionBy(*key).orderBy("arrival")) - 1
    return records.withColumn("__row", row).join(base, key).withColumn("offset", (F.col("base") + F.col("__row")).cast("long")).drop("base", "__row")


def batch_summary(records: DataFrame) -> DataFrame:
    """Number of records and bytes for each topic, partition and window; empty groups have no row."""
    return records.groupBy(*VP, "window_start").agg(F.count(F.lit(1)).alias("record_count"), F.sum("payload_bytes").cast("long").alias("payload_bytes"))


def segment_batches(records: DataFrame, overhead: int = 8) -> DataFrame:
    """The index: one segment for each topic and window, one row for each of its partitions.

    A partition's encoded size is its payload and an overhead for each record; byte ranges are
    half-open and follow each other by partition.
    """
    merged = records.groupBy(*VP, "window_start").agg(
        F.min("offset").alias("seq_start"), F.max("offset").alias("seq_end"), F.count(F.lit(1)).alias("record_count"), F.sum("payload_bytes").cast("long").alias("payload_bytes")
    )
    size = F.col("payload_bytes") + overhead * F.col("record_count")
    upto = F.sum(size).over(Window.partitionBy("topic", "window_start").orderBy("vp").rowsBetween(Window.unboundedPreceding, 0))
    step = ((F.col("window_start") * 1000 - EPOCH_MS) / STEP_MS).cast("long")
    snowflake = F.shiftleft(step, LOW_BITS) + F.length("topic")
    return merged.withColumn("snowflake_id", snowflake).withColumn("byte_end", upto.cast("long")).withColumn("byte_start", (F.col("byte_end") - size).cast("long"))


def merge_contiguous(batches: DataFrame, by: list[str]) -> DataFrame:
    """Merges batches by some columns: least start, greatest end, sums, and whether the ranges leave no hole."""
    out = batches.groupBy(*by).agg(
        F.min("seq_start").alias("seq_start"), F.max("seq_end").alias("seq_end"), F.sum("record_count").cast("long").alias("record_count"), F.sum("payload_bytes").cast("long").alias("payload_bytes")
    )
    return out.withColumn("contiguous", F.col("seq_end") - F.col("seq_start") + 1 == F.col("record_count"))


def append_status(requests: DataFrame) -> DataFrame:
    """Adds status by the first rule that holds.

    requests: partition_count, num_writers (null: topic unknown), vp, record_count, overloaded,
    assigned, draining.
    """
    status: Column = (
        F.when(F.col("partition_count").isNull(), "UNKNOWN_TOPIC")
        .when((F.col("vp") < 0) | (F.col("vp") >= F.col("partition_count") * F.col("num_writers")), "BAD_REQUEST")
        .when(F.col("record_count") == 0, "BAD_REQUEST")
        .when(F.col("overloaded"), "OVERLOADED")
        .when(~F.col("assigned") | F.col("draining"), "NOT_LEASE_HOLDER")
        .otherwise("OK")
    )
    return requests.withColumn("status", status)


def response_action(status: Column) -> Column:
    """What a client does with a status: done, fail or retry (also without a response)."""
    return F.when(status == "OK", "done").when(status.isin("UNKNOWN_TOPIC", "BAD_REQUEST"), "fail").otherwise("retry")


def micro_batches(records: DataFrame, most_records: int, most_bytes: int) -> DataFrame:
    """Adds batch: sealed when records or bytes reach a limit; a prefix of the partition's arrivals each.

    Greedy packing depends on where the batch before ended, which no SQL window tells, so the
    arrivals of a partition's window are folded in order in one grouped function. Columns: topic,
    vp, window_start, offset, payload_bytes.
    """

    def pack(rows):
        rows = rows.sort_values("offset")
        batch, n, size, out = 0, 0, 0, []
        for b in rows["payload_bytes"]:
            out.append(batch)
            n, size = n + 1, size + b
            if n >= most_records or size >= most_bytes:
                batch, n, size = batch + 1, 0, 0
        return rows.assign(batch=out)

    slim = records.select(*VP, "window_start", "offset", "payload_bytes")
    return slim.groupBy(*VP, "window_start").applyInPandas(pack, "topic string, vp int, window_start long, offset long, payload_bytes long, batch long")


def hilo_reservations(requests: DataFrame) -> DataFrame:
    """Blocks of offsets reserved by each request of a partition in order: start after the block before, inclusive end.

    requests: topic, vp, arrival, size; sizes below 1 are refused and take nothing.
    """
    ok = F.col("size") > 0
    taken = F.sum(F.when(ok, F.col("size")).otherwise(0)).over(Window.partitionBy(*VP).orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    out = requests.withColumn("block_end", F.when(ok, taken - 1).cast("long"))
    return out.withColumn("block_start", F.when(ok, F.col("block_end") - F.col("size") + 1).cast("long")).withColumn("accepted", ok)


def fence_check(segment_vps: DataFrame, leases: DataFrame, now_ms: int, most: int = 99) -> DataFrame:
    """Whether all partitions of each segment are held by the writer that says so; all or nothing.

    segment_vps: topic, window_start, vp, holder, epoch, session. leases: topic, vp, holder, epoch,
    session, expiry_ms. A lease that expires now has expired.
    """
    s, held = segment_vps.alias("s"), leases.alias("l")
    match = (F.col("l.holder") == F.col("s.holder")) & (F.col("l.epoch") == F.col("s.epoch")) & (F.col("l.session") == F.col("s.session")) & (F.col("l.expiry_ms") > now_ms)
    joined = s.join(held, (F.col("s.topic") == F.col("l.topic")) & (F.col("s.vp") == F.col("l.vp")), "left")
    joined = joined.select("s.topic", "s.window_start", "s.vp", F.coalesce(match, F.lit(False)).alias("ok"))
    out = joined.groupBy("topic", "window_start").agg(F.count(F.lit(1)).alias("fences"), F.count_if(~F.col("ok")).alias("failed"))
    return out.withColumn("committed", (F.col("failed") == 0) & (F.col("fences") <= most))


def ttl_expiry(segments: DataFrame, topics: DataFrame, buffer_s: float) -> DataFrame:
    """Adds expires_s: creation second plus retention plus buffer, each rounded up; null for unknown topics or no retention."""
    out = segments.join(F.broadcast(topics.select("topic", "retention_s")), "topic", "left")
    expires = F.floor(F.col("created_ms") / 1000) + F.ceil("retention_s") + F.ceil(F.lit(float(buffer_s)))
    return out.withColumn("expires_s", F.when(F.col("retention_s") > 0, expires).cast("long")).drop("retention_s")


def publication_status(segments: DataFrame, lag_ms: int) -> DataFrame:
    """Adds published_in_time: metadata must be there before the least lag of its topics is over."""
    return segments.withColumn("published_in_time", F.col("published_ms") - F.col("started_ms") < lag_ms)

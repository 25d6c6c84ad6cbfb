"""Driver tables replayed as streams: files in, micro-batches through the stateful reader, a table out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.log import segment_batches
from tidemark.sources.tables import WINDOW_S, event_records
from tidemark.streaming.reader import read_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder (or, without one, in the warehouse), for streams' files and state."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replay_events(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """Deliveries of the events' index, streamed in some micro-batches by window, in any order.

    The horizon spans all events, so what comes early waits for what is missing.
    """
    folder = scratch(spark, "replay")
    index = segment_batches(event_records(spark, sf_dir)).select("topic", "vp", "window_start", "seq_start", "seq_end", (F.col("window_start") + WINDOW_S).alias("now_s"))
    index.repartitionByRange(parts, "window_start").write.parquet(f"{folder}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(index.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = read_stream(stream, 400 * 86400, -1).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out")


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over the event stream with a watermark: topic, window_start, record_count, payload_bytes."""
    folder = scratch(spark, "windows")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    slim = events.select(F.col("event_type").alias("topic"), F.col("ts").cast("timestamp").alias("at"), F.octet_length("props").cast("long").alias("bytes"))
    slim.repartitionByRange(4, "at").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(slim.schema).parquet(f"{folder}/in").withWatermark("at", "15 seconds")
    out = stream.groupBy("topic", F.window("at", f"{WINDOW_S} seconds").alias("w")).agg(F.count(F.lit(1)).alias("record_count"), F.sum("bytes").alias("payload_bytes"))
    out = out.select("topic", F.unix_seconds(F.col("w.start")).alias("window_start"), "record_count", "payload_bytes")
    name = f"windows_{uuid.uuid4().hex}"
    out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def commit(spark: SparkSession, stream: DataFrame, folder: str) -> None:
    """Cursors of a delivery stream, committed batch by batch: the greatest end of each partition, never backwards.

    Each micro-batch writes the whole (slim) cursor table under its own number, so a batch that is
    run again writes the same files again.
    """

    def keep(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("topic", "vp").agg(F.max("seq_end").alias("cursor"))
        if number:
            new = new.unionByName(spark.read.parquet(f"{folder}/cursors/{number - 1}"))
        new.groupBy("topic", "vp").agg(F.max("cursor").alias("cursor")).write.mode("overwrite").parquet(f"{folder}/cursors/{number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/commit").trigger(availableNow=True).start().awaitTermination()

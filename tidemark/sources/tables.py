"""The driver's tables as logs: records with topic, virtual partition, offset, window and size.

Their event time stands in for the broker's clock, which these tables don't have; arrival is the
order of ids, and times never run backwards in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import floor_to, mod_partition
from tidemark.operators.log import assign_offsets

PARTITIONS, WINDOW_S = 8, 21600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, vp, arrival, event_ts_ms, window_start, payload_bytes of table events."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_type").alias("topic"),
        mod_partition(F.col("user_id"), PARTITIONS).alias("vp"),
        F.col("event_id").alias("arrival"),
        ms.alias("event_ts_ms"),
        floor_to(F.floor(ms / 1000), WINDOW_S).alias("window_start"),
        F.octet_length("props").cast("long").alias("payload_bytes"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_offsets(event_arrivals(spark, sf_dir))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table lineitem as one topic: the order is the key, orders arrive by key, lines by number."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("orders").alias("topic"),
        mod_partition(F.col("l_orderkey"), PARTITIONS).alias("vp"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("arrival"),
        floor_to(F.col("l_orderkey"), 1000).alias("window_start"),
        F.round("l_quantity").cast("long").alias("payload_bytes"),
    )
    return assign_offsets(rows)

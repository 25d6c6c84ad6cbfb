"""The log at rest: blobs and their index as partitioned Parquet, any Hadoop file system.

Blobs are written before the index, so whatever the index names is there; a reader that finds no
blob for an index row has found a loss (scan.lost()). The index lies in folders by topic and
window, its rows in order of id, so that scans prune folders and skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import control
from tidemark.operators.scan import window_scan


def publish(records: DataFrame, folder: str, write: int, most_bytes: int = 64 * 2**20) -> None:
    """Adds records (topic, vp, window_start, offset, event_ts_ms, payload) as blobs, then their index.

    write numbers this write (modulo 65,536 among writes to one window). Its blobs and index lie in
    folders of their own, so a retry of the same write replaces what an earlier try left, or does
    nothing if that had come to its end; other writes to the same windows are not touched. A
    window's partitions are packed into objects of at most `most_bytes` of payload; a partition
    that is larger is an object alone.
    """
    spark = records.sparkSession
    blobs, index = f"{folder}/blobs/write={write}", f"{folder}/index/write={write}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return
    sizes = records.groupBy("topic", "window_start", "vp").agg(F.sum(F.octet_length("payload") + 12).cast("long").alias("encoded_bytes"))
    objects = control.pack_segments(sizes, most_bytes).drop("encoded_bytes")
    packed = codec.write_blobs(records.join(objects, ["topic", "window_start", "vp"]), write=write)
    packed.write.mode("overwrite").partitionBy("topic", "window_start").parquet(blobs)
    rows = index_of(spark.read.parquet(blobs))
    rows.repartition("topic", "window_start").sortWithinPartitions("topic", "window_start", "snowflake_id", "vp").write.mode("overwrite").partitionBy("topic", "window_start").parquet(index)


def index_of(blobs: DataFrame) -> DataFrame:
    """Index rows of blobs: one for each batch in them. The id is the number in the blob's key."""
    rows = blobs.select("topic", "window_start", "blob_key", F.explode("ranges").alias("r"))
    snowflake = F.regexp_extract("blob_key", r"/(\d+)\.\w+$", 1).cast("long")
    return rows.select("topic", "window_start", snowflake.alias("snowflake_id"), "blob_key", "r.*")


def load_blobs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/blobs").drop("write")


def load_index(spark: SparkSession, folder: str, topic: str, windows: list[int], min_snowflake: int | None = None) -> DataFrame:
    """One pruned scan: folders by topic and window, row groups by id."""
    return window_scan(spark.read.parquet(f"{folder}/index").drop("write"), topic, windows, min_snowflake)


def read(spark: SparkSession, folder: str, batches: DataFrame) -> DataFrame:
    """Records of index rows, each blob opened once; rows whose blob is gone give nothing."""
    ranges = batches.select("blob_key", F.lit(0).alias("idx"), "vp", "seq_start", "seq_end", "byte_start", "byte_end")
    return codec.read_ranges(load_blobs(spark, folder), ranges).drop("idx")


def whole_objects(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """Whole files as blobs, those of at most so many bytes: blob_key, content. Larger ones aren't opened."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    return files.select(F.col("path").alias("blob_key"), "content")

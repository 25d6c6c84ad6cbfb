"""What several operators of this subpackage share: reading, words, lineage cuts, ranks, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, after lower-casing A-Z: runs of digits, letters and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A token for word counts: runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that all executors share.

    The folder is the cluster's spark.checkpoint.dir; only a local session without one gets a
    folder of its own. A cluster without the setting is an error: no machine-local folder will do.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def lean(df: DataFrame) -> DataFrame:
    """The same frame, after setting Arrow batches to 8 MB where the session has Spark's 64 MB: texts fill them, and each task holds some."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) in ("67108864b", "64m", "64MB", "67108864"):
        df.sparkSession.conf.set(name, "8m")
    return df


def words_of(text):
    """Array of the words of a text; null gives an empty array.

    Only A-Z go to lower case: lower() does that for ASCII texts; in others, it would touch more
    alphabets, so words that it changes go letter by letter. Single characters instead of ranges
    let Java's regular expressions use a table.
    """
    ascii_words = F.regexp_extract_all(F.lower(text), F.lit(f"[0123456789{LOWER}]+"), F.lit(0))
    any_words = F.regexp_extract_all(text, F.lit(f"[0123456789{LOWER}{UPPER}\\x{{80}}-\\x{{10FFFF}}]+"), F.lit(0))
    low = F.transform(any_words, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, LOWER)))
    words = F.when(F.octet_length(text) == F.char_length(text), ascii_words).otherwise(low)
    return F.coalesce(words, F.array().cast("array<string>"))


def word_count(text):
    """Number of white-space separated tokens; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Gapless rank from 0 in the order given, without a single-task window.

    Range partitions of the order are cut by a checkpoint, so that counts and ranks see the same
    partitions; the driver gets one count per partition only. The result is a checkpoint's rows
    ranked within their partition plus an offset.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "__part int, __start long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + within).drop("__part", "__start")


def hot_from(total: int) -> int:
    """From how many rows on a key counts as hot: so that at most 10,000 keys do, whatever the size."""
    return max(100, total // 10_000)


def join_hot(rows: DataFrame, one: DataFrame, key: str, hot: int) -> DataFrame:
    """rows left-joined with `one`, which has one row per key and `n`, how many of the rows have it.

    Keys of more than `hot` rows are joined by broadcast (hot_from() bounds their number), so no
    task gets all rows of one; the others are shuffled. Rows with a null key stay where they are.
    """
    extra = [c for c in one.columns if c not in (key, "n")]
    big = one.where(F.col("n") > hot).select(key, F.struct(*extra).alias("__big"))
    marked = rows.join(F.broadcast(big), key, "left")
    here = F.col("__big").isNotNull() | F.col(key).isNull()
    fast = marked.where(here).select(*rows.columns, *[F.col("__big")[c].alias(c) for c in extra])
    rest = marked.where(~here).drop("__big").join(one.where(F.col("n") <= hot).drop("n"), key, "left")
    return fast.unionByName(rest.select(*rows.columns, *extra))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the least node reachable.

    Alternating large-star and small-star rounds: each is one aggregation and one join, hubs are
    pre-aggregated and joined by broadcast, and the number of rounds is logarithmic. Nothing but a
    checksum reaches the driver; each round is cut by a checkpoint.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = cut(e), None
    while True:
        sign = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if sign == before or not sign[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, hot = sign, hot_from(2 * sign[0])
        least = lambda pairs: pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # few edges: no node can be hot
        joined = lambda pairs, low: join_hot(pairs, low, "u", hot) if 2 * sign[0] > hot else pairs.join(low.drop("n"), "u")  # noqa: B023, E731
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).withColumn("m", F.least("u", "m"))
        large = joined(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = least(large)
        small = joined(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())

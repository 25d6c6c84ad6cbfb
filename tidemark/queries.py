"""The registered queries over the driver's tables, each with the same in DuckDB's SQL where there is one.

Inputs that the tables don't have (cursors, bounds, leases, plans, publication times) are derived
from them by fixed rules, named here once for both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.keys import blob_key, id_text, id_time_ms, parse_window_key, sip_partition, varint_size, virtual_partition, window_key
from tidemark.operators import client, control, flush, inspect, lease, log, placement, scan
from tidemark.operators import cost as costs
from tidemark.plans import reader, windows
from tidemark.sources.tables import PARTITIONS, WINDOW_S, event_arrivals, event_records, order_records, table
from tidemark.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_REC = """rec AS (
  SELECT event_type AS topic, CAST(user_id % 8 AS INTEGER) AS vp, event_id AS arrival, epoch_ms(ts) AS event_ts_ms, CAST(epoch_ms(ts) // 21600000 * 21600 AS BIGINT) AS window_start,
         CAST(strlen(props) AS BIGINT) AS payload_bytes, row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY event_id) - 1 AS "offset" FROM events)"""
_ORD = """ord AS (
  SELECT 'orders' AS topic, CAST(l_orderkey % 8 AS INTEGER) AS vp, l_orderkey, l_linenumber, CAST(l_orderkey // 1000 * 1000 AS BIGINT) AS window_start, CAST(round(l_quantity) AS BIGINT) AS payload_bytes,
         row_number() OVER (PARTITION BY l_orderkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS "offset" FROM lineitem)"""
_IDX = (
    _REC
    + """, idx AS (
  SELECT topic, vp, window_start, seq_start, seq_end, record_count, payload_bytes, CAST(((window_start * 1000 - 1409529600000) // 10) * 16777216 + length(topic) AS BIGINT) AS snowflake_id, byte_end, byte_end - size AS byte_start
  FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY topic, window_start ORDER BY vp) AS BIGINT) AS byte_end
        FROM (SELECT topic, vp, window_start, min("offset") AS seq_start, max("offset") AS seq_end, count(*) AS record_count, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes,
                     CAST(sum(payload_bytes) + 8 * count(*) AS BIGINT) AS size FROM rec GROUP BY topic, vp, window_start)))"""
)
_CUR = _IDX + ", cur AS (SELECT topic, vp, CAST(max(seq_end) // 2 AS BIGINT) AS cursor FROM idx WHERE vp <> 0 GROUP BY topic, vp)"
_BND = _IDX + ", bnd AS (SELECT topic, vp, CASE WHEN vp <> 0 OR topic = 'view' THEN min(snowflake_id) + CAST(vp * 172800 AS BIGINT) * 100 * 16777216 END AS min_snowflake FROM idx WHERE vp < 6 GROUP BY topic, vp)"
_LEASES = "leases AS (SELECT 't' || CAST(c_custkey % 4 AS VARCHAR) AS topic, CAST(c_custkey AS INTEGER) AS vp, 'm' || CAST(c_custkey % 7 AS VARCHAR) AS owner, c_custkey * 1000 AS expiry_ms FROM customer WHERE c_custkey % 6 <> 5)"
_PLAN = "plan AS (SELECT 't' || CAST(c_custkey % 4 AS VARCHAR) AS topic, CAST(c_custkey AS INTEGER) AS vp, 'm' || CAST(c_custkey % (7 + c_custkey % 3) AS VARCHAR) AS member_id FROM customer WHERE c_custkey % 11 <> 3)"
NOW_MS = 1706300000000  # within the events' time


def register(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def index(spark: SparkSession, sf: str) -> DataFrame:
    return log.segment_batches(event_records(spark, sf))


def cursors(idx: DataFrame) -> DataFrame:
    return idx.where("vp <> 0").groupBy("topic", "vp").agg(F.floor(F.max("seq_end") / 2).alias("cursor"))


def bounds(idx: DataFrame) -> DataFrame:
    low = F.min("snowflake_id") + F.col("vp").cast("long") * 172800 * 100 * 2**24
    out = idx.where("vp < 6").groupBy("topic", "vp").agg(low.alias("min_snowflake"))
    return out.withColumn("min_snowflake", F.when((F.col("vp") != 0) | (F.col("topic") == "view"), F.col("min_snowflake")))


def leases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").where(k % 6 != 5).select(F.concat(F.lit("t"), k % 4).alias("topic"), k.cast("int").alias("vp"), F.concat(F.lit("m"), k % 7).alias("owner"), (k * 1000).alias("expiry_ms"))


def plan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").where(k % 11 != 3).select(F.concat(F.lit("t"), k % 4).alias("topic"), k.cast("int").alias("vp"), F.concat(F.lit("m"), k % (7 + k % 3)).alias("member_id"))


# Write path


@register(f'WITH {_REC} SELECT topic, vp, arrival AS event_id, "offset" FROM rec')
def log_assign_offsets(spark, sf):
    return event_records(spark, sf).select("topic", "vp", F.col("arrival").alias("event_id"), "offset")


@register(f"WITH {_REC} SELECT topic, vp, window_start, count(*) AS record_count, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM rec GROUP BY ALL")
def batch_summary(spark, sf):
    return log.batch_summary(event_arrivals(spark, sf))


@register(f'WITH {_ORD} SELECT topic, vp, l_orderkey, l_linenumber, "offset" FROM ord')
def order_log_offsets(spark, sf):
    return order_records(spark, sf).select("topic", "vp", "arrival.l_orderkey", "arrival.l_linenumber", "offset")


@register(f"WITH {_ORD} SELECT topic, vp, window_start, count(*) AS record_count, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM ord GROUP BY ALL")
def order_batch_summary(spark, sf):
    return log.batch_summary(order_records(spark, sf))


@register(f"WITH {_IDX} SELECT topic, vp, window_start, snowflake_id, seq_start, seq_end, record_count, payload_bytes, byte_start, byte_end FROM idx")
def segment_index(spark, sf):
    return index(spark, sf).select("topic", "vp", "window_start", "snowflake_id", "seq_start", "seq_end", "record_count", "payload_bytes", "byte_start", "byte_end")


@register(
    f"WITH {_IDX} SELECT topic, vp, CAST(window_start // 86400 AS BIGINT) AS day, min(seq_start) AS seq_start, max(seq_end) AS seq_end, CAST(sum(record_count) AS BIGINT) AS record_count, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, "
    "max(seq_end) - min(seq_start) + 1 = sum(record_count) AS contiguous FROM idx WHERE window_start // 21600 % 5 <> 3 GROUP BY topic, vp, day"
)
def merge_contiguity_check(spark, sf):
    kept = index(spark, sf).where(F.floor(F.col("window_start") / WINDOW_S) % 5 != 3)
    return log.merge_contiguous(kept.withColumn("day", F.floor(F.col("window_start") / 86400)), ["topic", "vp", "day"])


@register(
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'UNKNOWN_TOPIC' WHEN user_id >= 2 * 64 THEN 'BAD_REQUEST' WHEN value < 2 THEN 'BAD_REQUEST' WHEN event_id % 13 = 0 THEN 'OVERLOADED'
       WHEN user_id % 5 = 0 OR event_id % 17 = 0 THEN 'NOT_LEASE_HOLDER' ELSE 'OK' END AS status FROM events"""
)
def append_status(spark, sf):
    topics = spark.createDataFrame([(t, 64, 2) for t in ("click", "error", "purchase", "view")], "topic string, partition_count int, num_writers int")
    requests = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("topic"),
        F.col("user_id").alias("vp"),
        F.when(F.col("value") < 2, 0).otherwise(1).alias("record_count"),
        (F.col("event_id") % 13 == 0).alias("overloaded"),
        (F.col("user_id") % 5 != 0).alias("assigned"),
        (F.col("event_id") % 17 == 0).alias("draining"),
    )
    return log.append_status(requests.join(F.broadcast(topics), "topic", "left")).select("event_id", "status")


@register(
    f"""WITH {_REC}, q AS (SELECT topic, vp, arrival, arrival % 7 * 10 AS size FROM rec)
    SELECT topic, vp, arrival, size, size > 0 AS accepted, CASE WHEN size > 0 THEN CAST(e - size AS BIGINT) END AS block_start, CASE WHEN size > 0 THEN CAST(e - 1 AS BIGINT) END AS block_end
    FROM (SELECT *, sum(size) OVER (PARTITION BY topic, vp ORDER BY arrival) AS e FROM q)"""
)
def hilo_reservations(spark, sf):
    rows = event_arrivals(spark, sf).select("topic", "vp", "arrival", (F.col("arrival") % 7 * 10).alias("size"))
    return log.hilo_reservations(rows)


@register(
    f"""WITH {_IDX} SELECT topic, window_start, count(*) AS fences, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE NOT ok) = 0 AND count(*) <= 99 AS committed
    FROM (SELECT topic, window_start, NOT (vp = 7 OR (vp = 3 AND window_start // 21600 % 4 = 1)) AS ok FROM idx) GROUP BY topic, window_start"""
)
def fence_check(spark, sf):
    idx = index(spark, sf)
    session = F.when(F.floor(F.col("window_start") / WINDOW_S) % 4 == 1, "old").otherwise("s")
    claims = idx.select("topic", "window_start", "vp", F.lit("w").alias("holder"), F.lit(1).alias("epoch"), F.when(F.col("vp") == 3, session).otherwise("s").alias("session"))
    held = idx.select("topic", "vp").distinct().select("topic", "vp", F.lit("w").alias("holder"), F.lit(1).alias("epoch"), F.lit("s").alias("session"), F.when(F.col("vp") == 7, NOW_MS).otherwise(NOW_MS + 1).alias("expiry_ms"))
    return log.fence_check(claims, held, NOW_MS)


@register(
    f"WITH {_IDX} SELECT DISTINCT topic, window_start, CASE topic WHEN 'view' THEN window_start + 3601 + 31 WHEN 'click' THEN window_start + 60 + 31 END AS expires_s FROM idx"
)
def ttl_expiry(spark, sf):
    topics = spark.createDataFrame([("view", 3600.2), ("click", 60.0), ("error", 0.0)], "topic string, retention_s double")
    segments = index(spark, sf).select("topic", "window_start", (F.col("window_start") * 1000 + 700).alias("created_ms")).distinct()
    return log.ttl_expiry(segments, topics, 30.5).drop("created_ms")


@register(f"WITH {_IDX} SELECT topic, vp, window_start, 16000 * (snowflake_id // 16777216 // 8640000 % 2) < 15000 AS published_in_time FROM idx")
def publication_deadline(spark, sf):
    late = F.shiftright("snowflake_id", 24) % 17280000 >= 8640000
    rows = index(spark, sf).select("topic", "vp", "window_start", F.lit(0).alias("started_ms"), F.when(late, 16000).otherwise(0).alias("published_ms"))
    return log.publication_status(rows, 15_000).select("topic", "vp", "window_start", "published_in_time")


@register(
    f"""WITH {_IDX} SELECT topic, vp, window_start, topic || '#' || CAST(window_start AS VARCHAR) AS key, topic AS parsed_topic, window_start AS parsed_start, lpad(CAST(snowflake_id AS VARCHAR), 20, '0') AS id_text,
    window_start * 1000 AS id_ms, 'base/shared/' || CAST(window_start AS VARCHAR) || '/' || CAST(snowflake_id AS VARCHAR) || '.zst' AS blob_key, CAST(vp + 3 * 8 AS BIGINT) AS writer_vp,
    CASE WHEN byte_end < 128 THEN 1 WHEN byte_end < 16384 THEN 2 ELSE 3 END AS length_bytes FROM idx"""
)
def key_codec(spark, sf):
    i = index(spark, sf).withColumn("key", window_key(F.col("topic"), F.col("window_start")))
    p = parse_window_key(F.col("key"))
    return i.select(
        "topic",
        "vp",
        "window_start",
        "key",
        p["topic"].alias("parsed_topic"),
        p["window_start"].alias("parsed_start"),
        id_text(F.col("snowflake_id")).alias("id_text"),
        id_time_ms(F.col("snowflake_id")).alias("id_ms"),
        blob_key(F.col("window_start"), F.col("snowflake_id"), prefix="base/").alias("blob_key"),
        virtual_partition(F.col("vp"), 3, PARTITIONS).alias("writer_vp"),
        varint_size(F.col("byte_end")).alias("length_bytes"),
    )


# Scan planning


@register("SELECT w AS window_start, (w + 300) * 1000 > 1706300000000 - 615010 AS eligible FROM (SELECT CAST(unnest([1706299200, 1706299500, 1706299800]) AS BIGINT) AS w)")
def candidate_windows(spark, sf):
    horizon = windows.Horizon(publication_lag_ms=600_000 - 250, visibility_ms=15_000, cache_age_ms=250)
    found = windows.candidate_windows(spark, NOW_MS, 300, horizon).where(F.col("window_start") >= 1706299200)
    open_ = windows.eligible_windows(found, NOW_MS, 300, horizon).select("window_start", F.lit(True).alias("e"))
    return found.join(open_, "window_start", "left").select("window_start", F.coalesce("e", F.lit(False)).alias("eligible"))


@register("SELECT CAST(unnest([1788613800, 1788614100, 1788614400]) AS BIGINT) AS window_start")
def inspector_windows(spark, sf):
    return windows.windows_around(spark, 1788614177, 300, 1)


@register(f"WITH {_BND} SELECT topic, CASE WHEN count(*) = count(min_snowflake) THEN min(min_snowflake) END AS floor FROM bnd GROUP BY topic")
def shared_scan_floor(spark, sf):
    return windows.shared_floor(bounds(index(spark, sf)), ["topic"])


@register(f"WITH {_BND} SELECT idx.topic, idx.vp, window_start, snowflake_id, min_snowflake FROM idx JOIN bnd USING (topic, vp) WHERE min_snowflake IS NULL OR snowflake_id >= min_snowflake")
def window_scan_lower_bound(spark, sf):
    i = index(spark, sf)
    return scan.bounded_scan(i, bounds(i)).select("topic", "vp", "window_start", "snowflake_id", "min_snowflake")


@register(
    f"""WITH {_IDX}, w AS (SELECT DISTINCT topic, vp, window_start AS s, window_start + 21600 AS e FROM idx),
    m AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY topic, vp ORDER BY s) >= s THEN 0 ELSE 1 END AS n FROM w),
    g AS (SELECT *, sum(n) OVER (PARTITION BY topic, vp ORDER BY s) AS k FROM m) SELECT topic, vp, min(s) AS start, max(e) AS "end", count(*) AS parts FROM g GROUP BY topic, vp, k"""
)
def coverage_islands(spark, sf):
    cover = index(spark, sf).select("topic", "vp", F.col("window_start").alias("start"), (F.col("window_start") + WINDOW_S).alias("end"))
    return windows.islands(cover, ["topic", "vp"], "start", "end")


@register(
    f"""WITH {_IDX}, w AS (SELECT topic, min(window_start) AS s, max(window_start) AS e FROM idx GROUP BY topic)
    SELECT topic, s AS start, e AS "end", CASE topic WHEN 'view' THEN s WHEN 'click' THEN e ELSE s + 86400 END AS rest_start FROM w"""
)
def coverage_residual(spark, sf):
    want = index(spark, sf).groupBy("topic").agg(F.min("window_start").alias("start"), F.max("window_start").alias("end"))
    begin = F.when(F.col("topic") == "view", F.col("start") + 1).otherwise(F.col("start"))
    reach = F.when(F.col("topic") == "click", F.col("end") + 5).otherwise(F.col("start") + 86400)
    return windows.uncovered(want, want.select("topic", begin.alias("start"), reach.alias("end")), ["topic"])


@register(f"WITH {_IDX} SELECT DISTINCT window_start FROM idx WHERE window_start >= (1706300000000 - 864000000) // 21600000 * 21600")
def retention_floor(spark, sf):
    return windows.retained(index(spark, sf).select("window_start").distinct(), NOW_MS, 864_000, WINDOW_S)


# Read path


@register(f"WITH {_CUR} SELECT topic, vp, window_start, seq_start, seq_end FROM idx LEFT JOIN cur USING (topic, vp) WHERE cursor IS NULL OR seq_end > cursor")
def cursor_whole_batch_skip(spark, sf):
    i = index(spark, sf)
    return scan.after_cursor(i, cursors(i)).select("topic", "vp", "window_start", "seq_start", "seq_end")


@register(
    f"""WITH {_CUR} SELECT idx.topic, idx.vp, r.window_start, "offset", greatest(seq_start, coalesce(cursor + 1, seq_start)) > seq_start AS suffix
    FROM idx LEFT JOIN cur USING (topic, vp) JOIN rec r ON r.topic = idx.topic AND r.vp = idx.vp AND r.window_start = idx.window_start WHERE cursor IS NULL OR "offset" > cursor"""
)
def cursor_suffix(spark, sf):
    i = index(spark, sf)
    return scan.exploded(scan.after_cursor(i, cursors(i))).select("topic", "vp", "window_start", "offset", "suffix")


@register(f"WITH {_IDX} SELECT topic, window_start * 1000 + vp * 3600000 <= 1705000000000 AS visible, count(*) AS batches, CAST(sum(record_count) AS BIGINT) AS records FROM idx GROUP BY topic, visible")
def visibility_deferred(spark, sf):
    i = index(spark, sf).withColumn("published_ms", F.col("window_start") * 1000 + F.col("vp") * 3_600_000)
    return scan.visibility(i, 1_705_000_000_000).groupBy("topic", "visible").agg(F.count(F.lit(1)).alias("batches"), F.sum("record_count").cast("long").alias("records"))


@register(
    f"""WITH {_IDX} SELECT topic, vp, window_start, payload_bytes, u <= 15 + 60 * vp OR n = 1 AS admitted FROM
    (SELECT *, sum(payload_bytes) OVER (PARTITION BY topic, vp ORDER BY window_start) AS u, row_number() OVER (PARTITION BY topic, vp ORDER BY window_start) AS n FROM idx)"""
)
def capacity_prefix(spark, sf):
    out = scan.capacity_prefix(index(spark, sf), 15 + 60 * F.col("vp"), ["topic", "vp"], ["window_start"])
    return out.select("topic", "vp", "window_start", "payload_bytes", "admitted")


@register(
    f"""WITH {_REC} SELECT topic, vp, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY topic, vp ORDER BY "offset") AS n, sum(payload_bytes) OVER (PARTITION BY topic, vp ORDER BY "offset") AS b FROM rec)
    WHERE n = 1 OR (n <= 20 AND b <= 150)"""
)
def next_batch(spark, sf):
    return scan.next_batch(event_records(spark, sf), 20, 150, ["topic", "vp"], ["offset"]).select("topic", "vp", "offset")


@register(f"WITH {_IDX} SELECT topic, vp, window_start, snowflake_id, seq_start, seq_end FROM idx WHERE window_start // 21600 % 7 = 2")
def lost_ranges(spark, sf):
    i = index(spark, sf).withColumn("blob_key", blob_key(F.col("window_start"), F.col("snowflake_id")))
    blobs = i.where(F.floor(F.col("window_start") / WINDOW_S) % 7 != 2)
    return scan.lost(i, blobs).select("topic", "vp", "window_start", "snowflake_id", "seq_start", "seq_end")


@register(
    f"""WITH {_IDX}, s AS (SELECT * FROM idx) SELECT topic, window_start, snowflake_id, min(byte_start) AS span_start, max(byte_end) AS span_end, CAST(sum(byte_end - byte_start) AS BIGINT) AS wanted,
    count(*) AS ranges, CAST(max(byte_end) - min(byte_start) - sum(byte_end - byte_start) AS BIGINT) AS overfetch FROM s GROUP BY topic, window_start, snowflake_id"""
)
def read_spans(spark, sf):
    return scan.read_spans(index(spark, sf))


@register(f"WITH {_IDX} SELECT topic, vp, window_start, max(snowflake_id) AS frontier FROM idx GROUP BY ALL")
def frontier_max(spark, sf):
    return scan.frontier(index(spark, sf))


@register(
    f"""WITH {_IDX} SELECT o.topic, o.vp, o."offset", i.window_start AS source_window, i.snowflake_id AS source_snowflake
    FROM rec o LEFT JOIN (SELECT * FROM idx WHERE window_start // 21600 % 9 <> 4) i ON o.topic = i.topic AND o.vp = i.vp AND o.window_start = i.window_start"""
)
def offset_source_lookup(spark, sf):
    i = index(spark, sf).where(F.floor(F.col("window_start") / WINDOW_S) % 9 != 4)
    return scan.offset_sources(event_records(spark, sf).select("topic", "vp", "offset"), i, 64)


@register(f"WITH {_IDX} SELECT topic, vp, window_start, snowflake_id FROM idx")
def snapshot_dedup(spark, sf):
    i = index(spark, sf).select("topic", "vp", "window_start", "snowflake_id")
    return scan.deduplicated(i.unionByName(i.where("vp < 4")))


@register(f"WITH {_IDX} SELECT topic, vp, snowflake_id FROM (SELECT *, row_number() OVER (PARTITION BY topic, vp ORDER BY snowflake_id DESC) AS r FROM idx) WHERE r <= 5")
def newest_sources(spark, sf):
    return scan.newest(index(spark, sf), 5).select("topic", "vp", "snowflake_id")


@register(
    f"""WITH {_IDX}, w AS (SELECT topic, window_start, CAST(sum(payload_bytes) AS BIGINT) AS bytes, count(*) AS entries FROM idx GROUP BY ALL)
    SELECT topic, window_start, bytes, entries, sum(bytes) OVER x <= 5000 AND sum(entries) OVER x <= 300 AS kept FROM w WINDOW x AS (PARTITION BY topic ORDER BY window_start DESC)"""
)
def cache_eviction(spark, sf):
    w = index(spark, sf).groupBy("topic", "window_start").agg(F.sum("payload_bytes").cast("long").alias("bytes"), F.count(F.lit(1)).alias("entries"))
    return scan.cached_windows(w, 5000, 300)


@register(
    f"""WITH {_CUR} SELECT topic, vp, window_start, seq_start > cursor + 1 AND window_start * 1000 > 1706300000000 - 864000000 AS held,
    CASE WHEN seq_start > cursor + 1 AND window_start * 1000 > 1706300000000 - 864000000 THEN window_start * 1000 + 864000000 END AS matures_ms FROM idx JOIN cur USING (topic, vp)"""
)
def sequence_hold(spark, sf):
    i = index(spark, sf)
    return scan.hold(i.join(cursors(i), ["topic", "vp"]), NOW_MS, 864_000_000, WINDOW_S).select("topic", "vp", "window_start", "held", "matures_ms")


@register(
    f"""WITH {_BND}, x AS (SELECT *, count(*) OVER (PARTITION BY topic, vp, window_start, snowflake_id) AS n FROM (SELECT topic, vp, window_start, snowflake_id FROM idx UNION ALL SELECT topic, vp, window_start, snowflake_id FROM idx WHERE vp = 1 AND window_start // 21600 % 10 = 0))
    SELECT x.topic, x.vp, window_start, snowflake_id, CASE WHEN n > 1 THEN 'duplicate_id' WHEN b.topic IS NULL THEN 'partition_not_requested' WHEN snowflake_id < min_snowflake THEN 'below_bound' END AS violation
    FROM x LEFT JOIN bnd b ON x.topic = b.topic AND x.vp = b.vp WHERE n > 1 OR b.topic IS NULL OR snowflake_id < min_snowflake"""
)
def query_violations(spark, sf):
    i = index(spark, sf)
    rows = i.select("topic", "vp", "window_start", "snowflake_id")
    twice = rows.where((F.col("vp") == 1) & (F.floor(F.col("window_start") / WINDOW_S) % 10 == 0))
    return scan.query_violations(rows.unionByName(twice), bounds(i), 0)


@register(f"WITH {_IDX}, p AS (SELECT DISTINCT topic, vp FROM idx) SELECT topic, vp, row_number() OVER (PARTITION BY topic ORDER BY vp <= 4, vp) - 1 AS turn FROM p")
def partition_rotation(spark, sf):
    p = index(spark, sf).select("topic", "vp").distinct().withColumn("last_vp", F.lit(4))
    return scan.rotation(p).select("topic", "vp", F.col("turn").cast("long"))


# Reports

_ISSUES = """, x AS (SELECT topic, vp, seq_start - CASE WHEN window_start // 21600 % 6 = 1 THEN 2 ELSE 0 END AS seq_start, seq_end, snowflake_id + CASE WHEN window_start // 21600 % 8 = 5 THEN 30000000000000 ELSE 0 END AS snowflake_id, cursor
  FROM idx JOIN cur USING (topic, vp) WHERE window_start // 21600 % 5 <> 3),
p AS (SELECT *, row_number() OVER (PARTITION BY topic, vp ORDER BY {order}) AS pos FROM x),
f AS (SELECT *, max(seq_end) OVER w AS pe, arg_max(seq_start, seq_end * 1000000 - pos) OVER w AS ps FROM p WINDOW w AS (PARTITION BY topic, vp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, greatest(cursor, coalesce(pe, cursor)) + 1 AS ne, CASE WHEN pe IS NULL OR pe <= cursor THEN cursor + 1 ELSE ps END AS hs FROM f)
SELECT topic, vp, '{name}' AS order_name, CASE WHEN seq_end < ne THEN CASE WHEN seq_start >= hs THEN 'overlap' ELSE 'out_of_order' END WHEN seq_start > ne THEN 'gap' ELSE 'overlap' END AS kind,
  CASE WHEN seq_end < ne THEN seq_start WHEN seq_start > ne THEN ne ELSE greatest(seq_start, cursor + 1) END AS issue_start,
  CASE WHEN seq_end < ne THEN seq_end WHEN seq_start > ne THEN seq_start - 1 ELSE ne - 1 END AS issue_end,
  CASE WHEN seq_end < ne AND seq_start < hs THEN ne END AS expected_at_least
FROM n WHERE (seq_end < ne AND seq_end > cursor) OR seq_start > ne OR (seq_end >= ne AND seq_start <= ne AND greatest(seq_start, cursor + 1) < ne)"""


def damaged(idx: DataFrame) -> DataFrame:
    """The index with some windows gone, some batches that begin too early and some with ids out of turn."""
    turn = F.floor(F.col("window_start") / WINDOW_S)
    out = idx.where(turn % 5 != 3).withColumn("seq_start", F.col("seq_start") - F.when(turn % 6 == 1, 2).otherwise(0))
    return out.withColumn("snowflake_id", F.col("snowflake_id") + F.when(turn % 8 == 5, F.lit(30000000000000)).otherwise(0))


@register(f"WITH {_CUR}{_ISSUES.format(order='snowflake_id, seq_start', name='source')}")
def continuity_issues(spark, sf):
    i = index(spark, sf)
    return inspect.continuity(damaged(i), cursors(i), ["snowflake_id", "seq_start"], "source")


@register(f"WITH {_CUR}{_ISSUES.format(order='seq_start, seq_end', name='sequence')}")
def continuity_issues_by_sequence(spark, sf):
    i = index(spark, sf)
    return inspect.continuity(damaged(i), cursors(i), ["seq_start", "seq_end"], "sequence")


@register(
    f"""WITH {_IDX}, x AS (SELECT topic, vp, seq_start, snowflake_id + CASE WHEN window_start // 21600 % 8 = 5 AND vp < 3 THEN 30000000000000 ELSE 0 END AS s FROM idx)
    SELECT topic, vp, bool_and(a = b) AS same_order, count(*) AS batches FROM (SELECT *, row_number() OVER (PARTITION BY topic, vp ORDER BY s, seq_start) AS a, row_number() OVER (PARTITION BY topic, vp ORDER BY seq_start, s) AS b FROM x) GROUP BY topic, vp"""
)
def order_divergence(spark, sf):
    late = (F.floor(F.col("window_start") / WINDOW_S) % 8 == 5) & (F.col("vp") < 3)
    i = index(spark, sf).withColumn("snowflake_id", F.col("snowflake_id") + F.when(late, F.lit(30000000000000)).otherwise(0))
    return inspect.order_divergence(i, ["snowflake_id", "seq_start"], ["seq_start", "snowflake_id"])


@register(
    f"""WITH {_CUR}, r AS (SELECT *, row_number() OVER (PARTITION BY topic, vp ORDER BY seq_start) - 1 AS position FROM idx JOIN cur USING (topic, vp)),
    f AS (SELECT *, coalesce(min(CASE WHEN seq_end > cursor THEN position END) OVER (PARTITION BY topic, vp), max(position) OVER (PARTITION BY topic, vp) + 1) AS first FROM r)
    SELECT topic, vp, CAST(position AS INTEGER) AS position, seq_start, seq_end, CASE WHEN seq_end <= cursor THEN 'before_or_at' WHEN seq_start <= cursor + 1 THEN 'crosses' ELSE 'after' END AS relation FROM f WHERE position BETWEEN first - 2 AND first + 2"""
)
def cursor_context(spark, sf):
    i = index(spark, sf)
    return inspect.cursor_context(i, cursors(i), 2).select("topic", "vp", "position", "seq_start", "seq_end", "relation")


_DELIVERED = _REC + ', del AS (SELECT topic, vp, "offset" AS delivery_idx, "offset", window_start FROM rec WHERE ("offset" * 7 + vp) % 31 > 1)'


def delivered(spark, sf):
    r = event_records(spark, sf).where((F.col("offset") * 7 + F.col("vp")) % 31 > 1)
    return r.select("topic", "vp", F.col("offset").alias("delivery_idx"), "offset", "window_start")


@register(
    f'WITH {_DELIVERED} SELECT topic, vp, delivery_idx, previous, "offset", "offset" - previous - 1 AS missing FROM (SELECT *, lag("offset") OVER (PARTITION BY topic, vp ORDER BY delivery_idx) AS previous FROM del) WHERE "offset" > previous + 1'
)
def delivery_gaps(spark, sf):
    return inspect.delivery_gaps(delivered(spark, sf))


@register(
    f"""WITH {_DELIVERED} SELECT topic, vp, window_start, min("offset") AS range_start, max("offset") AS range_end, count(*) AS delivered
    FROM (SELECT *, "offset" - row_number() OVER (PARTITION BY topic, vp, window_start ORDER BY delivery_idx) AS k FROM del) GROUP BY topic, vp, window_start, k"""
)
def delivered_ranges(spark, sf):
    return inspect.delivered_ranges(delivered(spark, sf))


@register(
    f"""WITH {_IDX}, c AS (SELECT topic, vp, CASE WHEN vp = 2 THEN NULL WHEN vp = 3 THEN 1706270400 ELSE min(window_start) END AS ckpt_window FROM idx GROUP BY topic, vp)
    SELECT topic, vp, ckpt_window, CASE WHEN ckpt_window IS NULL THEN 'no_checkpoint' ELSE 'behind' END AS reason, 1706270400 - ckpt_window AS behind_s FROM c WHERE ckpt_window IS NULL OR ckpt_window <> 1706270400"""
)
def lagging_partitions(spark, sf):
    low = F.when(F.col("vp") == 2, F.lit(None).cast("long")).when(F.col("vp") == 3, F.lit(1706270400)).otherwise(F.min("window_start"))
    return inspect.lagging(index(spark, sf).groupBy("topic", "vp").agg(low.alias("ckpt_window")), 1706270400)


@register(
    """WITH o AS (SELECT user_id AS p, event_id AS s, CASE WHEN event_id % 50 = 7 THEN 'b' ELSE 'a' END AS run FROM events WHERE event_id % 23 <> 5 UNION ALL SELECT user_id, event_id, 'a' FROM events WHERE event_id % 29 = 1),
    c AS (SELECT p, s, count(*) AS n FROM o WHERE run = 'a' GROUP BY p, s), e AS (SELECT user_id AS p, event_id AS s FROM events WHERE event_id % 41 <> 9), j AS (SELECT e.p AS want, coalesce(n, 0) AS n FROM e FULL JOIN c ON e.p = c.p AND e.s = c.s)
    SELECT count(want) AS expected, count(*) FILTER (WHERE want IS NOT NULL AND n > 0) AS unique_seen, CAST(coalesce(sum(n - 1) FILTER (WHERE want IS NOT NULL AND n > 1), 0) AS BIGINT) AS duplicates, count(*) FILTER (WHERE want IS NOT NULL AND n = 0) AS missing,
    count(*) FILTER (WHERE want IS NULL) AS unexpected, (SELECT count(*) FROM o WHERE run <> 'a') AS other_runs FROM j"""
)
def stress_validation(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("producer"), F.col("event_id").alias("sequence"))
    seen = e.where(F.col("sequence") % 23 != 5).withColumn("run", F.when(F.col("sequence") % 50 == 7, "b").otherwise("a"))
    again = e.where(F.col("sequence") % 29 == 1).withColumn("run", F.lit("a"))
    return inspect.stress_validation(e.where(F.col("sequence") % 41 != 9), seen.unionByName(again), "a")


@register("SELECT event_id, repeat('0a', 16) AS run, user_id AS producer, event_id AS sequence FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 3 = 0")
def stress_payloads(spark, sf):
    h = F.concat(F.lit("42535331"), F.repeat(F.lit("0a"), 16), F.lpad(F.hex("user_id"), 8, "0"), F.lpad(F.hex("event_id"), 16, "0"))
    payload = F.unhex(F.when(F.col("event_id") % 3 == 0, F.substring(h, 1, 62)).otherwise(h))
    return table(spark, sf, "events").select("event_id", inspect.parse_payload(payload).alias("p")).select("event_id", "p.*")


@register("SELECT conv_id, CAST(max(turn) + 1 - count(*) AS BIGINT) AS missing, bool_and(ok) AS in_order FROM (SELECT *, turn > coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS ok FROM conversations) GROUP BY conv_id")
def conversation_gaps(spark, sf):
    """Turns as offsets: what is missing in each conversation."""
    c = table(spark, sf, "conversations").select(F.lit("conversations").alias("topic"), F.col("conv_id").alias("vp"), F.col("turn").alias("delivery_idx"), F.col("turn").alias("offset"))
    gaps = inspect.delivery_gaps(c).groupBy("vp").agg(F.sum("missing").alias("gap"))
    first = c.groupBy("vp").agg(F.min("offset").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("d"))
    out = first.join(gaps, "vp", "left")
    return out.select(F.col("vp").alias("conv_id"), (F.col("first") + F.coalesce("gap", F.lit(0))).cast("long").alias("missing"), (F.col("n") == F.col("d")).alias("in_order"))


# Leases and placement


@register(
    f"""WITH {_LEASES}, {_PLAN}, j AS (SELECT coalesce(l.topic, p.topic) AS topic, coalesce(l.vp, p.vp) AS vp, owner, member_id AS desired, coalesce(expiry_ms > 500000, FALSE) AS live FROM leases l FULL JOIN plan p ON l.topic = p.topic AND l.vp = p.vp)
    SELECT topic, vp, owner, desired, live, CASE WHEN owner IS NULL THEN 'unleased' WHEN desired IS NULL THEN 'unplanned' WHEN NOT live THEN 'expired' WHEN owner = desired THEN 'settled' ELSE 'moving' END AS state FROM j"""
)
def lease_plan_report(spark, sf):
    return lease.lease_plan_report(leases(spark, sf), plan(spark, sf), 500_000)


@register(f"WITH {_LEASES} SELECT topic, owner, count(*) AS active FROM leases WHERE expiry_ms > 500000 GROUP BY topic, owner")
def active_leases(spark, sf):
    return lease.active(leases(spark, sf), 500_000).groupBy("topic", "owner").agg(F.count(F.lit(1)).alias("active"))


_MEMBERS = ", members AS (SELECT DISTINCT topic, 'm' || CAST(k AS VARCHAR) AS member_id FROM plan, (SELECT unnest(range(0, 9)) AS k))"


def members(spark, sf):
    ids = spark.range(9).select(F.concat(F.lit("m"), F.col("id")).alias("member_id"))
    return plan(spark, sf).select("topic").distinct().join(F.broadcast(ids))


@register(
    f"""WITH {_PLAN}{_MEMBERS}, l AS (SELECT m.topic, m.member_id, count(p.vp) AS n FROM members m LEFT JOIN plan p ON m.topic = p.topic AND m.member_id = p.member_id GROUP BY ALL)
    SELECT topic, count(*) AS members, min(n) AS least, max(n) AS most, max(n) - min(n) AS spread FROM l GROUP BY topic HAVING max(n) - min(n) > 1"""
)
def plan_balance_violations(spark, sf):
    return placement.balance_violations(plan(spark, sf), members(spark, sf))


@register(f"WITH {_PLAN} SELECT topic, vp % 100 AS logical, count(*) AS vps, count(DISTINCT member_id) AS owners, count(DISTINCT member_id) = 1 AS colocated FROM plan GROUP BY topic, vp % 100")
def colocation(spark, sf):
    return placement.colocation(plan(spark, sf), 100)


@register(
    f"""WITH {_LEASES}, {_PLAN}, pods AS (SELECT 'm' || CAST(k AS VARCHAR) AS member_id, CASE WHEN k = 4 THEN NULL ELSE 'p' || CAST(k % 3 AS VARCHAR) END AS pod_id FROM (SELECT unnest(range(0, 9)) AS k) WHERE k <> 5),
    j AS (SELECT p.topic, p.member_id, l.owner AS b, x.pod_id AS pa, y.pod_id AS pb, y.member_id AS alive FROM plan p LEFT JOIN leases l ON p.topic = l.topic AND p.vp = l.vp LEFT JOIN pods x ON p.member_id = x.member_id LEFT JOIN pods y ON l.owner = y.member_id)
    SELECT topic, CASE WHEN b IS NULL THEN 'new' WHEN b = member_id THEN 'stayed' WHEN alive IS NULL THEN 'orphan' WHEN pa IS NULL OR pb IS NULL THEN 'unknown_pod' WHEN pa = pb THEN 'within_pod' ELSE 'across_pods' END AS movement, count(*) AS partitions FROM j GROUP BY ALL"""
)
def movement_summary(spark, sf):
    k = F.col("id")
    pods = spark.range(9).where(k != 5).select(F.concat(F.lit("m"), k).alias("member_id"), F.when(k != 4, F.concat(F.lit("p"), k % 3)).alias("pod_id"))
    return placement.movement(plan(spark, sf), leases(spark, sf).withColumnRenamed("owner", "member_id"), pods)


@register(
    f"""WITH {_PLAN}, twice AS (SELECT * FROM plan UNION ALL SELECT * FROM plan WHERE vp % 50 = 1), parts AS (SELECT 't' || CAST(c_custkey % 4 AS VARCHAR) AS topic, CAST(c_custkey AS INTEGER) AS vp FROM customer WHERE c_custkey % 70 <> 8)
    SELECT topic, vp, 'assigned_twice' AS violation FROM twice GROUP BY topic, vp HAVING count(*) > 1 UNION ALL SELECT topic, vp, 'unknown_partition' FROM twice WHERE (topic, vp) NOT IN (SELECT topic, vp FROM parts)
    UNION ALL SELECT topic, vp, 'unassigned' FROM parts WHERE (topic, vp) NOT IN (SELECT topic, vp FROM twice) UNION ALL SELECT topic, vp, 'unknown_member' FROM twice WHERE member_id = 'm8'"""
)
def plan_violations(spark, sf):
    p = plan(spark, sf)
    parts = table(spark, sf, "customer").where(F.col("c_custkey") % 70 != 8).select(F.concat(F.lit("t"), F.col("c_custkey") % 4).alias("topic"), F.col("c_custkey").cast("int").alias("vp"))
    return placement.plan_violations(p.unionByName(p.where("vp % 50 = 1")), parts, members(spark, sf).where("member_id <> 'm8'"))


@register("SELECT bulk, outcome, min(idx) AS span_start, max(idx) AS span_end FROM (SELECT user_id AS bulk, idx, event_type AS outcome, idx - row_number() OVER (PARTITION BY user_id, event_type ORDER BY idx) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events)) GROUP BY bulk, outcome, k")
def completion_spans(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "events").withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return control.completion_spans(rows.select(F.col("user_id").alias("bulk"), "idx", F.col("event_type").alias("outcome")))


_COST = """SELECT * FROM (VALUES ('strong', 57600.0, 57600.0, 153000.0, 144000.0, 0.22725, 0.31104, 0.53829), ('eventual', 57600.0, 57600.0, 153000.0, 74880.0, 0.20997, 0.31104, 0.52101),
 ('fenced', 57600.0, 57600.0, 210600.0, 1065600.0, 0.52965, 0.31104, 0.84069)) t(scenario, segments, range_reads, wru, rru, index_cost, object_cost, total_cost)"""


@register(_COST.replace("SELECT *", "SELECT scenario, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("segments", "range_reads", "wru", "rru", "index_cost", "object_cost", "total_cost")), 1))
def cost_model(spark, sf):
    out = costs.cost(costs.parameters(spark, {"strong": {}, "eventual": {"metadata_eventual_reads": 1.0}, "fenced": {"transactional_metadata_writes": 1.0}}))
    return out.select("scenario", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


# Flushing


_BUF = "buf AS (SELECT event_type AS topic, CAST(user_id AS INTEGER) AS vp, bool_or(event_id % 97 = 0) AS draining, CAST(max(event_id % 900) AS BIGINT) AS age_ms, CAST(sum(strlen(props)) AS BIGINT) AS buffered_bytes FROM events GROUP BY event_type, user_id)"


def buffers(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("topic"), F.col("user_id").cast("int").alias("vp"))
    return e.agg(F.bool_or(F.col("event_id") % 97 == 0).alias("draining"), F.max(F.col("event_id") % 900).alias("age_ms"), F.sum(F.octet_length("props")).cast("long").alias("buffered_bytes"))


@register(f"WITH {_BUF} SELECT topic, vp, CASE WHEN draining THEN 'lease_drain' WHEN age_ms >= 850 THEN 'max_delay' WHEN buffered_bytes >= 120 THEN 'max_bytes' END AS trigger FROM buf")
def flush_triggers(spark, sf):
    trigger = flush.flush_trigger(F.col("draining"), F.col("age_ms"), F.col("buffered_bytes"), 850, 120)
    return buffers(spark, sf).select("topic", "vp", trigger.alias("trigger"))


@register(
    f"""WITH {_BUF}, s AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY vp) AS r FROM buf WHERE NOT draining)
    SELECT topic, vp, 'max_delay' AS trigger, CAST(dense_rank() OVER (ORDER BY topic <= 'error', topic) - 1 AS INTEGER) AS turn FROM s WHERE r <= 99"""
)
def flush_plan(spark, sf):
    return flush.flush_plan(buffers(spark, sf), 850, 120, last_topic="error")


@register(f"WITH {_REC} SELECT topic || '/' || CAST(vp AS VARCHAR) AS batch, \"offset\" AS pos, sum(payload_bytes + 4) OVER (PARTITION BY topic, vp ORDER BY \"offset\") <= 500 AS in_prefix FROM rec")
def prefix_split(spark, sf):
    r = event_records(spark, sf).select(F.concat_ws("/", "topic", F.col("vp").cast("string")).alias("batch"), F.col("offset").alias("pos"), (F.col("payload_bytes") + 4).alias("encoded_bytes"))
    return flush.prefix_split(r, 500).drop("encoded_bytes")


@register(
    f"""WITH {_IDX} SELECT topic, CASE WHEN vp = 0 THEN 'lease_drain' WHEN record_count > 3 THEN 'max_bytes' ELSE 'max_delay' END AS trigger, count(*) AS partitions, CAST(sum(record_count) AS BIGINT) AS records,
    CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM idx GROUP BY topic, trigger"""
)
def plan_summary(spark, sf):
    return flush.plan_summary(index(spark, sf).withColumn("trigger", F.when(F.col("vp") == 0, "lease_drain").when(F.col("record_count") > 3, "max_bytes").otherwise("max_delay")))


@register(
    """WITH a AS (SELECT event_type AS topic, 'r' || CAST(user_id % 3 AS VARCHAR) AS reason, event_id AS id FROM events)
    SELECT topic, reason, max(n) AS retries, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY topic, reason ORDER BY id DESC) AS r, count(*) OVER (PARTITION BY topic, reason) AS n FROM a) WHERE r <= 3 GROUP BY topic, reason"""
)
def retry_summary(spark, sf):
    e = table(spark, sf, "events")
    return flush.retry_summary(e.select(F.col("event_type").alias("topic"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("reason"), F.col("event_id").alias("at"), F.col("event_id").alias("id")), 3)


@register(f"WITH {_IDX} SELECT topic, CAST(sum(record_count) AS BIGINT) AS records, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, count(*) FILTER (WHERE vp >= 4) AS sealed_batches FROM idx GROUP BY topic")
def buffered_stats(spark, sf):
    i = index(spark, sf)
    return flush.buffered_stats(i.where("vp < 4"), i.where("vp >= 4"))


# Readers

_CKPT = (
    _IDX
    + """, ck AS (SELECT topic, vp, CASE WHEN vp <> 7 THEN max(seq_end) // 2 END AS cursor, CASE vp WHEN 1 THEN NULL WHEN 2 THEN min(window_start) WHEN 3 THEN 1706313600 WHEN 7 THEN NULL ELSE max(window_start) - 86400 END AS ckpt_window,
  CASE WHEN vp IN (1, 7) THEN NULL ELSE max(snowflake_id) - CAST(8640000 AS BIGINT) * 16777216 END AS ckpt_snowflake, CASE WHEN vp = 1 AND topic <> 'view' THEN 1706200000123 END AS committed_ms FROM idx GROUP BY topic, vp)"""
)


def checkpoints(idx: DataFrame) -> DataFrame:
    vp = F.col("vp")
    window = F.when(vp.isin(1, 7), F.lit(None)).when(vp == 2, F.min("window_start")).when(vp == 3, F.lit(1706313600)).otherwise(F.max("window_start") - 86400)
    return idx.groupBy("topic", "vp").agg(
        F.when(vp != 7, F.floor(F.max("seq_end") / 2)).alias("cursor"),
        window.cast("long").alias("ckpt_window"),
        F.when(~vp.isin(1, 7), F.max("snowflake_id") - 86400 * 100 * 2**24).alias("ckpt_snowflake"),
        F.when((vp == 1) & (F.col("topic") != "view"), F.lit(1706200000123)).alias("committed_ms"),
    )


@register(
    f"""WITH {_CKPT}, s AS (SELECT *, greatest(coalesce(ckpt_window, committed_ms // 21600000 * 21600, 1705428000), 1705428000) AS source FROM ck)
    SELECT topic, vp, CASE WHEN cursor IS NULL THEN 'fresh' WHEN source <= 1706292000 THEN 'recovering' ELSE 'fast' END AS mode, CAST(CASE WHEN cursor IS NULL THEN 1706292000 WHEN source <= 1706292000 THEN source END AS BIGINT) AS next_window,
    CAST(CASE WHEN cursor IS NOT NULL AND source <= 1706292000 AND ckpt_window = source THEN CAST(ceil((greatest(ckpt_snowflake // 16777216 * 10 + 1409529600000 - 15010, source * 1000) - 1409529600000) / 10.0) AS BIGINT) * 16777216 END AS BIGINT) AS first_bound,
    CAST(1706292000 AS BIGINT) AS cutover_window FROM s"""
)
def hydrate(spark, sf):
    out = reader.hydrate(checkpoints(index(spark, sf)), NOW_MS, WINDOW_S, 864_000, 15_010)
    return out.select("topic", "vp", "mode", "next_window", "first_bound", "cutover_window")


@register(
    f"""WITH {_IDX}, q AS (SELECT topic, vp, window_start, CAST((window_start + vp * 1000) // 21600 * 21600 AS BIGINT) AS al, snowflake_id FROM idx)
    SELECT topic, vp, window_start, least(greatest(al, 1705428000), 1706292000) AS start_window, CASE WHEN al BETWEEN 1705428000 AND 1706292000 THEN snowflake_id END AS start_bound FROM q"""
)
def seek(spark, sf):
    q = index(spark, sf).select("topic", "vp", "window_start", F.lit(0).alias("offset"), "snowflake_id").withColumn("asked", F.col("window_start"))
    out = reader.seek(q.withColumn("window_start", F.col("window_start") + F.col("vp") * 1000), NOW_MS, WINDOW_S, 864_000)
    return out.select("topic", "vp", F.col("asked").alias("window_start"), "start_window", "start_bound")


@register(
    f"""WITH {_IDX}, w AS (SELECT topic, vp, window_start * 1000 + 5 AS coverage_floor_ms, greatest(window_start, 1704412800) AS c FROM idx)
    SELECT topic, vp, coverage_floor_ms, c AS coverage_window, CASE WHEN c >= 1706270400 THEN 'none' WHEN c + 21600 = 1706270400 THEN 'tail' ELSE 'recover' END AS plan FROM w"""
)
def fast_debt(spark, sf):
    s = index(spark, sf).select("topic", "vp", (F.col("window_start") * 1000 + 5).alias("coverage_floor_ms"))
    return reader.fast_debt(s, NOW_MS, WINDOW_S, 15_000_000, 1704412800)


@register(
    f"""WITH {_IDX}, b AS (SELECT topic, vp, window_start, CASE WHEN vp % 2 = 0 THEN snowflake_id + 5 END AS frontier,
      CAST(ceil((greatest(window_start * 1000, least(1706300000000 - 15010, window_start * 1000 + vp * 7000003)) - 1409529600000) / 10.0) AS BIGINT) * 16777216 AS s FROM idx)
    SELECT topic, vp, window_start, greatest(s, coalesce(frontier, s)) AS bound FROM b"""
)
def fast_bound(spark, sf):
    s = index(spark, sf).select(
        "topic", "vp", "window_start", (F.col("window_start") * 1000 + F.col("vp") * 7000003).alias("coverage_floor_ms"), F.when(F.col("vp") % 2 == 0, F.col("snowflake_id") + 5).alias("frontier")
    )
    return reader.fast_bound(s, NOW_MS, 15_010).select("topic", "vp", "window_start", "bound")


@register(
    f"""WITH {_IDX}, s AS (SELECT topic, vp, window_start, CASE vp % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'recovering' ELSE 'fast' END AS mode, record_count > 2 AS deferred FROM idx),
    t AS (SELECT *, CASE WHEN deferred THEN window_start ELSE window_start + 21600 END AS nx FROM s), u AS (SELECT *, CASE WHEN (mode = 'fresh' AND NOT deferred) OR (mode = 'recovering' AND nx > 1706292000) THEN 'fast' ELSE mode END AS new_mode FROM t)
    SELECT topic, vp, window_start, new_mode, CASE WHEN new_mode <> 'fast' THEN nx END AS new_window FROM u"""
)
def reader_transitions(spark, sf):
    kind = F.element_at(F.array(F.lit("fresh"), F.lit("recovering"), F.lit("fast")), F.col("vp") % 3 + 1)
    s = index(spark, sf).select("topic", "vp", F.col("window_start").alias("scanned_window"), kind.alias("mode"), (F.col("record_count") > 2).alias("deferred"), F.lit(1706292000).cast("long").alias("cutover_window"))
    return reader.after_pass(s, WINDOW_S).select("topic", "vp", F.col("scanned_window").alias("window_start"), "new_mode", "new_window")


_SEALS = _BND + """, pa AS (SELECT topic, vp, window_start, CASE WHEN (vp + window_start // 21600) % 5 <> 0 THEN snowflake_id + vp END AS sealed_before FROM idx),
  se AS (SELECT topic, window_start, min(least) AS sealed_before, count(*) FILTER (WHERE sealed_before IS NULL AND (min_snowflake IS NULL OR min_snowflake < least)) = 0 AND min(least) IS NOT NULL AS reusable
         FROM (SELECT pa.*, b.min_snowflake, min(sealed_before) OVER (PARTITION BY pa.topic, window_start) AS least FROM pa LEFT JOIN bnd b ON pa.topic = b.topic AND pa.vp = b.vp) GROUP BY topic, window_start)"""


def seals(idx: DataFrame) -> DataFrame:
    part = F.when((F.col("vp") + F.floor(F.col("window_start") / WINDOW_S)) % 5 != 0, F.col("snowflake_id") + F.col("vp"))
    return reader.seal(idx.select("topic", "vp", "window_start", part.alias("sealed_before")), bounds(idx))


@register(f"WITH {_SEALS} SELECT topic, window_start, sealed_before, reusable FROM se")
def metadata_seal(spark, sf):
    return seals(index(spark, sf))


@register(
    f"""WITH {_SEALS} SELECT topic, vp, window_start, snowflake_id FROM idx LEFT JOIN (SELECT topic, window_start, sealed_before FROM se WHERE reusable) s USING (topic, window_start)
    WHERE sealed_before IS NULL OR snowflake_id >= sealed_before OR (snowflake_id < sealed_before AND vp % 2 = 0)"""
)
def cached_merge(spark, sf):
    i = index(spark, sf).select("topic", "vp", "window_start", "snowflake_id")
    return reader.merged(i.where("vp % 2 = 0"), i, seals(index(spark, sf)).where("reusable").select("topic", "window_start", "sealed_before"))


@register(f"WITH {_LEASES}, {_PLAN} SELECT topic, vp, 'added' AS change FROM plan WHERE (topic, vp) NOT IN (SELECT topic, vp FROM leases) UNION ALL SELECT topic, vp, 'removed' FROM leases WHERE (topic, vp) NOT IN (SELECT topic, vp FROM plan)")
def membership_delta(spark, sf):
    return reader.membership_delta(leases(spark, sf), plan(spark, sf))


@register(
    f"""WITH {_BND} SELECT topic, vp, window_start, snowflake_id FROM (SELECT idx.topic, idx.vp, window_start, snowflake_id, row_number() OVER (PARTITION BY idx.topic, window_start ORDER BY snowflake_id, idx.vp) AS r
    FROM idx JOIN bnd b ON idx.topic = b.topic AND idx.vp = b.vp WHERE min_snowflake IS NULL OR snowflake_id >= min_snowflake) WHERE r <= 4"""
)
def response_projection(spark, sf):
    i = index(spark, sf)
    return reader.response_projection(i, bounds(i), 4).select("topic", "vp", "window_start", "snowflake_id")


@register(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unaligned_window' WHEN event_id % 5 = 0 THEN 'one_coverage_needed' WHEN user_id % 11 = 0 THEN 'partition_twice' WHEN user_id >= 100 THEN 'invalid_partition' END AS violation FROM events"""
)
def request_validation(spark, sf):
    e, ask = table(spark, sf, "events"), F.array(F.col("user_id"), F.when(F.col("user_id") % 11 == 0, F.col("user_id")).otherwise((F.col("user_id") + 1) % 100))
    q = e.select(
        "event_id",
        (F.lit(300) * F.col("event_id") + (F.col("event_id") % 7 == 0).cast("int")).alias("window_start"),
        F.when(F.col("event_id") % 2 == 0, ask).alias("tail"),
        F.when((F.col("event_id") % 2 != 0) | (F.col("event_id") % 5 == 0), ask).alias("full"),
        F.lit(100).alias("partitions"),
    )
    q = q.withColumn("full", F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") % 2 != 0), F.lit(None)).otherwise(F.col("full")))
    return reader.request_violation(q, 300).select("event_id", "violation")


# Clients and coordinators


@register(
    f"""WITH {_REC}, q AS (SELECT rec.*, CASE WHEN topic = 'signup' THEN 'UNKNOWN_TOPIC' WHEN payload_bytes + 20 > 32 THEN 'TOO_LARGE' WHEN arrival % 13 = 0 THEN 'OVERLOADED' WHEN vp = 5 OR arrival % 17 = 0 THEN 'NOT_LEASE_HOLDER' ELSE 'OK' END AS status FROM rec)
    SELECT arrival AS input_idx, status, CASE WHEN status = 'OK' THEN row_number() OVER (PARTITION BY topic, vp, status ORDER BY window_start, arrival) - 1 END AS "offset" FROM q"""
)
def produce(spark, sf):
    topics = spark.createDataFrame([(t, 64, 2) for t in ("click", "error", "purchase", "view")], "topic string, partition_count int, num_writers int")
    r = event_arrivals(spark, sf).withColumns({"input_idx": F.col("arrival"), "encoded_bytes": client.encoded_bytes(F.lit(10), F.col("payload_bytes")), "overloaded": F.col("arrival") % 13 == 0, "assigned": F.col("vp") != 5, "draining": F.col("arrival") % 17 == 0})
    return client.produce(r, topics, 32)


@register("SELECT doc_id, n + 18 + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 ELSE 3 END + 1 AS encoded_bytes, n + 18 + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 ELSE 3 END + 1 > 4096 AS rejected FROM (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents)")
def record_guard(spark, sf):
    size = client.encoded_bytes(F.lit(10), F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).cast("long")
    return table(spark, sf, "documents").select("doc_id", size.alias("encoded_bytes"), client.too_large(size, 4096).alias("rejected"))


_GROUP = "grp AS (SELECT 't' || CAST(c_custkey % 4 AS VARCHAR) AS topic, 'm' || CAST(c_custkey % 40 AS VARCHAR) AS member_id, c_custkey * 1000 AS expiry_ms FROM customer)"


def group_members(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.concat(F.lit("t"), k % 4).alias("topic"), F.concat(F.lit("m"), k % 40).alias("member_id"), (k * 1000).alias("expiry_ms"))


@register(f"WITH {_GROUP} SELECT DISTINCT topic, member_id FROM grp WHERE expiry_ms > 100000")
def active_members(spark, sf):
    return client.active_members(group_members(spark, sf), 100_000)


@register(
    f"""WITH {_GROUP}, {_PLAN}, a AS (SELECT DISTINCT topic, member_id FROM grp WHERE expiry_ms > 100000 AND topic <> 't2' UNION SELECT topic, member_id FROM plan WHERE topic = 't2'),
    p AS (SELECT DISTINCT topic, member_id FROM plan) SELECT coalesce(a.topic, p.topic) AS topic, count(*) FILTER (WHERE p.topic IS NULL) AS joined, count(*) FILTER (WHERE a.topic IS NULL) AS "left",
    coalesce(a.topic, p.topic) <> 't1' AS valid, coalesce(a.topic, p.topic) <> 't2' AS repair FROM a FULL JOIN p ON a.topic = p.topic AND a.member_id = p.member_id GROUP BY coalesce(a.topic, p.topic)"""
)
def repair_gate(spark, sf):
    p = plan(spark, sf)
    m = group_members(spark, sf).where("topic <> 't2'").unionByName(p.where("topic = 't2'").select("topic", "member_id", F.lit(200_000).cast("long").alias("expiry_ms")))
    return client.repair_gate(m, p, p.where("topic = 't1'").select("topic"), 100_000)


@register(
    f"""WITH {_LEASES}, {_PLAN}, h AS (SELECT 't' || CAST(o_custkey % 4 AS VARCHAR) AS topic, CAST(o_custkey AS INTEGER) AS vp, o_orderkey AS o, o_orderstatus = 'F' AS d FROM orders)
    SELECT l.topic, l.vp, l.owner AS member_id, count(*) FILTER (WHERE NOT d) AS dropped, max(CASE WHEN d THEN o END) AS fence
    FROM leases l LEFT JOIN h ON h.topic = l.topic AND h.vp = l.vp WHERE (l.topic, l.vp, l.owner) NOT IN (SELECT topic, vp, member_id FROM plan) GROUP BY l.topic, l.vp, l.owner"""
)
def revocations(spark, sf):
    k = F.col("o_custkey")
    held = table(spark, sf, "orders").select(F.concat(F.lit("t"), k % 4).alias("topic"), k.cast("int").alias("vp"), F.col("o_orderkey").alias("offset"), (F.col("o_orderstatus") == "F").alias("delivered"))
    return client.revocations(leases(spark, sf).withColumnRenamed("owner", "member_id"), plan(spark, sf), held)


@register(
    """WITH e AS (SELECT event_type AS topic, CAST(user_id AS INTEGER) AS vp, event_id AS seq, CASE row_number() OVER w % 4 WHEN 1 THEN CASE WHEN event_id % 10 = 0 THEN 'stop' ELSE 'admit' END WHEN 2 THEN 'stop' WHEN 3 THEN 'drained' ELSE 'release' END AS step FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)),
    f AS (SELECT *, lag(step) OVER (PARTITION BY topic, vp ORDER BY seq) AS b FROM e)
    SELECT topic, vp, seq, CASE step WHEN 'admit' THEN 'admitted_before_release' WHEN 'stop' THEN 'stopped_without_admission' WHEN 'drained' THEN 'drained_while_admitting' ELSE 'released_before_drain' END AS violation FROM f
    WHERE CASE step WHEN 'admit' THEN b IS NOT NULL AND b <> 'release' WHEN 'stop' THEN b IS DISTINCT FROM 'admit' WHEN 'drained' THEN b IS DISTINCT FROM 'stop' ELSE b IS DISTINCT FROM 'drained' END"""
)
def drain_violations(spark, sf):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")) % 4
    step = F.when(turn == 1, F.when(F.col("event_id") % 10 == 0, "stop").otherwise("admit")).when(turn == 2, "stop").when(turn == 3, "drained").otherwise("release")
    return client.drain_violations(table(spark, sf, "events").select(F.col("event_type").alias("topic"), F.col("user_id").cast("int").alias("vp"), F.col("event_id").alias("seq"), step.alias("step")))


@register(
    """WITH c AS (SELECT event_type AS topic, CASE WHEN value <= 1 THEN 1.0 WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
    SELECT topic, CAST(bucket AS DOUBLE) AS bucket, n, CAST(sum(n) OVER (PARTITION BY topic ORDER BY bucket NULLS LAST) AS BIGINT) AS upto FROM c"""
)
def value_histogram(spark, sf):
    return client.histogram(table(spark, sf, "events").withColumnRenamed("event_type", "topic"), "value", [1, 10, 50], ["topic"])


@register(f"WITH {_IDX} SELECT topic, max(greatest(0, 1706300000000 - window_start * 1000 - vp)) AS oldest_ms FROM idx GROUP BY topic")
def oldest_cache_age(spark, sf):
    return client.oldest_cache_age(index(spark, sf).withColumn("observed_ms", F.col("window_start") * 1000 + F.col("vp")), NOW_MS, ["topic"])


@register("SELECT event_type AS operation, count(*) AS calls, sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 8 * 0.5 END)::DOUBLE AS units, CAST(sum(1 + event_id % 3) AS BIGINT) AS pages FROM events GROUP BY event_type")
def capacity_totals(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("operation"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 8 * 0.5).alias("units"), (1 + F.col("event_id") % 3).alias("pages"))
    return client.capacity_totals(e, ["operation"])


@register("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'done' WHEN event_id % 6 IN (1, 2) THEN 'fail' ELSE 'retry' END AS action FROM events")
def response_routing(spark, sf):
    status = F.when(F.col("event_id") % 6 < 5, F.get(F.array(*map(F.lit, ("OK", "UNKNOWN_TOPIC", "BAD_REQUEST", "NOT_LEASE_HOLDER", "OVERLOADED"))), (F.col("event_id") % 6).cast("int")))
    return table(spark, sf, "events").select("event_id", log.response_action(status).alias("action"))


@register(
    f"""WITH {_CUR}{_ISSUES.format(order="snowflake_id, seq_start", name="source").replace("SELECT topic, vp, 'source'", ", iss AS (SELECT topic, vp, 'source'", 1)}),
    x2 AS (SELECT topic, vp, seq_start - CASE WHEN window_start // 21600 % 6 = 1 THEN 2 ELSE 0 END AS seq_start, seq_end, record_count, snowflake_id + CASE WHEN window_start // 21600 % 8 = 5 THEN 30000000000000 ELSE 0 END AS snowflake_id FROM idx WHERE window_start // 21600 % 5 <> 3),
    sz AS (SELECT topic, count(DISTINCT snowflake_id) AS segments, count(*) AS batches, CAST(sum(record_count) AS BIGINT) AS records FROM x2 GROUP BY topic),
    od AS (SELECT topic, bool_and(a = b) AS same_order FROM (SELECT topic, row_number() OVER (PARTITION BY topic, vp ORDER BY snowflake_id, seq_start) AS a, row_number() OVER (PARTITION BY topic, vp ORDER BY seq_start, snowflake_id) AS b FROM x2) GROUP BY topic),
    ck AS (SELECT topic, vp, CASE WHEN vp = 2 THEN NULL WHEN vp = 3 THEN 1706270400 ELSE min(window_start) END AS w FROM idx GROUP BY topic, vp)
    SELECT sz.*, (SELECT count(*) FROM iss WHERE iss.topic = sz.topic AND kind = 'gap') AS gaps, (SELECT count(*) FROM iss WHERE iss.topic = sz.topic AND kind = 'overlap') AS overlaps,
    (SELECT count(*) FROM iss WHERE iss.topic = sz.topic AND kind = 'out_of_order') AS out_of_order, same_order, (SELECT count(*) FROM ck WHERE ck.topic = sz.topic AND (w IS NULL OR w <> 1706270400)) AS lagging FROM sz JOIN od USING (topic)"""
)
def inspect_metadata(spark, sf):
    i = index(spark, sf)
    low = F.when(F.col("vp") == 2, F.lit(None).cast("long")).when(F.col("vp") == 3, F.lit(1706270400)).otherwise(F.min("window_start"))
    return inspect.inspect_metadata(damaged(i), cursors(i), i.groupBy("topic", "vp").agg(low.alias("ckpt_window")), 1706270400)


# Folds, told in SQL by recursion; and what SQL can't say: tests hold the latter against golden values and invariants


@register()
def siphash_partition(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("topic"), sip_partition(F.col("user_id").cast("string").cast("binary"), PARTITIONS).alias("vp"))
    return e.groupBy("topic", "vp").agg(F.count(F.lit(1)).alias("records"))


@register("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS payload_bytes, CASE WHEN text IS NOT NULL THEN TRUE END AS same FROM documents")
def zstd_round_trip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    packed = docs.withColumn("packed", codec.compress(F.col("payload")))
    back = packed.select("doc_id", "payload", codec.decompress(F.col("packed")).alias("back"))
    return back.select("doc_id", F.octet_length("back").cast("long").alias("payload_bytes"), (F.col("back") == F.col("payload")).alias("same"))


@register(
    f"""WITH {_IDX} SELECT topic, window_start, CAST(sum(record_count) AS BIGINT) AS records, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, min(seq_start) AS first_offset FROM idx GROUP BY topic, window_start"""
)
def blob_batches(spark, sf):
    """Events encoded as blobs, one for each topic and window, then read back by byte range."""
    blobs = codec.write_blobs(event_records(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("arrival"), "props"), "arrival").withColumn("payload", F.col("props").cast("binary")))
    back = codec.read_ranges(blobs, blobs.select("blob_key", F.posexplode("ranges").alias("idx", "r")).select("blob_key", "idx", "r.*"))
    back = back.join(blobs.select("blob_key", "topic", "window_start"), "blob_key")
    return back.groupBy("topic", "window_start").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("payload")).cast("long").alias("payload_bytes"), F.min("offset").alias("first_offset"))


@register(
    f"""WITH RECURSIVE {_REC}, e AS (SELECT *, row_number() OVER (PARTITION BY topic, vp, window_start ORDER BY "offset") AS n FROM rec),
    s AS (SELECT topic, vp, window_start, n, payload_bytes, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS c, payload_bytes AS z FROM e WHERE n = 1
      UNION ALL SELECT e.topic, e.vp, e.window_start, e.n, e.payload_bytes, s.batch + CASE WHEN s.c >= 3 OR s.z >= 40 THEN 1 ELSE 0 END, CASE WHEN s.c >= 3 OR s.z >= 40 THEN 1 ELSE s.c + 1 END,
        CASE WHEN s.c >= 3 OR s.z >= 40 THEN e.payload_bytes ELSE s.z + e.payload_bytes END FROM s JOIN e ON e.topic = s.topic AND e.vp = s.vp AND e.window_start = s.window_start AND e.n = s.n + 1)
    SELECT topic, vp, window_start, batch, count(*) AS records, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM s GROUP BY topic, vp, window_start, batch"""
)
def micro_batches(spark, sf):
    out = log.micro_batches(event_records(spark, sf), 3, 40)
    return out.groupBy("topic", "vp", "window_start", "batch").agg(F.count(F.lit(1)).alias("records"), F.sum("payload_bytes").cast("long").alias("payload_bytes"))


@register()
def broker_groups(spark, sf):
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("offset", "payload_bytes"))), lambda x: x["payload_bytes"] + 12)
    r = event_records(spark, sf).groupBy("topic", "vp", "window_start").agg(sizes.alias("sizes"))
    pos = (F.col("window_start") * 10 + F.col("vp")).alias("pos")
    return flush.broker_groups(r.select(F.concat(F.lit("b"), F.pmod(F.xxhash64("topic", "vp"), F.lit(3))).alias("broker"), (pos * 10 + F.length("topic")).alias("pos"), "sizes"), 200)


@register()
def segment_packing(spark, sf):
    return control.pack_segments(index(spark, sf).withColumn("encoded_bytes", F.col("byte_end") - F.col("byte_start")), 64)


@register(
    """WITH RECURSIVE e AS (SELECT event_type AS topic, event_id AS idx, CAST(greatest(0, floor(value / 10) - 1) AS INTEGER) AS split_count, event_id % 9 <> 0 AS successful, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
    s AS (SELECT topic, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS idx, 0 AS split_count, TRUE AS successful, CAST(1000 AS BIGINT) AS cur, 0 AS sp, 0 AS cl FROM (SELECT DISTINCT topic FROM e)
      UNION ALL SELECT topic, n, idx, split_count, successful, nw, CASE WHEN nw <> cur THEN 0 ELSE sp2 END, CASE WHEN nw <> cur THEN 0 ELSE cl2 END FROM (
        SELECT *, CASE WHEN split_count > 0 AND sp2 >= 3 THEN greatest(50, cur - (greatest(0, cur - least(1000, greatest(50, (cur + split_count) // (split_count + 1)))) + 3) // 4)
                       WHEN split_count = 0 AND successful AND cl2 >= 3 THEN least(1000, cur + (1000 - cur + 1) // 2) ELSE cur END AS nw FROM (
          SELECT e.topic, e.n, e.idx, e.split_count, e.successful, s.cur, CASE WHEN e.split_count > 0 THEN s.sp + 1 ELSE 0 END AS sp2, CASE WHEN e.split_count = 0 AND e.successful THEN s.cl + 1 ELSE 0 END AS cl2
          FROM s JOIN e ON e.topic = s.topic AND e.n = s.n + 1)))
    SELECT topic, idx, split_count, successful, cur AS delay_ms FROM s WHERE n > 0"""
)
def adaptive_delay(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("idx"), F.greatest(F.lit(0), F.floor(F.col("value") / 10) - 1).cast("int").alias("split_count"), (F.col("event_id") % 9 != 0).alias("successful"))
    return control.adaptive_delay(e, 50, 1000)


@register(
    f"""WITH RECURSIVE {_REC}, e AS (SELECT topic, vp, arrival AS idx, arrival % 100 * 150 AS used, arrival % 400 = 0 AS foreground, row_number() OVER (PARTITION BY topic, vp ORDER BY arrival) AS n FROM rec),
    s AS (SELECT topic, vp, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS used, FALSE AS foreground, CAST(10000 AS BIGINT) AS size FROM (SELECT DISTINCT topic, vp FROM e)
      UNION ALL SELECT e.topic, e.vp, e.n, e.idx, e.used, e.foreground, CASE WHEN e.foreground OR e.used * 4 >= s.size * 3 THEN least(4294967295, s.size * 2) ELSE s.size END FROM s JOIN e ON e.topic = s.topic AND e.vp = s.vp AND e.n = s.n + 1)
    SELECT topic, vp, idx, used, foreground, size FROM s WHERE n > 0"""
)
def reservation_growth(spark, sf):
    e = event_arrivals(spark, sf).select("topic", "vp", F.col("arrival").alias("idx"), (F.col("arrival") % 100 * 150).alias("used"), (F.col("arrival") % 400 == 0).alias("foreground"))
    return control.reservation_sizes(e, 10_000)


@register(
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY topic, vp ORDER BY ts_ms, seq) AS n, CASE WHEN cmd = 'reserve' THEN 100 END AS size, 'w' || CAST(seq % 2 AS VARCHAR) AS holder, 's' || CAST(seq % 2 AS VARCHAR) AS session FROM (
        SELECT event_type AS topic, CAST(user_id % 16 AS INTEGER) AS vp, epoch_us(ts) // 1000 AS ts_ms, CAST(event_id % 1000 AS INTEGER) AS seq, (['acquire', 'reserve', 'heartbeat', 'acquire', 'release'])[event_id % 5 + 1] AS cmd FROM events)),
    s AS (SELECT topic, vp, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts_ms, 0 AS seq, '' AS cmd, '' AS st, CAST('' AS VARCHAR) AS h, CAST('' AS VARCHAR) AS se, CAST(0 AS BIGINT) AS ep, CAST(0 AS BIGINT) AS ex, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS m FROM (SELECT DISTINCT topic, vp FROM e)
      UNION ALL SELECT topic, vp, n, ts_ms, seq, cmd, st, CASE WHEN st = 'Ok' AND cmd = 'acquire' THEN holder ELSE h END, CASE WHEN st = 'Ok' AND cmd = 'acquire' THEN session ELSE se END,
        CASE WHEN st = 'Ok' AND cmd = 'acquire' AND (ep = 0 OR ex <= ts_ms OR se <> session) THEN ep + 1 ELSE ep END,
        CASE WHEN st = 'Ok' AND cmd IN ('acquire', 'heartbeat') THEN ts_ms + 3600000 WHEN st = 'Ok' AND cmd = 'release' THEN ts_ms ELSE ex END,
        CASE WHEN st = 'Ok' AND cmd = 'reserve' THEN coalesce(m + 1, 0) END, CASE WHEN st = 'Ok' AND cmd = 'reserve' THEN coalesce(m + 1, 0) + 99 ELSE m END
      FROM (SELECT e.topic, e.vp, e.n, e.ts_ms, e.seq, e.cmd, e.holder, e.session, s.h, s.se, s.ep, s.ex, s.m,
              CASE WHEN e.cmd = 'acquire' THEN CASE WHEN s.ep > 0 AND s.ex > e.ts_ms AND (s.h <> e.holder OR s.se <> e.session) THEN 'HeldByOther' ELSE 'Ok' END
                   WHEN s.ep = 0 OR s.ex <= e.ts_ms THEN 'Expired' WHEN s.h <> e.holder OR s.se <> e.session THEN 'HeldByOther' ELSE 'Ok' END AS st
            FROM s JOIN e ON e.topic = s.topic AND e.vp = s.vp AND e.n = s.n + 1))
    SELECT topic, vp, ts_ms, seq, cmd, st AS status, ep AS epoch, ex AS expiry_ms, b AS block_start, b + 99 AS block_end, m AS max_seq FROM s WHERE n > 0"""
)
def producer_lease_fold(spark, sf):
    e = table(spark, sf, "events")
    cmd = F.element_at(F.array(*map(F.lit, ("acquire", "reserve", "heartbeat", "acquire", "release"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = e.select(F.col("event_type").alias("topic"), (F.col("user_id") % 16).cast("int").alias("vp"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_id") % 1000).cast("int").alias("seq"), cmd.alias("cmd"))
    rows = rows.withColumns({"holder": F.concat(F.lit("w"), F.col("seq") % 2), "session": F.concat(F.lit("s"), F.col("seq") % 2), "duration_ms": F.lit(3_600_000).cast("long"), "size": F.when(F.col("cmd") == "reserve", F.lit(100)).cast("long")})
    return lease.fold_producer_leases(rows)


@register()
def consumer_lease_fold(spark, sf):
    e = table(spark, sf, "events")
    cmd = F.element_at(F.array(*map(F.lit, ("assign", "commit", "heartbeat", "assign", "release"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = e.select(F.col("event_type").alias("topic"), F.lit("g").alias("group_id"), (F.col("user_id") % 16).cast("int").alias("vp"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_id") % 1000).cast("int").alias("seq"), cmd.alias("cmd"))
    rows = rows.withColumns({"owner": F.concat(F.lit("m"), F.col("seq") % 2), "generation": (F.col("seq") % 2).cast("long"), "duration_ms": F.lit(3_600_000).cast("long"), "cursor_seq": F.col("seq").cast("long")})
    return lease.fold_consumer_leases(rows)


@register()
def planner_lease_fold(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("topic"), F.concat(F.lit("g"), F.col("user_id") % 8).alias("group_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_id") % 1000).cast("int").alias("seq"), F.when(F.col("event_id") % 2 == 0, "acquire").otherwise("publish").alias("cmd"))
    rows = rows.withColumns({"member": F.concat(F.lit("m"), F.floor(F.col("seq") / 2) % 2), "session": F.lit("s"), "duration_ms": F.lit(3_600_000).cast("long")})
    return lease.fold_planner_leases(rows.withColumn("planner", F.col("member")))


@register()
def rendezvous_owner(spark, sf):
    nodes = table(spark, sf, "nation").select(F.col("n_name").alias("node_id"))
    return placement.rendezvous_owner(index(spark, sf).select("topic", "window_start").distinct(), nodes, ["topic", "window_start"])


@register()
def balanced_assignment(spark, sf):
    parts = [(r["topic"], r["vp"]) for r in index(spark, sf).select("topic", "vp").distinct().collect()]  # 8 partitions a topic
    out = placement.balanced(parts, [f"n{k}" for k in range(5)])
    return spark.createDataFrame([(*k, v) for k, v in sorted(out.items())], "topic string, vp int, node_id string")


@register()
def sticky_assignment(spark, sf):
    before = {v: f"m{v % 5}" for v in range(64)}
    after = placement.repair(placement.sticky(list(range(64)), 16, [f"m{k}" for k in range(1, 7)], before), 16, 25)
    return spark.createDataFrame([(v, before[v], o) for v, o in sorted(after.items())], "vp int, before string, member_id string")


@register(f"WITH {_IDX} SELECT topic, vp, window_start, seq_start AS deliver_from, seq_end, CAST(0 AS BIGINT) AS gap FROM idx")
def stream_replay(spark, sf):
    """The streaming reader over events in micro-batches; tests hold it against the batch form."""
    return replay.replay_events(spark, sf)


@register(f"WITH {_REC} SELECT topic, window_start, count(*) AS record_count, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM rec GROUP BY topic, window_start")
def stream_windows(spark, sf):
    return replay.windowed_counts(spark, sf)

"""Hourly request cost of a log on an object store and a key-value index, as column expressions over a table of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The model's default inputs.
DEFAULTS: dict[str, float] = {
    "p_ddb_w_million": 1.25,
    "p_ddb_r_million": 0.25,
    "p_s3_put_1k": 0.005,
    "p_s3_get_1k": 0.0004,
    "r_ingest_per_hour": 10_000_000.0,
    "b_record_bytes": 350.0,
    "g_consumer_groups": 1.0,
    "p_owned_prod": 128.0,
    "p_owned_cons_total": 128.0,
    "n_cons": 8.0,
    "flush_max_delay_s": 1.0,
    "lease_duration_prod_s": 30.0,
    "reservation_size": 10_000.0,
    "heartbeat_cons_s": 10.0,
    "rebalance_interval_s": 10.0,
    "polls_per_s": 2.0,
    "fast_window_queries_per_poll": 1.0,
    "recovery_window_queries_per_hour": 0.0,
    "metadata_eventual_reads": 0.0,
    "transactional_metadata_writes": 0.0,
    "avg_partitions_per_segment": 8.0,
    "pages_per_metadata_query": 1.2,
    "coordination_strong_reads_per_rebalance": 2.0,
    "kb_seg_item": 0.475,
    "kb_lease_prod": 1.0,
    "kb_lease_cons": 1.0,
    "kb_membership": 1.0,
    "kb_assignment_plan": 8.0,
    "kb_scanned_per_metadata_query_page": 8.0,
    "kb_coordination_read": 4.0,
    "f_write_conflict_overhead": 0.0,
    "f_read_conflict_overhead": 0.0,
    "effective_segment_payload_bytes": 32.0 * 1024 * 1024,
    "active_topics_with_buffered_data": 16.0,
    "range_reads_per_segment_per_consumer_group": 1.0,
    "producer_foreground_reservation_writes_per_hour": 0.0,
    "s_seg_per_hour": 0.0,
    "s_range_read_per_hour": 0.0,
    "consumer_partition_claims_per_hour": 0.0,
    "consumer_cursor_commits_per_hour": 0.0,
    "assignment_plan_publications_per_hour": 0.0,
}


def parse_override(text: str) -> tuple[str, float]:
    """NAME=VALUE; true and false count as 1 and 0."""
    name, mark, value = text.partition("=")
    if not mark or name.strip() not in DEFAULTS:
        raise ValueError(f"not a parameter: {text!r}")
    word = value.strip().lower()
    return name.strip(), float(word == "true") if word in ("true", "false") else float(word)


def parameters(spark: SparkSession, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(name, *(DEFAULTS | own).values()) for name, own in scenarios.items()]
    return spark.createDataFrame(rows, "scenario string, " + ", ".join(f"{k} double" for k in DEFAULTS))


def cost(params: DataFrame) -> DataFrame:
    """scenario and the hourly segments, range reads, write and read units, and costs."""
    c = F.col
    hourly = lambda every: F.lit(3600.0) / F.greatest(every, F.lit(1e-9))
    written = lambda kb: F.ceil(F.greatest(kb, F.lit(0.0))).cast("double")
    read = lambda kb: F.ceil(F.greatest(kb, F.lit(0.0)) / 4.0).cast("double")
    given = lambda name, estimate: F.when(c(name) > 0, c(name)).otherwise(estimate)
    by_size = c("r_ingest_per_hour") * c("b_record_bytes") / F.greatest(c("effective_segment_payload_bytes"), F.lit(1.0))
    by_time = c("active_topics_with_buffered_data") * hourly(c("flush_max_delay_s"))
    out = params.withColumn("segments", given("s_seg_per_hour", F.greatest(by_size, by_time)))
    ranges = c("segments") * c("g_consumer_groups") * F.greatest(c("range_reads_per_segment_per_consumer_group"), F.lit(0.0))
    out = out.withColumn("range_reads", given("s_range_read_per_hour", ranges))
    out = out.withColumn("lease_writes", c("p_owned_prod") * (3600.0 / F.greatest(c("lease_duration_prod_s") / 3.0, F.lit(1.0))))
    reserves = F.greatest(c("r_ingest_per_hour") / F.greatest(c("reservation_size"), F.lit(1.0)) - c("lease_writes"), F.lit(0.0))
    out = out.withColumn("reserve_writes", given("producer_foreground_reservation_writes_per_hour", reserves))
    fast = c("g_consumer_groups") * c("n_cons") * c("polls_per_s") * 3600.0 * c("fast_window_queries_per_poll") * c("pages_per_metadata_query")
    out = out.withColumn("scan_pages", fast + c("recovery_window_queries_per_hour") * c("pages_per_metadata_query"))
    fenced: Column = c("transactional_metadata_writes") > 0
    groups, plans = c("g_consumer_groups"), c("assignment_plan_publications_per_hour")
    wru = (
        c("segments") * written(c("kb_seg_item")) * F.when(fenced, 2.0).otherwise(1.0)
        + (c("lease_writes") + c("reserve_writes")) * written(c("kb_lease_prod"))
        + (groups * c("p_owned_cons_total") * hourly(c("heartbeat_cons_s")) + c("consumer_partition_claims_per_hour") + c("consumer_cursor_commits_per_hour")) * written(c("kb_lease_cons"))
        + (groups * c("n_cons") * hourly(c("heartbeat_cons_s")) + groups * hourly(c("rebalance_interval_s"))) * written(c("kb_membership"))
        + plans * 2.0 * written(c("kb_assignment_plan"))
    )
    rru = (
        c("scan_pages") * read(c("kb_scanned_per_metadata_query_page")) * F.when(c("metadata_eventual_reads") > 0, 0.5).otherwise(1.0)
        + groups * c("n_cons") * hourly(c("rebalance_interval_s")) * c("coordination_strong_reads_per_rebalance") * read(c("kb_coordination_read"))
        + F.when(fenced, c("segments") * F.greatest(c("avg_partitions_per_segment"), F.lit(0.0)) * 2.0 * read(c("kb_lease_prod"))).otherwise(0.0)
        + plans * 2.0 * read(c("kb_membership"))
    )
    out = out.withColumn("wru", wru * (1.0 + F.greatest(c("f_write_conflict_overhead"), F.lit(0.0)))).withColumn("rru", rru * (1.0 + F.greatest(c("f_read_conflict_overhead"), F.lit(0.0))))
    index = c("wru") / 1e6 * c("p_ddb_w_million") + c("rru") / 1e6 * c("p_ddb_r_million")
    objects = c("segments") / 1e3 * c("p_s3_put_1k") + c("range_reads") / 1e3 * c("p_s3_get_1k")
    out = out.withColumn("index_cost", index).withColumn("object_cost", objects)
    return out.select("scenario", "segments", "range_reads", "wru", "rru", "index_cost", "object_cost", (c("index_cost") + c("object_cost")).alias("total_cost"))

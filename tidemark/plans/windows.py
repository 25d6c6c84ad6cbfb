"""Scan planning: which windows a reader needs, from which id on, and what of them is covered already.

Time is always a parameter, never the wall clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Horizon:
    """How long after its time a segment may still turn up."""

    publication_lag_ms: int = 15_000
    clock_skew_ms: int = 10
    visibility_ms: int = 0
    cache_age_ms: int = 0

    @property
    def ms(self) -> int:
        return self.publication_lag_ms + self.clock_skew_ms + self.visibility_ms + self.cache_age_ms

    @classmethod
    def eventual(cls, cache_age_ms: int = 250) -> Horizon:
        return cls(visibility_ms=2_000, cache_age_ms=cache_age_ms)


def floor_s(ms: int, size_s: int) -> int:
    return ms // (size_s * 1000) * size_s


def candidate_windows(spark: SparkSession, now_ms: int, size_s: int, horizon: Horizon, most: int = 32) -> DataFrame:
    """window_start of the current window and those that the horizon reaches back to, oldest first, at most so many."""
    back = min(most - 1, -(-horizon.ms // (size_s * 1000)))
    now = floor_s(now_ms, size_s)
    return spark.range(now - back * size_s, now + size_s, size_s).select(F.col("id").alias("window_start"))


def eligible_windows(windows: DataFrame, now_ms: int, size_s: int, horizon: Horizon) -> DataFrame:
    """Those that may still get segments: their end is after the safe time."""
    return windows.where((F.col("window_start") + size_s) * 1000 > now_ms - horizon.ms)


def windows_around(spark: SparkSession, at_s: int, size_s: int, radius: int) -> DataFrame:
    if not 0 <= radius <= 10:
        raise ValueError("the radius is from 0 to 10")
    start = at_s // size_s * size_s
    return spark.range(start - radius * size_s, start + (radius + 1) * size_s, size_s).select(F.col("id").alias("window_start"))


def shared_floor(bounds: DataFrame, by: list[str]) -> DataFrame:
    """The least bound of those that share a scan; one without a bound leaves the scan without one."""
    b = F.col("min_snowflake")
    return bounds.groupBy(*by).agg(F.when(F.count(F.lit(1)) == F.count(b), F.min(b)).alias("floor"))


def islands(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of half-open intervals that touch or overlap; never across a hole."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    marked = intervals.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    run = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__island", F.sum("__new").over(run))
    return marked.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("__island")


def uncovered(wanted: DataFrame, covered: DataFrame, by: list[str]) -> DataFrame:
    """Of wanted [start, end) what the first covered interval from its start on doesn't reach: [rest_start, end).

    covered: islands, start and end. Only a cover that holds the start counts (a prefix).
    """
    w, c = wanted.alias("w"), covered.alias("c")
    same = [F.col(f"w.{k}") == F.col(f"c.{k}") for k in by]
    inside = (F.col("c.start") <= F.col("w.start")) & (F.col("c.end") > F.col("w.start"))
    cond = inside
    for s in same:
        cond = s & cond
    joined = w.join(c, cond, "left")
    rest = F.least(F.coalesce(F.col("c.end"), F.col("w.start")), F.col("w.end"))
    return joined.select(*[F.col(f"w.{k}") for k in by], F.col("w.start").alias("start"), F.col("w.end").alias("end"), rest.alias("rest_start"))


def retained(windows: DataFrame, cutover_ms: int, retention_s: int, size_s: int) -> DataFrame:
    """Windows from the one that the retention reaches back to."""
    return windows.where(F.col("window_start") >= floor_s(cutover_ms - retention_s * 1000, size_s))

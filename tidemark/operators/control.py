"""Sequential controllers: flush delay, reservation growth, segment packing, completion spans.

Each step depends on the one before, so they fold one key's ordered rows; keys run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


class FlushDelay:
    """Lowers the delay after three flushes in a row that were split, raises it after three that weren't."""

    def __init__(self, floor: int, most: int, enabled: bool = True) -> None:
        self.floor, self.most, self.enabled, self.current, self.split, self.clean = floor, most, enabled, most, 0, 0

    def observe(self, splits: int, successful: bool) -> int:
        if not self.enabled:
            self.current, self.split, self.clean = self.most, 0, 0
            return self.current
        before = self.current
        if splits > 0:
            self.split, self.clean = self.split + 1, 0
            if self.split >= 3:
                target = min(self.most, max(self.floor, _ceil_div(self.current, splits + 1)))
                self.current = max(self.floor, self.current - _ceil_div(max(0, self.current - target), 4))
        elif successful:
            self.split, self.clean = 0, self.clean + 1
            if self.clean >= 3:
                self.current = min(self.most, self.current + _ceil_div(self.most - self.current, 2))
        else:
            self.split = self.clean = 0
        if self.current != before:
            self.split = self.clean = 0
        return self.current


def adaptive_delay(flushes: DataFrame, floor_ms: int, most_ms: int) -> DataFrame:
    """flushes: topic, idx, split_count, successful. Adds delay_ms after each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        c = FlushDelay(floor_ms, most_ms)
        return rows.assign(delay_ms=[c.observe(int(n), bool(ok)) for n, ok in zip(rows["split_count"], rows["successful"], strict=True)])

    return flushes.select("topic", "idx", "split_count", "successful").groupBy("topic").applyInPandas(run, "topic string, idx long, split_count int, successful boolean, delay_ms long")


def reservation_sizes(uses: DataFrame, start: int, most: int = 2**32 - 1) -> DataFrame:
    """uses: topic, vp, idx, used, foreground. Adds size: doubled, up to the most, when a writer had to wait or used three quarters."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, size, out = rows.sort_values("idx"), start, []
        for used, foreground in zip(rows["used"], rows["foreground"], strict=True):
            if foreground or used * 4 >= size * 3:
                size = min(most, size * 2)
            out.append(size)
        return rows.assign(size=out)

    return uses.select("topic", "vp", "idx", "used", "foreground").groupBy("topic", "vp").applyInPandas(run, "topic string, vp int, idx long, used long, foreground boolean, size long")


def pack_sizes(sizes: list[int], cap: int) -> list[int]:
    """Object number of each size in order: as few objects under the cap as can be, evenly filled; what exceeds the cap is alone.

    From the back, the least number of objects of each rest; then an object ends where the next
    size would exceed the cap, or where stopping is nearer to an even share of what is left and
    the rest still fits in the objects left.
    """
    n = len(sizes)
    nxt = 0
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        total, nxt = 0, i
        while nxt < n and (nxt == i or total + sizes[nxt] <= cap):
            total += sizes[nxt]
            nxt += 1
            if total > cap:
                break
        least[i] = 1 + least[nxt]
    out, obj, current, left, rest = [], 0, 0, least[0], sum(sizes)
    for i, s in enumerate(sizes):
        if current:
            target = _ceil_div(current + rest, max(1, left))
            full = current + s > cap
            even = least[i] <= left - 1 and abs(current - target) < abs(current + s - target)
            if full or even:
                obj, current, left = obj + 1, 0, left - 1
        out.append(obj)
        current += s
        rest -= s
    return out


def pack_segments(encoded: DataFrame, cap: int) -> DataFrame:
    """encoded: topic, window_start, vp, encoded_bytes. Adds object: which of the segment's objects a partition goes to."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vp")
        return rows.assign(object=pack_sizes([int(x) for x in rows["encoded_bytes"]], cap))

    slim = encoded.select("topic", "window_start", "vp", "encoded_bytes")
    return slim.groupBy("topic", "window_start").applyInPandas(run, "topic string, window_start long, vp int, encoded_bytes long, object int")


def completion_spans(results: DataFrame) -> DataFrame:
    """bulk, span_start, span_end, outcome: runs of consecutive result indexes with one outcome. results: bulk, idx, outcome."""
    run = F.col("idx") - F.row_number().over(Window.partitionBy("bulk", "outcome").orderBy("idx"))
    out = results.withColumn("__run", run).groupBy("bulk", "outcome", "__run").agg(F.min("idx").alias("span_start"), F.max("idx").alias("span_end"))
    return out.drop("__run")


def backoff_ms(attempt: int, base_ms: int = 25, most_ms: int = 1000) -> int:
    """How long to wait before an attempt (0: the first retry), without jitter."""
    return min(most_ms, base_ms * 2**attempt)

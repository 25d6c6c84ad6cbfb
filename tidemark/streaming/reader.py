"""The log's reader as a stateful stream: one cursor for each partition, suffixes, holds and lost ranges.

Batches (index rows) of a partition come in any micro-batch and order. The reader keeps the cursor
and what waits; a batch that leaves a gap is held until its window can get nothing more (its start
plus the horizon is over, by the segments' own time), then the gap is accepted. Nothing is
delivered twice, nothing before the cursor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass
class Reader:
    """One partition's cursor and held batches (window, start, end), pure; shared with the batch form."""

    horizon_s: int
    cursor: int | None = None
    held: list[tuple[int, int, int]] = field(default_factory=list)

    def take(self, batches: list[tuple[int, int, int]], now_s: int) -> list[tuple[int, int, int, int]]:
        """(window, deliver_from, end, gap) of what can be delivered now, in order of offsets."""
        waiting, out = sorted({*self.held, *batches}, key=lambda b: (b[1], b[2], b[0])), []
        self.held = []
        for window, start, end in waiting:
            if self.cursor is not None and end <= self.cursor:
                continue
            gap = 0 if self.cursor is None else max(0, start - self.cursor - 1)
            if gap and window + self.horizon_s > now_s:
                self.held.append((window, start, end))
                continue
            begin = start if self.cursor is None else max(start, self.cursor + 1)
            out.append((window, begin, end, gap))
            self.cursor = end
        return out


class _Processor(StatefulProcessor):
    def __init__(self, horizon_s: int, start: int | None) -> None:
        self.horizon_s, self.start = horizon_s, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "value bigint")
        self.held = handle.getListState("held", "window_start bigint, seq_start bigint, seq_end bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        reader = Reader(self.horizon_s, self.cursor.get()[0] if self.cursor.exists() else self.start, [tuple(int(x) for x in r) for r in self.held.get()] if self.held.exists() else [])
        frame = pd.concat(list(rows))
        batches = [(int(w), int(s), int(e)) for w, s, e in zip(frame["window_start"], frame["seq_start"], frame["seq_end"], strict=True)]
        out = reader.take(batches, int(frame["now_s"].max()))
        if reader.cursor is not None:
            self.cursor.update((reader.cursor,))
        if reader.held:
            self.held.put(reader.held)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame([(key[0], key[1], *r) for r in out], columns=["topic", "vp", "window_start", "deliver_from", "seq_end", "gap"])

    def close(self) -> None:
        pass


SCHEMA = "topic string, vp int, window_start bigint, deliver_from bigint, seq_end bigint, gap bigint"


def read_stream(index: DataFrame, horizon_s: int, start: int | None = None) -> DataFrame:
    """Streaming index rows (topic, vp, window_start, seq_start, seq_end, now_s) to deliveries.

    start: the cursor of partitions that have none yet (-1: from offset 0); None takes what comes first.
    """
    return index.groupBy("topic", "vp").transformWithStateInPandas(_Processor(horizon_s, start), SCHEMA, "append", "none")


def read_batch(index: DataFrame, horizon_s: int, now_s: int, start: int | None = None) -> DataFrame:
    """The same over all rows at once; keys run in parallel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        batches = [(int(w), int(s), int(e)) for w, s, e in zip(rows["window_start"], rows["seq_start"], rows["seq_end"], strict=True)]
        out = Reader(horizon_s, start).take(batches, now_s)
        return pd.DataFrame([(rows["topic"].iloc[0], rows["vp"].iloc[0], *r) for r in out], columns=["topic", "vp", "window_start", "deliver_from", "seq_end", "gap"])

    return index.select("topic", "vp", "window_start", "seq_start", "seq_end").groupBy("topic", "vp").applyInPandas(run, SCHEMA)

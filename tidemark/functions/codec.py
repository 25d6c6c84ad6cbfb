"""Opaque bytes: compression, batches in blobs, and reads by byte range. Arrow batches, no rows one by one.

A blob is the batches of one segment one after the other, each compressed by itself; a batch is its
records as lengths and bytes, so that a range of a blob can be read alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import blob_key, id_floor

LEVEL = 3


def compress(payload: Column, level: int = LEVEL) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=level)
        return values.map(lambda b: None if b is None else z.compress(bytes(b)))

    return run(payload)


def decompress(payload: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        z = zstandard.ZstdDecompressor()
        return values.map(lambda b: None if b is None else z.decompress(bytes(b)))

    return run(payload)


_HEAD, _RECORD = struct.Struct("<Iq"), struct.Struct("<qI")


def encode_batch(vp: int, first: int, records: list[tuple[int, bytes]], level: int = LEVEL) -> bytes:
    """Compressed: partition and first offset, then event time, length and bytes of each record."""
    body = b"".join(_RECORD.pack(ts, len(p)) + p for ts, p in records)
    return zstandard.ZstdCompressor(level=level).compress(_HEAD.pack(vp, first) + body)


def decode_batch(data: bytes, vp: int, count: int) -> tuple[int, list[tuple[int, bytes]]]:
    """First offset and records; an error if the batch is another partition's or has another number of records."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    own, first = _HEAD.unpack_from(raw)
    at, out = _HEAD.size, []
    while at < len(raw):
        ts, n = _RECORD.unpack_from(raw, at)
        at += _RECORD.size
        out.append((ts, raw[at : at + n]))
        at += n
    if own != vp or len(out) != count:
        raise ValueError(f"the batch holds {len(out)} records of partition {own}; the index says {count} of {vp}")
    return first, out


_RANGE = "struct<vp:int,seq_start:bigint,seq_end:bigint,byte_start:bigint,byte_end:bigint>"


def write_blobs(records: DataFrame, prefix: str = "", write: int | None = None) -> DataFrame:
    """blob_key, content, ranges: one blob for each topic, window and object. records: topic, vp, window_start, offset, event_ts_ms, payload.

    object (optional column, 0 to 255): which of the window's objects a record goes to; one blob is
    one task's work, so callers deal windows out to objects of bounded size. write: a number that
    tells this write's ids and keys from other writes' to the same window; without one, ids differ
    by the topic's length only, and windows must be written once.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        parts, at, ranges = [], 0, []
        for vp, part in rows.sort_values("offset").groupby("vp", sort=True):
            offsets = part["offset"]
            data = encode_batch(int(vp), int(offsets.iloc[0]), [(int(t), bytes(p)) for t, p in zip(part["event_ts_ms"], part["payload"], strict=True)])
            ranges.append({"vp": int(vp), "seq_start": int(offsets.iloc[0]), "seq_end": int(offsets.iloc[-1]), "byte_start": at, "byte_end": at + len(data)})
            parts.append(data)
            at += len(data)
        return pd.DataFrame({"topic": [rows["topic"].iloc[0]], "window_start": [rows["window_start"].iloc[0]], "object": [rows["object"].iloc[0]], "content": [b"".join(parts)], "ranges": [ranges]})

    number = F.col("object").cast("int") if "object" in records.columns else F.lit(0)
    slim = records.select("topic", "vp", "window_start", "offset", "event_ts_ms", "payload", number.alias("object"))
    out = slim.groupBy("topic", "window_start", "object").applyInPandas(build, f"topic string, window_start long, object int, content binary, ranges array<{_RANGE}>")
    low = F.length("topic") if write is None else F.lit(write % 2**16 * 256) + F.col("object")
    key = blob_key(F.col("window_start"), id_floor(F.col("window_start") * 1000) + low, prefix=prefix)
    return out.withColumn("blob_key", F.concat_ws("/", "topic", key)).select("blob_key", "topic", "window_start", "content", "ranges")


def read_ranges(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """blob_key, idx, vp, offset, event_ts_ms, payload of wanted ranges (blob_key, idx, vp, seq_start, seq_end, byte_start, byte_end).

    Ranges of a blob are gathered first, so each blob is joined and opened once; idx keeps the
    order that was asked for. Ranges past the end are errors; an empty range gives nothing; ranges
    of missing blobs give nothing (scan.lost() tells them).
    """
    asked = wanted.groupBy("blob_key").agg(F.sort_array(F.collect_list(F.struct("idx", "vp", "seq_start", "seq_end", "byte_start", "byte_end"))).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, content, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in ranges:
                    if r["byte_end"] > len(content):
                        raise ValueError(f"range past the end of {key}")
                    if r["byte_start"] == r["byte_end"]:
                        continue
                    first, found = decode_batch(content[r["byte_start"] : r["byte_end"]], r["vp"], r["seq_end"] - r["seq_start"] + 1)
                    rows += [{"blob_key": key, "idx": r["idx"], "vp": r["vp"], "offset": first + k, "event_ts_ms": ts, "payload": p} for k, (ts, p) in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("blob_key", pa.string()), ("idx", pa.int32()), ("vp", pa.int32()), ("offset", pa.int64()), ("event_ts_ms", pa.int64()), ("payload", pa.binary())]))

    joined = blobs.select("blob_key", "content").join(asked, "blob_key")
    return joined.mapInArrow(read, "blob_key string, idx int, vp int, offset bigint, event_ts_ms bigint, payload binary")

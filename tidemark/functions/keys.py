"""Keys of the log: partitions by SipHash-1-3, time windows, time-ordered ids and their text forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time-ordered ids: 10 ms steps since this instant, above 24 bits that only break ties.
EPOCH_MS, STEP_MS, LOW_BITS = 1409529600000, 10, 24

_U = np.uint64


def _round(v: list[np.ndarray]) -> None:
    rotate = lambda x, n: (x << _U(n)) | (x >> _U(64 - n))
    v[0] = v[0] + v[1]
    v[2] = v[2] + v[3]
    v[1] = rotate(v[1], 13) ^ v[0]
    v[3] = rotate(v[3], 16) ^ v[2]
    v[0] = rotate(v[0], 32)
    v[2] = v[2] + v[1]
    v[0] = v[0] + v[3]
    v[1] = rotate(v[1], 17) ^ v[2]
    v[3] = rotate(v[3], 21) ^ v[0]
    v[2] = rotate(v[2], 32)


def siphash13(messages: list[bytes]) -> np.ndarray:
    """SipHash-1-3 with a zero key of each message after its length (little endian, 8 bytes); uint64.

    All messages advance together, word by word; the ones that have ended stand still.
    """
    framed = [len(m).to_bytes(8, "little") + m for m in messages]
    size = np.array([len(m) for m in framed], np.int64)
    words = int(size.max() // 8) + 1 if len(size) else 0
    table = np.zeros((len(framed), words * 8), np.uint8)
    for k, m in enumerate(framed):
        table[k, : len(m)] = np.frombuffer(m, np.uint8)
    table = table.view("<u8").astype(np.uint64)
    last = size // 8
    table[np.arange(len(framed)), last] |= (size.astype(np.uint64) & _U(255)) << _U(56)
    v = [np.full(len(framed), x, np.uint64) for x in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]
    for w in range(words):
        live = last >= w
        part = [x[live] for x in v]
        m = table[live, w]
        part[3] = part[3] ^ m
        _round(part)
        part[0] = part[0] ^ m
        for x, y in zip(v, part, strict=True):
            x[live] = y
    v[2] = v[2] ^ _U(0xFF)
    for _ in range(3):
        _round(v)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def sip_partition(key: Column, partitions: int) -> Column:
    """Logical partition of a binary key: the hash modulo the number of partitions, taken unsigned; null for a null key."""

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        out = pd.Series(pd.array([pd.NA] * len(keys), dtype="Int32"))
        has = keys.notna().to_numpy()
        if has.any():
            out[has] = (siphash13([bytes(k) for k in keys[has]]) % _U(partitions)).astype(np.int32)
        return out

    return part(key)


def mod_partition(key: Column, partitions: int) -> Column:
    """The plain stand-in for integer keys, which SQL can check."""
    return F.pmod(key, F.lit(partitions)).cast("int")


def virtual_partition(logical: Column, writer: Column | int, partitions: int) -> Column:
    """logical + writer * partitions, held within 32 unsigned bits."""
    return F.least(logical.cast("long") + F.lit(writer).cast("long") * partitions, F.lit(2**32 - 1))


def floor_to(value: Column, size: int) -> Column:
    """The start of the window of a size; right for negative times too."""
    return value - F.pmod(value, F.lit(size))


def id_floor(ms: Column) -> Column:
    """The least id whose 10 ms step begins at or after an instant in ms."""
    step = F.ceil((ms - EPOCH_MS) / F.lit(STEP_MS)).cast("long")
    return F.greatest(F.shiftleft(step, LOW_BITS), F.lit(0).cast("long"))


def id_time_ms(snowflake: Column) -> Column:
    return F.shiftright(snowflake, LOW_BITS) * STEP_MS + EPOCH_MS


def id_text(snowflake: Column) -> Column:
    """Twenty digits, so that text order is number order."""
    return F.lpad(snowflake.cast("string"), 20, "0")


def window_key(topic: Column, start_s: Column) -> Column:
    return F.concat_ws("#", topic, start_s.cast("string"))


def parse_window_key(key: Column) -> Column:
    """Struct of topic and start; the last "#" counts, so topics may hold one. Nulls if it is no key."""
    ok = F.regexp_extract(key, r"^(.*)#(-?\d+)$", 2)
    topic = F.when(ok != "", F.regexp_extract(key, r"^(.*)#(-?\d+)$", 1))
    return F.struct(topic.alias("topic"), F.when(ok != "", ok).cast("long").alias("window_start"))


def blob_key(window_start: Column, snowflake: Column, suffix: str = "zst", prefix: str = "") -> Column:
    prefix = prefix.strip().rstrip("/")
    parts = [F.lit(prefix)] if prefix else []
    return F.concat_ws("/", *parts, F.lit("shared"), window_start.cast("string"), F.concat(snowflake.cast("string"), F.lit(f".{suffix}")))


def varint_size(value: Column) -> Column:
    """Bytes of an unsigned value in groups of seven bits."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + (value >= F.lit(2 ** (7 * k))).cast("int")
    return size

"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**bits cells between its least and greatest value: strings by the
seven bytes after their common prefix (so that order is kept), numbers by their logarithm. The
cell's place on the Hilbert curve orders the rows, and the order is cut into runs of equal numbers
of rows: counts are at most one apart. Rows of a shard are near each other in every dimension, so
a file's least and greatest values prune scans on any of them.

Ranks come from ``common.global_rank``: no task sees more than a range partition of the order, and
a hot cell is split by the checksum of the text and the id. Quantising needs the least and
greatest values only, so reruns agree whatever the order of tasks.

Defined results: a null value is in cell 0. Null and empty texts have size 16 and checksum 0.
Repeated rows take places of their own, next to each other. With fewer rows than shards some
shards stay empty. An empty table gives an empty result. Columns that have one of the added names
are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import global_rank


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of rows of cell numbers (rows, dimensions), by Gray-code rotations from the top bit down.

    Of each axis in turn, a set bit flips the lower bits of the first axis, a clear one swaps them
    with it; what remains is undone by the Gray code across axes, and bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for k in range(n):
            up = (x[k] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(up, low, swap)
            if k:
                x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    carry = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        carry ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= carry
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            out = out << 1 | (x[k] >> b & 1)
    return out


def _common_prefix(a: str, b: str) -> int:
    a8, b8 = a.encode(), b.encode()
    return next((k for k, (x, y) in enumerate(zip(a8, b8, strict=False)) if x != y), min(len(a8), len(b8)))


def _cells(df: DataFrame, dims: dict[str, Column], bits: int) -> list[Column]:
    kinds = dict(df.select(*[c.alias(n) for n, c in dims.items()]).dtypes)
    ends = df.agg(*[f(c).alias(f"{n}_{f.__name__}") for n, c in dims.items() for f in (F.min, F.max)]).first()
    out = []
    for name, column in dims.items():
        low, high = ends[f"{name}_min"], ends[f"{name}_max"]
        if low is None or low == high:
            out.append(F.lit(0).cast("long"))
            continue
        if kinds[name] == "string":
            skip = _common_prefix(low, high)
            seven = lambda v: int.from_bytes(v.encode()[skip : skip + 7].ljust(7, b"\0"), "big")  # noqa: B023, E731
            bare = F.substring(column.cast("binary"), skip + 1, 7)
            value = F.conv(F.rpad(F.hex(bare), 14, "0"), 16, 10).cast("double")
            a, b = float(seven(low)), float(seven(high))
        else:
            value = F.log1p(column.cast("double") - F.lit(float(low)))
            a, b = 0.0, float(np.log1p(float(high) - float(low)))
        place = F.floor((value - a) / (b - a) * (2**bits - 1) + 0.5)
        out.append(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), place)), F.lit(0)).cast("long"))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """docs with size and text_crc32 in place of columns of these names."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop("size", "text_crc32", "curve", "shard", "slot")
    return docs.withColumn("size", F.octet_length(text).cast("long") + 16).withColumn("text_crc32", F.crc32(text.cast("binary")))


def cut_runs(docs: DataFrame, shards: int = 40, dims: dict[str, Column] | None = None, bits: int = 5) -> DataFrame:
    """All columns of measured documents and curve, shard, slot.

    dims: up to 62 / bits named columns; by default source, lang and the size of the text.
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "size": F.col("size")}
    if len(dims) * bits > 62:
        raise ValueError("too many cells for an index of 62 bits")

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    cells = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(_cells(docs, dims, bits))])
    order = [F.col(c) for c in ("curve", "text_crc32", "size", "doc_id")]
    ranked = global_rank(docs.withColumn("curve", curve(cells)), order, "__rank")
    total = max(1, ranked.count())
    ranked = ranked.withColumn("shard", F.expr(f"cast(__rank * {shards} div {total} as int)"))
    return ranked.withColumn("slot", F.expr(f"__rank - (shard * {total}L + {shards - 1}) div {shards}")).drop("__rank")


def shard(docs: DataFrame, **parameters) -> DataFrame:
    """All rows and columns of docs and size, text_crc32, curve, shard, slot."""
    return cut_runs(measured(docs), **parameters)


def slim_shards(docs: DataFrame, **parameters) -> DataFrame:
    """The same without the text, which then isn't shuffled."""
    return cut_runs(measured(docs).drop("text"), **parameters)

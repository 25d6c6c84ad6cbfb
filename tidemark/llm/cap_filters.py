"""Embedding near-duplicates by spherical-cap filters: product codes, list decoding, join on filters, verification.

1. Equal vectors form a class; only one row per class goes on.
2. Filters are directions: the concatenation of one code word per block of a randomly rotated
   space (a product code), so `words ** blocks` directions need only `words * blocks` code words.
   Directions of one code depend on each other, so `codes` codes with rotations of their own share
   the filters out: else the number of caps that a vector is in would vary too much.
   A vector passes the filters whose direction its dot product with reaches the cap's height.
   They are listed by decoding: block after block, only prefixes that can still reach the height
   go on, so the cost follows the number of filters passed, not of all filters.
3. Height and number of filters follow the number of vectors: the height makes a cap hold about
   `cap_rows` vectors, the number makes two vectors at the threshold share `shared_caps` caps on
   average. The search is sub-quadratic, and a pair is missed with a chance of about
   exp(-shared_caps) at the threshold, less above it.
4. Vectors are joined by shared caps and verified by cosine in double precision, as told in
   ``buckets``: hot caps are split into tiles, each pair counts once. No cap on partners.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are components of their own. Vectors of different lengths don't link. Repeated
rows link with each other like copies. A component's id is its least non-null id. Extra columns
and labels are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import buckets
from tidemark.llm.bytesoup import trimmed
from tidemark.llm.common import cut, lean


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Float64 vectors; None for those that can't be compared."""
    edge, has = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    null = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    flat[null] = np.nan
    out: list[np.ndarray | None] = []
    for k in range(len(column)):
        x = flat[edge[k] : edge[k + 1]]
        out.append(x if has[k] and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in vectors(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], ["vec_id", "cls", "embedding"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def cap_shares(dim: int, height: float, cosine: float, steps: int = 2000) -> tuple[float, float]:
    """The share of the unit sphere in a cap, and the chance that both of two vectors at a cosine are in it."""
    if dim < 3:
        a = math.acos(height)
        return a / math.pi, max(0.0, a - math.acos(cosine) / 2) / math.pi
    s = height + (np.arange(steps) + 0.5) * (1 - height) / steps
    density = lambda x, d: np.maximum(0, 1 - x * x) ** ((d - 3) / 2)
    grid = -1 + (np.arange(8000) + 0.5) / 4000
    total = density(grid, dim).sum() / 4000
    inner = density(grid, dim - 1) if dim > 3 else 1 / np.sqrt(np.maximum(1e-12, 1 - grid * grid))
    tail = np.append(np.cumsum(inner[::-1])[::-1], 0) / inner.sum()
    need = (height - cosine * s) / np.sqrt((1 - cosine**2) * np.maximum(1e-12, 1 - s * s))
    given = np.where(need <= -1, 1, np.where(need >= 1, 0, tail[np.clip(np.ceil((need + 1) * 4000).astype(int), 0, 8000)]))
    one = density(s, dim) * (1 - height) / steps / total
    return float(one.sum()), float((one * given).sum())


class Caps:
    """The filters for vectors of one length."""

    def __init__(self, dim: int, rows: int, cosine: float, cap_rows: float, shared_caps: float, codes: int, seed: int) -> None:
        low, high, share = 0.0, cosine, min(0.5, cap_rows / max(rows, 1))
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if cap_shares(dim, mid, cosine)[0] > share else (low, mid)
        self.height = low
        filters = shared_caps / max(cap_shares(dim, low, cosine)[1], 1e-12) / codes
        blocks = 1 if dim < 16 else max(2, math.ceil(math.log(max(filters, 2)) / math.log(256)))
        words = math.ceil(filters ** (1 / blocks))
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        self.edges = [dim * k // blocks for k in range(blocks + 1)]
        parts = list(zip(self.edges, self.edges[1:], strict=False))
        self.codes = []
        for _ in range(codes):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            self.codes.append((turn, [_unit(rng.standard_normal((words, b - a))) * math.sqrt((b - a) / dim) for a, b in parts]))

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and filter of all caps that hold rows of a table of unit vectors, by row."""
        rows, filters = [], []
        for n, (turn, blocks) in enumerate(self.codes):
            x = units @ turn
            scores = [x[:, a:b] @ c.T for a, b, c in zip(self.edges, self.edges[1:], blocks, strict=False)]
            rest = [sum((s.max(1) for s in scores[k + 1 :]), np.zeros(len(x))) for k in range(len(scores))]
            row, code, so_far = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
            for s, more in zip(scores, rest, strict=True):
                reach = so_far[:, None] + s[row]
                i, j = np.nonzero(reach + more[row][:, None] >= self.height)
                row, code, so_far = row[i], code[i] * s.shape[1] + j, reach[i, j]
            rows.append(row)
            filters.append(code * len(self.codes) + n)
        row, code = np.concatenate(rows), np.concatenate(filters)
        order = np.argsort(row, kind="stable")
        return row[order], code[order]


def _decoder(*parameters):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caps: dict[int, Caps] = {}
        for batch in batches:
            own = vectors(batch.column(1))
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(own)
            for dim in {len(x) for x in own}:
                if dim not in caps:
                    caps[dim] = Caps(dim, *parameters)
                at = [k for k, x in enumerate(own) if len(x) == dim]
                for lo in range(0, len(at), 256):
                    part = at[lo : lo + 256]
                    row, code = caps[dim].decode(_unit(np.stack([own[k] for k in part])))
                    cuts = np.searchsorted(row, np.arange(len(part) + 1))
                    for i, k in enumerate(part):
                        found[k] = (code[cuts[i] : cuts[i + 1]] << 12) | (dim & 0xFFF)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["cls", "caps"])

    return decode


def _near(cosine: float):
    def near(rows: list[np.ndarray]) -> np.ndarray:
        sizes = {len(x) for x in rows}
        out = np.zeros((len(rows), len(rows)), bool)
        for size in sizes:
            at = np.array([k for k, x in enumerate(rows) if len(x) == size])
            x = _unit(np.stack([rows[k] for k in at]).astype(np.float64))
            out[np.ix_(at, at)] = x @ x.T >= cosine
        return out

    return near


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, cap_rows: float = 200, shared_caps: float = 14, codes: int = 32, seed: int = 11, tile: int = 512) -> DataFrame:
    """vec_id, class_id, n_links, component_id, kept: one row per vector.

    n_links: other vectors found at the cosine or above. component_id: the least vec_id reachable
    by links, kept where it is the own one.
    """
    kind = np.float64 if "double" in dict(embeddings.dtypes)["embedding"] else np.float32
    name = "array<double>" if kind is np.float64 else "array<float>"
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(name))
    keyed = cut(lean(rows).mapInArrow(trimmed(_keyed), f"vec_id bigint, cls binary, embedding {name}"))
    classes = keyed.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"), F.first("embedding").alias("payload"))
    classes = cut(buckets.named(classes))
    decode = _decoder(classes.count(), cosine, cap_rows, shared_caps, codes, seed)
    placed = buckets.shared(classes.select("cls", "payload").mapInArrow(trimmed(decode), "cls binary, caps array<bigint>"), "caps", tile)
    payload = classes.select("cls", "n_rows", "payload").join(buckets.buckets_of(placed), "cls")
    found = buckets.linked(classes, placed, payload, _near(cosine), kind)
    return buckets.per_row(keyed.select("vec_id", "cls"), classes, found, "vec_id").drop("cls")

"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, verify on full n-gram sets.

1. Each text becomes the set of its word n-grams (64-bit hashes; words as in ``common.WORD``; a
   text of fewer than n words, but not none, has one gram: all of them). Texts of one set form a
   class; only one row per class goes on, with its number of documents.
2. ``bands`` picks rows and bands for a target recall at the threshold. A class's band hashes are
   shuffled; a band value shared by two classes or more is a bucket. Buckets of exactly the same
   classes count once.
3. The gram sets of the classes in buckets are dealt out and compared as told in ``buckets``.

Defined results: null and empty texts, and texts without words, link with nothing and are their
own component; their class is null. Equal texts, and different texts of one set, are in one class
and link with each other. Repeated rows count as documents of their own. Null ids stay as rows;
a component's id is its least non-null id. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import buckets, bytesoup
from tidemark.llm.common import cut, lean

_SEED = np.random.Generator(np.random.PCG64(77))
_MUL = _SEED.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(1, 2**63, 512, dtype=np.uint64)
U64 = np.uint64


def bands(threshold: float, recall: float, most: int = 80) -> tuple[int, int]:
    """Rows and bands: the most rows per band for which so many bands reach the recall with `most` hashes in all."""
    best = (1, max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))))
    for rows in range(2, 13):
        count = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if rows * count <= most:
            best = (rows, count)
    return best


def unique_grams(grams: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's grams sorted and without repeats."""
    parts, size = [], np.zeros(len(begin), np.int64)
    for k in range(len(begin) - 1):
        x = np.sort(grams[begin[k] : begin[k + 1]])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        parts.append(x)
        size[k + 1] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(size)


def _signer(n: int, rows: int, count: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = bytesoup.buffers(batch.column("text"))
            for lo, hi in bytesoup.chunks(offs):
                part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, first = bytesoup.word_spans(part, at)
                grams, begin = bytesoup.grams(bytesoup.word_hashes(part, starts, ends), first, n)
                sets, edge = unique_grams(grams, begin)
                full = np.flatnonzero(np.diff(edge))
                keys: list[bytes | None] = [None] * (hi - lo)
                hashes: list[np.ndarray | None] = [None] * (hi - lo)
                if len(full):
                    at0 = edge[full]
                    h = np.stack([np.add.reduceat(bytesoup.mix(sets ^ U64(s)), at0) for s in (0x51ED270B, 0x7FB5D329728EA185)], 1)
                    least = np.stack([np.minimum.reduceat(sets * _MUL[j] + _ADD[j], at0) for j in range(rows * count)], 1)
                    least = bytesoup.mix(least).reshape(len(full), count, rows)
                    band = np.zeros((len(full), count), U64)
                    for r in range(rows):
                        band = bytesoup.mix(band * U64(3) + least[:, :, r])
                    band = bytesoup.mix(band + np.arange(count, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
                    for i, k in enumerate(full):
                        keys[k], hashes[k] = h[i].tobytes(), band[i]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(lo, hi - lo) for x in ("doc_id", "th")), pa.array(keys, pa.binary()), pa.array(np.diff(edge)), pa.array(hashes, pa.list_(pa.int64()))],
                    ["doc_id", "th", "cls", "n_grams", "bands"],
                )

    return sign


def _setter(n: int):
    """Rows of cls, n_rows, buckets and text to the same with the gram set in place of the text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = bytesoup.buffers(batch.column("text"))
            for lo, hi in bytesoup.chunks(offs):
                part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, first = bytesoup.word_spans(part, at)
                grams, begin = bytesoup.grams(bytesoup.word_hashes(part, starts, ends), first, n)
                values, edge = unique_grams(grams, begin)
                column = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values.view(np.int64)))
                rest = [batch.column(name).slice(lo, hi - lo) for name in ("cls", "n_rows", "buckets")]
                yield pa.RecordBatch.from_arrays([*rest, column], ["cls", "n_rows", "buckets", "payload"])

    return sets


def _near(threshold: float):
    def near(sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(s) for s in sets], np.float64)
        both = buckets.shared_counts(sets)
        return both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9

    return near


def _joined(docs: DataFrame, n: int, threshold: float, recall: float, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, th, cls, n_grams), classes (hash, cls, class_id, n_rows, first) and what buckets.linked() finds."""
    rows, count = bands(threshold, recall)
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    signed = cut(lean(docs).mapInArrow(bytesoup.trimmed(_signer(n, rows, count)), "doc_id bigint, th bigint, cls binary, n_grams bigint, bands array<bigint>"))
    classes = signed.where("cls is not null").groupBy("cls")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    classes = classes.agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"), first, F.first("bands").alias("bands"))
    classes = cut(buckets.named(classes))
    placed = buckets.shared(classes, "bands", tile)
    # one text for each class in a bucket: that of its first row
    own = classes.select("cls", "n_rows", "first.*").join(buckets.buckets_of(placed), "cls").alias("c")
    texts = docs.alias("d").join(own, F.expr("d.doc_id <=> c.doc_id and d.th = c.th")).select("cls", "n_rows", "buckets", "text")
    sets = texts.mapInArrow(bytesoup.trimmed(_setter(n)), "cls binary, n_rows bigint, buckets array<bigint>, payload array<bigint>")
    return signed.drop("bands"), classes.drop("bands"), buckets.linked(classes, placed, sets, _near(threshold), np.uint64)


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, tile: int = 256) -> DataFrame:
    """doc_id, class_id, n_grams, n_links, component_id, kept: one row per document.

    class_id: the least doc_id with the same n-gram set (null without words). n_links: other
    documents of Jaccard similarity >= threshold, those of the own class included. component_id:
    the least doc_id reachable by links. kept: the document stays when one of each component does
    (of repeated rows with that id, all; distinct() leaves one).
    """
    signed, classes, found = _joined(docs, n, threshold, recall, tile)
    return buckets.per_row(signed.select("doc_id", "cls", "n_grams"), classes, found, "doc_id").drop("cls")


def distinct(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, tile: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that stay when one row of each component does.

    The one with the least id stays (a null id is greater than all), of equal ids the one with the
    least hash of its n-gram set, then of its text, of equal rows one of them. Rows without words stay. What goes is broadcast
    only after it was counted.
    """
    signed, classes, found = _joined(docs, n, threshold, recall, tile)
    rows = buckets.with_class(signed.where("cls is not null"), classes, found, "first")
    rows = rows.where(~((F.col("root") == F.col("name")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))))
    gone = cut(rows.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_anti")
    twice = cut(signed.where("cls is not null").groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).count().where("count > 1").drop("count"))
    if twice.isEmpty():
        return out
    # repeated rows: number those that are left, and only those
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    plain = [F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")]
    one = out.join(twice, match).withColumn("__k", F.row_number().over(Window.partitionBy("__id", "__th").orderBy(*plain)))
    return out.join(twice, match, "left_anti").unionByName(one.where("__k = 1").select(*docs.columns))

"""Benchmark decontamination by winnowing, with DataFrame functions only.

1. The fingerprint of a window of `n` words is the least hash of the k-grams in it (n - k + 1 of
   them), so any span of n words or more that a document shares with the benchmark has equal
   fingerprints on both sides: none is missed. Windows that follow each other mostly share their
   fingerprint, so a document has far fewer fingerprints than words; these, each once, are
   joined with the benchmark's. In the same scan words are counted.
2. In the documents with a common fingerprint, hits are extended: each window is compared as a
   whole, by its fingerprint and a hash of all its words (128 bits together). Windows that overlap
   merge into spans.

An item of fewer than n words, but not none, is one window of all its words, with the hash of all
its words as its fingerprint and that of its ends beside it; documents are looked up at those
lengths only if the benchmark has them.

What is joined to the documents (the benchmark's fingerprints and windows; the ids of documents
with a common fingerprint) is broadcast only after its rows were counted, up to `broadcast_rows`;
beyond that Spark joins by shuffling both sides.

Defined results: null and empty texts have no words, no hits, and are not contaminated. Repeated
document rows each give a row; null ids are kept. Items without words are ignored; repeated items
count once per item_id; an item with a null id marks words but is in no item count. An empty
benchmark gives no hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, words_of

def _let(value: Column, f) -> Column:
    """f(value), with the value evaluated once: the optimizer can't inline what a lambda binds."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _shifted(a: Column, by: int, f) -> Column:
    """f of each element and the one that stands `by` places on."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + by), n), f)


def _spread(a: Column, length: int, f, then, have: int = 1) -> Column:
    """then(f folded over each run of `length` elements of an array), by doubling.

    The last step takes two runs that overlap: no matter for an idempotent f, and a hash of the
    two still tells all words.
    """
    if have == length:
        return then(a)
    by = min(have, length - have)
    return _let(_shifted(a, by, f), lambda b: _spread(b, length, f, then, have + by))


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _windows(hashes: Column, n: int, k: int) -> Column:
    """Structs (length, a, b) of all windows of n words: a the least k-gram hash, b that of the whole window."""

    def both(g: Column) -> Column:
        row = lambda a, b: F.struct(F.lit(n).alias("length"), a.alias("a"), b.alias("b"))
        return _spread(g, n - k + 1, _least, lambda a: F.zip_with(a, _shifted(g, n - k, _pair), row))

    return _spread(hashes, k, _pair, both)


def _runs(hashes: Column, m: int) -> Column:
    """The same for all runs of m words, m < n, by the hash of the run and that of its ends."""
    row = lambda a, b: F.struct(F.lit(m).alias("length"), a.alias("a"), b.alias("b"))
    ends = _shifted(hashes, m - 1, lambda a, b: F.xxhash64(b, a))
    return _spread(hashes, m, _pair, lambda a: F.zip_with(a, ends, row))


def fingerprints(df: DataFrame, keep: list[str], text: str, n: int, k: int, short: list[int], whole: bool) -> DataFrame:
    """keep..., pos, length, a, b: a row for each window of n words (and each run of a length in short).

    whole: runs of the lengths in short count only if they are the whole text (items).
    """
    hashed = F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))
    rows = df.select(*keep, F.posexplode(_let(hashed, lambda h: _windows(h, n, k))).alias("pos", "w"))
    for m in short:
        run = lambda h: F.when(F.size(h) == m, _runs(h, m)) if whole else _runs(h, m)  # noqa: B023, E731
        rows = rows.unionByName(df.select(*keep, F.posexplode(_let(hashed, run)).alias("pos", "w")))
    return rows.select(*keep, "pos", "w.*")


def _winnowed(hashes: Column, n: int, k: int, short: list[int]) -> Column:
    """The fingerprints, each once, of all windows of n words and all runs of the lengths in short."""
    found = _spread(hashes, k, _pair, lambda g: _spread(g, n - k + 1, _least, F.array_distinct))
    return F.concat(found, *[_spread(hashes, m, _pair, F.array_distinct) for m in short])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, k: int = 8, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, th, n_words) per document row; (doc_id, th, pos, length) of windows that occur in items; (doc_id, th, item_id).

    th tells rows of one id apart: the hash of the text. pos counts words from 0.
    """
    sizes = benchmark.select(F.size(words_of(F.col("text"))).alias("n")).where(F.col("n").between(1, n - 1)).distinct()
    short = sorted(r["n"] for r in sizes.collect())  # n - 1 lengths at most
    items = cut(fingerprints(benchmark, ["item_id"], "text", n, k, short, True).select("item_id", "length", "a", "b").distinct())
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    hashed = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    # a null before the fingerprints: the row that stands for the document itself
    none = F.array(F.lit(None).cast("long"))
    scan = docs.select("doc_id", "th", _let(hashed, lambda h: F.struct(F.size(h).cast("long").alias("n"), F.concat(none, _winnowed(h, n, k, short)).alias("f"))).alias("s"))
    scan = scan.select("doc_id", "th", F.col("s.n").alias("n_words"), F.explode("s.f").alias("a"))
    known = _small(cut(items.select("a", F.lit(True).alias("known")).distinct()), broadcast_rows)
    scan = cut(scan.join(known, "a", "left").where("a is null or known").select("doc_id", "th", "n_words", F.col("a").isNull().alias("row")))
    candidates = _small(cut(scan.where("not row").select("doc_id", "th").distinct()), broadcast_rows).alias("c")
    chosen = docs.alias("d").join(candidates, F.expr("d.doc_id <=> c.doc_id and d.th = c.th"), "left_semi")
    known = _small(cut(items.select("length", "a", "b").distinct()), broadcast_rows)
    found = cut(fingerprints(chosen, ["doc_id", "th"], "text", n, k, short, False).join(known, ["length", "a", "b"]))
    pairs = found.select("doc_id", "th", "length", "a", "b").distinct().join(items, ["length", "a", "b"]).select("doc_id", "th", "item_id").distinct()
    return scan.where("row").drop("row"), found.select("doc_id", "th", "pos", "length").distinct(), pairs


def spans(found: DataFrame) -> DataFrame:
    """doc_id, th, start, end: hits merged into maximal spans of words, end exclusive."""
    w = Window.partitionBy("doc_id", "th").orderBy("pos", "length")
    before = F.max(F.col("pos") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(before.isNull() | (F.col("pos") > before), 1).otherwise(0))
    marked = marked.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.max(F.col("pos") + F.col("length"))
    return marked.groupBy("doc_id", "th", "span").agg(F.min("pos").alias("start"), ends.alias("end")).drop("span")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, k: int = 8, share: int = 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, th, n_words, n_hit, item_ids, hit_spans, contaminated: one row per row of docs (doc_id, text).

    contaminated: at least one word in `share` is part of a window that occurs in the benchmark.
    hit_spans are (start, end) in words; item_ids are sorted as strings.
    """
    rows, found, pairs = hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), n, k, broadcast_rows)
    length = F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit")
    merged = spans(found).groupBy("doc_id", "th").agg(length, F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))
    items = pairs.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    marked = merged.alias("m").join(items.alias("i"), F.expr("m.doc_id <=> i.doc_id and m.th = i.th"), "left")
    marked = marked.select(F.col("m.doc_id").alias("__id"), F.col("m.th").alias("__th"), "n_hit", "hit_spans", "item_ids")
    out = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").select(
        "doc_id",
        "th",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("hit_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_spans"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000, **parameters) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    bad = cut(report(docs, benchmark, broadcast_rows=broadcast_rows, **parameters).where("contaminated").select("doc_id", "th").distinct())
    bad = _small(bad, broadcast_rows).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_anti")

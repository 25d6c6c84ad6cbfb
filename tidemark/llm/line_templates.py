"""Line dedup by a template tree of fixed depth, with DataFrame functions only.

Tree: a line's white space becomes single spaces and each run of digits one sign (variable
fields). Its leaf is given by its number of tokens and its first `depth` tokens. Only leaves with
lines of at least `min_docs` documents go on, so random lines leave after one slim aggregation.

Templates: in a leaf, each place's most frequent token (each distinct line counts with its number
of documents; of equals the least) is fixed if it has at least half of the documents, else it is a
wildcard. Lines that agree with the leaf's template in at least `similarity` of all places belong
to it. The others go on as a group of their own, in which a token is fixed if it has more than
half, until each line has a template; a template of one line is that line. If a group's template
takes less than 0.3 of its documents, several templates share it, and the others are split by
their tokens at one place: of those where no token has half, the one with the fewest and heaviest
tokens (greatest sum of squares), else the one with the least majority. A group loses at least
about a fifth of its documents that way, so rounds grow with the logarithm of the largest leaf. A
line whose token at such a place is a field's rare value may stay a template of its own.
several=False ends after the first template of each leaf. A template in lines of `min_docs`
documents recurs.

Lines of up to `depth` tokens go through the same tree: all of their tokens lead, so the leaf is
the line (digits aside). As short lines are more likely to be equal by chance, templates of fewer
than `short_tokens` tokens may be asked to be in `short_docs` documents instead (the same number by
default, so length makes no difference).

Recurring templates are dropped from all documents but the first (least id, then line), so that
no content is lost altogether; keep_first=False drops it there too.

Hot leaves and templates are aggregated before each shuffle, by (leaf, place, token) or (template,
document); no window or list gathers a template's lines in one task. What is known of a leaf, line
or template is joined with its lines by broadcast for the few of very many lines (`join_hot`), by
shuffle for the others; the set of leaves (fixed-size rows) is broadcast after it was counted, up to `broadcast_rows`.

Defined results: null and empty texts have no lines to drop; a null text stays null. Repeated rows
(equal id and text) count as one document and lose the same lines. Null ids are kept, as the
least. Extra columns stay with dedup(); a column that has an added name is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, hot_from, join_hot

ADDED = ["n_lines", "n_recurring", "n_dropped", "clean_text"]


def _lines(docs: DataFrame, depth: int, short_tokens: int) -> DataFrame:
    """doc_id, th, line, text, leaf, same, short: all lines with tokens, normalised. same: hash of the whole line."""
    text = F.col("text")
    odd = [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\r", "\f", "\x0b")]  # most texts need no replacing, and searching is cheap
    text = F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")).otherwise(text)
    text = F.when(F.rlike(text, F.lit("[0123456789]")), F.regexp_replace(text, "[0123456789]+", "0")).otherwise(text)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    rows = rows.withColumn("text", F.trim("text")).where("text <> ''").withColumn("n", F.size(F.split("text", " ")))
    leaf = F.xxhash64("n", F.substring_index("text", " ", depth))
    return rows.select("doc_id", "th", "line", "text", leaf.alias("leaf"), F.xxhash64("text").alias("same"), (F.col("n") < short_tokens).alias("short"))


def _named(distinct: DataFrame, similarity: float, several: bool) -> DataFrame:
    """leaf, same, own for the distinct lines (leaf, same, text, docs) of mixed leaves. own: 0 for the leaf's first template."""
    group, words = ["leaf", "part"], F.split("text", " ")
    done, rest = [], distinct.withColumn("part", F.lit(0).cast("long"))
    while True:
        tokens = rest.select(*group, "docs", F.posexplode(words).alias("place", "token"))
        counts = tokens.groupBy(*group, "place", "token").agg(F.sum("docs").alias("c"))
        best = F.min(F.struct((-F.col("c")).alias("c"), "token")).alias("best")
        places = counts.groupBy(*group, "place").agg(best, F.sum("c").alias("all"), F.sum(F.col("c").cast("double") * F.col("c")).alias("even"))
        twice = -2 * F.col("best.c")
        fixed = F.when(twice > F.col("all") if done else twice >= F.col("all"), F.col("best.token"))
        open_first = F.when(twice < F.col("all"), F.struct(F.lit(0).alias("k"), (-F.col("even")).alias("v"), "place"))
        at = F.min(F.coalesce(open_first, F.struct(F.lit(1).alias("k"), (twice / 2.0).alias("v"), "place")))
        # a place of the template each: bounded by the line
        template = places.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("place", fixed.alias("token")))).alias("template"), at["place"].alias("at"))
        agree = F.size(F.filter(F.zip_with(words, F.col("template.token"), lambda x, y: x == y), lambda same: same))
        rest = cut(rest.join(template, group).withColumn("fits", agree >= similarity * F.size(words)).drop("template"))
        own = F.col("part") if several else F.when(F.col("fits"), F.col("part")).otherwise(F.col("same"))
        done.append(rest.where("fits" if several else "true").select("leaf", "same", own.alias("own")))
        if not several or rest.where("not fits").isEmpty():
            return reduce(DataFrame.unionByName, done)
        share = rest.groupBy(*group).agg(F.sum(F.when(F.col("fits"), F.col("docs")).otherwise(0)).alias("fit"), F.sum("docs").alias("all"))
        split = F.when(F.col("fit") < 0.3 * F.col("all"), F.get(words, F.col("at")))
        rest = rest.where("not fits").join(share.where("fit < all"), group).select("leaf", "same", "text", "docs", F.xxhash64("part", F.lit(len(done)), split).alias("part"))


def recurring(docs: DataFrame, depth: int = 4, similarity: float = 0.7, min_docs: int = 2, short_tokens: int = 5, short_docs: int | None = None, broadcast_rows: int = 2_000_000, several: bool = True) -> DataFrame:
    """doc_id, th, line, leaf, own (0: the leaf's first template, else another of it), first: lines of recurring templates.

    first: whether it is the template's first line in its first document.
    """
    lines = _lines(docs.select("doc_id", "text"), depth, short_tokens)
    need = F.when(F.first("short"), min_docs if short_docs is None else short_docs).otherwise(min_docs).alias("need")
    count = F.count(F.lit(1))
    per_doc = lines.groupBy("leaf", "doc_id", "th").agg(F.min("same").alias("a"), F.max("same").alias("b"), F.first("short").alias("short"), count.alias("n"))
    leaves = per_doc.groupBy("leaf").agg(count.alias("docs"), (F.min("a") != F.max("b")).alias("mixed"), need, F.sum("n").alias("n"))
    leaves = cut(leaves.where("docs >= need").select("leaf", "mixed", "need", "n"))
    size = leaves.agg(count, F.sum("n")).first()
    hot = hot_from(size[1] or 0)
    if size[0] <= broadcast_rows:
        lines = lines.join(F.broadcast(leaves.drop("n")), "leaf")
    else:
        lines = join_hot(lines, leaves, "leaf", hot).where("mixed is not null")
    # a leaf whose lines are all equal is its own template: only the text of the others is needed
    lines = cut(lines.withColumn("text", F.when(F.col("mixed"), F.col("text"))).drop("short"))
    mixed = lines.where("mixed")
    per_doc = mixed.groupBy("leaf", "same", "doc_id", "th").agg(F.first("text").alias("text"), count.alias("n"))
    distinct = cut(per_doc.groupBy("leaf", "same").agg(F.first("text").alias("text"), count.alias("docs"), F.sum("n").alias("n")))
    named = _named(distinct, similarity, several).join(distinct.select("leaf", "same", "n"), ["leaf", "same"])
    place = ["doc_id", "th", "line", "leaf", "need"]
    alone = lines.where("not mixed").select(*place, F.lit(0).cast("long").alias("own"))
    # one row for each line of a repeated row is enough
    pair = lambda a, b: F.struct(F.col(a), F.col(b)).alias("pair")
    own = join_hot(mixed.select(*place, pair("leaf", "same")), named.select(pair("leaf", "same"), "own", "n"), "pair", hot)
    marked = cut(own.select(*place, "own").unionByName(alone).distinct())
    by_doc = marked.groupBy("leaf", "own", "doc_id", "th").agg(F.min("line").alias("line"), F.first("need").alias("need"), count.alias("n"))
    first: Column = F.min(F.struct("doc_id", "th", "line")).alias("f")
    groups = by_doc.groupBy("leaf", "own").agg(count.alias("docs"), F.first("need").alias("need"), first, F.sum("n").alias("n")).where("docs >= need")
    out = join_hot(marked.select("doc_id", "th", "line", pair("leaf", "own")), groups.select(pair("leaf", "own"), "f", "n"), "pair", hot).where("f is not null")
    return out.select("doc_id", "th", "line", "pair.leaf", "pair.own", F.struct("doc_id", "th", "line").eqNullSafe(F.col("f")).alias("first"))


def dedup(docs: DataFrame, keep_first: bool = True, **parameters) -> DataFrame:
    """All rows and columns of docs (doc_id, text) and n_lines, n_recurring, n_dropped, clean_text."""
    found = recurring(docs, **parameters)
    gone = ~F.col("first") if keep_first else F.lit(True)
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(
        F.count(F.lit(1)).alias("n_recurring"), F.sort_array(F.collect_list(F.when(gone, F.col("line")))).alias("__gone")
    )
    docs = docs.drop(*ADDED)
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return out.select(
        *docs.columns,
        F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce("n_recurring", F.lit(0)).cast("long").alias("n_recurring"),
        F.size(gone).cast("long").alias("n_dropped"),
        F.when(F.size(gone) == 0, F.col("text")).otherwise(kept).alias("clean_text"),
    )

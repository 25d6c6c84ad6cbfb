"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each document of a source gets the same expected number of copies, its source's target over its
source's size. The whole part is sure; the fractions are rounded so that the words of each source
come out as wanted:

- Pivot: of two documents with fractions p, q and sizes s, t, words are moved from one to the
  other until one fraction is 0 or 1. The direction is drawn so that expectations stay as they
  are. The words expected of the two together don't change, so neither does the source's total.
- Tree: the fractional documents of a source are dealt out into blocks of about `block` by a hash.
  A block is folded by pivots and leaves at most one document with a fraction, which goes on to
  the next round, until a source has one left. The number of rounds is the logarithm of the number
  of documents to the base `block`; no task ever holds more than a block at once.
- Root: the one fraction that is left is taken in part (`root="part"`: so many of its words, which
  makes the source's total exact to one word) or drawn (`root="draw"`: whole copies only; the total
  is off by at most that document's size).

Rows that agree in source, id, size and text go through as one unit with their number of rows and
share its copies out evenly, so repeated rows can't pile up in a block. Random numbers are hashes
of the unit, the round and the seed: reruns agree.

Targets: all sources share `share` times all sizes by weight, none gets more than `most` times its
own size; the excess goes to the others by weight until none is above. Only a few sums for each
round of that reach the driver.

Defined results: null and empty texts have size 0 and no words to take. A null source is a source
of its own, the last. Sources whose texts are all empty have target 0. An empty table gives an
empty result. Extra columns stay with apply(), and are ignored by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, global_rank, word_count

UNIT = ["source", "doc_id", "size", "th"]


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target. sizes: source, source_size (one row each)."""
    named = global_rank(sizes.where("source is not null"), [F.col("source")])
    last = named.count()
    named = named.unionByName(sizes.where("source is null").withColumn("rank", F.lit(last).cast("long")))
    table = F.array(*[F.lit(float(w)) for w in weights])
    named = cut(named.select("source", "source_size", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")))
    total, top = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(most * F.col("source_size")), F.lit(0.0))).first()
    goal, level = min(share * total, top), 0.0
    while total:
        full = most * F.col("source_size") <= level * F.col("weight")
        taken, weight = named.agg(
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if not weight or (new := (goal - taken) / weight) <= level:
            break
        level = new
    return named.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.lit(level) * F.col("weight")))


def _draw(seed: int, *by: Column) -> Column:
    """A number from [0, 1) that depends on the unit, the round and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11) * F.lit(2.0**-53)


def _pivot(acc: Column, x: Column) -> Column:
    """Fold one more element (place, p, mass, u) into (place, p, mass of the open one; places that are up)."""
    s, t, p, q = acc["size"], x["size"], acc["p"], x["p"]
    rise = F.least(s * (1 - p), t * q)  # words that the open one can take over
    fall = F.least(s * p, t * (1 - q))  # words that it can give
    up = x["u"] * (rise + fall) < fall
    open_done = F.when(up, s * (1 - p) <= t * q).otherwise(s * p <= t * (1 - q))
    new_done = F.when(up, t * q <= s * (1 - p)).otherwise(t * (1 - q) <= s * p)
    p_new = F.when(up, p + rise / s).otherwise(p - fall / s)
    q_new = F.when(up, q - rise / t).otherwise(q + fall / t)
    risen = F.concat(
        acc["risen"],
        F.when(open_done & up, F.array(acc["at"])).otherwise(F.array().cast("array<int>")),
        F.when(new_done & ~up, F.array(x["at"])).otherwise(F.array().cast("array<int>")),
    )

    def state(at: Column, p: Column, size: Column, risen: Column) -> Column:
        return F.struct(at.alias("at"), p.alias("p"), size.alias("size"), risen.alias("risen"))

    none = state(F.lit(-1), F.lit(0.0), F.lit(0.0), risen)
    both = F.when(open_done & new_done, none).when(open_done, state(x["at"], q_new, t, risen)).otherwise(state(acc["at"], p_new, s, risen))
    return F.when(acc["at"] < 0, state(x["at"], q, t, acc["risen"])).otherwise(both)


def _round(open_: DataFrame, level: int, block: int, seed: int) -> DataFrame:
    """Units with p in (0, 1) to units with p 0, 1 or (one for each block at most) between."""
    here = open_.groupBy("source").agg(F.count(F.lit(1)).alias("units")).alias("c")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("units") / block)).cast("long")
    dealt = open_.alias("o").join(here, F.expr("o.source <=> c.source")).select(
        *[F.col(f"o.{c}") for c in open_.columns],
        F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "o.doc_id", "o.size", "o.th"), blocks).alias("block"),
        _draw(seed + 1, F.lit(level), F.col("o.doc_id"), F.col("o.size"), F.col("o.th")).alias("u"),
    )
    rest = [c for c in open_.columns if c not in ("source", "size")]
    rows = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("size", "u", *rest))).alias("rows"))
    order = F.transform("rows", lambda x, i: F.struct(i.alias("at"), x["p"].alias("p"), x["size"].cast("double").alias("size"), x["u"].alias("u")))
    start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("p"), F.lit(0.0).alias("size"), F.array().cast("array<int>").alias("risen"))
    done = rows.select("source", "rows", F.aggregate(order, start, _pivot).alias("end"))
    out = done.select("source", "end", F.posexplode("rows").alias("at", "x"))
    p = F.when(F.col("at") == F.col("end.at"), F.col("end.p")).otherwise(F.array_contains("end.risen", F.col("at")).cast("double"))
    return out.select("source", "x.size", *[p.alias("p") if c == "p" else F.col(f"x.{c}") for c in rest])


def mix(docs: DataFrame, block: int = 32, seed: int = 5, root: str = "part", **shares) -> DataFrame:
    """doc_id, th, size, source, source_size, target, copies, part, taken: one row per row of docs.

    docs: doc_id, text, source. copies: whole copies to take. part: words of one more copy, which
    only one document of a source can have. taken: copies * size + part.
    """
    slim = docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    units = cut(slim.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goal = cut(targets(sizes, **shares))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")
    start = units.alias("u").join(goal.alias("g"), F.expr("u.source <=> g.source"))
    start = start.select(*[F.col(f"u.{c}") for c in [*UNIT, "n"]], "source_size", "target", share.alias("e"))
    near = F.round("e")
    whole = F.when(F.abs(F.col("e") - near) < 1e-9, near).otherwise(F.floor("e").cast("double"))
    start = cut(start.withColumn("base", whole.cast("long")).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("e") - whole, F.lit(0.0))).otherwise(0.0)).drop("e"))
    done, open_, level = [start.where("p = 0")], start.where("p > 0"), 0
    while open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] > 1:
        level += 1
        both = cut(_round(open_, level, block, seed).select(*start.columns))
        done.append(both.where("p = 0 or p = 1"))
        open_ = both.where("p > 0 and p < 1")
    if root == "draw":
        drawn = (_draw(seed + 2, F.col("doc_id"), F.col("size"), F.col("th")) < F.col("p")).cast("double")
        open_ = open_.withColumn("p", drawn)
    out = open_
    for d in done:
        out = out.unionByName(d)
    out = out.withColumn("copies", F.col("base") + F.floor("p")).withColumn("part", F.round((F.col("p") - F.floor("p")) * F.col("size")).cast("long"))
    # rows of a unit share its copies evenly; the part goes to the first row that has fewer
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    each = F.floor(F.col("copies") / F.col("n")) + (F.col("row") <= F.col("copies") % F.col("n")).cast("long")
    part = F.when(F.col("row") == F.col("copies") % F.col("n") + 1, F.col("part")).otherwise(0)
    out = out.withColumn("each", each).withColumn("part", part.cast("long"))
    return out.select(
        "doc_id", "th", "size", "source", "source_size", "target", F.col("each").alias("copies"), "part", (F.col("each") * F.col("size") + F.col("part")).alias("taken")
    )


def apply(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed documents: each row of docs, with all its columns, as many times as whole copies are taken.

    Meant for root="draw". Repeated rows get the copies of their unit shared out evenly.
    """
    taken = mix(docs, **{"root": "draw"} | parameters).groupBy("doc_id", "th", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("source").alias("__source"), "copies", "n")
    own = docs.columns
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")) & F.col("source").eqNullSafe(F.col("__source"))
    rows = docs.join(taken.withColumnsRenamed({"copies": "__copies", "n": "__n"}), match)
    # rows that agree in id, text and source share their copies out evenly
    w = Window.partitionBy("__id", "__th", "__source").orderBy(*[c for c, kind in docs.dtypes if not kind.startswith("map")])
    same = rows.where("__n > 1").withColumn("__k", F.row_number().over(w))
    same = same.withColumn("__copies", F.floor(F.col("__copies") / F.col("__n")) + (F.col("__k") <= F.col("__copies") % F.col("__n")).cast("long"))
    both = rows.where("__n = 1").select(*own, "__copies").unionByName(same.select(*own, "__copies"))
    return both.select(*own, F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))).alias("__k")).drop("__k")

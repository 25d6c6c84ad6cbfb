"""From raw documents to mixed, sharded training data: one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. run() applies
them one after another without the files between.

1. toxicity: documents that the string-kernel machine scores 0.5 or more go.
2. near_duplicates: of each component of documents of five-word-gram Jaccard similarity 0.8 or
   more, the document with the least id stays.
3. decontamination: documents of which one word in twenty or more is in a 13-word window of the
   benchmark go.
4. mixing: documents are repeated (at most twice) or left out so that sources share the words of
   the mix by weight; only whole copies here, so a source is off its target by one document at most.
5. sharding: all copies get a shard and a slot along the Hilbert curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import hilbert, jaccard_join, mixing, toxicity, winnow
from tidemark.llm.common import cut, table

#: SQL can't express the first two stages and the draws of the mix: tests/llm hold what run() keeps, takes and deals out against a brute-force version.
ORACLE_SQL: str | None = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.distinct(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert.shard(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)  # as the files between stages do: later stages read their input more than once
    return docs

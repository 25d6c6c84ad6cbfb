"""The pipeline's stages on a small corpus, against what each must do by itself."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import registry
from tidemark.llm.common import word_count

SF = "/root/testdata/sf0.001"


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in queries and {"op1_line_template_dedup", "op2_winnowing_decontamination", "op6_license_sentence_rules"} <= set(sql)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=str)


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage = text(40)
    bench = [(1, passage)]
    clean = [(k, text(60), "en", f"s{k % 3}", 1) for k in range(60)]
    near = clean[5][1].split()
    near[30] = "changed"
    rows = clean + [(100, clean[4][1], "en", "s0", 1), (101, " ".join(near), "en", "s1", 1), (102, text(20) + " " + passage + " " + text(20), "en", "s2", 1)]
    rows += [(k, text(20) + " you idiot moron " + text(20) + " stupid", "en", "s0", 1) for k in range(200, 230)]
    labels = [(k, 1, 0) for k in range(60)] + [(k, 0, 1) for k in range(200, 230)]
    for name, schema, data in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long", rows),
        ("labels", "doc_id long, quality int, toxic int", labels),
        ("benchmark", "item_id long, text string", bench),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        if name != "sharding":
            assert after.columns == docs.columns
        docs, seen[name] = after, sorted(r.doc_id for r in after.collect())
    ids = set(range(60))
    assert not set(seen["toxicity"]) & set(range(200, 230)) and len(ids - set(seen["toxicity"])) <= 1
    kept = set(seen["toxicity"])
    assert set(seen["near_duplicates"]) == kept - {100, 101}
    assert set(seen["decontamination"]) == kept - {100, 101, 102}
    assert max(Counter(seen["mixing"]).values()) <= 2 and seen["sharding"] == seen["mixing"]
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    words = docs.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert abs(words - 1.5 * 60 * len(kept - {100, 101, 102})) <= 300
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.shard, r.slot) for r in run.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())


def test_runs_on_the_small_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_run_equals_brute_force(spark):
    """What run() keeps on the small tables: scored text by text, sets compared pair by pair, windows looked up one by one; then the mix and the shards by their laws."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    from test_operators import brute_contamination, brute_links, scores, water

    from tidemark.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if scores(model, [r[1] or ""])[0] < 0.5]
    _, root = brute_links([(i, t) for i, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    told = {d: (n, hit) for d, n, hit, _ in brute_contamination([(i, t) for i, t, _ in rows], items)}
    rows = [r for r in rows if not (told[r[0]][1] > 0 and 20 * told[r[0]][1] >= told[r[0]][0])]
    run = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in run} <= {r[0] for r in rows}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes, taken, copies = Counter(), Counter(), Counter(r.doc_id for r in run)
    for i, _, s in rows:
        sizes[s] += size[i]
        taken[s] += size[i] * copies[i]
    target = water(sizes)
    assert max(copies.values()) <= 2 and all(abs(taken[s] - target[s]) <= max(size.values()) for s in sizes)
    shards = Counter(r.shard for r in run)
    assert max(shards.values()) - min(shards.values()) <= 1

"""Queries of this subpackage, as ``__spark_entry__`` registers them, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cap_filters, hilbert, html_text, jaccard_join, license_rules, line_templates, mixing, pii_crf, toxicity, winnow
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.dedup(docs).drop("text")


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    out = hilbert.slim_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_spherical_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op6_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_rules.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", *[F.array_join(c, ",").alias(c) for c in ("ids", "rules", "licenses")])


def op7_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_personal_data_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.digest(pii_crf.find(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS raw,
                  string_split(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)) AS a FROM documents),
l AS (SELECT r, doc_id, n, s, len(string_split(s, ' ')) AS k, array_to_string(string_split(s, ' ')[1:4], ' ') AS h
      FROM (SELECT r, doc_id, unnest(range(0, len(a))) AS n, trim(unnest(a), ' ') AS s FROM d)),
e AS (SELECT * FROM l WHERE s <> '' AND (k, h) IN (SELECT k, h FROM l GROUP BY k, h HAVING count(DISTINCT r) >= 2)),
u AS (SELECT k, h, s, count(DISTINCT r) AS docs FROM e GROUP BY k, h, s),
t AS (SELECT k, h, s, docs, unnest(range(0, k)) AS p, unnest(string_split(s, ' ')) AS w FROM u),
c AS (SELECT k, h, p, w, sum(docs) AS c FROM t GROUP BY k, h, p, w),
b AS (SELECT k, h, p, w FROM (SELECT *, row_number() OVER (PARTITION BY k, h, p ORDER BY c DESC, w) AS o, sum(c) OVER (PARTITION BY k, h, p) AS al FROM c) WHERE o = 1 AND 2 * c >= al),
o AS (SELECT t.k, t.h, t.s, CASE WHEN count(b.w) >= 0.7 * t.k THEN '' ELSE t.s END AS own
      FROM t LEFT JOIN b ON t.k = b.k AND t.h = b.h AND t.p = b.p AND t.w = b.w GROUP BY t.k, t.h, t.s),
m AS (SELECT e.r, e.doc_id, e.n, e.k, e.h, o.own FROM e JOIN o ON e.k = o.k AND e.h = o.h AND e.s = o.s),
g AS (SELECT k, h, own, min((doc_id, n)) AS f FROM m GROUP BY k, h, own HAVING count(DISTINCT r) >= 2),
x AS (SELECT r, count(*) AS n_recurring, coalesce(list(n) FILTER (WHERE (doc_id, n) <> f), []) AS gone FROM m JOIN g USING (k, h, own) GROUP BY r)
SELECT doc_id, CAST(CASE WHEN text = '' OR text IS NULL THEN 0 ELSE len(raw) END AS BIGINT) AS n_lines, CAST(coalesce(n_recurring, 0) AS BIGINT) AS n_recurring,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN coalesce(len(gone), 0) = 0 THEN text ELSE array_to_string([raw[i + 1] FOR i IN range(0, len(raw)) IF NOT list_contains(gone, i)], chr(10)) END AS clean_text
FROM d LEFT JOIN x USING (r)
"""

_OP2 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[p + 1 : p + 13], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, m, p, array_to_string(w[p + 1 : p + m], ' ') AS t
  FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
), h AS (
  SELECT DISTINCT r, p, m FROM dw WHERE (m, t) IN (SELECT m, t FROM iw)
), n AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS q FROM h) GROUP BY r
), k AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT dw.r, CAST(iw.item_id AS VARCHAR) AS x FROM dw JOIN iw ON dw.m = iw.m AND dw.t = iw.t WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_template_dedup": _OP1, "op2_winnowing_decontamination": _OP2, "op6_license_sentence_rules": license_rules.sql()}

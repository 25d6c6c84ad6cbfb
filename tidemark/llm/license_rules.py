"""Licence scans by sentence rules, with DataFrame functions only.

A text is normalised: lower case, everything but a-z, 0-9 and line breaks one space (so comment
signs at line starts go), none of it beside a line break. A sentence begins at a line's start or
after a sentence's end (full stops, exclamation and question marks before white space; blank
lines) and ends likewise; single line breaks within it stand for spaces, so sentences may be
wrapped at any column. Known sentences (``license_table``, a fixed table) are the branches of one
regular expression, longest first, so of two that begin alike the longer is found, and of two that
overlap the earlier. No row is shuffled. The identifiers of a document's known sentences, in
order, are matched against the rules in order: a rule takes all runs of its identifiers that no
rule before it took. What stands between known sentences doesn't matter.

Comment signs that are words (dnl, REM) stay, so sentences after them aren't found; nor are known
sentences within a line, without a sentence's end before and after.

Defined results: null and empty texts have no sentences. Repeated rows each give a row; null ids
are kept. Documents without known sentences give empty lists. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_table import RULES, SENTENCES

_END, _OTHER = r"[.!?]+(\s+|$)", r"[^a-z0-9\n]+"


def known() -> list[tuple[str, str]]:
    """Normalised entries and identifiers. An entry that has sentence ends within keeps all of its parts, two line breaks between."""
    whole = lambda s: re.sub(_OTHER, " ", re.sub(_END, "\n\n", s.lower())).replace(" \n", "\n").replace("\n ", "\n").strip()
    return sorted({(whole(s), name) for name, sentences in SENTENCES.items() for s in sentences})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_sentences, ids, rules, licenses for every row of docs (doc_id, text).

    ids: known identifiers in order; rules: those that matched, in the rules' order; licenses:
    theirs, each once, in that order. th is the hash of the text.
    """
    names = dict(known())
    flat = {s.replace("\n", " "): name for s, name in names.items()}
    text = F.concat(F.lit("\n"), F.lower(F.coalesce("text", F.lit(""))), F.lit("\n"))
    text = F.regexp_replace(F.regexp_replace(text, _END, "\n\n"), _OTHER, " ")
    text = F.concat(F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")), F.lit("\n"))
    any_of = "|".join(s.replace(" ", "[ \n]") for s in sorted(names, key=len, reverse=True))
    ids = F.create_map(*[F.lit(x) for pair in flat.items() for x in pair])
    found = docs.select("doc_id", F.xxhash64("text").alias("th"), F.regexp_extract_all(text, F.lit(f"\n({any_of})(?=\n)"), F.lit(1)).alias("ids"))
    found = found.withColumn("ids", F.transform("ids", lambda s: F.element_at(ids, F.translate(s, "\n", " "))))
    found = found.withColumn("left", F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|")))
    for k, (_, _, run) in enumerate(RULES):
        run = "".join(f"|{i}|" for i in run)
        found = found.withColumn(f"r{k}", F.contains("left", F.lit(run))).withColumn("left", F.replace("left", F.lit(run), F.lit("||")))
    rules = F.array_compact(F.array(*[F.when(F.col(f"r{k}"), F.lit(name)) for k, (name, _, _) in enumerate(RULES)]))
    spdx = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"r{k}"), F.lit(spdx)) for k, (_, spdx, _) in enumerate(RULES)])))
    return found.select("doc_id", "th", "ids", rules.alias("rules"), spdx.alias("licenses"), F.size("ids").cast("long").alias("n_sentences"))


def sql() -> str:
    """The same as DuckDB's SQL: doc_id, n_sentences, ids, rules, licenses (lists joined by commas).

    It starts from the table's own sentences and looks up what stands at each line's start; a
    chain of successors stands for the leftmost, longest matches that don't overlap.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(s)}, {quote(i)})" for i, sentences in SENTENCES.items() for s in sentences)
    steps, before = [], "f"
    for k, (_, _, ids) in enumerate(RULES):
        run = quote("".join(f"|{i}|" for i in ids))
        steps.append(f"s{k} AS (SELECT * REPLACE (replace(l, {run}, '||') AS l), contains(l, {run}) AS r{k} FROM {before})")
        before = f"s{k}"
    rules = ", ".join(f"CASE WHEN r{k} THEN {quote(n)} END" for k, (n, _, _) in enumerate(RULES))
    seen, licences = {}, []
    for k, (_, spdx, _) in enumerate(RULES):
        seen.setdefault(spdx, []).append(f"r{k}")
    for spdx, any_of in seen.items():
        licences.append(f"CASE WHEN {' OR '.join(any_of)} THEN {quote(spdx)} END")
    plain = """replace(replace(regexp_replace(regexp_replace(lower({}), '[.!?]+(\\s+|$)', chr(10) || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10))"""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {plain.format("chr(10) || coalesce(text, '') || chr(10)")} || chr(10) AS t FROM documents),
k AS (SELECT id, trim(replace({plain.format("s")}, chr(10), ' ')) AS s FROM (VALUES {table}) x(s, id)),
a AS (SELECT r, t, unnest(list_filter(range(1, length(t) + 1), lambda i: t[i] = chr(10))) AS p FROM d WHERE EXISTS (SELECT 1 FROM k WHERE contains(replace(t, chr(10), ' '), s))),
m AS (SELECT DISTINCT r, p, p + length(s) + 1 AS q, id FROM a, (SELECT DISTINCT length(s) AS n FROM k) JOIN k ON length(k.s) = n
      WHERE t[p + n + 1] = chr(10) AND replace(t[p + 1 : p + n], chr(10), ' ') = k.s),
b AS (SELECT r, p, max(q) AS q, arg_max(id, q) AS id FROM m GROUP BY r, p),
c AS (SELECT x.r, x.p, x.q, x.id, (SELECT min(y.p) FROM b y WHERE y.r = x.r AND y.p >= x.q) AS follows FROM b x),
g AS (SELECT * FROM c WHERE (r, p) IN (SELECT r, min(p) FROM c GROUP BY r) UNION ALL SELECT c.* FROM g JOIN c ON c.r = g.r AND c.p = g.follows),
f AS (SELECT r, string_agg(id, ',' ORDER BY p) AS ids, '|' || string_agg(id, '||' ORDER BY p) || '|' AS l, count(*) AS n FROM g GROUP BY r),
{", ".join(steps)}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS ids,
       CASE WHEN n IS NULL THEN '' ELSE concat_ws(',', {rules}) END AS rules,
       CASE WHEN n IS NULL THEN '' ELSE concat_ws(',', {", ".join(licences)}) END AS licenses
FROM d LEFT JOIN {before} USING (r)
"""

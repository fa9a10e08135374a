"""Queries of the record operators: rejected lines, packed values and nested entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.operators.delimited import POS_HEADS, parse_dictionary_lines
from tsumugi.operators.nested import flatten_entities
from tsumugi.operators.packed_values import learn_codes, split_packed
from tsumugi.plans.text import WS
from tsumugi.runtime import table


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return parse_dictionary_lines(table(spark, base, "dict_lines")).where(F.col("reason").isNotNull()).select("row_id", "reason")


def p4_loaded(spark: SparkSession, base: str) -> DataFrame:
    loaded = parse_dictionary_lines(table(spark, base, "dict_lines")).where(F.col("reason").isNull())
    return loaded.select("row_id", "kind", "surface", "reading", "pronunciation", "left_id", "right_id", "cost", F.array_join("pos", "-").alias("pos"), "base")


def packed_fields(spark: SparkSession, base: str) -> DataFrame:
    morphemes = table(spark, base, "morphemes").select(F.lit("morphemes").alias("src"), F.col("morph_id").alias("rec_id"), "feature")
    overlay = table(spark, base, "overlay_entries").select(F.lit("overlay_entries").alias("src"), F.col("overlay_id").alias("rec_id"), "feature")
    return morphemes.unionByName(overlay)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    fields = packed_fields(spark, base)
    return split_packed(fields, learn_codes(fields), ["src", "rec_id"])


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return flatten_entities(table(spark, base, "wikidata_lines"))


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_HEADS = ", ".join(f"'{h}'" for h in sorted(POS_HEADS))
P4_SQL = f"""
WITH l AS (SELECT DISTINCT row_id, kind, line FROM dict_lines WHERE line IS NOT NULL AND NOT (kind = 'user' AND (starts_with(line, '#') OR regexp_full_match(line, '{WS}*')))),
f AS (SELECT *, regexp_full_match(line, '(?s){_FIELD}(,{_FIELD})*') AS whole, list_transform(regexp_extract_all(line || ',', '(?s)({_FIELD}),', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS p FROM l),
c AS (SELECT *, CASE WHEN kind = 'source' THEN len(p) = 13 ELSE len(p) IN (4, 10) END AS fits, regexp_full_match(p[4], '[+-]?[0-9]+') AND try_cast(p[4] AS INTEGER) BETWEEN -32768 AND 32767 AS priced FROM f),
r AS (SELECT *, CASE WHEN NOT whole THEN 'quoting' WHEN NOT fits THEN 'columns' WHEN NOT coalesce(priced, false) THEN 'cost'
  WHEN len(p) > 4 AND (list_contains(p[5:10], '') OR p[5] NOT IN ({_HEADS})) THEN 'pos' WHEN regexp_full_match(p[1], '{WS}*') THEN 'surface' END AS reason FROM c)
"""
P4_LOADED_SQL = P4_SQL + """
SELECT row_id, kind, p[1] AS surface, CASE WHEN kind = 'source' THEN p[12] ELSE p[2] END AS reading, CASE WHEN kind = 'source' THEN p[13] ELSE p[3] END AS pronunciation,
  CASE WHEN kind = 'source' THEN try_cast(p[2] AS INTEGER) END AS left_id, CASE WHEN kind = 'source' THEN try_cast(p[3] AS INTEGER) END AS right_id, p[4]::INTEGER AS cost,
  CASE WHEN len(p) > 4 THEN array_to_string(p[5:10], '-') END AS pos, CASE WHEN kind = 'source' THEN p[11] END AS base FROM r WHERE reason IS NULL
"""


def _leaf(x: str, member: str) -> str:
    return f"CASE json_type({x}) WHEN 'OBJECT' THEN json_extract_string({x}, '$.{member}') WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN NULL ELSE json_extract_string({x}, '$') END"


def _many(source: str) -> str:
    return f"(SELECT *, unnest(CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') WHEN 'NULL' THEN [] ELSE [x] END) AS i, unnest(range(CASE json_type(x) WHEN 'ARRAY' THEN json_array_length(x)::INTEGER WHEN 'NULL' THEN 0 ELSE 1 END)) AS ord_no FROM {source} WHERE x IS NOT NULL)"


ENTITY_SQL = f"""
WITH e AS (SELECT DISTINCT line_id, regexp_replace(line, '^[{WS[1:-1]}\\[,\ufeff]+|[{WS[1:-1]}\\],]+$', '', 'g') AS s FROM wikidata_lines),
v AS (SELECT line_id, s::JSON AS j FROM e WHERE starts_with(s, '{{') AND json_valid(s)),
m AS (SELECT line_id, kind, j, unnest(json_keys(j)) AS k FROM (
  SELECT line_id, 'label' AS kind, json_extract(j, '$.labels') AS j FROM v UNION ALL SELECT line_id, 'alias', json_extract(j, '$.aliases') FROM v UNION ALL SELECT line_id, 'sitelink', json_extract(j, '$.sitelinks') FROM v) WHERE json_type(j) = 'OBJECT'),
x AS (SELECT line_id, kind, k AS map_key, json_extract(j, '$."' || k || '"') AS x FROM m),
b AS (SELECT line_id, map_key, json_extract(x, '$.badges') AS x FROM x WHERE kind = 'sitelink' AND json_type(x) = 'OBJECT'),
flat AS (
  SELECT line_id, kind, map_key, 0 AS ord_no, {_leaf("x", "value")} AS leaf_value FROM x WHERE kind = 'label'
  UNION ALL SELECT line_id, kind, map_key, 0, {_leaf("x", "title")} FROM x WHERE kind = 'sitelink'
  UNION ALL SELECT line_id, kind, map_key, ord_no, {_leaf("i", "value")} FROM {_many("(SELECT * FROM x WHERE kind = 'alias')")}
  UNION ALL SELECT line_id, 'badge', map_key, ord_no, {_leaf("i", "value")} FROM {_many("b")})
"""

QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded, "p6_found": p6_found, "p7_found": p7_found}
SQL = {"p4_found": P4_SQL + "SELECT row_id, reason FROM r WHERE reason IS NOT NULL", "p4_loaded": P4_LOADED_SQL, "p7_found": ENTITY_SQL + "SELECT * FROM flat WHERE leaf_value IS NOT NULL"}

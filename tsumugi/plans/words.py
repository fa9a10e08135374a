"""Queries of dictionaries: user entries, run-time words, validation and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.operators import words as wo
from tsumugi.operators.lattice import entries_found
from tsumugi.plans.lattice import WORDS, part_lexicon, part_texts
from tsumugi.plans.text import WS
from tsumugi.runtime import numbered, table


def entries(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "user_entries").select("entry_id", "surface", "reading", "pronunciation", "cost", "pos", "dict_name").distinct()


def userdict_stats(spark: SparkSession, base: str) -> DataFrame:
    return wo.statistics(entries(spark, base))


def userdict_parse(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "dict_lines").where(F.col("kind") == "user").select("row_id", "line").distinct()
    return wo.parse_lines(lines).select("row_id", "surface", "reading", "pronunciation", "cost", "pos", "error")


def userdict_validation(spark: SparkSession, base: str) -> DataFrame:
    return wo.validation_counts(userdict_parse(spark, base))


def userdict_errors(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "dict_lines").where(F.col("kind") == "user").select("row_id", "line_no", "line").distinct()
    return wo.validation_errors(lines)


def userdict_order(spark: SparkSession, base: str) -> DataFrame:
    """Place of every entry in order of cost, then surface, then id; entries without a cost first."""
    return numbered(entries(spark, base), [F.col("cost"), F.col("surface"), F.col("entry_id")], "place", 1).select("entry_id", "place")


def userdict_merge(spark: SparkSession, base: str) -> DataFrame:
    rows = entries(spark, base)
    mine, other = rows.where(F.col("dict_name") == "user_01"), rows.where(F.col("dict_name") == "user_02")
    return wo.merge(mine, other, "entry_id").select("entry_id", "surface", "dict_name")


def userdict_prefix(spark: SparkSession, base: str) -> DataFrame:
    return wo.find_by_prefix(entries(spark, base), "カ").select("entry_id", "surface")


def userdict_remove(spark: SparkSession, base: str) -> DataFrame:
    rows = entries(spark, base)
    return wo.remove(rows, "データ").groupBy("dict_name").agg(F.count(F.lit(1)).alias("n"))


def userdict_formats(spark: SparkSession, base: str) -> DataFrame:
    return entries(spark, base).select("entry_id", wo.as_csv().alias("csv"), wo.as_dictionary_line().alias("line"), wo.as_json().alias("json"))


def overlay_entries(spark: SparkSession, base: str) -> DataFrame:
    """All entries that have a surface."""
    rows = entries(spark, base).where("surface is not null")
    return wo.to_overlay(rows).groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.min("wcost").alias("least_cost"), F.min("feature").alias("feature"))


def overlay_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Run-time words ahead of system words in a prefix lookup over the part names."""
    lexicon = part_lexicon(spark).add_words([("bluebolt", "ブルーボルト", "ブルーボルト", 500), ("red", "レッド", "レッド", 900)])
    found = entries_found(part_texts(spark, base), lexicon)
    return found.groupBy("surface", "layer").agg(F.sum("n").alias("n"), F.min("wcost").alias("wcost"))


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_ENTRIES = "e AS (SELECT DISTINCT entry_id, surface, reading, pronunciation, cost, pos, dict_name FROM user_entries)"
_LINES = f"""
l AS (SELECT DISTINCT row_id, line_no, {_trim("line")} AS s FROM dict_lines WHERE kind = 'user'),
t AS (SELECT row_id, line_no, s, string_split(s, ',') AS p FROM l WHERE s <> '' AND NOT starts_with(s, '#')),
v AS (SELECT row_id, line_no, s, {_trim("p[1]")} AS surface, {_trim("p[2]")} AS reading, {_trim("p[3]")} AS pronunciation, CASE WHEN regexp_full_match({_trim("p[4]")}, '[+-]?[0-9]+') AND try_cast({_trim("p[4]")} AS INTEGER) BETWEEN -32768 AND 32767 THEN try_cast({_trim("p[4]")} AS INTEGER) END AS cost,
  CASE WHEN len(p) > 4 THEN array_to_string(p[5:], ',') ELSE '名詞,固有名詞,一般,*,*,*' END AS pos, len(p) AS n FROM t),
w AS (SELECT *, CASE WHEN contains(s, chr(10)) THEN 'line break' WHEN n < 4 THEN 'too few fields' WHEN cost IS NULL THEN 'invalid cost' END AS error FROM v),
u AS (SELECT row_id, surface, reading, pronunciation, cost, pos, error FROM w)
"""
_CHARS = "coalesce(sum(length(surface)), 0)"
_JSON = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_OVER = ", ".join(f"('{w}', 1, {cost})" for w, _, _, cost in WORDS) + ", ('bluebolt', 0, 500), ('red', 0, 900)"

QUERIES = {f.__name__: f for f in (userdict_stats, userdict_parse, userdict_validation, userdict_errors, userdict_order, userdict_merge, userdict_prefix, userdict_remove, userdict_formats, overlay_entries, overlay_lookup)}
SQL = {
    "userdict_stats": f"WITH {_ENTRIES} SELECT count(*) AS n_entries, count(DISTINCT surface) AS n_surfaces, avg(cost) AS avg_cost, min(cost) AS min_cost, max(cost) AS max_cost, {_CHARS}::BIGINT AS total_chars, {_CHARS} / count(*)::DOUBLE AS avg_surface_len FROM e",
    "userdict_parse": f"WITH {_LINES} SELECT * FROM u",
    "userdict_validation": f"WITH {_LINES} SELECT count(*) FILTER (error IS NULL) AS n_valid, count(*) FILTER (error IS NOT NULL) AS n_invalid FROM u",
    "userdict_errors": f"WITH {_LINES} SELECT row_id, line_no, error AS message, s AS content FROM w WHERE error IS NOT NULL",
    "userdict_order": f"WITH {_ENTRIES} SELECT entry_id, row_number() OVER (ORDER BY cost NULLS FIRST, surface NULLS FIRST, entry_id) AS place FROM e",
    "userdict_merge": f"""WITH {_ENTRIES}, o AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY entry_id) AS r FROM e WHERE dict_name = 'user_02' AND surface NOT IN (SELECT surface FROM e WHERE dict_name = 'user_01' AND surface IS NOT NULL))
SELECT entry_id, surface, dict_name FROM e WHERE dict_name = 'user_01' UNION ALL SELECT entry_id, surface, dict_name FROM o WHERE r = 1""",
    "userdict_prefix": f"WITH {_ENTRIES} SELECT entry_id, surface FROM e WHERE starts_with(surface, 'カ')",
    "userdict_remove": f"WITH {_ENTRIES} SELECT dict_name, count(*) AS n FROM e WHERE surface IS DISTINCT FROM 'データ' GROUP BY dict_name",
    "userdict_formats": f"""WITH {_ENTRIES}, f AS (SELECT entry_id, coalesce(surface, '') AS surface, coalesce(reading, '') AS reading, coalesce(pronunciation, '') AS pronunciation, coalesce(cost, 0) AS cost, coalesce(pos, '名詞,固有名詞,一般,*,*,*') AS pos FROM e)
SELECT entry_id, concat_ws(',', surface, reading, pronunciation, cost::VARCHAR, pos) AS csv, concat_ws(',', surface, '0', '0', cost::VARCHAR, pos, reading) AS line,
'{{"surface":"' || {_JSON.format('surface')} || '","reading":"' || {_JSON.format('reading')} || '","pronunciation":"' || {_JSON.format('pronunciation')} || '","cost":' || cost || ',"pos":"' || {_JSON.format('pos')} || '"}}' AS json
FROM f""",
    "overlay_entries": f"WITH {_ENTRIES} SELECT surface, count(*) AS n, min(coalesce(cost, 0)) AS least_cost, min(concat_ws(',', coalesce(pos, '名詞,固有名詞,一般,*,*,*'), coalesce(reading, '*'), coalesce(pronunciation, '*'))) AS feature FROM e WHERE surface IS NOT NULL GROUP BY surface",
    "overlay_lookup": f"""WITH w(surface, layer, wcost) AS (VALUES {_OVER}), t AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS text FROM part), s AS (SELECT id, text, unnest(range(length(text))) AS i FROM t)
SELECT w.surface, w.layer, count(*) AS n, min(w.wcost) AS wcost FROM s JOIN w ON substr(s.text, s.i + 1, length(w.surface)) = w.surface GROUP BY ALL""",
}

"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.functions import features as fe
from tsumugi.functions import phonetic as ph
from tsumugi.functions import text as tx
from tsumugi.runtime import table

WS = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def requests(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "parse_requests")


def normalize_requests(spark: SparkSession, base: str) -> DataFrame:
    return requests(spark, base).select("request_id", tx.Normalizer()("text").alias("normalized"), tx.Normalizer().with_lowercase()(F.col("text")).alias("lowered"), tx.Normalizer.minimal()("text").alias("unchanged"))


_OLD = tx.FULL_ASCII + "　〜" + tx.HALF_KANA + tx.ZERO_WIDTH
_NEW = tx.HALF_ASCII + " ～" + tx.FULL_KANA
_NORMAL = f"regexp_replace(regexp_replace(translate(text, {q(_OLD)}, {q(_NEW)}), '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')"
NORMALIZE_SQL = f"SELECT request_id, {_NORMAL} AS normalized, lower({_NORMAL}) AS lowered, text AS unchanged FROM parse_requests"

STEPS = {
    "compatibility": (tx.compatibility, f"translate(text, {q(tx.FULL_ASCII + '　〜')}, {q(tx.HALF_ASCII + ' ～')})"),
    "digits": (tx.halfwidth_digits, f"translate(text, {q(tx.FULL_DIGITS)}, {q(tx.HALF_DIGITS)})"),
    "letters": (tx.halfwidth_letters, f"translate(text, {q(tx.FULL_LETTERS)}, {q(tx.HALF_LETTERS)})"),
    "katakana": (tx.fullwidth_katakana, f"translate(text, {q(tx.HALF_KANA)}, {q(tx.FULL_KANA)})"),
    "visible": (tx.remove_zero_width, f"regexp_replace(text, '[{tx.ZERO_WIDTH}]', '', 'g')"),
    "collapsed": (tx.collapse_whitespace, f"regexp_replace(text, '{WS}+', ' ', 'g')"),
    "trimmed": (tx.trim_whitespace, f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"),
    "unspaced": (tx.remove_whitespace, f"regexp_replace(text, '{WS}+', '', 'g')"),
    "quotes": (tx.normalize_quotes, f"translate(text, {q(tx.QUOTES[0])}, {q(tx.QUOTES[1])})"),
    "punctuation": (tx.normalize_punctuation, f"translate(text, {q(tx.PUNCTUATION[0])}, {q(tx.PUNCTUATION[1])})"),
}


def normalization_steps(spark: SparkSession, base: str) -> DataFrame:
    return requests(spark, base).select("request_id", *[f("text").alias(name) for name, (f, _) in STEPS.items()])


def script_predicates(spark: SparkSession, base: str) -> DataFrame:
    return requests(spark, base).select("request_id", tx.is_hiragana_only("text").alias("hiragana_only"), tx.is_katakana_only("text").alias("katakana_only"), tx.contains_kanji("text").alias("has_kanji"))


SCRIPT_SQL = f"""
SELECT request_id, regexp_full_match(text, '(?s)[぀-ゟ{WS[1:-1]}]*') AS hiragana_only,
  regexp_full_match(text, '(?s)[゠-ヿ･-ﾟ{WS[1:-1]}]*') AS katakana_only, regexp_matches(text, '[{tx.KANJI}]') AS has_kanji
FROM parse_requests
"""


def char_type_counts(spark: SparkSession, base: str) -> DataFrame:
    return requests(spark, base).select("request_id", *[c.alias(f"n_{name}" if name != "japanese_ratio" else name) for name, c in tx.char_type_counts("text").items()])


def _count_sql(members: str) -> str:
    return f"length(text) - length(regexp_replace(text, {q('[' + members + ']')}, '', 'g'))"


_COUNTS = {name: _count_sql(members) for name, members in tx.CHAR_CLASSES.items()}
CHAR_TYPES_SQL = f"""
WITH c AS (SELECT request_id, {', '.join(f'{sql} AS n_{name}' for name, sql in _COUNTS.items())}, length(text) AS n_total FROM parse_requests)
SELECT *, n_total - ({' + '.join(f'n_{name}' for name in _COUNTS)}) AS n_other,
  CASE WHEN n_total = 0 THEN 0.0 ELSE (n_hiragana + n_katakana + n_kanji) / n_total::DOUBLE END AS japanese_ratio FROM c
"""


def byte_offsets(spark: SparkSession, base: str) -> DataFrame:
    morphemes = table(spark, base, "morphemes")
    return morphemes.select("morph_id", F.octet_length("surface").alias("n_bytes"), tx.byte_offset("surface", F.lit(1)).alias("second_at"))


BYTES_SQL = "SELECT morph_id, octet_length(encode(surface)) AS n_bytes, octet_length(encode(surface[1:1])) AS second_at FROM morphemes"


def kana_conversion(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "user_entries").select("entry_id", tx_alias(ph.to_hiragana, "hiragana"), tx_alias(ph.to_katakana, "katakana"))


def tx_alias(f, name: str, column: str = "reading") -> Column:
    return f(column).alias(name)


KANA_SQL = f"SELECT entry_id, translate(reading, {q(tx.KATAKANA)}, {q(tx.HIRAGANA)}) AS hiragana, translate(reading, {q(tx.HIRAGANA)}, {q(tx.KATAKANA)}) AS katakana FROM user_entries"


def phonetics(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "user_entries").select("entry_id", tx_alias(ph.to_romaji, "romaji"), tx_alias(ph.to_ipa, "ipa"), tx_alias(ph.to_xsampa, "xsampa"))


def _hiragana_sql(x: str) -> str:
    return f"translate({x}, {q(tx.KATAKANA)}, {q(tx.HIRAGANA)})"


def _table_pairs(table_: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(table_.items(), key=lambda kv: -len(kv[0]))


def romaji_sql(x: str) -> str:
    doubled = [(f"っ{k}", f"{letter}{k}") for letter, kana in ph.geminations(ph.ROMAJI).items() for k in kana]
    return replaced(_hiragana_sql(x), doubled + [("っ", "tsu")] + _table_pairs(ph.ROMAJI))


def ipa_sql(x: str) -> str:
    doubled = [(f"っ{k}", f"{letter}{k}") for letter, kana in ph.geminations(ph.IPA, ph.IPA_VOWELS).items() for k in kana]
    return replaced(_hiragana_sql(x), doubled + [("ー", "ː")] + _table_pairs(ph.IPA) + [("っ", "")])


def xsampa_sql(x: str) -> str:
    return replaced(_hiragana_sql(x), [("っ", ":"), ("ー", ":")] + _table_pairs(ph.XSAMPA))


PHONETICS_SQL = f"SELECT entry_id, {romaji_sql('reading')} AS romaji, {ipa_sql('reading')} AS ipa, {xsampa_sql('reading')} AS xsampa FROM user_entries"


def token_ipa(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "morphemes").select("morph_id", ph.token_ipa("feature").alias("ipa"))


IPA_CASE = f"""CASE WHEN len(p) >= 9 AND p[9] NOT IN ('*', '') THEN {ipa_sql('p[9]')}
  WHEN len(p) >= 8 AND p[8] NOT IN ('*', '') THEN CASE WHEN p[1] = '助詞' AND p[8] = 'ハ' THEN 'wa' WHEN p[1] = '助詞' AND p[8] = 'ヘ' THEN 'e' WHEN p[1] = '助詞' AND p[8] = 'ヲ' THEN 'o' ELSE {ipa_sql('p[8]')} END END"""
TOKEN_IPA_SQL = f"WITH f AS (SELECT morph_id, string_split(feature, ',') AS p FROM morphemes) SELECT morph_id, {IPA_CASE} AS ipa FROM f"


def feature_fields(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "morphemes").select("morph_id", fe.parse_feature("feature").alias("f"), fe.full_pos("feature").alias("full_pos"), fe.pos_class("feature").alias("pos_class"))
    return rows.select("morph_id", "f.*", "full_pos", "pos_class")


_POS_CASE = "CASE " + " ".join(f"WHEN starts_with(feature, {q(head)}) THEN {q(name)}" for head, name in fe.POS_CLASSES.items()) + " WHEN feature IS NULL THEN 'other' ELSE 'other' END"
FEATURE_SQL = f"""
WITH f AS (SELECT morph_id, feature, string_split(feature, ',') AS p FROM morphemes)
SELECT morph_id, {', '.join(f'p[{i}] AS {name}' for i, name in enumerate(fe.FIELDS, 1))},
  array_to_string(list_filter(p[1:4], lambda x: x <> '*'), '-') AS full_pos, {_POS_CASE} AS pos_class FROM f
"""


def token_members(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "morphemes").select("morph_id", fe.token_dict(F.col("surface"), F.col("feature")).alias("t"))
    return rows.select("morph_id", "t.*")


TOKEN_MEMBERS_SQL = """
WITH f AS (SELECT morph_id, surface, feature, string_split(feature, ',') AS p FROM morphemes)
SELECT morph_id, surface, feature, p[1] AS pos, p[2] AS pos1, p[3] AS pos2, p[4] AS pos3, nullif(p[5], '*') AS inflection,
  nullif(p[6], '*') AS conjugation, nullif(p[7], '*') AS base, nullif(p[8], '*') AS reading, nullif(p[9], '*') AS pronunciation FROM f
"""


def escapes(spark: SparkSession, base: str) -> DataFrame:
    return requests(spark, base).select("request_id", fe.escape_json("text").alias("json"), fe.escape_turtle("text").alias("turtle"), fe.escape_dot("text").alias("dot"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_CONTROL = replaced(_ESCAPED, [])
for _c in range(1, 32):
    if _c not in (9, 10, 13):
        _CONTROL = f"replace({_CONTROL}, chr({_c}), '\\u{_c:04x}')"
ESCAPES_SQL = f"SELECT request_id, {_CONTROL} AS json, {_ESCAPED} AS turtle, {_ESCAPED} AS dot FROM parse_requests"


def uris(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "semantic_entries").groupBy("uri").agg(F.count(F.lit(1)).alias("n_rows"))
    short = rows.withColumn("compact", fe.compact_uri("uri"))
    return short.select("uri", "n_rows", "compact", fe.expand_uri("compact").alias("expanded"), fe.expand_any("compact").alias("expanded_any"), fe.detect_source("uri").alias("source"), fe.schema_org_type(fe.detect_source("uri")).alias("kind"))


def _case(x: str, prefixes: list[str], back: bool, otherwise: str) -> str:
    whens = []
    for p in prefixes:
        long = fe.PREFIXES[p]
        old, new = (f"{p}:", long) if back else (long, f"{p}:")
        whens.append(f"WHEN starts_with({x}, {q(old)}) THEN {q(new)} || substr({x}, {len(old) + 1})")
    return f"CASE {' '.join(whens)} ELSE {otherwise} END"


URIS_SQL = f"""
WITH u AS (SELECT uri, count(*) AS n_rows, {_case('uri', list(fe.COMPACT), False, 'uri')} AS compact FROM semantic_entries GROUP BY uri)
SELECT uri, n_rows, compact, {_case('compact', list(fe.COMPACT), True, "CASE WHEN starts_with(compact, 'http://') OR starts_with(compact, 'https://') THEN compact END")} AS expanded,
  {_case('compact', list(fe.PREFIXES), True, 'compact')} AS expanded_any,
  CASE WHEN contains(uri, 'wikidata.org') THEN 'Wikidata' WHEN contains(uri, 'dbpedia.org') THEN 'DBpedia' WHEN contains(uri, 'schema.org') THEN 'SchemaOrg' ELSE 'Custom' END AS source,
  'http://schema.org/Thing' AS kind FROM u
"""


def dump_paths(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "build_configs").select("build_id", fe.is_wikidata_dump("wikidata_path").alias("wikidata"), fe.is_wikipedia_dump("wikipedia_path").alias("wikipedia"))


DUMP_SQL = """
SELECT build_id, contains(string_split(wikidata_path, '/')[-1], 'wikidata') AND (ends_with(wikidata_path, '.json') OR ends_with(wikidata_path, '.json.gz')) AS wikidata,
  contains(string_split(wikipedia_path, '/')[-1], 'wikipedia') OR contains(string_split(wikipedia_path, '/')[-1], 'abstract') AS wikipedia FROM build_configs
"""

QUERIES = {
    "normalize_requests": normalize_requests, "normalization_steps": normalization_steps, "script_predicates": script_predicates, "char_type_counts": char_type_counts, "byte_offsets": byte_offsets,
    "kana_conversion": kana_conversion, "phonetics": phonetics, "token_ipa": token_ipa, "feature_fields": feature_fields, "token_members": token_members, "escapes": escapes, "uris": uris, "dump_paths": dump_paths,
}
SQL = {
    "normalize_requests": NORMALIZE_SQL, "normalization_steps": "SELECT request_id, " + ", ".join(f"{sql} AS {name}" for name, (_, sql) in STEPS.items()) + " FROM parse_requests",
    "script_predicates": SCRIPT_SQL, "char_type_counts": CHAR_TYPES_SQL, "byte_offsets": BYTES_SQL, "kana_conversion": KANA_SQL, "phonetics": PHONETICS_SQL, "token_ipa": TOKEN_IPA_SQL,
    "feature_fields": FEATURE_SQL, "token_members": TOKEN_MEMBERS_SQL, "escapes": ESCAPES_SQL, "uris": URIS_SQL, "dump_paths": DUMP_SQL,
}

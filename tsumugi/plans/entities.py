"""Queries of entity linking and of the export formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.functions.features import NAMESPACE, PREFIXES, schema_org_type
from tsumugi.functions.phonetic import token_ipa
from tsumugi.operators import entities as en
from tsumugi.operators import exports as ex
from tsumugi.operators.nested import flatten_entities
from tsumugi.plans.records import ENTITY_SQL
from tsumugi.plans.text import IPA_CASE
from tsumugi.runtime import table

MOST = 3
KINDS = ("person", "Place", "ORGANIZATION", "event", "work", "product", "other", "planet", "")
RESOLVED = ["http://www.wikidata.org/entity/Q1", "http://www.wikidata.org/entity/Q7000000000001"]


def flat_entities(spark: SparkSession, base: str) -> DataFrame:
    """Flat entity rows with the entity's id, each line for itself, the first line of an id."""
    lines = table(spark, base, "wikidata_lines")
    ids = lines.select("line_id", F.regexp_extract("line", r'"id"\s*:\s*"(Q\d+)"', 1).alias("entity_id")).where(F.col("entity_id") != "")
    first = ids.groupBy("entity_id").agg(F.min("line_id").alias("line_id"))
    return flatten_entities(lines).join(first, "line_id")


def knowledge_base(spark: SparkSession, base: str) -> DataFrame:
    return en.knowledge_base(flat_entities(spark, base))


def knowledge_base_size(spark: SparkSession, base: str) -> DataFrame:
    return en.index_size(knowledge_base(spark, base))


def candidates(spark: SparkSession, base: str) -> DataFrame:
    """Candidates of all builds, one row per surface and uri with the earliest entry.

    A confidence below 0 counts as 0, above 1 as 1; entries without any (NULL or NaN) are no
    candidates.
    """
    rows = table(spark, base, "semantic_entries").where("surface is not null and uri is not null and confidence is not null and not isnan(confidence)")
    return en.dedupe_candidates(rows.select("entry_id", "surface", "uri", en.clamp(F.col("confidence")).alias("confidence")).distinct(), ["entry_id"])


def candidate_index(spark: SparkSession, base: str) -> DataFrame:
    return candidates(spark, base).select("surface", "uri", "entry_id")


def merge_lexicon(spark: SparkSession, base: str) -> DataFrame:
    users = table(spark, base, "user_entries").select("entry_id", "surface").distinct()
    return en.merge_candidates(users, candidates(spark, base), MOST)


def entity_link(spark: SparkSession, base: str) -> DataFrame:
    tokens = table(spark, base, "morphemes").select("morph_id", "surface").distinct()
    linked = en.link(tokens, candidates(spark, base))
    return linked.groupBy("morph_id").agg(F.count("uri").alias("n_entities"), F.max_by("uri", F.struct("confidence", "uri")).alias("best"))


def _strategy(name: str, strategy: str, **options):
    def query(spark: SparkSession, base: str) -> DataFrame:
        won = en.disambiguate(candidates(spark, base), ["surface"], strategy, "entry_id", **options)
        return won.select("surface", "uri", "rank_no")

    query.__name__ = name
    return query


disambiguate_highest = _strategy("disambiguate_highest", "highest")
disambiguate_prior = _strategy("disambiguate_prior", "prior")
disambiguate_context = _strategy("disambiguate_context", "context", resolved=RESOLVED)
disambiguate_none = _strategy("disambiguate_none", "none")


def pool_entries(spark: SparkSession, base: str) -> DataFrame:
    return en.semantic_pool(candidates(spark, base), ["surface", "uri"])


def schema_types(spark: SparkSession, base: str) -> DataFrame:
    """Types of entities whose class follows from their number, unknown classes and NULL included."""
    kinds = F.array(*map(F.lit, KINDS))
    rows = table(spark, base, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % (len(KINDS) + 1)).cast("int")).alias("kind"))
    return rows.select("p_partkey", schema_org_type(F.col("kind")).alias("type"))


def pool_stats(spark: SparkSession, base: str) -> DataFrame:
    return en.pool_statistics(table(spark, base, "semantic_entries").select("entry_id", "uri").distinct())


def tokens(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "morphemes").select("morph_id", "request_id", "token_ix", "surface", "feature", "word_id", "pos_id", "wcost").distinct()
    return rows.where(F.col("feature").isNotNull() & F.col("surface").isNotNull()).withColumnRenamed("request_id", "text_id").drop("morph_id")


def linked_tokens(spark: SparkSession, base: str) -> DataFrame:
    best = en.disambiguate(candidates(spark, base), ["surface"], "highest", "entry_id").select("surface", F.array(F.struct("uri", "confidence")).alias("entities"))
    return tokens(spark, base).join(best, "surface", "left")


def mentioned_tokens(spark: SparkSession, base: str) -> DataFrame:
    """Tokens of the requests and, as one text per build, the surfaces of the builds, with entities."""
    rows = table(spark, base, "semantic_entries").where("surface is not null").groupBy(F.col("build_id").cast("long").alias("text_id"), "surface").agg(F.min("entry_id").cast("int").alias("token_ix"))
    named = rows.withColumn("feature", F.concat(F.lit("名詞,固有名詞,一般,*,*,*,"), F.col("surface"), F.lit(",*,*")))
    best = en.disambiguate(candidates(spark, base), ["surface"], "highest", "entry_id").select("surface", F.array(F.struct("uri", "confidence")).alias("entities"))
    return tokens(spark, base).select("text_id", "token_ix", "surface", "feature").unionByName(named).join(best, "surface", "left")


def _export(name: str, make):
    def query(spark: SparkSession, base: str) -> DataFrame:
        return make(spark, base)

    query.__name__ = name
    return query


export_plain = _export("export_plain", lambda s, b: ex.plain(tokens(s, b)))
export_plain_ipa = _export("export_plain_ipa", lambda s, b: ex.plain(tokens(s, b).withColumn("ipa", token_ipa("feature"))))
export_dump = _export("export_dump", lambda s, b: ex.dump(tokens(s, b)))
export_json = _export("export_json", lambda s, b: ex.json(tokens(s, b)))
export_wakati = _export("export_wakati", lambda s, b: ex.wakati(tokens(s, b)))
export_word_ids = _export("export_word_ids", lambda s, b: ex.word_ids(tokens(s, b)))
export_triples = _export("export_triples", lambda s, b: ex.triples(mentioned_tokens(s, b)))
export_ntriples = _export("export_ntriples", lambda s, b: ex.ntriples(ex.triples(tokens(s, b))))
export_nquads = _export("export_nquads", lambda s, b: ex.nquads(ex.triples(tokens(s, b))))
export_turtle = _export("export_turtle", lambda s, b: ex.turtle(linked_tokens(s, b)))
export_jsonld = _export("export_jsonld", lambda s, b: ex.jsonld(linked_tokens(s, b).withColumn("ipa", token_ipa("feature"))))


def entity_mentions(spark: SparkSession, base: str) -> DataFrame:
    """How often each entity is mentioned, over the triples table."""
    rows = ex.triples(mentioned_tokens(spark, base))
    return rows.where(F.col("predicate") == f"<{NAMESPACE}entity>").groupBy("object").agg(F.count(F.lit(1)).alias("n_mentions"))


def mention_tokens(spark: SparkSession, base: str) -> DataFrame:
    """Tokens that mention the first or the last of the linked uris, found over the triples table, as the SPARQL text asks."""
    rows = ex.triples(mentioned_tokens(spark, base))
    ends = en.disambiguate(candidates(spark, base), ["surface"], "highest", "entry_id").agg(F.min("uri"), F.max("uri")).first()
    found = [ex.mentions(rows, uri).select("text_id", "token_ix", "surface", F.lit(uri).alias("uri")) for uri in ends if uri is not None]
    return reduce(DataFrame.unionByName, found).distinct() if found else spark.createDataFrame([], "text_id long, token_ix int, surface string, uri string")


_CAND = """c AS (SELECT * FROM (SELECT DISTINCT entry_id, surface, uri, greatest(0::FLOAT, least(1::FLOAT, confidence)) AS confidence FROM semantic_entries WHERE surface IS NOT NULL AND uri IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence))
  QUALIFY row_number() OVER (PARTITION BY surface, uri ORDER BY entry_id) = 1)"""
_SOURCE = "CASE WHEN contains(uri, 'wikidata.org') THEN 'Wikidata' WHEN contains(uri, 'dbpedia.org') THEN 'DBpedia' WHEN contains(uri, 'schema.org') THEN 'SchemaOrg' ELSE 'Custom' END"
_TOK = "t AS (SELECT request_id AS text_id, token_ix, surface, feature, word_id, pos_id, wcost, string_split(feature, ',') AS p FROM (SELECT DISTINCT morph_id, request_id, token_ix, surface, feature, word_id, pos_id, wcost FROM morphemes) WHERE feature IS NOT NULL AND surface IS NOT NULL)"
_BEST = "b AS (SELECT surface, uri FROM c QUALIFY row_number() OVER (PARTITION BY surface ORDER BY confidence DESC, entry_id) = 1)"

_MENTIONED = _TOK.replace("t AS (", "t0 AS (", 1) + """, t AS (SELECT text_id, token_ix, surface, p FROM t0
  UNION ALL SELECT build_id, min(entry_id), surface, ['名詞', '固有名詞', '一般', '*', '*', '*', surface, '*', '*'] FROM semantic_entries WHERE surface IS NOT NULL GROUP BY build_id, surface)"""


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"


def _ranked(score: str, top: bool = True) -> str:
    one = " WHERE rank_no = 1" if top else ""
    return f"WITH {_CAND} SELECT * FROM (SELECT surface, uri, row_number() OVER (PARTITION BY surface ORDER BY {score} DESC, entry_id) AS rank_no FROM c){one}"


def _agg(line: str, separator: str, name: str, head: str = "''", tail: str = "''", where: str = "") -> str:
    return f"WITH {_TOK} SELECT text_id, {head} || string_agg({line}, {separator} ORDER BY token_ix, {line}) || {tail} AS {name} FROM t{where} GROUP BY text_id"


_TRIPLES = f"""r AS (
  SELECT text_id, token_ix, '<{ex.BASE}#token' || token_ix || '>' AS subject, unnest([
    {{'p': '<{PREFIXES['rdf']}type>', 'o': '<{NAMESPACE}Token>'}}, {{'p': '<{NAMESPACE}surface>', 'o': '"' || {_esc('surface')} || '"'}},
    {{'p': '<{NAMESPACE}pos>', 'o': '"' || {_esc('p[1]')} || '"'}}, {{'p': '<{NAMESPACE}reading>', 'o': '"' || {_esc("nullif(p[8], '*')")} || '"'}}]) AS x FROM t)"""
_LINE = "SELECT text_id, token_ix, subject || ' ' || x.p || ' ' || x.o || ' {0}.' AS line FROM r WHERE x.o IS NOT NULL"
_TURTLE_HEAD = "'@base <" + ex.BASE + "> .' || chr(10) || " + " || ".join(f"'@prefix {p}: <{u}> .' || chr(10)" for p, u in PREFIXES.items()) + " || chr(10)"

QUERIES = {
    f.__name__: f
    for f in (knowledge_base, knowledge_base_size, candidate_index, merge_lexicon, entity_link, disambiguate_highest, disambiguate_prior, disambiguate_context, disambiguate_none, pool_entries, pool_stats, schema_types)
    + (export_plain, export_plain_ipa, export_dump, export_json, export_wakati, export_word_ids, export_triples, export_ntriples, export_nquads, export_turtle, export_jsonld, entity_mentions, mention_tokens)
}
_KB = ENTITY_SQL + """, ids AS (SELECT line_id, nullif(regexp_extract(line, '"id"\\s*:\\s*"(Q[0-9]+)"', 1), '') AS entity_id FROM wikidata_lines), first AS (SELECT entity_id, min(line_id) AS line_id FROM ids WHERE entity_id IS NOT NULL GROUP BY 1),
f AS (SELECT entity_id, kind, map_key, leaf_value FROM flat JOIN first USING (line_id) WHERE leaf_value IS NOT NULL), names AS (SELECT DISTINCT entity_id, leaf_value AS surface FROM f WHERE kind IN ('label', 'alias') AND map_key = 'ja'),
links AS (SELECT entity_id, count(DISTINCT map_key) AS n FROM f WHERE kind = 'sitelink' GROUP BY 1),
kb AS (SELECT surface, 'http://www.wikidata.org/entity/' || entity_id AS uri, max(least((0.1::FLOAT + least((coalesce(n, 0)::FLOAT / 100::FLOAT)::FLOAT, 0.9::FLOAT))::FLOAT, 1::FLOAT)) AS confidence FROM names LEFT JOIN links USING (entity_id) GROUP BY ALL)
"""
_JSONLD_HEAD = "'{' || chr(10) || '  \"@context\": {' || chr(10) || " + " || ',' || chr(10) || ".join(f"'    \"{p}\": \"{PREFIXES[p]}\"'" for p in ("wd", "dbr", "schema", "tok")) + " || chr(10) || '  },' || chr(10) || '  \"@type\": \"tok:Analysis\",' || chr(10) || '  \"tokens\": [' || chr(10)"


def _member(name: str, value: str) -> str:
    return f"coalesce('      \"{name}\": \"' || {value} || '\",' || chr(10), '')"


SQL = {
    "knowledge_base": _KB + "SELECT * FROM kb",
    "knowledge_base_size": _KB + "SELECT count(DISTINCT surface) AS n_surfaces, count(*) AS n_mappings FROM kb",
    "export_plain_ipa": f"WITH {_TOK}, i AS (SELECT *, {IPA_CASE} AS ipa FROM t), l AS (SELECT text_id, token_ix, surface || chr(9) || feature || coalesce(chr(10) || '  IPA: /' || ipa || '/', '') AS line FROM i) SELECT text_id, string_agg(line, chr(10) ORDER BY token_ix, line) || chr(10) || 'EOS' || chr(10) AS plain FROM l GROUP BY text_id",
    "export_jsonld": f"""WITH {_TOK}, i AS (SELECT *, {IPA_CASE} AS ipa FROM t), l AS (SELECT text_id, token_ix, '    {{' || chr(10) || {_member("surface", _esc("surface"))} || {_member("pos", _esc("p[1]"))} || {_member("reading", _esc("nullif(p[8], '*')"))}
  || {_member("pronunciation", "'/' || ipa || '/'")} || '      "wcost": ' || coalesce(wcost, 0) || chr(10) || '    }}' AS line FROM i) SELECT text_id, {_JSONLD_HEAD} || string_agg(line, ',' || chr(10) ORDER BY token_ix, line) || chr(10) || '  ]' || chr(10) || '}}' AS jsonld FROM l GROUP BY text_id""",
    "candidate_index": f"WITH {_CAND} SELECT surface, uri, entry_id FROM c",
    "merge_lexicon": f"""WITH {_CAND}, u AS (SELECT DISTINCT entry_id, surface FROM user_entries), k AS (SELECT surface, uri, row_number() OVER (PARTITION BY surface ORDER BY confidence DESC, uri) AS r FROM c),
m AS (SELECT surface, count(*) AS n, string_agg(uri, '|' ORDER BY r) AS uris FROM k WHERE r <= {MOST} GROUP BY surface) SELECT entry_id, u.surface, coalesce(n, 0) AS n_candidates, coalesce(uris, '') AS uris FROM u LEFT JOIN m USING (surface)""",
    "entity_link": f"WITH {_CAND}, m AS (SELECT DISTINCT morph_id, surface FROM morphemes) SELECT morph_id, count(uri) AS n_entities, (max({{'c': confidence, 'u': uri}}) FILTER (uri IS NOT NULL)).u AS best FROM m LEFT JOIN c USING (surface) GROUP BY morph_id",
    "disambiguate_highest": _ranked("confidence"),
    "disambiguate_prior": _ranked(f"(confidence * (CASE WHEN {_SOURCE} = 'Wikidata' THEN 1.2 WHEN {_SOURCE} = 'DBpedia' THEN 1.1 ELSE 1.0 END)::FLOAT)::FLOAT"),
    "disambiguate_context": _ranked(f"CASE WHEN uri IN ({', '.join(repr(u) for u in RESOLVED)}) THEN (confidence * 1.5::FLOAT)::FLOAT ELSE confidence END"),
    "disambiguate_none": _ranked("confidence", top=False),
    "pool_entries": f"WITH {_CAND} SELECT row_number() OVER (ORDER BY surface, uri) AS pool_id, uri, floor((confidence * 255::FLOAT)::FLOAT)::INTEGER / 255::DOUBLE AS confidence, {_SOURCE} AS source FROM c",
    "schema_types": "SELECT p_partkey, 'http://schema.org/' || CASE p_partkey % 10 WHEN 0 THEN 'Person' WHEN 1 THEN 'Place' WHEN 2 THEN 'Organization' WHEN 3 THEN 'Event' WHEN 4 THEN 'CreativeWork' WHEN 5 THEN 'Product' ELSE 'Thing' END AS type FROM part",
    "pool_stats": f"""WITH e AS (SELECT DISTINCT entry_id, uri FROM semantic_entries WHERE uri IS NOT NULL), u AS (SELECT uri, count(*) AS n, {_SOURCE} AS s FROM e GROUP BY uri)
SELECT sum(n)::BIGINT AS n_entries, count(*) AS n_uris, {', '.join(f"coalesce(sum(n) FILTER (s = '{s}'), 0)::BIGINT AS n_{s.lower()}" for s in ("Wikidata", "DBpedia", "SchemaOrg", "Custom"))}, sum(octet_length(encode(uri)) + 1)::BIGINT AS string_bytes FROM u""",
    "export_plain": _agg("surface || chr(9) || feature", "chr(10)", "plain", tail="chr(10) || 'EOS' || chr(10)"),
    "export_dump": _agg("'[' || token_ix || '] ' || surface || ' (pos_id=' || coalesce(pos_id, 0) || ', wcost=' || coalesce(wcost, 0) || ')' || chr(9) || feature", "chr(10)", "dump", tail="chr(10) || 'EOS' || chr(10)"),
    "export_json": _agg(f"'{{\"surface\":\"' || {_esc('surface')} || '\",\"feature\":\"' || {_esc('feature')} || '\"}}'", "','", "json", "'['", "']'"),
    "export_wakati": _agg("surface", "' '", "wakati"),
    "export_word_ids": _agg("coalesce(word_id, 4294967295)::VARCHAR", "' '", "word_ids"),
    "export_triples": f"""WITH {_CAND}, {_BEST}, {_MENTIONED}, {_TRIPLES} SELECT text_id, token_ix, subject, x.p AS predicate, x.o AS object FROM r WHERE x.o IS NOT NULL
UNION ALL SELECT text_id, token_ix, '<{ex.BASE}#token' || token_ix || '>', '<{NAMESPACE}entity>', '<' || uri || '>' FROM t JOIN b USING (surface)""",
    "export_ntriples": f"WITH {_TOK}, {_TRIPLES} " + _LINE.format(""),
    "export_nquads": f"WITH {_TOK}, {_TRIPLES} " + _LINE.format(f"<{ex.GRAPH}> "),
    "export_turtle": f"""WITH {_CAND}, {_BEST}, {_TOK}, l AS (SELECT text_id, token_ix, '<#token' || token_ix || '> a tok:Token ;' || chr(10) || concat_ws(' ;' || chr(10), '    tok:surface "' || {_esc('surface')} || '"', '    tok:pos "' || {_esc('p[1]')} || '"',
  '    tok:reading "' || {_esc("nullif(p[8], '*')")} || '"', '    tok:entity <' || uri || '>') || ' .' || chr(10) || chr(10) AS line FROM t LEFT JOIN b USING (surface))
SELECT text_id, {_TURTLE_HEAD} || string_agg(line, '' ORDER BY token_ix, line) AS turtle FROM l GROUP BY text_id""",
    "mention_tokens": f"""WITH {_CAND}, {_BEST}, {_MENTIONED} SELECT DISTINCT m.text_id, m.token_ix, '"' || {_esc('t.surface')} || '"' AS surface, uri FROM t m JOIN b USING (surface) JOIN t ON t.text_id = m.text_id AND t.token_ix = m.token_ix WHERE uri IN (SELECT min(uri) FROM b UNION SELECT max(uri) FROM b)""",
    "entity_mentions": f"WITH {_CAND}, {_BEST}, {_MENTIONED} SELECT '<' || uri || '>' AS object, count(*) AS n_mentions FROM t JOIN b USING (surface) GROUP BY uri",
}

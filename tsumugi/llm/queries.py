"""Queries of the text operators over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.llm import languages, leaks, lookalikes, packing, sentences
from tsumugi.llm.burst_counts import count_terms
from tsumugi.llm.topn import top_n
from tsumugi.runtime import table

LARGEST_WORD_ID = 4294967294


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return _best_entities(spark, base).select("build_id", "surface", "rank_no", "uri")


def _best_entities(spark: SparkSession, base: str) -> DataFrame:
    settings = table(spark, base, "build_configs").groupBy("build_id").agg(F.max(F.coalesce("max_candidates", F.lit(5))).alias("most"))
    limit = settings.agg(F.max("most")).first()[0] or 0
    rows = table(spark, base, "semantic_entries").select("build_id", "surface", "uri", "confidence").join(settings, "build_id")
    return top_n(rows, ["build_id", "surface"], "uri", "confidence", "most", limit)


P2_SQL = """
WITH s AS (SELECT build_id, max(coalesce(max_candidates, 5)) AS most FROM build_configs GROUP BY build_id),
v AS (
  SELECT e.build_id, e.surface, e.uri, max(greatest(0, least(1, e.confidence))) AS score, max(s.most) AS most
  FROM semantic_entries e JOIN s USING (build_id)
  WHERE e.confidence IS NOT NULL AND NOT isnan(e.confidence) AND e.uri IS NOT NULL
  GROUP BY e.build_id, e.surface, e.uri
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY build_id, surface ORDER BY score DESC, uri) AS INT) AS rank_no FROM v)
SELECT build_id, surface, rank_no, uri FROM r WHERE rank_no <= most
"""


def latest_sentences(spark: SparkSession, base: str) -> DataFrame:
    """word_ids of every sentence in its latest delivery; sentences without an id stand for themselves."""
    rows = table(spark, base, "w2v_corpus").select("sent_id", "loaded_at", "word_ids")
    known = rows.where(F.col("sent_id").isNotNull()).groupBy("sent_id").agg(F.max(F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), "word_ids")).alias("last")).select("last.word_ids")
    return known.unionByName(rows.where(F.col("sent_id").isNull()).select("word_ids"))


def p3_counts(spark: SparkSession, base: str) -> DataFrame:
    counted = count_terms(latest_sentences(spark, base), "word_ids", 0, LARGEST_WORD_ID)
    return counted.select(F.col("term").alias("word_id"), F.col("occurrences").alias("n_occurrences"), F.col("records").alias("n_sentences"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    setting = table(spark, base, "vocab_settings").orderBy("setting_id").first()
    if setting is None:
        return spark.createDataFrame([], "word_id bigint, verdict string")
    holding = latest_sentences(spark, base).where(F.exists("word_ids", lambda x: F.coalesce(x.between(0, LARGEST_WORD_ID), F.lit(False))))
    spoken = holding.agg(F.count(F.lit(1)).alias("n")).scalar()
    rare = F.when(F.col("n_occurrences") < setting.min_count, "rare")
    common = F.when(F.col("n_sentences") > spoken * F.lit(setting.max_share), "common")
    verdicts = p3_counts(spark, base).select("word_id", F.explode(F.array_compact(F.array(rare, common))).alias("verdict"))
    return verdicts


P3_LATEST = """
WITH last AS (
  SELECT sent_id, arg_max(word_ids, coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS ids FROM w2v_corpus WHERE sent_id IS NOT NULL GROUP BY sent_id
  UNION ALL SELECT NULL, word_ids FROM w2v_corpus WHERE sent_id IS NULL
),
numbered AS (SELECT row_number() OVER () AS s, ids FROM last),
words AS (SELECT s, w FROM (SELECT s, unnest(ids) AS w FROM numbered) WHERE w BETWEEN 0 AND 4294967294),
counts AS (SELECT w AS word_id, count(*) AS n_occurrences, count(DISTINCT s) AS n_sentences FROM words GROUP BY w)
"""
P3_COUNTS_SQL = P3_LATEST + "SELECT * FROM counts"
P3_FOUND_SQL = P3_LATEST + """
SELECT word_id, 'rare' AS verdict FROM counts WHERE n_occurrences < (SELECT min_count FROM vocab_settings)
UNION ALL
SELECT word_id, 'common' FROM counts WHERE n_sentences > (SELECT max_share FROM vocab_settings) * (SELECT count(DISTINCT s) FROM words)
"""

def p1_found(spark: SparkSession, base: str) -> DataFrame:
    requests = table(spark, base, "parse_requests").select(F.lit("parse_requests").alias("src"), F.col("request_id").alias("rec_id"), F.lit(0).cast("long").alias("shift"), "text")
    requests = requests.where(F.col("text").isNotNull()).dropDuplicates()
    model = sentences.train(table(spark, base, "parse_requests").select(F.col("request_id").alias("rec_id"), "text"))
    streams = sentences.stream_paragraphs(table(spark, base, "sentence_reads")).select(F.lit("sentence_reads").alias("src"), "rec_id", "shift", "text")
    in_streams = sentences.number_sentences(sentences.split_texts(streams, model).drop("shift"))
    return sentences.split_texts(requests, model).drop("shift").unionByName(in_streams)


def _looks(spark: SparkSession, base: str) -> DataFrame:
    requests = table(spark, base, "parse_requests").select(F.lit("parse_requests.text").alias("field"), F.col("request_id").alias("id"), "text")
    entries = table(spark, base, "user_entries").select(F.lit("user_entries.surface").alias("field"), F.col("entry_id").alias("id"), F.col("surface").alias("text"))
    return requests.unionByName(entries)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    records = _looks(spark, base)
    return lookalikes.same_look_pairs(records, lookalikes.learn_scores(records, "text"))


def p5_forms(spark: SparkSession, base: str) -> DataFrame:
    records = _looks(spark, base)
    return lookalikes.with_forms(records, "text", lookalikes.learn_scores(records, "text")).select("field", "id", "form")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Passages within the error budget, verified by Myers' distance; those at distance 0 share a whole run."""
    return p9_passages(spark, base).where(F.col("distance") == 0).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, base: str) -> DataFrame:
    return leaks.find_leaks(table(spark, base, "documents"), table(spark, base, "eval_items"), fuzzy=True)


def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    settings = [(r.pack_id, r.capacity_tokens) for r in table(spark, base, "pack_settings").where("pack_id is not null and capacity_tokens is not null").distinct().collect()]
    return packing.pack(table(spark, base, "documents"), sorted(settings))


def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    packed = p8_packed(spark, base)
    return packed.groupBy("pack_id", "container_no").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("n_items"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return languages.doubtful(_languages(spark, base))


def _languages(spark: SparkSession, base: str) -> DataFrame:
    documents = table(spark, base, "documents")
    return languages.document_languages(documents, languages.train(documents))


def p10_languages(spark: SparkSession, base: str) -> DataFrame:
    return _languages(spark, base).select("doc_id", "lang", "share", "confidence")


def p10_segments(spark: SparkSession, base: str) -> DataFrame:
    documents = table(spark, base, "documents")
    return languages.language_segments(documents, languages.train(documents))


QUERIES = {"p8_packed": p8_packed, "p8_containers": p8_containers, "p10_found": p10_found, "p10_languages": p10_languages, "p10_segments": p10_segments, "p1_found": p1_found, "p5_found": p5_found, "p5_forms": p5_forms, "p9_found": p9_found, "p9_passages": p9_passages, "p2_found": p2_found, "p3_found": p3_found, "p3_counts": p3_counts}
SQL = {"p2_found": P2_SQL, "p3_found": P3_FOUND_SQL, "p3_counts": P3_COUNTS_SQL}

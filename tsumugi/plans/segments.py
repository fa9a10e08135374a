"""Queries of sentences, windows, chunks, vectors, vocabularies and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsumugi.operators import metrics as me
from tsumugi.operators import segments as se
from tsumugi.operators import vectors as ve
from tsumugi.plans.text import WS
from tsumugi.runtime import table

MOST, OVERLAP = 256, 32
MIN_COUNT, SAMPLE = 5, 1e-4
BOUNDS = me.linear_bounds(0.0, 100.0, 20)
LOG_BOUNDS = me.log_bounds(1.0, 1000.0, 12)


def texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "parse_requests").select(F.col("request_id").alias("text_id"), "text").where(F.col("text").isNotNull()).distinct()


def boundary_sentences(spark: SparkSession, base: str) -> DataFrame:
    return se.sentences(texts(spark, base))


def pending_rests(spark: SparkSession, base: str) -> DataFrame:
    """What sentence buffers still hold after all pieces of each stream."""
    reads = table(spark, base, "sentence_reads").where(F.col("text").isNotNull()).select("stream_id", "read_no", "text").distinct()
    streams = reads.groupBy(F.col("stream_id").alias("text_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("read_no", "text"))).getField("text"), "").alias("text"))
    return se.pending(streams)


def context_windows(spark: SparkSession, base: str) -> DataFrame:
    return se.context_window(se.sentences(texts(spark, base), se.MULTILINGUAL), 2).select("text_id", "ord", "context")


def overlapping_chunks(spark: SparkSession, base: str) -> DataFrame:
    documents = table(spark, base, "documents").where(F.col("text").isNotNull())
    return documents.select("doc_id", F.posexplode(se.chunks(F.col("text"), MOST, OVERLAP)).alias("chunk_no", "chunk"))


def boundary_chunks(spark: SparkSession, base: str) -> DataFrame:
    return texts(spark, base).select("text_id", F.posexplode(se.boundary_chunks(F.col("text"), 64)).alias("chunk_no", "chunk"))


def stream_progress(spark: SparkSession, base: str) -> DataFrame:
    rows = se.sentences(texts(spark, base)).select("sentence", F.char_length("sentence").alias("n_tokens"), F.col("sentence").contains("…").alias("failed"))
    return se.progress(rows)


def corpus(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "w2v_corpus").select("sent_id", "loaded_at", "word_ids").distinct()
    return rows.select("sent_id", F.filter("word_ids", lambda w: w.between(0, 4294967295)).alias("word_ids"))


def vocabulary(spark: SparkSession, base: str) -> DataFrame:
    return ve.vocabulary(corpus(spark, base), MIN_COUNT, SAMPLE)


def context_pairs(spark: SparkSession, base: str) -> DataFrame:
    return ve.context_pairs(corpus(spark, base), 2).groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def mean_pooling(spark: SparkSession, base: str) -> DataFrame:
    pooled = ve.mean_pooling(table(spark, base, "embeddings"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("i", "v")).select("label", "i", F.round("v", 5).alias("v"))


def cosine_to_mean(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "embeddings")
    centers = ve.mean_pooling(rows, "label").withColumnRenamed("embedding", "center")
    return rows.join(centers, "label").select("vec_id", F.round(ve.cosine(F.col("embedding"), F.col("center")), 4).alias("cosine"))


def embedding_lookup(spark: SparkSession, base: str) -> DataFrame:
    tokens = table(spark, base, "morphemes").select("morph_id", "word_id").distinct()
    vectors = table(spark, base, "embeddings").select(F.col("vec_id").alias("word_id"), "embedding")
    return ve.lookup(tokens, vectors).select("morph_id", F.size("embedding").alias("dim"), F.element_at("embedding", 1).cast("double").alias("first"))


def word2vec(spark: SparkSession, base: str) -> DataFrame:
    """Nearest words of every word whose id is divisible by 50, by vectors trained with the operator's
    defaults; without a word frequent enough there is no row."""
    try:
        vectors = ve.train_word2vec(corpus(spark, base).where(F.size("word_ids") > 1), min_count=MIN_COUNT)
    except ValueError:
        return spark.createDataFrame([], "word_id long, rank_no int, neighbour long, cosine double")
    return ve.most_similar(vectors, vectors.where(F.col("word_id") % 50 == 0), 5)


def vectors_info(spark: SparkSession, base: str) -> DataFrame:
    return ve.info(table(spark, base, "embeddings").select(F.col("vec_id").alias("word_id"), "embedding"))


def similar_embeddings(spark: SparkSession, base: str) -> DataFrame:
    """The 5 nearest vectors of every one whose id is divisible by 50."""
    vectors = table(spark, base, "embeddings").select(F.col("vec_id").alias("word_id"), "embedding")
    return ve.most_similar(vectors, vectors.where(F.col("word_id") % 50 == 0), 5).select("word_id", "rank_no", "neighbour", F.round("cosine", 6).alias("cosine"))


def histogram_events(spark: SparkSession, base: str) -> DataFrame:
    return me.histogram(table(spark, base, "events"), "value", BOUNDS)


def log_histogram_orders(spark: SparkSession, base: str) -> DataFrame:
    prices = table(spark, base, "lineitem").select((F.col("l_extendedprice") / 100).alias("v"))
    return me.histogram(prices, "v", LOG_BOUNDS).select("bucket_no", "n")


def percentiles_events(spark: SparkSession, base: str) -> DataFrame:
    return me.percentiles(me.histogram(table(spark, base, "events"), "value", BOUNDS), [50, 95, 99])


def parse_stats(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "sentence_reads").distinct().select(F.char_length("text").alias("n_chars"), F.octet_length("text").alias("n_tokens"), (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("read_at").cast("timestamp"))).alias("seconds"))
    return me.parse_stats(rows)


def stream_laps(spark: SparkSession, base: str) -> DataFrame:
    at = F.unix_micros(F.col("read_at").cast("timestamp"))
    marks = table(spark, base, "sentence_reads").distinct().select(F.col("stream_id").alias("timer"), F.col("read_no").alias("name"), at.alias("at"))
    first = Window.partitionBy("timer").orderBy("at", "name")
    return me.laps(marks.withColumn("at", F.col("at") - F.first("at").over(first))).select("timer", "name", F.col("duration").cast("long").alias("duration"))


def suite_summary(spark: SparkSession, base: str) -> DataFrame:
    results = table(spark, base, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.sum("l_quantity").alias("seconds"), F.count(F.lit(1)).alias("iterations"))
    return me.suite_summary(results).select("n", "fastest", "slowest", F.round("avg_ops", 9).alias("avg_ops"))


def throughput_orders(spark: SparkSession, base: str) -> DataFrame:
    """Rates per kind of lines: lines as items, prices as bytes and quantities as seconds."""
    sums = table(spark, base, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("size"), F.sum(F.col("l_quantity").cast("long")).alias("seconds"))
    rates = sums.select("l_returnflag", "l_linestatus", me.throughput(F.col("items"), F.col("size"), F.col("seconds")).alias("t"))
    return rates.select("l_returnflag", "l_linestatus", *[F.round(F.col(f"t.{c}"), 9).alias(c) for c in ("items_per_second", "bytes_per_second", "mb_per_second")])


def memory_stats(spark: SparkSession, base: str) -> DataFrame:
    """Current and peak of a running balance: sizes of parts, taken and given back in turn."""
    changes = table(spark, base, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 == 0, -F.col("p_size")).otherwise(F.col("p_size")).cast("long").alias("change"))
    return me.memory(changes)


_TEXTS = "t AS (SELECT DISTINCT request_id AS text_id, text FROM parse_requests WHERE text IS NOT NULL)"


def _sentences(boundary: str) -> str:
    s = boundary.replace(".", "\\.").replace("?", "\\?")
    return f"""s AS (SELECT text_id, unnest(l) AS sentence, unnest(range(len(l))) AS ord FROM (SELECT text_id, list_filter(regexp_extract_all(text, '[^{s}]*[{s}]|[^{s}]+'), lambda x: regexp_matches(x, '[^{WS[1:-1]}]')) AS l FROM t))"""


_CORPUS = "c AS (SELECT sent_id, list_filter(word_ids, lambda x: x BETWEEN 0 AND 4294967295) AS ids FROM (SELECT DISTINCT sent_id, loaded_at, word_ids FROM w2v_corpus))"
_BUCKETS = f"""h AS (SELECT i AS bucket_no, ({100.0 / 20} * i)::DOUBLE AS lower, ({100.0 / 20} * (i + 1))::DOUBLE AS upper FROM (SELECT unnest(range(20)) AS i)),
n AS (SELECT CASE WHEN value >= 0 AND value < 100 THEN floor(value / {100.0 / 20})::INTEGER ELSE 19 END AS b, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
k AS (SELECT bucket_no, lower, upper, coalesce(n, 0) AS n FROM h LEFT JOIN n ON b = bucket_no)"""
_MEAN = "m AS (SELECT label, i, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL) GROUP BY ALL)"
_US = "epoch_us({0})"

QUERIES = {
    f.__name__: f
    for f in (boundary_sentences, pending_rests, context_windows, overlapping_chunks, boundary_chunks, stream_progress, vocabulary, context_pairs, mean_pooling, cosine_to_mean, embedding_lookup, word2vec, similar_embeddings, vectors_info)
    + (histogram_events, log_histogram_orders, percentiles_events, parse_stats, stream_laps, suite_summary, memory_stats, throughput_orders)
}
SQL = {
    "boundary_sentences": f"WITH {_TEXTS}, {_sentences(se.JAPANESE)} SELECT text_id, ord, sentence FROM s",
    "pending_rests": """WITH s AS (SELECT stream_id AS text_id, string_agg(text, '' ORDER BY read_no) AS text FROM (SELECT DISTINCT stream_id, read_no, text FROM sentence_reads WHERE text IS NOT NULL) GROUP BY stream_id),
r AS (SELECT text_id, regexp_extract(text, '[^。！？]*$') AS pending FROM s) SELECT text_id, pending, pending <> '' AS has_pending, octet_length(encode(pending)) AS pending_len FROM r""",
    "context_windows": f"WITH {_TEXTS}, {_sentences(se.MULTILINGUAL)} SELECT text_id, ord, coalesce(array_to_string(list(sentence) OVER (PARTITION BY text_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ''), '') AS context FROM s",
    "overlapping_chunks": f"""WITH d AS (SELECT doc_id, text, CASE WHEN octet_length(encode(text)) <= {MOST} THEN 0 ELSE greatest(0, ceil((length(text) - {MOST}) / {MOST - OVERLAP}::DOUBLE))::INTEGER END AS last FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i AS chunk_no, CASE WHEN octet_length(encode(text)) <= {MOST} THEN text ELSE substr(text, i * {MOST - OVERLAP} + 1, {MOST}) END AS chunk FROM (SELECT doc_id, text, unnest(range(last + 1)) AS i FROM d)""",
    "boundary_chunks": f"""WITH RECURSIVE {_TEXTS},
w(text_id, text, i, now, chunk_no, chunk) AS (
  SELECT text_id, text, 0, '', 0, NULL::VARCHAR FROM t
  UNION ALL
  SELECT text_id, text, i + 1, CASE WHEN cut THEN '' ELSE n END, chunk_no + cut::INTEGER, CASE WHEN cut THEN n END
  FROM (SELECT *, (contains('。！？', c) AND octet_length(encode(n)) >= 32 OR octet_length(encode(n)) >= 64) AND regexp_matches(n, '[^{WS[1:-1]}]') AS cut FROM (SELECT *, substr(text, i + 1, 1) AS c, now || substr(text, i + 1, 1) AS n FROM w WHERE i < length(text)))
)
SELECT text_id, chunk_no - 1 AS chunk_no, chunk FROM w WHERE chunk IS NOT NULL UNION ALL SELECT text_id, chunk_no, now FROM w WHERE i = length(text) AND regexp_matches(now, '[^{WS[1:-1]}]')""",
    "stream_progress": f"""WITH {_TEXTS}, {_sentences(se.JAPANESE)}, g AS (SELECT * FROM s WHERE NOT contains(sentence, '…')) SELECT (SELECT sum(octet_length(encode(sentence))) FROM g)::BIGINT AS n_bytes, (SELECT count(*) FROM g) AS n_sentences,
(SELECT sum(length(sentence)) FROM g)::BIGINT AS n_tokens, (SELECT count(*) FROM s WHERE contains(sentence, '…')) AS n_errors, (SELECT avg(octet_length(encode(sentence))) FROM g) AS bytes_per_sentence, (SELECT avg(length(sentence)) FROM g) AS tokens_per_sentence""",
    "vocabulary": f"""WITH {_CORPUS}, w AS (SELECT unnest(ids) AS word_id FROM c), n AS (SELECT word_id, count(*) AS n FROM w GROUP BY 1), f AS (SELECT *, n / (SELECT sum(n) FROM n)::DOUBLE AS f FROM n WHERE n >= {MIN_COUNT})
SELECT word_id, n, row_number() OVER (ORDER BY n DESC, word_id) - 1 AS remapped_id, least(1.0, sqrt({SAMPLE} / f) + {SAMPLE} / f) AS sample_prob FROM f""",
    "context_pairs": f"""WITH {_CORPUS}, k AS (SELECT row_number() OVER () AS s, ids FROM c), w AS (SELECT s, unnest(ids) AS w, unnest(range(len(ids))) AS i FROM k)
SELECT a.w AS center, b.w AS context, count(*) AS n FROM w a JOIN w b ON a.s = b.s AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY ALL""",
    "mean_pooling": f"WITH {_MEAN} SELECT label, i, round(v, 5) AS v FROM m",
    "cosine_to_mean": f"""WITH {_MEAN}, c AS (SELECT label, list(v ORDER BY i) AS center FROM m GROUP BY label)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, center), lambda x: x[1]::DOUBLE * x[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(center, lambda x: x * x)))), 4) AS cosine FROM embeddings JOIN c USING (label)""",
    "embedding_lookup": "WITH m AS (SELECT DISTINCT morph_id, word_id FROM morphemes) SELECT morph_id, len(embedding) AS dim, embedding[1]::DOUBLE AS first FROM m LEFT JOIN embeddings ON vec_id = word_id AND word_id <> 4294967295",
    "vectors_info": "SELECT count(*) AS n_words, max(vec_id) AS max_word_id, max(len(embedding)) AS dim, count(*) FILTER (len(list_filter(embedding, lambda v: v <> 0)) = 0) AS n_zero FROM embeddings",
    "similar_embeddings": """WITH q AS (SELECT a.vec_id AS word_id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY c DESC, neighbour) AS rank_no FROM q) SELECT word_id, rank_no, neighbour, round(c, 6) AS cosine FROM r WHERE rank_no <= 5""",
    "histogram_events": f"WITH {_BUCKETS} SELECT * FROM k",
    "log_histogram_orders": f"""WITH b AS (SELECT unnest(range({len(LOG_BOUNDS) - 1})) AS bucket_no, unnest([{', '.join(map(repr, LOG_BOUNDS[:-1]))}]) AS lo, unnest([{', '.join(map(repr, LOG_BOUNDS[1:]))}]) AS hi),
v AS (SELECT l_extendedprice / 100 AS v FROM lineitem WHERE l_extendedprice IS NOT NULL), n AS (SELECT coalesce(bucket_no, {len(LOG_BOUNDS) - 2}) AS k, count(*) AS n FROM v LEFT JOIN b ON v >= lo AND v < hi GROUP BY 1) SELECT bucket_no, coalesce(n, 0) AS n FROM b LEFT JOIN n ON k = bucket_no""",
    "percentiles_events": f"""WITH {_BUCKETS}, r AS (SELECT *, sum(n) OVER (ORDER BY bucket_no) AS c, sum(n) OVER () AS t FROM k), p AS (SELECT unnest([50.0, 95.0, 99.0])::DOUBLE AS p)
SELECT p, arg_min((lower + upper) / 2, bucket_no)::DOUBLE AS value FROM r, p WHERE c >= floor(t * p / 100) GROUP BY p""",
    "parse_stats": f"""WITH r AS (SELECT length(text) AS c, octet_length(encode(text)) AS k, {_US.format('received_at')} - {_US.format('read_at')} AS s FROM (SELECT DISTINCT * FROM sentence_reads))
SELECT count(*) AS n_texts, sum(c)::BIGINT AS n_chars, sum(k)::BIGINT AS n_tokens, min(s) AS min_seconds, max(s) AS max_seconds, sum(s) / count(*)::DOUBLE AS avg_seconds, sum(c) / sum(s)::DOUBLE AS chars_per_second, sum(k) / sum(s)::DOUBLE AS tokens_per_second, sum(k) / count(*)::DOUBLE AS tokens_per_text FROM r""",
    "stream_laps": f"WITH m AS (SELECT stream_id AS timer, read_no AS name, {_US.format('read_at')} AS at0 FROM (SELECT DISTINCT * FROM sentence_reads)) SELECT timer, name, at0 - coalesce(lag(at0) OVER (PARTITION BY timer ORDER BY at0, name), at0) AS duration FROM m",
    "suite_summary": """WITH r AS (SELECT l_returnflag AS name, sum(l_quantity) AS s, count(*) AS i FROM lineitem GROUP BY 1)
SELECT count(*) AS n, arg_min(name, s / i) AS fastest, arg_max(name, s / i) AS slowest, round(avg(i / s), 9) AS avg_ops FROM r""",
    "throughput_orders": """WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS i, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS b, sum(l_quantity::BIGINT) AS t FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(i / t::DOUBLE, 9) AS items_per_second, round(b / t::DOUBLE, 9) AS bytes_per_second, round(b / t::DOUBLE / 1048576, 9) AS mb_per_second FROM s""",
    "memory_stats": "WITH c AS (SELECT p_partkey AS ord, sum(CASE WHEN p_partkey % 3 = 0 THEN -p_size ELSE p_size END) OVER (ORDER BY p_partkey) AS now FROM part), b AS (SELECT ord, now - least(0, min(now) OVER (ORDER BY ord)) AS held FROM c) SELECT arg_max(held, ord)::BIGINT AS current, max(held)::BIGINT AS peak FROM b",
}

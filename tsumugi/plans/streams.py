"""Queries that run a stream over the driver's tables to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.runtime import checkpoint_dir, table
from tsumugi.streaming.sentences import event_rates, stream_sentences


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """All output of a stream whose input is complete, through a table in the shared folder."""
    where = f"{folder}/{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/out")


def _read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, base, name).schema).parquet(f"{base}/{name}.parque[t]")  # a pattern, as the table may be a file or a folder


def streamed_sentences(spark: SparkSession, base: str) -> DataFrame:
    """Finished sentences per stream when all pieces arrive in one trigger."""
    reads = _read(spark, base, "sentence_reads").dropDuplicates(["stream_id", "read_no"])
    done = drain(stream_sentences(reads, time="read_at", patience="3650 days"), checkpoint_dir(spark))
    return done.where("finished").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.char_length("sentence")).alias("n_chars"))


def streamed_rates(spark: SparkSession, base: str) -> DataFrame:
    """Closed windows of events; those beyond the watermark at the end stay open."""
    rates = drain(event_rates(_read(spark, base, "events"), "1 day", "0 seconds"), checkpoint_dir(spark))
    return rates.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_RAW = "(SELECT stream_id, string_agg(text, '' ORDER BY read_no) AS text FROM (SELECT DISTINCT stream_id, read_no, text FROM sentence_reads WHERE text IS NOT NULL) GROUP BY stream_id)"
QUERIES = {"streamed_sentences": streamed_sentences, "streamed_rates": streamed_rates}
SQL = {
    "streamed_sentences": f"""WITH s AS (SELECT stream_id, unnest(regexp_extract_all(text, '[^。！？]*[。！？]')) AS sentence FROM {_RAW})
SELECT stream_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars FROM s WHERE trim(sentence) <> '' GROUP BY stream_id""",
    "streamed_rates": """WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT * FROM e WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""",
}

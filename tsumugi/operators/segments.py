"""Sentences by boundary characters, context windows, chunks and progress of a stream of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JAPANESE, MULTILINGUAL, NEWLINE = "。！？", "。！？.!?", "\n"  # fixed values


def sentences(texts: DataFrame, boundary: str = JAPANESE) -> DataFrame:
    """text_id, ord and sentence; the boundary character ends its sentence, blank sentences have no row."""
    stop = f"[{re.escape(boundary)}]"
    pieces = F.split(F.col("text"), f"(?<={stop})")
    kept = F.filter(pieces, lambda s: s.rlike(r"(?U)[^\s]"))
    return texts.where(F.col("text").isNotNull()).select("text_id", F.posexplode(kept).alias("ord", "sentence"))


def pending(texts: DataFrame, boundary: str = JAPANESE) -> DataFrame:
    """text_id, the rest behind the last boundary, whether there is one, and its bytes."""
    rest = F.regexp_extract("text", f"(?s)[^{re.escape(boundary)}]*\\z", 0)
    rows = texts.where(F.col("text").isNotNull()).select("text_id", rest.alias("pending"))
    return rows.select("text_id", "pending", (F.col("pending") != "").alias("has_pending"), F.octet_length("pending").alias("pending_len"))


def context_window(rows: DataFrame, n: int) -> DataFrame:
    """Each sentence with the ``n`` before it, joined."""
    before = Window.partitionBy("text_id").orderBy("ord").rowsBetween(-n, -1)
    return rows.withColumn("context", F.array_join(F.collect_list("sentence").over(before), ""))


def chunks(text: Column, most: int, overlap: int) -> Column:
    """Overlapping chunks of ``most`` characters; a text of at most ``most`` bytes stays whole."""
    step = most - min(overlap, most // 2)
    last = F.greatest(F.lit(0), F.ceil((F.char_length(text) - most) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(most)))
    return F.when(F.octet_length(text) <= most, F.array(text)).otherwise(cut)


def boundary_chunks(text: Column, most: int, boundary: str = JAPANESE) -> Column:
    """Chunks cut behind a boundary from half of ``most`` bytes on, or at ``most`` bytes; blank ones are never cut."""
    stops = F.array(*[F.lit(c) for c in boundary])
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, c: Column) -> Column:
        now = F.concat(state["now"], c)
        size = F.octet_length(now)
        cut = (F.array_contains(stops, c) & (size >= most // 2) | (size >= most)) & now.rlike(r"(?U)[^\s]")
        return F.struct(F.when(cut, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"), F.when(cut, F.lit("")).otherwise(now).alias("now"))

    rest = lambda s: F.when(s["now"].rlike(r"(?U)[^\s]"), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), start, step, rest)


def progress(rows: DataFrame) -> DataFrame:
    """Totals over (sentence, n_tokens, failed) and per-sentence means, 0 over nothing."""
    good = F.count_if(~F.col("failed"))
    size = F.coalesce(F.sum(F.when(~F.col("failed"), F.octet_length("sentence"))), F.lit(0))
    tokens = F.coalesce(F.sum(F.when(~F.col("failed"), F.col("n_tokens"))), F.lit(0))
    mean = lambda a: F.when(good == 0, 0.0).otherwise(a / good)
    return rows.agg(size.alias("n_bytes"), good.alias("n_sentences"), tokens.alias("n_tokens"), F.count_if("failed").alias("n_errors"), mean(size).alias("bytes_per_sentence"), mean(tokens).alias("tokens_per_sentence"))

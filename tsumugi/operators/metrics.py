"""Metrics over tables of measurements: histograms, percentiles, parse and timing statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear_bounds(low: float, high: float, n: int) -> list[float]:
    n = max(n, 1)
    return [low + i * (high - low) / n for i in range(n + 1)]


def log_bounds(low: float, high: float, n: int) -> list[float]:
    n = max(n, 1)
    a, b = math.log(max(low, 2.2250738585072014e-308)), math.log(high)
    return [math.exp(a + i * (b - a) / n) for i in range(n + 1)]


def bucket(value: Column, bounds: list[float]) -> Column:
    """Index of the half-open bucket that holds a value; the last one for values outside all."""
    array = F.array(*[F.lit(b) for b in bounds])
    inside = (value >= bounds[0]) & (value < bounds[-1])
    below = F.size(F.filter(array, lambda b: b <= value)) - 1
    return F.when(inside, below).otherwise(len(bounds) - 2)


def histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """bucket_no, lower and upper bound and count of every bucket, empty ones included."""
    counted = values.where(F.col(column).isNotNull()).groupBy(bucket(F.col(column), bounds).alias("bucket_no")).agg(F.count(F.lit(1)).alias("n"))
    frame = values.sparkSession.createDataFrame([(i, bounds[i], bounds[i + 1]) for i in range(len(bounds) - 1)], "bucket_no int, lower double, upper double")
    return frame.join(counted, "bucket_no", "left").select("bucket_no", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def percentiles(buckets: DataFrame, ps: list[float]) -> DataFrame:
    """Midpoint of the first bucket at which the running count reaches floor(total * p / 100)."""
    running = buckets.withColumn("_c", F.sum("n").over(Window.orderBy("bucket_no").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("n").over(Window.partitionBy()))
    wanted = running.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    reached = wanted.where(F.col("_c") >= F.floor(F.col("_t") * F.col("p") / 100))
    return reached.groupBy("p").agg(F.min_by((F.col("lower") + F.col("upper")) / 2, "bucket_no").alias("value"))


def parse_stats(rows: DataFrame) -> DataFrame:
    """Totals over (n_chars, n_tokens, seconds), extremes and rates, 0 over nothing."""
    n, chars, tokens, time = F.count(F.lit(1)), F.sum("n_chars"), F.sum("n_tokens"), F.sum("seconds")
    rate = lambda a, b: F.when((b == 0) | b.isNull(), 0.0).otherwise(a / b)
    return rows.agg(
        n.alias("n_texts"), chars.alias("n_chars"), tokens.alias("n_tokens"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"), rate(time, n).alias("avg_seconds"),
        rate(chars, time).alias("chars_per_second"), rate(tokens, time).alias("tokens_per_second"), rate(tokens, n).alias("tokens_per_text"),
    )


def laps(marks: DataFrame) -> DataFrame:
    """Duration of each lap of (timer, name, at) since the mark before it."""
    return marks.withColumn("duration", F.col("at") - F.coalesce(F.lag("at").over(Window.partitionBy("timer").orderBy("at", "name")), F.lit(0.0)))


def suite_summary(results: DataFrame) -> DataFrame:
    """Number, time, fastest, slowest and mean operations per second of (name, seconds, iterations)."""
    average = F.when(F.col("iterations") == 0, 0.0).otherwise(F.col("seconds") / F.col("iterations"))
    rate = F.when(F.col("seconds") == 0, 0.0).otherwise(F.col("iterations") / F.col("seconds"))
    return results.agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"), F.min_by("name", F.struct(average, "name")).alias("fastest"), F.max_by("name", F.struct(average, "name")).alias("slowest"), F.avg(rate).alias("avg_ops"))


def memory(events: DataFrame) -> DataFrame:
    """Current and peak bytes of (ord, change), never below zero in between; 0 over nothing.

    Each range of ``ord`` is summed up by its total, its lowest and highest running sum and its
    greatest rise; the driver combines one such row per partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = low = high = rise = 0
        for batch in batches:
            sums = total + np.cumsum(batch.column(0).to_numpy(zero_copy_only=False))
            if len(sums):
                lows = np.minimum(np.minimum.accumulate(sums), low)
                high, rise = max(high, int(sums.max())), max(rise, int((sums - lows).max()))
                total, low = int(sums[-1]), int(lows[-1])
        row = (TaskContext.get().partitionId(), total, low, high, rise)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["p", "total", "low", "high", "rise"])

    rows = events.where(F.col("change").isNotNull()).select("ord", F.col("change").cast("long").alias("change"))
    ordered = rows.repartitionByRange("ord", "change").sortWithinPartitions("ord", "change").select("change")
    current = peak = 0
    for r in sorted(ordered.mapInArrow(run, "p long, total long, low long, high long, rise long").collect()):
        peak = max(peak, current + r.high, r.rise)
        current = max(current + r.total, r.total - r.low)
    return events.sparkSession.createDataFrame([(current, peak)], "current long, peak long")


def throughput(items: Column, size: Column, seconds: Column) -> Column:
    per = lambda a: F.when(seconds == 0, 0.0).otherwise(a / seconds)
    return F.struct(per(items).alias("items_per_second"), per(size).alias("bytes_per_second"), (per(size) / 1048576).alias("mb_per_second"), (per(size) / 1073741824).alias("gb_per_second"))

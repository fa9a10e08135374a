"""Top N items of every group by score histograms.

Items are counted once per (group, item) and written to the shared folder. Each group's
scores are counted from there in BINS equal bins. The highest bin at and above which at least
N items lie is a safe lower threshold: every item of the group's top N has a score in or
above it. Thresholds are kept only of groups with more than N items; rows below them are
dropped before any row moves to its group. The survivors are ranked exactly, with the item
as tie key. Ties of any number stay right: rows of one bin are all kept, and the exact
ranking prunes them to N in every task before it shuffles.

Counting is by (group, item) and (group, bin), so a group with a third of all rows is
spread over all tasks and only its BINS counters meet. The thresholds have one row per group
above N. They are written and measured: up to SMALL bytes they are broadcast, so that nothing
is shuffled before it is pruned; beyond, they are joined by group, where the adaptive planner
splits the rows of a hot group.

Defined results: scores that are NULL or NaN are not ranked; scores are clamped to
[0, 1]; an item counts once per group with its highest score; N is per group, NULL
means ``default_n``, and 0 keeps none; a group whose key has no N is left out; repeated
rows change nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.runtime import durable

BINS = 256
SMALL = 32 << 20  # bytes of thresholds that are broadcast


def top_n(rows: DataFrame, group: list[str], item: str, score: str, most: str, limit: int, bins: int = BINS) -> DataFrame:
    """``group`` columns, rank_no, ``item`` and ``score`` of the first ``most`` items per group.

    ``most`` is an integer column, constant within a group and at most ``limit``.
    """
    value = F.col(score)
    valid = rows.where(value.isNotNull() & ~F.isnan(value) & (F.col(most) > 0) & F.col(item).isNotNull())
    clamped = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), value.cast("float")))
    best = valid.groupBy(*group, item).agg(F.max(clamped).alias(score), F.max(most).alias(most))
    best = best.withColumn("_bin", F.floor(F.col(score) * bins).cast("int"))

    best = durable(best)

    histogram = best.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.max(most).alias(most))
    downward = Window.partitionBy(*group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    above = histogram.withColumn("_above", F.coalesce(F.sum("_n").over(downward), F.lit(0)))
    reached = above.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min(F.when(F.col("_above") < F.col(most), F.col("_bin"))).alias("_least"), F.sum("_n").alias("_all"), F.max(most).alias("_most"))
    thresholds = reached.where(F.col("_all") > F.col("_most")).drop("_all", "_most")

    thresholds = durable(thresholds)
    size = thresholds.agg(F.coalesce(F.sum(F.lit(64) + sum((F.coalesce(F.octet_length(F.col(f"_{g}").cast("string")), F.lit(0)) for g in group), F.lit(0))), F.lit(0))).first()[0]
    thresholds = F.broadcast(thresholds) if size <= SMALL else thresholds
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    survivors = best.join(thresholds, same, "left").where(F.col("_least").isNull() | (F.col("_bin") >= F.col("_least")))
    order = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(item))
    ranked = survivors.select(*group, item, score, most).withColumn("rank_no", F.row_number().over(order))
    return ranked.where((F.col("rank_no") <= limit) & (F.col("rank_no") <= F.col(most))).select(*group, "rank_no", item, score)

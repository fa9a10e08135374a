"""Session-level helpers shared by all operators: tables, parallelism and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL = 16 << 20  # bytes per core below which shuffled rows are redistributed for Python work


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Parquet table ``name`` below the folder ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir`` if the session names one.

    Only where it is unset and the master is local (single-machine tests) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="tsumugi-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    Inputs of many splits (every large table) are left alone. Only what would leave cores
    idle is redistributed before CPU-bound Python work: scans of fewer splits than cores,
    and shuffled rows so few that the adaptive planner would merge them into a few tasks.
    Nothing is run to find this out. A session that does not show its plans gets ``df`` back.
    """
    if not hasattr(df, "_jdf"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        size = int(str(execution.optimizedPlan().stats().sizeInBytes()))
        return df.repartition(cores) if size < cores * SMALL else df
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)


def numbered(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """``df`` with consecutive numbers in ``order``, without a task that sees all rows.

    Rows are range-partitioned and sorted; each number is the row's place in its partition
    plus the sizes of the partitions before. The placed rows are written once, so numbers
    do not depend on how often they are read.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return placed.join(offsets, "_p").withColumn(name, F.col("_i") + F.col("_o") + first).drop("_p", "_i", "_o")

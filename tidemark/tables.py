"""Access to the parquet tables of one directory, and to the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset and all is one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it with its lineage cut."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, but as a parquet table, which keeps columns prunable and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_stages(spark: SparkSession) -> int:
    """Delete the tables that this application has written by :func:`written`; gives how many.

    For the end of a job, when no frame that rests on one of them is read any more.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(path(root, f"stage-{spark.sparkContext.applicationId}-*")) or []
    return sum(bool(fs.delete(f.getPath(), True)) for f in found)


def current_memories(memories: DataFrame, *columns: str) -> DataFrame:
    """One row per ``id``: that of the largest ``sync_version`` (a null version is the oldest).

    Rows with a null id are dropped. Among rows that tie in version, exact copies apart, the one whose
    values order last wins, so that the result does not depend on the order of the rows.
    """
    rest = [c for c in columns if c != "id"]
    version = F.coalesce(F.col("sync_version"), F.lit(-(2**62))).alias("_v")
    packed = F.struct(version, *[F.col(c) for c in rest])
    best = memories.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(packed).alias("_m"))
    return best.select("id", *[F.col(f"_m.{c}").alias(c) for c in rest])


def numbered(df: DataFrame, out: str, *order: str) -> DataFrame:
    """``df`` with ``out``: the number of each row, from 0 without gaps, in the order of columns over the whole table.

    Rows are sorted in ranges, each range counts its own, and adds those of the ranges before it: one number a range,
    and no task with all rows. Rows that tie in all of ``order`` get their numbers in any order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_mid", F.monotonically_increasing_id()))  # once, for the numbers are those of one run
    placed = placed.withColumns({"_range": F.shiftright("_mid", 33), "_mid": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    ranges = F.broadcast(ranges.select("_range", before.alias("_before")))  # as many rows as partitions
    return placed.join(ranges, "_range").withColumn(out, F.col("_mid") + F.col("_before")).drop("_mid", "_range", "_before")

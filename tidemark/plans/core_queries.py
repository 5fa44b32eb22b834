"""Queries of the general operators p1 (instants) and p5 (history)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.instants import with_instant
from tidemark.operators.components import functional_components
from tidemark.operators.history import build_history
from tidemark.tables import current_memories, table, written

TIME_FIELDS = ["event_time", "expiration_date", "timestamp"]
CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"


def with_owner_clock(df: DataFrame, owners: DataFrame) -> DataFrame:
    """Add ``home_zone`` and ``month_first`` of each row's user (null and false for unknown users).

    The join is left to the planner: it broadcasts ``owners`` only where its size is under the session's
    threshold, and else sorts and merges, splitting the users that hold many rows.
    """
    clock = owners.groupBy("user_id").agg(F.max("home_zone").alias("home_zone"), F.max(F.col("locale") == "en-US").alias("month_first"))
    return df.join(clock, "user_id", "left")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time value of ``scenarios`` that denotes one instant and is not spelled canonically."""
    fields = F.stack(F.lit(len(TIME_FIELDS)), *[x for f in TIME_FIELDS for x in (F.lit(f), F.col(f))]).alias("field", "value")
    values = table(spark, sf_dir, "scenarios").select("id", "user_id", fields).where("value is not null and id is not null").where(~F.col("value").rlike(CANONICAL) | F.col("value").endswith("\n"))
    clocked = with_owner_clock(values, table(spark, sf_dir, "owners"))
    found = with_instant(clocked, "value", "utc_us", F.col("home_zone"), F.col("month_first")).where("utc_us is not null")
    return found.select("id", "field", "utc_us").distinct()


def lines_of_memories(memories: DataFrame) -> DataFrame:
    """Current memories that belong to a line of two or more: id, component, closed (superseded by another), start_us, end_us."""
    current = current_memories(memories, "superseded_by", "valid_from", "valid_until", "created_at")
    key = lambda c: F.lower(F.trim(F.col(c)))
    current = written(current.withColumn("_key", key("id")).withColumn("_next", key("superseded_by")))
    links = current.where("_next is not null and _next <> _key").select(F.col("_key").alias("id"), F.col("_next").alias("next"))
    links = links.groupBy("id").agg(F.max("next").alias("next"))
    links = links.join(current.select(F.col("_key").alias("next")).distinct(), "next", "left_semi")
    component = functional_components(links)
    linked = current.join(component.select(F.col("id").alias("_key"), "component"), "_key")
    times = linked.select("id", "component", F.col("superseded_by").isNotNull().alias("closed"), "valid_from", "valid_until", "created_at")
    for source, out in (("valid_from", "_from"), ("created_at", "_made"), ("valid_until", "_until")):
        times = with_instant(times, source, out, "UTC")
    return times.select("id", "component", "closed", F.coalesce("_from", "_made").alias("start_us"), F.col("_until").alias("end_us"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every line of superseded memories, with the seconds in which it was valid.

    Two snapshots are merged: the facts that were closed by another one, and those still open.
    """
    members = written(lines_of_memories(table(spark, sf_dir, "memories")))
    first = members.where("start_us is not null").groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("start_us", "id")).alias("f"))
    lines = first.where("n > 1").select("component", F.col("f.id").alias("line_id"))
    members = written(members.join(lines, "component"))
    history = build_history([members.where("closed"), members.where("not closed")], "line_id", "start_us", ["id"], "end_us")
    seconds = lambda c: F.floor(F.col(c) / 1_000_000).cast("bigint")
    return history.select("line_id", F.col("id").alias("memory_id"), seconds("from").alias("from_s"), F.coalesce(seconds("until"), F.lit(-1)).cast("bigint").alias("until_s"))

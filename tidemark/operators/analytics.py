"""Statistics over memories and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_summary(memories: DataFrame) -> DataFrame:
    """``(user_id, total, agents, first_at, last_at)``."""
    return memories.groupBy("user_id").agg(F.count("*").alias("total"), F.count_distinct("agent_id").alias("agents"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def frequency(df: DataFrame, time: str, granularity: str) -> DataFrame:
    """``(period, n)`` by day, week (from Monday) or month; any other granularity is an error."""
    if granularity not in ("day", "week", "month"):
        raise ValueError(f"unknown granularity {granularity}")
    return df.where(F.col(time).isNotNull()).groupBy(F.date_trunc(granularity, F.col(time)).cast("date").alias("period")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nearest-rank p50, p95 and p99 by group."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return df.groupBy(*by).agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), disc(0.99).alias("p99"))


def recall_at(hits: DataFrame, truth: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """``(recall)``: the share of true (query, item) rows among the first ``k`` hits of their query."""
    best = hits.where(F.col("rank") <= k).select(query, item, F.lit(1.0).alias("hit")).distinct()
    return truth.select(query, item).distinct().join(best, [query, item], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def user_totals(users: DataFrame, memories: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """``users(user_id)`` with the counts of their memories and other rows, first and last creation, and distinct agents; 0 without any."""
    own = memories.groupBy("user_id").agg(F.count("*").alias("memories"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count_distinct("agent_id").alias("agents"))
    out, zero = users.join(own, "user_id", "left"), ["memories", "agents", *others]
    for name, rows in others.items():
        out = out.join(rows.groupBy("user_id").agg(F.count("*").alias(name)), "user_id", "left")
    return out.select("user_id", "first_at", "last_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])

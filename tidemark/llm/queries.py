"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.instants import with_instant
from tidemark.llm.conversations import conversations
from tidemark.llm.leaks import leaks
from tidemark.llm.neighbours import nearest, similar_pairs
from tidemark.llm.packing import pack, token_counts, usage
from tidemark.llm.pii import find_pii, mask_pii
from tidemark.llm.sentences import sentences
from tidemark.plans.core_queries import with_owner_clock
from tidemark.tables import current_memories, table, written


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every whole session with its place in the session."""
    events = table(spark, sf_dir, "scenarios").where("kind = 'event' and session_id is not null").select("session_id", "id", "user_id", "role", "content", "timestamp")
    clocked = with_owner_clock(events, table(spark, sf_dir, "owners"))
    timed = with_instant(clocked, "timestamp", "at", F.col("home_zone"), F.col("month_first"))
    return conversations(timed).select("session_id", "turn_no", "id")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "id", "content") for t in ("scenarios", "memories")]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal datum in the contents of scenarios and memories."""
    return find_pii(_contents(spark, sf_dir), "content", ["table_name", "id"]).select("table_name", "id", "kind", "start_at").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of scenarios and memories with placeholders for personal data."""
    return mask_pii(_contents(spark, sf_dir), "content").select("table_name", "id", "masked")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of current memories of similarity 0.93 or more of which one is among the 10 most similar of the other."""
    current = current_memories(table(spark, sf_dir, "memories"), "embedding").withColumnRenamed("embedding", "vector")
    return similar_pairs(current, 64, 0.93, 10).select("id_a", "id_b")


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of all embeddings for every id that 100 divides, searched exactly."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest(e.where("id % 100 = 0"), e, 64, 10, factor=1.0)
    return found.select(F.col("query").alias("vec_id"), "neighbour", F.round("similarity", 4).alias("similarity"))


def p4_nearest_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of all current memories for every memory whose number 100 divides."""
    current = current_memories(table(spark, sf_dir, "memories"), "embedding").withColumnRenamed("embedding", "vector")
    number = F.conv("id", 16, 10).cast("decimal(20,0)")  # ids are hexadecimal
    found = nearest(current.where(number % 100 == 0), current, 64, 10)
    return found.select(F.col("query").alias("id"), "neighbour", "rank", F.round("similarity", 4).alias("similarity"))


def _budgets(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The stated capacities; a handful of rows."""
    return sorted((r.budget_id, r.capacity_tokens) for r in table(spark, sf_dir, "context_budgets").collect())


def p6_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one, in its container of each capacity."""
    sizes = written(token_counts(table(spark, sf_dir, "documents")))  # read twice by the packing
    return pack(sizes, _budgets(spark, sf_dir))


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return usage(p6_bins(spark, sf_dir), _budgets(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds at least half of an evaluation item's passage."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document."""
    return sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p3_masked": p3_masked, "p4_found": p4_found, "p4_nearest": p4_nearest, "p4_nearest_memories": p4_nearest_memories, "p6_bins": p6_bins, "p6_usage": p6_usage, "p7_found": p7_found, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    cosine = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
    return {
        "p4_nearest": f"SELECT vec_id, neighbour, round(s, 4) AS similarity FROM (SELECT q.vec_id, e.vec_id AS neighbour, {cosine} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {cosine} DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) WHERE r <= 10",
    }

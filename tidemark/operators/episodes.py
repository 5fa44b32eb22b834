"""From events to episodes and facts: compaction, context, access, erasure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import preview, token_estimate
from tidemark.operators.lifecycle import reinforced, retention

#: Sessions under so many tokens are summarised by their first messages, without a model.
SMALL = 200


def compacted(events: DataFrame, processed: DataFrame | None = None, first: int = 5) -> DataFrame:
    """``(session_id, user_id, title, summary, n, tokens, start_at, end_at, small)``: one episode a session.

    ``events`` has ``session_id``, ``id``, ``user_id``, ``role``, ``content`` and ``at``; those in
    ``processed(id)`` are left out. Rows without ``at`` come last in their session. The title is the first message of a user, the summary the first ``first``
    messages, up to 2,000 characters. Only those messages are gathered, however long a session is. Sessions
    that are not ``small`` are for a model to purify; rows without session or content are ignored.
    """
    rows = events.where("session_id is not null and content is not null")
    if processed is not None:
        rows = rows.join(processed.select("id").distinct(), "id", "left_anti")
    keys, user = ["session_id", "id"], F.lower(F.trim("role")) == "user"
    # the figures need no whole texts, so none are shuffled for them
    slim = rows.select(*keys, "user_id", "at", user.alias("_user"), F.when(user, preview(F.col("content"), 60)).alias("_title"), token_estimate(F.col("content")).alias("_tokens")).dropDuplicates(keys)
    stats = slim.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"), F.min_by("_title", F.when(F.col("_user"), F.struct(F.col("at").isNull().alias("_late"), "at", "id"))).alias("title"),
        F.count("*").alias("n"), F.sum("_tokens").alias("tokens"), F.min("at").alias("start_at"), F.max("at").alias("end_at"),
    )
    order = Window.partitionBy("session_id").orderBy(F.asc_nulls_last("at"), "id")
    lead = rows.select(*keys, "at", "content").dropDuplicates(keys).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first)
    text = lead.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "content"))), lambda m: m.content), "\n").alias("summary"))
    joined = stats.join(text, "session_id")
    return joined.select("session_id", "user_id", "title", F.substring("summary", 1, 2000).alias("summary"), "n", "tokens", "start_at", "end_at", (F.col("tokens") < SMALL).alias("small"))


def first_texts(rows: DataFrame, keys: list[str], order: list[Column], text: str, n: int, joint: str) -> DataFrame:
    """``(*keys, text)``: the first ``n`` texts of every key in an order, joined; no more than those are gathered."""
    first = rows.where(F.col(text).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", text))), lambda m: m[text]), joint)
    return first.groupBy(*keys).agg(joined.alias("text"))


def session_context(events: DataFrame, session_id: str, budget: int) -> DataFrame:
    """``(id, role, content, at)``: the newest messages of a session within a token budget, oldest first.

    A message is estimated at ten tokens at least, so no more than a tenth of the budget are looked at.
    """
    own = events.where(F.col("session_id") == session_id).dropDuplicates(["id"]).orderBy(F.desc("at"), F.desc("id")).limit(budget // 10 + 1)
    run = Window.partitionBy(F.lit(0)).orderBy(F.desc("at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # budget / 10 rows
    kept = own.withColumn("_s", F.sum(token_estimate(F.coalesce("content", F.lit("")))).over(run)).where(F.col("_s") <= budget)
    return kept.select("id", "role", "content", "at").orderBy("at", "id")


def chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """``df`` with ``chunk_no`` and ``chunk``: overlapping runs of ``size`` sentences by simple terminators."""
    sentences = F.filter(F.split(F.col(text), "(?<=[.!?。！？])\\s*"), lambda s: s.rlike("[^\\s\\p{Z}]"))
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_ss") - 1 - overlap, F.lit(0)), F.lit(step))
    cut = df.where(F.col(text).isNotNull()).withColumn("_ss", sentences).where(F.size("_ss") > 0)
    return cut.select("*", F.posexplode(starts).alias("chunk_no", "_at")).withColumn("chunk", F.array_join(F.slice("_ss", F.col("_at") + 1, size), " ")).drop("_ss", "_at")


def most_queried(links: DataFrame, queried: DataFrame) -> DataFrame:
    """``(id, queried)``: the largest ``queried_count(session_id, queried_count)`` of the sessions in ``links(id, session_id)``, 0 without one."""
    return links.join(queried, "session_id", "left").groupBy("id").agg(F.coalesce(F.max("queried_count"), F.lit(0)).alias("queried"))


def priorities(episodes: DataFrame, queried: DataFrame) -> DataFrame:
    """Episodes with ``queried``: the largest query count of their sessions, 0 without one; most wanted first."""
    most = most_queried(episodes.select("id", F.explode("session_ids").alias("session_id")), queried)
    return episodes.join(most, "id", "left").withColumn("queried", F.coalesce("queried", F.lit(0))).orderBy(F.desc("queried"), F.desc_nulls_last("significance"), "id")


def accessed(memories: DataFrame, log: DataFrame, days: Column) -> DataFrame:
    """``memories`` after the accesses in ``log(id)``: counts add up, stability grows once per row that was read."""
    reads = log.groupBy("id").agg(F.count("*").alias("_reads"))
    joined = memories.join(reads, "id", "left")
    kept = retention(days, F.col("stability"), F.col("resolution"))
    grown = F.when(F.col("_reads").isNotNull(), reinforced(F.col("stability"), kept)).otherwise(F.col("stability"))
    return joined.withColumns({"stability": grown, "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_reads", F.lit(0))}).drop("_reads")


def scoped_delete(memories: DataFrame, scope: Column, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what stays, history rows of what goes); immutable rows stay unless forced."""
    gone = F.coalesce(scope, F.lit(False)) & (F.lit(force) | ~F.coalesce("immutable", F.lit(False)))
    return memories.where(~gone), memories.where(gone).select("id", F.lit("DELETE").alias("event"), F.col("content").alias("old_content"))


def erased(tables: dict[str, DataFrame], user_id: str, edges: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """All tables without a user: rows by ``user_id``, and for ``edges`` {table: (column, table it points at)} those that point at erased rows."""
    gone = {n: df.where(F.col("user_id") == user_id) for n, df in tables.items() if "user_id" in df.columns}
    out = {n: df.where(F.col("user_id").isNull() | (F.col("user_id") != user_id)) if n in gone else df for n, df in tables.items()}
    for name, (column, target) in (edges or {}).items():
        out[name] = out[name].join(gone[target].select(F.col("id").alias(column)).distinct(), column, "left_anti")
    return out


def reranked(hits: DataFrame, query: str, scorer: Callable | None, k: int) -> DataFrame:
    """The best ``k`` hits by a scorer (a pandas UDF of query and text); without one, or where it fails with null, by their score."""
    if scorer is None:
        return hits.orderBy(F.desc("score"), "id").limit(k)
    scored = hits.withColumn("rerank", scorer(F.lit(query), F.col("content")))
    return scored.orderBy(F.desc_nulls_last("rerank"), F.desc("score"), "id").limit(k)


def facts_from_answers(answers: DataFrame, answer: str) -> DataFrame:
    """``(id, fact, op)`` from models' answers: lists of strings, ``facts``, ``memory`` or operations ADD, UPDATE, DELETE, NONE.

    Answers that are no JSON after repair give no rows.
    """
    from tidemark.functions.text import repaired_json

    fixed = answers.withColumn("_j", repaired_json(F.col(answer)))
    item = "array<struct<text string, fact string, content string, memory string, event string, op string>>"
    body = F.coalesce(F.get_json_object("_j", "$.facts"), F.get_json_object("_j", "$.memory"), F.get_json_object("_j", "$.operations"), F.col("_j"))
    parsed = fixed.withColumn("_b", body)
    plain = parsed.select("id", F.explode(F.from_json("_b", "array<string>")).alias("fact")).where("fact is not null and fact not like '{%'").select("id", "fact", F.lit("ADD").alias("op"))
    rich = parsed.select("id", F.explode(F.from_json("_b", item)).alias("x")).select("id", F.coalesce("x.text", "x.fact", "x.content", "x.memory").alias("fact"), F.upper(F.coalesce("x.event", "x.op", F.lit("ADD"))).alias("op"))
    return plain.unionByName(rich.where("fact is not null and op in ('ADD', 'UPDATE', 'DELETE', 'NONE')"))

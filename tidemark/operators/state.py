"""State beside the facts: sessions, episodes, traits, procedures, logs, and what is done to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import days_between, retention
from tidemark.operators.writes import inserted_if_absent

#: Characters that the notes of a session keep.
NOTES = 2000
#: Listing orders by kind: (column, descending).
ORDERS = {"traits": ("confidence", True), "procedures": ("updated_at", True), "sources": ("registered_at", False), "recalls": ("timestamp", True), "meditations": ("started_at", True), "sessions": ("started_at", True), "episodes": ("started_at", True), "messages": ("at", False)}


def sessions_opened(sessions: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions with the new ones, requests refused): a session belongs to the user it has, or is first asked for by.

    Both frames have ``session_id``, ``user_id`` and ``started_at``. A request for a session of another user is refused; of several
    users who ask for a new one the first by start, then user, gets it.
    """
    first = asked.groupBy("session_id").agg(F.min(F.struct("started_at", "user_id")).alias("_f")).select("session_id", F.col("_f.user_id").alias("user_id"), F.col("_f.started_at").alias("started_at"))
    out = inserted_if_absent(sessions.select("session_id", "user_id", "started_at"), first, ["session_id"])
    owner = out.select("session_id", F.col("user_id").alias("_owner"))
    return out, asked.join(owner, "session_id").where(~F.col("user_id").eqNullSafe(F.col("_owner"))).drop("_owner")


def notes_appended(sessions: DataFrame, notes: DataFrame) -> DataFrame:
    """``sessions`` with the texts of ``notes(session_id, at, note)`` behind their ``structured_notes``, in order, cut at NOTES characters.

    At most so many notes as fit are gathered of each session: a note counts one character at least, empty ones are dropped.
    """
    told = notes.where("note <> ''").withColumn("_before", F.sum(F.char_length("note")).over(Window.partitionBy("session_id").orderBy("at", "note").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.char_length("note"))
    short = told.where(F.col("_before") < NOTES)
    text = short.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "note"))), lambda n: n.note), "").alias("_more"))
    joined = sessions.join(text, "session_id", "left")
    value = F.when(F.col("_more").isNotNull(), F.substring(F.concat(F.coalesce("structured_notes", F.lit("")), "_more"), 1, NOTES)).otherwise(F.col("structured_notes"))
    return joined.select(*[value.alias(c) if c == "structured_notes" else F.col(c) for c in sessions.columns])


def notes_cleared(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """``sessions`` without notes where ``ids(session_id)`` names them."""
    met = sessions.join(ids.select("session_id", F.lit(True).alias("_met")).distinct(), "session_id", "left")
    return met.select(*[F.when(F.col("_met").isNull(), F.col(c)).alias(c) if c == "structured_notes" else F.col(c) for c in sessions.columns])


def counted_up(rows: DataFrame, key: str, log: DataFrame, count: str, last: str | None = None) -> DataFrame:
    """``rows`` with ``count`` raised by the rows of ``log(key, at)`` and ``last`` set to the latest of them."""
    hits = log.groupBy(key).agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    joined = rows.join(hits, key, "left")
    value = {count: F.coalesce(F.col(count), F.lit(0)) + F.coalesce("_n", F.lit(0))}
    if last:
        value[last] = F.coalesce("_at", last)
    return joined.select(*[value[c].alias(c) if c in value else F.col(c) for c in rows.columns])


def sessions_closed(sessions: DataFrame, closed: DataFrame) -> DataFrame:
    """``sessions`` with ``ended_at`` from ``closed(session_id, ended_at)``, the latest of several."""
    ends = closed.groupBy("session_id").agg(F.max("ended_at").alias("_end"))
    return sessions.join(ends, "session_id", "left").select(*[F.coalesce("_end", c).alias(c) if c == "ended_at" else F.col(c) for c in sessions.columns])


def reinforced_episodes(episodes: DataFrame, reads: DataFrame) -> DataFrame:
    """``episodes`` after the reads in ``reads(id, at)``: each makes them a tenth stronger, up to 10, and counts."""
    grown = counted_up(episodes, "id", reads, "recall_count", "last_recalled")
    n = reads.groupBy("id").agg(F.count("*").alias("_reads"))
    strength = F.when(F.col("_reads").isNull(), F.col("storage_strength")).otherwise(F.least(F.lit(10.0), F.col("storage_strength") * F.pow(F.lit(1.1), F.col("_reads"))))
    return grown.join(n, "id", "left").select(*[strength.alias(c) if c == "storage_strength" else F.col(c) for c in episodes.columns])


def stamped(rows: DataFrame, key: str, ids: DataFrame, column: str, value: Column) -> DataFrame:
    """``rows`` with ``column`` set to a value where ``ids(key)`` names them."""
    met = rows.join(ids.select(key).distinct().withColumn("_met", F.lit(True)), key, "left")
    return met.select(*[F.when(F.col("_met"), value).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])


def processed(events: DataFrame, log: DataFrame) -> DataFrame:
    """``events`` with ``processed``: whether the append-only ``log(id)`` names them; a reset is a log without them."""
    return events.join(log.select("id").distinct().withColumn("_met", F.lit(True)), "id", "left").withColumn("processed", F.coalesce("_met", F.lit(False))).drop("_met")


def tagged(memories: DataFrame, tags: DataFrame) -> DataFrame:
    """``memories`` with ``session_id`` and ``episode_id`` from ``tags(id, session_id, episode_id)``; null tags keep what is there."""
    news = tags.groupBy("id").agg(F.max("session_id").alias("_s"), F.max("episode_id").alias("_e"))
    joined = memories.join(news, "id", "left")
    value = {"session_id": F.coalesce("_s", "session_id"), "episode_id": F.coalesce("_e", "episode_id") if "episode_id" in memories.columns else F.col("_e")}
    return joined.select(*[value.pop(c).alias(c) if c in value else F.col(c) for c in memories.columns], *[v.alias(c) for c, v in value.items()])


def listed(rows: DataFrame, kind: str, user_id: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The rows of a kind in its order, nulls last and ties by all columns; of a user and a page where asked for."""
    column, down = ORDERS[kind]
    own = rows if user_id is None else rows.where(F.col("user_id") == user_id)
    out = own.orderBy(F.desc_nulls_last(column) if down else F.asc_nulls_last(column), *[c for c in rows.columns if c != column])
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key in an append-only log, by ``order`` and then all columns."""
    rest = [c for c in log.columns if c not in (key, order)]
    best = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_m"))
    return best.select(key, *[F.col(f"_m.{c}").alias(c) for c in (order, *rest)]).select(*log.columns)


def with_feedback(recalls: DataFrame, feedback: DataFrame) -> DataFrame:
    """``recalls`` with the last ``feedback(recall_id, at, feedback)`` of each."""
    last = feedback.groupBy("recall_id").agg(F.max_by("feedback", "at").alias("_f"))
    return recalls.join(last, "recall_id", "left").select(*[F.coalesce("_f", c).alias(c) if c == "feedback" else F.col(c) for c in recalls.columns])


def traces(memories: DataFrame, ids: DataFrame, now: Column, time: Column) -> tuple[DataFrame, DataFrame]:
    """(rows read with their ``retention``, access log): reading by id, with the retention of one constant for all resolutions."""
    own = memories.join(ids.select("id").distinct(), "id", "left_semi")
    kept = retention(days_between(time, now), F.coalesce("stability", F.lit(1.0)))
    return own.withColumn("retention", kept), own.select("id")


def ids_appended(rows: DataFrame, key: str, column: str, more: DataFrame) -> DataFrame:
    """``rows`` whose array ``column`` has the ids of ``more(key, id)`` at its end, in order; those it holds already are not repeated."""
    news = more.groupBy(key).agg(F.sort_array(F.collect_set("id")).alias("_ids"))
    joined = rows.join(news, key, "left")
    have = F.coalesce(F.col(column), F.array().cast("array<string>"))
    value = F.when(F.col("_ids").isNull(), F.col(column)).otherwise(F.concat(have, F.array_except("_ids", have)))
    return joined.select(*[value.alias(c) if c == column else F.col(c) for c in rows.columns])


def counters(before: DataFrame, after: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """``(created, updated, deleted, unchanged)`` of a run, from the rows before and after it; one row."""
    state = lambda df, as_: df.select(key, F.xxhash64(*watched).alias(as_))
    both = state(before, "_b").join(state(after, "_a"), key, "full")
    n = lambda cond: F.coalesce(F.sum(cond.cast("int")), F.lit(0)).cast("bigint")
    b, a = F.col("_b"), F.col("_a")
    return both.agg(n(b.isNull() & a.isNotNull()).alias("created"), n(b.isNotNull() & a.isNotNull() & (b != a)).alias("updated"), n(a.isNull() & b.isNotNull()).alias("deleted"), n(b.isNotNull() & (a == b)).alias("unchanged"))


def looked_up(rows: DataFrame, value: Column, key: str = "id") -> DataFrame:
    """The rows of one id."""
    return rows.where(F.col(key) == value)


def fetched(rows: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """``pos`` and the rows of a caller's list of ids, numbered from 1 in its order; unknown ids are left out, repeated ones give rows again."""
    asked = rows.sparkSession.createDataFrame([(k + 1, v) for k, v in enumerate(ids)], f"pos int, {key} {rows.schema[key].dataType.simpleString()}")
    return F.broadcast(asked).join(rows, key).select("pos", *rows.columns).orderBy("pos")  # the list the caller holds

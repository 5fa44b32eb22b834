"""The write path: a batch of facts is matched, deduplicated, merged with the stored ones and recorded."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import PREFERENCES, contains_any, contradiction_score
from tidemark.operators.lifecycle import greedy_duplicates, initial_stability, near_duplicates
from tidemark.tables import numbered, written

#: Cosine distance under which a fact is another one said again, and that up to which an explicit correction looks for what it corrects.
DUPLICATE, CORRECTED = 0.15, 0.45
#: Candidates that a new fact is held against, by shared entities and by vector each.
CANDIDATES = 20


class Added(NamedTuple):
    """What a batch leads to: all memories after it, and the history rows it adds."""

    memories: DataFrame
    history: DataFrame


def scope_key(*columns: str) -> Column:
    """One value for a scope of several columns; a null is a value of its own."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


def usable(vector: str, size: int) -> Column:
    col = F.col(vector)
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(col) == size) & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def nearest_in_scope(asked: DataFrame, rows: DataFrame, size: int, within: float, k: int = 1, block: int = 4000) -> DataFrame:
    """``(query, id, distance)``: the ``k`` nearest ``rows`` of the same scope for every row of ``asked``, up to a cosine distance.

    Both frames have ``scope``, ``id`` and ``vector``. Both are cut into blocks of about ``block`` rows a scope; a task
    compares one block of each by a matrix product and gives k rows a query at most, so that a scope that holds a
    large part of all rows is many tasks, and none emits all pairs. Only scopes that are asked for are read. A row
    is not its own neighbour; unusable vectors and null scopes are left out; equal distances rank by id.
    """

    def cut_up(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        clean = df.where(usable("vector", size) & F.col("scope").isNotNull()).select("scope", "id", "vector")
        counts = clean.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        return clean, counts

    left, left_blocks = cut_up(asked)
    right, right_blocks = cut_up(rows.join(left.select("scope").distinct(), "scope", "left_semi"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    both = left_blocks.withColumnRenamed("blocks", "i_n").join(right_blocks.withColumnRenamed("blocks", "j_n"), "scope")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = left.join(both, "scope").select("scope", own("i_n").alias("i"), every("j_n").alias("j"), F.lit(True).alias("asks"), "id", "vector")
    gives = right.join(both, "scope").select("scope", every("i_n").alias("i"), own("j_n").alias("j"), F.lit(False).alias("asks"), "id", "vector")
    kind = left.schema["id"].dataType.simpleString()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        q, r = (pdf[pdf["asks"] == flag].sort_values("id", kind="stable") for flag in (True, False))
        if not len(q) or not len(r):
            return pd.DataFrame({"query": q["id"].iloc[:0], "id": r["id"].iloc[:0], "distance": pd.Series(dtype="float64")})
        far = 1 - unit(np.stack(q["vector"].to_numpy()).astype(np.float64)) @ unit(np.stack(r["vector"].to_numpy()).astype(np.float64)).T
        qi, ri = q["id"].to_numpy(), r["id"].to_numpy()
        far[qi[:, None] == ri[None, :]] = np.inf
        at = np.argsort(far, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(far, at, 1)
        a, b = np.nonzero(near <= within)
        return pd.DataFrame({"query": qi[a], "id": ri[at[a, b]], "distance": near[a, b]})

    met = asks.unionByName(gives).groupBy("scope", "i", "j").applyInPandas(compare, f"query {kind}, id {kind}, distance double")
    order = Window.partitionBy("query").orderBy("distance", "id")
    return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def next_versions(changed: DataFrame, base: DataFrame, *order: str) -> DataFrame:
    """``changed`` with ``sync_version``: the numbers after the largest of ``base``, in an order."""
    most = base.agg(F.coalesce(F.max("sync_version"), F.lit(0)).alias("_most"))  # one row
    return numbered(changed, "_nth", *order).crossJoin(F.broadcast(most)).withColumn("sync_version", F.col("_most") + F.col("_nth") + 1).drop("_most", "_nth")


def added(base: DataFrame, batch: DataFrame, size: int, now: Column, threshold: float = DUPLICATE) -> Added:
    """``base`` after a batch of facts, and the history of it.

    Both frames have ``id``, ``user_id``, ``agent_id``, ``content``, ``embedding``, ``metadata`` and ``importance``, ``batch`` also
    ``seq``, the order of its rows; ``base`` has ``hash``, ``stability``, ``created_at``, ``updated_at`` and ``sync_version`` besides, and may have
    more, which are null for new rows. Within a user and agent, a fact is another one said again if its content is
    equal (by hash, then by the text itself) or its vector nearer than ``threshold``: to a stored fact first, and
    then to an earlier fact of the batch that is kept. It then brings its content, vector and metadata (where it has
    some) to that one, the last of several by ``seq``; all others are inserted. Vectors are compared as they are
    before the batch. Every fact makes one history row, UPDATE or ADD, and the next version number; a
    memory's version is that of its last change. Blank contents are left out; rows without usable vector
    match by content only.
    """
    rows = batch.where("content is not null and trim(content) <> ''").withColumns({"hash": F.md5("content"), "scope": scope_key("user_id", "agent_id")})
    rows = written(rows.where("id is not null"))
    stored = base.withColumn("scope", scope_key("user_id", "agent_id"))
    same = stored.select("scope", "hash", F.col("content").alias("_said"), F.col("id").alias("_old"))
    exact = rows.join(same, ["scope", "hash"]).where("content = _said").groupBy(F.col("id").alias("new")).agg(F.min("_old").alias("into"))
    first = rows.groupBy("scope", "content").agg(F.min(F.struct("seq", "id")).alias("_f")).select("scope", "content", F.col("_f.id").alias("_first"))
    rest = rows.join(exact.select(F.col("new").alias("id")), "id", "left_anti")
    repeats = rest.join(first, ["scope", "content"]).where("id <> _first").select(F.col("id").alias("new"), F.col("_first").alias("into"))
    single = written(rest.join(repeats.select(F.col("new").alias("id")), "id", "left_anti").select("id", "scope", "seq", F.col("embedding").alias("vector")))
    near = nearest_in_scope(single, stored.select("scope", "id", F.col("embedding").alias("vector")), size, threshold)
    close = written(near.where(F.col("distance") < threshold).select(F.col("query").alias("new"), F.col("id").alias("into")))
    left = single.join(close.select(F.col("new").alias("id")), "id", "left_anti")
    pairs = near_duplicates(left, "scope", "id", "vector", size, threshold)
    at = left.select("id", "seq")
    timed = pairs.join(at.select(F.col("id").alias("a"), F.col("seq").alias("_sa")), "a").join(at.select(F.col("id").alias("b"), F.col("seq").alias("_sb")), "b")
    later = F.struct("_sa", "a") > F.struct(F.col("_sb").alias("_sa"), F.col("b").alias("a"))
    ordered = timed.select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("b"))
    fallen = greedy_duplicates(ordered).select(F.col("id").alias("new"), F.col("kept").alias("into"))
    direct = written(exact.unionByName(close).unionByName(fallen))
    through = repeats.join(direct.select(F.col("new").alias("into"), F.col("into").alias("_at")), "into", "left").select("new", F.coalesce("_at", "into").alias("into"))
    into = direct.unionByName(through)
    placed = written(rows.join(into.withColumnRenamed("new", "id"), "id", "left").withColumn("into", F.coalesce("into", "id")))
    versioned = written(next_versions(placed, base, "seq", "id"))
    last = versioned.groupBy("into").agg(
        F.max_by(F.struct("content", "embedding", "hash", "sync_version"), "sync_version").alias("l"), F.max_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("sync_version"))).alias("m")
    )
    kept = stored.drop("scope").join(last.withColumnRenamed("into", "id"), "id", "left")
    told = F.col("l").isNotNull()
    pick = lambda new, old: F.when(told, new).otherwise(F.col(old)).alias(old)
    changed = {"content": F.col("l.content"), "embedding": F.col("l.embedding"), "hash": F.col("l.hash"), "sync_version": F.col("l.sync_version"), "updated_at": now, "metadata": F.coalesce("m", "metadata")}
    old = kept.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in base.columns])
    fresh = versioned.where("id = into").drop("content", "embedding", "hash", "metadata", "sync_version").join(last.withColumnRenamed("into", "id"), "id")
    made = {c: F.col(f"l.{c}") for c in ("content", "embedding", "hash", "sync_version")} | {"metadata": F.col("m"), "created_at": now, "updated_at": now, "stability": initial_stability(F.coalesce("importance", F.lit(0.5)))}
    new = fresh.select(*[(made[c] if c in made else F.col(c) if c in fresh.columns else F.lit(None)).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    before = stored.select(F.col("id").alias("into"), F.col("content").alias("old_content"))
    history = versioned.join(before, "into", "left").select(
        F.col("into").alias("id"), "user_id", F.when(F.col("id") == F.col("into"), "ADD").otherwise("UPDATE").alias("event"), "old_content", F.col("content").alias("new_content"), F.col("sync_version").alias("version")
    )
    return Added(old.unionByName(new), history)


def superseded(memories: DataFrame, new_ids: DataFrame, links: DataFrame, size: int, now: Column, threshold: float = 0.5) -> DataFrame:
    """``memories`` in which new facts supersede those they contradict.

    Candidates of a new fact are the CANDIDATES active facts of its user and agent that share most entities with it
    (``links(id, name)``), and, where it says that something changed, its nearest ones up to CORRECTED. What scores
    ``threshold`` or more gets ``superseded_by`` and ``valid_until``; of several new facts the one with the largest id.
    """
    active = memories.where("superseded_by is null").withColumn("scope", scope_key("user_id", "agent_id"))
    new = written(active.join(new_ids.select("id").distinct(), "id", "left_semi").select("id", "scope", "content", F.col("embedding").alias("vector")))
    named = links.select("id", F.lower("name").alias("name")).distinct()
    told = named.join(new.select("id", "scope"), "id").select(F.col("id").alias("query"), "scope", "name")
    shared = told.join(named.join(active.select("id", "scope"), "id"), ["scope", "name"]).where("id <> query").groupBy("query", "id").agg(F.count("*").alias("n"))
    by_name = shared.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "id"))).where(F.col("_r") <= CANDIDATES).select("query", "id")
    marked = new.where(contains_any(F.col("content"), PREFERENCES))
    by_vector = nearest_in_scope(marked, active.select("scope", "id", F.col("embedding").alias("vector")), size, CORRECTED, CANDIDATES).select("query", "id")
    pairs = by_name.unionByName(by_vector).distinct()
    scored = pairs.join(active.select("id", F.col("content").alias("_old")), "id").join(new.select(F.col("id").alias("query"), F.col("content").alias("_new")), "query")
    hit = scored.where(F.round(contradiction_score(F.col("_old"), F.col("_new"), F.lit(True)), 4) >= threshold).groupBy("id").agg(F.max("query").alias("_by"))
    out = memories.join(written(hit), "id", "left")
    return out.select(*[F.coalesce("_by", c).alias(c) if c == "superseded_by" else F.when(F.col("_by").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "valid_until" else F.col(c) for c in memories.columns])


def linked(links: DataFrame, more: DataFrame) -> DataFrame:
    """``links(id, name)`` with those of ``more`` that are new, names in lower case; repeated ones count once, nulls are none."""
    low = lambda df: df.where("id is not null and name is not null").select("id", F.lower("name").alias("name"))
    return low(links).unionByName(low(more)).distinct()


def refreshed(base: DataFrame, updates: DataFrame, key: str, columns: list[str], stamp: tuple[str, Column] | None = None) -> DataFrame:
    """``base`` with the given columns of ``updates`` where these are not null, by key; ``stamp`` is (column, value) set on every row met.

    Repeated keys in ``updates`` resolve to the largest value of each column. Keys that ``base`` lacks are ignored.
    """
    news = updates.groupBy(key).agg(*[F.max(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_met"))
    out = base.join(news, key, "left")
    value = {c: F.coalesce(f"_new_{c}", c) for c in columns}
    if stamp:
        value[stamp[0]] = F.when(F.col("_met"), stamp[1]).otherwise(F.col(stamp[0]))
    return out.select(*[value[c].alias(c) if c in value else F.col(c) for c in base.columns])


def inserted_if_absent(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``base`` and the ``rows`` whose key it lacks; of rows with one key the first in the order of all columns. Null keys are dropped."""
    kept = rows.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.min(F.struct(*[c for c in base.columns if c not in key])).alias("_r"))
    kept = kept.select(*key, *[F.col(f"_r.{c}").alias(c) for c in base.columns if c not in key])
    return base.unionByName(kept.join(base.select(*key), key, "left_anti"))


def with_relations(relations: DataFrame, pairs: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """``relations(source, target, kind, user_id)`` with those of ``pairs(a, b, user_id)`` by name; unknown names and known relations add nothing."""
    known = entities.groupBy("user_id", F.lower("name").alias("_name")).agg(F.min("id").alias("_id"))
    end = lambda c, as_: known.select("user_id", F.col("_name").alias(c), F.col("_id").alias(as_))
    low = pairs.select(F.lower("a").alias("a"), F.lower("b").alias("b"), "user_id")
    found = low.join(end("a", "source"), ["user_id", "a"]).join(end("b", "target"), ["user_id", "b"]).where("source <> target")
    return inserted_if_absent(relations, found.select("source", "target", F.lit(kind).alias("kind"), "user_id").distinct(), ["source", "target", "kind", "user_id"])


def without_entity(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) without the entities ``gone(id)`` and the relations that end at one."""
    ids = gone.select("id").distinct()
    left = relations
    for c in ("source", "target"):
        left = left.join(ids.withColumnRenamed("id", c), c, "left_anti")
    return entities.join(ids, "id", "left_anti"), left.select(*relations.columns)

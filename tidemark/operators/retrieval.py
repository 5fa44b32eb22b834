"""Ranked retrieval: BM25, vector, overlap and identifier channels, and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import auto_tokens, identifiers, overlap_score
from tidemark.functions.vectors import similarity_to
from tidemark.operators import lifecycle as L
from tidemark.operators.filters import day_ranges
from tidemark.tables import written

#: Channel weights and the constant of reciprocal-rank fusion.
WEIGHTS = {"vector": 0.3, "text": 0.35, "entity": 0.2, "overlap": 0.15, "identifier": 1.05}
RRF_K = 30
K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(term, id, tf, dl)``: how often each term occurs in each document, and the document's length."""
    words = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), auto_tokens(F.col(text)).alias("ws"))
    each = words.select("id", F.size("ws").alias("dl"), F.explode("ws").alias("term"))
    return each.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def bm25(docs: DataFrame, id_col: str, text: str, terms: list[str], scope: Column | None = None) -> DataFrame:
    """``(id, score)`` of documents with any of the terms; the statistics are those of the whole table.

    Only the query's terms are counted, inside the row, so nothing is shuffled but one row of statistics. Null texts are no documents.
    """
    terms = sorted({t.lower() for t in terms if t})
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    words = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), inside.alias("_in"), auto_tokens(F.col(text)).alias("_ws"))
    counted = words.select("id", "_in", F.size("_ws").alias("_dl"), *[_count("_ws", t).alias(f"_t{k}") for k, t in enumerate(terms)])
    counted = written(counted)  # a few numbers a document, read twice below; the texts are cut into words once
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_t{k}") > 0).cast("int")).alias(f"_df{k}") for k in range(len(terms))])
    hit = reduce(lambda a, b: a | b, [F.col(f"_t{k}") > 0 for k in range(len(terms))], F.lit(False))
    found = counted.where(hit & F.col("_in")).crossJoin(F.broadcast(stats))  # one row of statistics
    total = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"_t{k}"), F.col(f"_df{k}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return found.select("id", total.alias("score"))


def vector_channel(df: DataFrame, id_col: str, vector: str, query: list[float]) -> DataFrame:
    """``(id, score)``: cosine similarity to one query vector; rows without vector are left out."""
    return df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), similarity_to(query)(F.col(vector)).alias("score"))


def best_matches(queries: DataFrame, vectors: DataFrame, k: int, group: str | None = None, block: int = 2000) -> DataFrame:
    """``(query, id, score)``, with ``group`` also that column: the ``k`` most similar ``vectors`` of every query, in each group.

    Both frames have ``id`` and ``vector``, of one length and usable. The queries, a stated set, go to all rows
    in blocks of ``block``; each batch of rows keeps only its best ``k``. A vector is no match of its own id.
    """
    import numpy as np
    import pandas as pd

    keys = [group] if group else []
    asked = written(queries.select("id", "vector").withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(1 << 30))))
    blocks = max(1, -(-asked.count() // block))
    rows = vectors.select("id", "vector", *keys)
    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"query {kind}", f"id {kind}", "score double", *[f"{g} {rows.schema[g].dataType.simpleString()}" for g in keys]])

    def unit(v: list) -> np.ndarray:
        x = np.array([list(r) for r in v], np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def answering(sent):  # noqa: ANN001, ANN202
        def answer(batches):  # noqa: ANN001, ANN202
            ids, wanted = sent.value
            for pdf in batches:
                for g, part in pdf.groupby(group, dropna=False) if group else [(None, pdf)]:
                    part = part.sort_values("id", kind="stable")
                    own = part["id"].to_numpy()
                    scores = wanted @ unit(part["vector"]).T
                    scores[ids[:, None] == own[None, :]] = -np.inf
                    at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    found = np.take_along_axis(scores, at, 1)
                    q, c = np.nonzero(np.isfinite(found))
                    out = pd.DataFrame({"query": ids[q], "id": own[at[q, c]], "score": found[q, c]})
                    for name in keys:
                        out[name] = g
                    yield out

        return answer

    parts = []
    for b in range(blocks):
        part = [(r.id, list(r.vector)) for r in asked.where(F.col("_part") % blocks == b).toLocalIterator()]
        if part:
            sent = rows.sparkSession.sparkContext.broadcast((np.array([p[0] for p in part]), unit([p[1] for p in part])))
            parts.append(rows.mapInPandas(answering(sent), schema))
    if not parts:
        return rows.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score"), *keys).where("false")
    order = Window.partitionBy("query", *keys).orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def overlap_channel(df: DataFrame, id_col: str, text: str, query: list[str]) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), overlap_score(F.col(text), query).alias("score")).where("score > 0")


def identifier_channel(df: DataFrame, id_col: str, text: str, wanted: list[str]) -> DataFrame:
    """Rows that hold identifiers of the query, by how many."""
    held = F.size(F.array_intersect(F.transform(identifiers(F.col(text)), F.lower), F.array(*[F.lit(w.lower()) for w in wanted])))
    return df.select(F.col(id_col).alias("id"), held.cast("double").alias("score")).where("score > 0")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows by score, ties by id."""
    return df.orderBy(*(order or (F.desc("score"), F.col("id")))).limit(k)


def ranked(channels: dict[str, DataFrame], k: int) -> DataFrame:
    """``(channel, id, rank)``: the best ``k`` of every channel, ranked from 1."""
    parts = [top(df, k).select(F.lit(name).alias("channel"), "id", "score") for name, df in channels.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "id")))


def rrf(ranks: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """``(id, score)``: the weighted sum of 1 / (k + rank) over the channels."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")]
    return ranks.groupBy("id").agg(F.sum(F.coalesce(weight, F.lit(0.0)) / (k + F.col("rank"))).alias("score"))


def combmax(ranks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``(id, score)``: the largest weighted 1 / rank over the channels."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")]
    return ranks.groupBy("id").agg(F.max(weight / F.col("rank")).alias("score"))


def boosted(score: Column, time: Column, start: str, end: str, factor: float = 1.5) -> Column:
    """A score times ``factor`` for rows on the days of a range."""
    day = F.to_date(time)
    return F.when((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")), score * factor).otherwise(score)


def session_cap(df: DataFrame, n: int, session: str = "session_id") -> DataFrame:
    """At most ``n`` rows a session, the best first; rows without session all stay; 0 switches it off."""
    if n <= 0:
        return df
    order = Window.partitionBy(session).orderBy(F.desc("score"), "id")
    of_sessions = df.where(F.col(session).isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    return of_sessions.unionByName(df.where(F.col(session).isNull()))  # which meet in no window


def channel_confidence(ranks: DataFrame, k: int) -> DataFrame:
    """``(channel, confidence)``: mean over (1 + deviation) of the scores of the best ``k``."""
    best = ranks.where(F.col("rank") <= k).groupBy("channel")
    return best.agg((F.avg("score") / (1 + F.coalesce(F.stddev_samp("score"), F.lit(0.0)))).alias("confidence"))


def hybrid_search(memories: DataFrame, query: str, vector: list[float] | None, scope: Column, k: int = 10, pool: int = 30, entities: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """``(id, score)`` of the best ``k`` rows in scope over all channels, fused by reciprocal rank.

    The scope is applied to every channel. A row that holds an identifier of the query goes to the top by one
    point over the best. ``entities`` is a further channel of (id, score), such as linked memories. ``events``
    has ``id``, ``content`` and the columns of the scope; its rows join the text, overlap and identifier
    channels, with text statistics of their own. They have no vectors.
    """
    import re

    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", query.lower()) if w]
    own = memories.where(scope)
    text, texts = bm25(memories, "id", "content", words, scope), own.select("id", "content")
    if events is not None:
        text = text.unionByName(bm25(events, "id", "content", words, scope))
        texts = texts.unionByName(events.where(scope).select("id", "content"))
    channels = {"text": text, "overlap": overlap_channel(texts, "id", "content", words)}
    if vector is not None:
        channels["vector"] = vector_channel(own, "id", "embedding", vector)
    if entities is not None:
        channels["entity"] = entities
    wanted = [w for w in re.findall(r"[\w][\w\-.]*\w", query) if len(w.encode()) >= 4 and re.search(r"[0-9]", w)]
    if wanted:
        channels["identifier"] = identifier_channel(texts, "id", "content", wanted)
    ranks = written(ranked(channels, pool))  # a few rows a channel, used three times
    fused = rrf(ranks, WEIGHTS)
    if wanted:
        named = ranks.where("channel = 'identifier' and rank = 1").select("id", F.lit(True).alias("_named"))
        most = fused.agg(F.max("score").alias("_most"))
        fused = fused.join(named, "id", "left").crossJoin(F.broadcast(most)).select("id", F.when(F.col("_named"), F.col("_most") + 1).otherwise(F.col("score")).alias("score"))
    return top(fused, k)


#: Columns of a result, in order; the score comes last.
RESULT = [
    "id", "content", "user_id", "agent_id", "run_id", "app_id", "created_at", "updated_at", "metadata", "importance", "access_count", "immutable", "expiration_date", "categories", "memory_type",
    "stability", "privacy", "event_time", "session_id", "resolution", "superseded_by", "confidence",
]


def projected(rows: DataFrame, score: Column | None = None) -> DataFrame:
    """The columns of a result, with a score by any expression, null without one; columns that ``rows`` lacks are null."""
    have = set(rows.columns)
    return rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in RESULT], (F.lit(None).cast("double") if score is None else score).alias("score"))


def weighted(score: Column, resolution: Column) -> Column:
    """A relevance times the weight of the row's resolution."""
    return score * L.by_value(resolution, L.RESOLUTION_WEIGHT, 1.0)


def over_threshold(hits: DataFrame, least: float | None, distance: bool = False) -> DataFrame:
    """Hits whose score is ``least`` or more; with ``distance``, or less. None switches it off."""
    if least is None:
        return hits
    return hits.where(F.col("score") <= least if distance else F.col("score") >= least)


def scoped_top(rows: DataFrame, scopes: list[Column], widen: int, keep: Column, k: int) -> DataFrame:
    """The best ``k`` rows that pass ``keep``, of the best ``widen`` of every scope: no scope crowds out another."""
    parts = [top(rows.where(s), widen) for s in scopes]
    return top(reduce(DataFrame.unionByName, parts).where(keep).dropDuplicates(["id"]), k)


def fused_episodes(ranks: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """``(id, score)`` over the channels of episodes; a single channel passes through with its own scores."""
    several = F.min("channel").over(Window.partitionBy(F.lit(0)))  # the ranks of a few channels of k hits
    marked = ranks.withColumn("_several", several != F.max("channel").over(Window.partitionBy(F.lit(0))))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")], F.lit(0.0))
    part = F.when(F.col("_several"), weight / (k + F.col("rank"))).otherwise(F.col("score"))
    return marked.groupBy("id").agg(F.sum(part).alias("score"))


def rescored(hits: DataFrame, rows: DataFrame, count: int, now: Column, k: int = 10, ranges: list[tuple[str, str]] | None = None, per_session: int = 0, least: float | None = None) -> DataFrame:
    """``(id, score)``: fused ``hits`` after the time boost, forgetting, resolution weights, session cap and threshold.

    ``rows`` has ``id``, ``importance``, ``stability``, ``resolution``, ``session_id`` and the timestamps
    ``updated_at`` and ``event_time``; hits without a row are left out. ``count`` is how many memories the user
    has. Rows whose ``updated_at`` is null count as new. ``per_session`` 0 and ``least`` None switch these off.
    """
    known = rows.join(F.broadcast(hits.select("id", "score")), "id").dropDuplicates(["id"])  # k hits
    near = F.when(F.coalesce(day_ranges(F.col("event_time"), ranges or []), F.lit(False)), F.col("score") * 1.5).otherwise(F.col("score"))
    most = F.greatest(F.max("score").over(Window.partitionBy(F.lit(0))), F.lit(0.001))  # of the k hits
    days = F.coalesce(L.days_between(F.col("updated_at"), now), F.lit(0.0))
    kept = L.retention(days, F.coalesce("stability", F.lit(1.0)), F.col("resolution"))
    value = L.forgetting_score(F.least(F.lit(1.0), F.col("score") / most), kept, L.interference(F.lit(count)), F.coalesce("importance", F.lit(0.5)))
    final = known.withColumn("score", near).withColumn("score", weighted(value, F.col("resolution")))
    return over_threshold(top(session_cap(final, per_session), k).select("id", "score"), least)


def graph_augmented(hits: DataFrame, links: DataFrame, first: int = 10, n: int = 10) -> DataFrame:
    """``(id, score)``: the hits, and up to ``n`` rows that share an entity with the first ``first`` of them.

    ``links`` is (id, name). Added rows rank below every hit, the more entities they share the higher.
    """
    lead = top(hits, first).select("id")
    names = links.join(lead, "id", "left_semi").select("name").distinct()
    near = links.join(names, "name", "left_semi").join(hits.select("id"), "id", "left_anti").groupBy("id").agg(F.count_distinct("name").alias("shared"))
    least = hits.agg(F.coalesce(F.min("score"), F.lit(1.0)).alias("_least"))
    added = top(near.withColumnRenamed("shared", "score"), n).crossJoin(F.broadcast(least))  # one row
    return hits.select("id", "score").unionByName(added.select("id", (F.col("_least") * F.col("score") / (1.0 + F.col("score"))).alias("score")))

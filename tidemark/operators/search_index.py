"""Stored indexes: postings for full text and cleaned vectors, built once and asked by tables of queries in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import auto_tokens, identifiers, tokens
from tidemark.operators.retrieval import K1, RRF_K, WEIGHTS, B, postings
from tidemark.operators.writes import usable
from tidemark.tables import written


def text_index(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings ``(term, id, tf, dl)``, terms ``(term, df)``, corpus ``(n, avg_dl)`` of one row), for a store to keep."""
    entries = written(postings(docs, id_col, text))
    terms = entries.groupBy("term").agg(F.count("*").alias("df"))
    sizes = docs.where(F.col(text).isNotNull()).select(F.size(auto_tokens(F.col(text))).alias("dl"))
    return entries, terms, sizes.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def bm25_batch(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """``(query, id, score, rank)``: the ``k`` best documents for every query of ``queries(query, text)``, from the stored postings.

    Only the queries' terms meet postings, by an equi-join on the term, and each term's weight is worked out once;
    scores are summed before anything is ranked. A frequent term's postings are one key; the engine splits it.
    Ties rank by id. Queries without a known term, or null, give no rows; a term counts once a query.
    """
    entries, terms, corpus = index
    words = queries.where("text is not null").select("query", F.explode(F.array_distinct(auto_tokens(F.col("text")))).alias("term"))
    wanted = words.join(terms, "term").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = entries.join(wanted.select("query", "term", idf.alias("idf"), "avg_dl"), "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = met.groupBy("query", "id").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_table(rows: DataFrame, id_col: str, vector: str, size: int, *keep: str) -> DataFrame:
    """The derived table of usable vectors, of length one, with the columns to filter by; for a store to keep."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform(vector, lambda x: (x.cast("double") / F.col("_norm")).cast("float"))
    return rows.where(usable(vector, size)).withColumn("_norm", norm).select(F.col(id_col).alias("id"), unit.alias("vector"), *keep)


def index_changed(index: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """A derived table after changes: the rows of ``changed`` replace those of their id, and ids in ``gone(id)`` go."""
    out = changed.select("id").unionByName(gone.select("id")).distinct()
    return index.join(out, "id", "left_anti").unionByName(changed.join(gone.select("id").distinct(), "id", "left_anti"))


def rows_of_hits(hits: DataFrame, rows: DataFrame, score: Column | None = None) -> DataFrame:
    """The rows that ``hits(id, score)`` name, with their score; ids without a row are left out, repeated hits keep the best."""
    best = hits.groupBy("id").agg(F.max("score").alias("score"))
    joined = best.join(rows, "id")
    return joined if score is None else joined.withColumn("score", score)


def search_batch(queries: DataFrame, rows: DataFrame, k: int = 10, pool: int = 30) -> DataFrame:
    """``(query, id, score, rank)``: the best ``k`` rows for every query by text, overlap and identifiers, fused by reciprocal rank, in one job.

    ``queries`` has ``query``, ``text``, ``user_id`` and ``agent_id``, ``rows`` has ``id``, ``content``, ``user_id`` and ``agent_id``; a query
    sees the rows of its user, and with an agent those of that agent or none. Text statistics are those of all
    rows. Every channel is an equi-join: on term and user, on user, on identifier and user. A query that names
    an identifier puts the row that holds most of them on top by one point. Queries that hit nothing give no rows.
    """
    own = rows.where("content is not null")
    asked = written(queries.where("text is not null").select("query", "text", "user_id", F.col("agent_id").alias("_agent"), F.array_distinct(tokens(F.col("text"))).alias("_words")))
    sees = F.col("_agent").isNull() | F.col("agent_id").isNull() | (F.col("agent_id") == F.col("_agent"))
    entries, terms, corpus = text_index(own, "id", "content")
    scope = own.select("id", "user_id", "agent_id")
    words = asked.select("query", "user_id", "_agent", F.explode(F.array_distinct(auto_tokens(F.col("text")))).alias("term")).join(terms, "term").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = words.select("query", "user_id", "_agent", "term", idf.alias("idf"), "avg_dl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    met = entries.join(terms.join(words.select("term").distinct(), "term", "left_semi").select("term"), "term").join(scope, "id").join(wanted, ["term", "user_id"])
    text = met.where(sees).groupBy("query", "id").agg(F.sum(part).alias("score"))
    held = F.size(F.filter("_words", lambda w: F.contains(F.lower("content"), w)))
    met = own.join(asked.where(F.size("_words") > 0), "user_id").where(sees).select("query", "id", (held / F.size("_words")).alias("score"))
    named = lambda c: F.explode(F.array_distinct(F.transform(identifiers(F.col(c)), F.lower))).alias("_name")
    sought = asked.select("query", "user_id", "_agent", named("text"))
    found = own.select("id", "user_id", "agent_id", named("content")).join(sought, ["user_id", "_name"]).where(sees)
    channels = {"text": text, "overlap": met.where("score > 0"), "identifier": found.groupBy("query", "id").agg(F.count("*").cast("double").alias("score"))}
    every = reduce(DataFrame.unionByName, [df.select(F.lit(c).alias("channel"), "query", "id", F.round("score", 9).alias("score")) for c, df in channels.items()])
    best = Window.partitionBy("query", "channel").orderBy(F.desc("score"), "id")
    ranks = every.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= pool)
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("channel")]
    fused = ranks.groupBy("query", "id").agg(F.sum(weight / (RRF_K + F.col("_r"))).alias("score"), F.max((F.col("channel") == "identifier") & (F.col("_r") == 1)).alias("_top"))
    most = F.max("score").over(Window.partitionBy("query"))  # the pools of three channels
    final = fused.withColumn("score", F.when(F.col("_top"), most + 1).otherwise(F.col("score")))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "score", "rank")

"""Queries of the write path, of state beside the facts, of indexes and exports, each with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import filters as P
from tidemark.operators import graph as G
from tidemark.operators import lifecycle as L
from tidemark.operators import retrieval as R
from tidemark.operators import search_index as N
from tidemark.operators import state as T
from tidemark.operators import writes as W
from tidemark.plans.memory_queries import _ACTIVE, _AUTO, _CUR, _FUSE, _TIME, _TOK, AGENT, NOW, USER, _bm25_sql, _document_ranks, memories, micros, now, query
from tidemark.sources import exports as S
from tidemark.tables import table, written

# ---- projections, filters


@query("f1_projection", f"WITH {_CUR} SELECT {', '.join(c for c in R.RESULT if c != 'categories')}, array_to_string(categories, ',') AS categories, round(importance * 0.5, 6) AS score FROM cur")
def f1_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = R.projected(memories(spark, d, *R.RESULT[1:]), F.round(F.col("importance") * 0.5, 6))
    return rows.withColumn("categories", F.array_join("categories", ","))


@query("f2_field_mask", f"WITH {_CUR} SELECT id, user_id, resolution, content, CAST(NULL AS VARCHAR) AS agent_id, '' AS created_at, CAST(NULL AS DOUBLE) AS importance, session_id FROM cur")
def f2_field_mask(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "user_id", "resolution", "content", "agent_id", "created_at", "importance", "session_id")
    return P.masked_fields(m, ["memory", "session_id"])


_RANGE = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
_IN = "BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"


@query("f9_time_ranges", f"WITH {_CUR}, s AS (SELECT user_id, min(ts) AS at_ FROM events GROUP BY 1), e AS (SELECT user_id, date_trunc('day', ts) AS d, max(ts) AS at_ FROM events GROUP BY 1, 2) SELECT 'memories' AS layer, count(*) AS n FROM cur WHERE {_TIME.format('created_at')} {_IN} UNION ALL SELECT 'events', count(*) FROM events WHERE ts {_IN} UNION ALL SELECT 'sessions', count(*) FROM s WHERE at_ {_IN} UNION ALL SELECT 'episodes', count(*) FROM e WHERE at_ {_IN}")
def f9_time_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    layers = {
        "memories": memories(spark, d, "created_at").select(P.stored_time(F.col("created_at")).alias("at")), "events": e.select(F.col("ts").alias("at")),
        "sessions": e.groupBy("user_id").agg(F.min("ts").alias("at")), "episodes": e.groupBy("user_id", F.to_date("ts")).agg(F.max("ts").alias("at")),
    }
    return reduce(DataFrame.unionByName, [df.where(P.between_times(F.col("at"), *_RANGE)).agg(F.count("*").alias("n")).select(F.lit(k).alias("layer"), "n") for k, df in layers.items()])


@query("f12_mentions", f"WITH {_CUR}, n AS (SELECT DISTINCT user_id, lower(name) AS name FROM entities WHERE entity_type = 'pet' AND name <> '') SELECT id FROM cur WHERE EXISTS (SELECT 1 FROM n WHERE n.user_id = cur.user_id AND contains(lower(content), n.name))")
def f12_mentions(spark: SparkSession, d: str) -> DataFrame:
    return G.mentioning(memories(spark, d, "user_id", "content"), table(spark, d, "entities").where("entity_type = 'pet'"), "content").select("id")


@query("f14_text_query", r"""SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> '' AND w <> 'OR'), lambda w: '"' || replace(w, '"', '""') || '"'), ' OR ') AS q FROM eval_items""")
def f14_text_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", P.text_query(F.col("query")).alias("q"))


@query("f15_event_faults", r"WITH e AS (SELECT DISTINCT id, role, content FROM scenarios WHERE kind = 'event'), f AS (SELECT id, 'empty content' AS fault FROM e WHERE content IS NULL OR NOT regexp_matches(content, '[^\s\p{Z}]') UNION ALL SELECT id, 'id length' FROM e WHERE id IS NULL OR strlen(id) NOT BETWEEN 1 AND 256 UNION ALL SELECT id, 'unknown role' FROM e WHERE role IS NULL OR lower(trim(role)) NOT IN ('user', 'human', 'assistant', 'model', 'bot', 'system', 'tool') UNION ALL SELECT id, 'conflicting rows' FROM e GROUP BY id HAVING count(*) > 1) SELECT DISTINCT * FROM f")
def f15_event_faults(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("kind = 'event'").select("id", "role", "content", F.lit(None).cast("array<string>").alias("categories"))
    return P.event_faults(e)


# ---- joins, listings, paging


@query("j1_rows_of_hits", f"WITH {_CUR}, h AS (SELECT superseded_by AS id, count(*) AS score FROM memories WHERE superseded_by IS NOT NULL GROUP BY 1) SELECT h.id, h.score, cur.user_id FROM h JOIN cur USING (id)")
def j1_rows_of_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "memories").where("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.count("*").alias("score"))
    return N.rows_of_hits(hits, memories(spark, d, "user_id")).select("id", "score", "user_id")


_EDGES = "e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'in' AS kind FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'from' FROM supplier)"
_NODES = "nodes AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    end = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    n = table(spark, d, "nation").select(end("n", "n_nationkey").alias("source"), end("r", "n_regionkey").alias("target"), F.lit("in").alias("kind"))
    return n.unionByName(table(spark, d, "supplier").select(end("s", "s_suppkey").alias("source"), end("n", "s_nationkey").alias("target"), F.lit("from").alias("kind")))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t, letter, k, name: table(spark, d, t).select(F.concat(F.lit(letter), F.col(k)).alias("id"), F.col(name).alias("name"))
    return of("nation", "n", "n_nationkey", "n_name").unionByName(of("region", "r", "r_regionkey", "r_name")).unionByName(of("supplier", "s", "s_suppkey", "s_name"))


@query("j5_incident", f"WITH {_EDGES} SELECT n.id, CASE WHEN e.source = n.id THEN e.target ELSE e.source END AS other, e.kind FROM e JOIN (SELECT 'n' || n_nationkey AS id FROM nation) n ON e.source = n.id OR e.target = n.id")
def j5_incident(spark: SparkSession, d: str) -> DataFrame:
    return G.incident(_edges(spark, d), _nodes(spark, d).where("id like 'n%'"))


@query("j7_names", f"WITH {_EDGES}, {_NODES} SELECT e.*, a.name AS source_name, b.name AS target_name FROM e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target")
def j7_names(spark: SparkSession, d: str) -> DataFrame:
    return G.with_names(_edges(spark, d), _nodes(spark, d))


@query("r28_dictionary", "SELECT DISTINCT user_id, lower(name) AS name FROM entities WHERE name IS NOT NULL")
def r28_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return G.dictionary(table(spark, d, "entities"))


@query("r16_named_search", f"WITH RECURSIVE {_EDGES}, {_NODES}, h AS (SELECT id FROM (SELECT DISTINCT id, name FROM nodes WHERE contains(lower(name), 'on_1')) ORDER BY lower(name), id LIMIT 10), r AS (SELECT id, 0 AS hops FROM h UNION SELECT e.target, r.hops + 1 FROM r JOIN e ON e.source = r.id WHERE r.hops < 2) SELECT id, min(hops) AS hops FROM r GROUP BY 1")
def r16_named_search(spark: SparkSession, d: str) -> DataFrame:
    return G.searched(_nodes(spark, d), _edges(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst")), "ON_1", 2)


@query("s4_lookups", f"WITH {_CUR} SELECT 'memory' AS kind, id, user_id FROM cur WHERE id = (SELECT max(id) FROM memories) UNION ALL SELECT DISTINCT 'event', id, user_id FROM scenarios WHERE kind = 'event' AND id = (SELECT max(id) FROM scenarios WHERE kind = 'event') UNION ALL SELECT DISTINCT 'entity', id, user_id FROM entities WHERE id = (SELECT max(id) FROM entities) UNION ALL SELECT 'session', session_id, min(user_id) FROM scenarios WHERE session_id = (SELECT max(session_id) FROM scenarios) GROUP BY session_id UNION ALL SELECT 'source', source, min(user_id) FROM documents WHERE source = (SELECT max(source) FROM documents) GROUP BY source")
def s4_lookups(spark: SparkSession, d: str) -> DataFrame:
    s, docs = table(spark, d, "scenarios"), table(spark, d, "documents")
    layers = {
        "memory": memories(spark, d, "user_id"), "event": s.where("kind = 'event'").select("id", "user_id").distinct(), "entity": table(spark, d, "entities").select("id", "user_id").distinct(),
        "session": s.groupBy(F.col("session_id").alias("id")).agg(F.min("user_id").alias("user_id")), "source": docs.groupBy(F.col("source").alias("id")).agg(F.min("user_id").alias("user_id")),
    }
    got = [T.looked_up(df, F.lit(df.agg(F.max("id")).first()[0])).select(F.lit(k).alias("kind"), "id", "user_id") for k, df in layers.items()]
    return reduce(DataFrame.unionByName, got)


@query("s5_order_kept", "WITH ids AS (SELECT unnest(range(1, 41)) AS pos, unnest((SELECT list(id ORDER BY md5(id)) FROM (SELECT DISTINCT id FROM scenarios WHERE kind = 'event'))[1:40]) AS id) SELECT pos, i.id, min(role) AS role FROM ids i JOIN scenarios s ON s.id = i.id AND s.kind = 'event' GROUP BY 1, 2")
def s5_order_kept(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("kind = 'event'").groupBy("id").agg(F.min("role").alias("role"))
    asked = [r.id for r in e.orderBy(F.md5("id")).limit(40).select("id").collect()]  # the caller's list
    return T.fetched(e, asked)


@query("t2_session_page", "SELECT user_id AS session_id, epoch_us(min(ts)) AS started_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 10")
def t2_session_page(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(micros(F.min("ts")).alias("started_at"))
    return T.listed(s, "sessions", limit=20, offset=10)


@query("t2_episode_page", "SELECT user_id AS id, CAST(date_trunc('day', ts) AS DATE) AS started_at, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 2 DESC, 1, 3 LIMIT 20 OFFSET 5")
def t2_episode_page(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("started_at")).agg(F.count("*").alias("n"))
    return T.listed(e, "episodes", limit=20, offset=5)


@query("t2_message_page", "SELECT event_id AS id, user_id, epoch_us(ts) AS \"at\" FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts, event_id LIMIT 20 OFFSET 5")
def t2_message_page(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return T.listed(e.select(F.col("event_id").alias("id"), "user_id", micros("ts").alias("at")), "messages", e.agg(F.min("user_id")).first()[0], 20, 5)


@query("t8_trait_order", f"WITH {_CUR} SELECT id, user_id, confidence FROM cur WHERE resolution = 'identity' ORDER BY confidence DESC NULLS LAST, id LIMIT 50")
def t8_trait_order(spark: SparkSession, d: str) -> DataFrame:
    return T.listed(memories(spark, d, "user_id", "confidence", "resolution").where("resolution = 'identity'").select("id", "user_id", "confidence"), "traits", limit=50)


@query("t8_recall_order", "SELECT event_id AS recall_id, user_id, epoch_us(ts) AS timestamp FROM events ORDER BY ts DESC, event_id LIMIT 50")
def t8_recall_order(spark: SparkSession, d: str) -> DataFrame:
    return T.listed(table(spark, d, "events").select(F.col("event_id").alias("recall_id"), "user_id", micros("ts").alias("timestamp")), "recalls", limit=50)


@query("w3_token_budget_timed", "WITH s AS (SELECT user_id, event_id, sum(strlen(props) // 4 + 10) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT user_id, event_id FROM s WHERE s <= 120")
def w3_token_budget_timed(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.text import token_estimate

    e = table(spark, d, "events")
    return L.budget_suffix(e, "user_id", [F.desc("ts"), F.desc("event_id")], token_estimate(F.col("props")), 120).select("user_id", "event_id")


@query("a14_rollup_timed", "SELECT user_id, array_to_string(list_slice(list(event_type ORDER BY ts, event_id), 1, 5), ' | ') AS summary FROM events GROUP BY 1")
def a14_rollup_timed(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.episodes import first_texts

    return first_texts(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", 5, " | ").withColumnRenamed("text", "summary")


# ---- aggregates


@query("a1_user_totals", f"WITH {_CUR}, m AS (SELECT user_id, count(*) AS memories, min(created_at) AS first_at, max(created_at) AS last_at, count(DISTINCT agent_id) AS agents FROM cur GROUP BY 1), e AS (SELECT user_id, count(DISTINCT id) AS events FROM scenarios WHERE kind = 'event' GROUP BY 1), n AS (SELECT user_id, count(DISTINCT id) AS entities FROM entities GROUP BY 1) SELECT o.user_id, coalesce(memories, 0) AS memories, coalesce(events, 0) AS events, coalesce(entities, 0) AS entities, first_at, last_at, coalesce(agents, 0) AS agents FROM owners o LEFT JOIN m USING (user_id) LEFT JOIN e USING (user_id) LEFT JOIN n USING (user_id)")
def a1_user_totals(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.analytics import user_totals

    events = table(spark, d, "scenarios").where("kind = 'event'").select("user_id", "id").distinct()
    return user_totals(table(spark, d, "owners").select("user_id"), memories(spark, d, "user_id", "agent_id", "created_at"), {"events": events, "entities": table(spark, d, "entities").select("user_id", "id").distinct()})


@query("a11_run_counters", "WITH b AS (SELECT id, arg_max(content, sync_version) AS c FROM memories WHERE id IS NOT NULL AND sync_version % 2 = 0 GROUP BY 1), a AS (SELECT id, arg_max(content, sync_version) AS c FROM memories WHERE id IS NOT NULL AND sync_version % 3 = 0 GROUP BY 1) SELECT count(CASE WHEN b.id IS NULL THEN 1 END) AS created, count(CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL AND a.c IS DISTINCT FROM b.c THEN 1 END) AS updated, count(CASE WHEN a.id IS NULL THEN 1 END) AS deleted, count(CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL AND a.c IS NOT DISTINCT FROM b.c THEN 1 END) AS unchanged FROM b FULL JOIN a USING (id)")
def a11_run_counters(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").where("id is not null")
    part = lambda n: m.where(F.col("sync_version") % n == 0).groupBy("id").agg(F.max_by("content", "sync_version").alias("content"))
    return T.counters(part(2), part(3), "id", ["content"])


# ---- retrieval

_V = f"{_CUR}, v AS (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM cur WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), q AS (SELECT e FROM v ORDER BY id LIMIT 1), s AS (SELECT *, round(list_cosine_similarity(e, (SELECT e FROM q)), 6) AS score FROM v)"


def _scored(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current memories with a usable vector and their similarity to the stated one, that of the first id."""
    rows = written(memories(spark, d, "embedding", *columns).where(W.usable("embedding", 64)))
    first = rows.orderBy("id").select("embedding").first()
    vector = list(first[0]) if first else [1.0] * 64
    return rows.withColumn("score", F.round(V.similarity_to(vector)("embedding"), 6))


@query("r2_scoped_knn", f"WITH {_V}, k AS (SELECT * FROM (SELECT * FROM s WHERE user_id = '{USER}' AND agent_id = '{AGENT}' ORDER BY score DESC, id LIMIT 50) UNION ALL SELECT * FROM (SELECT * FROM s WHERE user_id = '{USER}' AND agent_id IS NULL ORDER BY score DESC, id LIMIT 50)) SELECT id, score FROM k WHERE {_ACTIVE} ORDER BY score DESC, id LIMIT 20")
def r2_scoped_knn(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, "user_id", "agent_id", "superseded_by", "expiration_date", "valid_until").where(F.col("user_id") == USER)
    found = R.scoped_top(s, [F.col("agent_id") == AGENT, F.col("agent_id").isNull()], 50, P.active(now()), 20)
    return found.select("id", "score")


@query("r3_vectors_in_ids", f"WITH {_V} SELECT id, score FROM s WHERE id IN (SELECT superseded_by FROM memories) ORDER BY score DESC, id LIMIT 10")
def r3_vectors_in_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "memories").where("superseded_by is not null").select(F.col("superseded_by").alias("id")).distinct()
    return R.top(_scored(spark, d).join(ids, "id", "left_semi").select("id", "score"), 10)


@query("r23_identity_search", f"WITH {_V} SELECT id, score FROM s WHERE resolution = 'identity' ORDER BY score DESC, id LIMIT 10")
def r23_identity_search(spark: SparkSession, d: str) -> DataFrame:
    return R.top(_scored(spark, d, "resolution").where("resolution = 'identity'").select("id", "score"), 10)


@query("r26_episode_vectors", f"WITH {_V} SELECT id, score FROM s WHERE resolution = 'narrative' AND user_id = (SELECT min(user_id) FROM s WHERE resolution = 'narrative') ORDER BY score DESC, id LIMIT 10")
def r26_episode_vectors(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, "resolution", "user_id").where("resolution = 'narrative'")
    return R.top(s.where(F.col("user_id") == s.agg(F.min("user_id")).first()[0]).select("id", "score"), 10)


@query("r11_episode_rrf", f"WITH {_FUSE} SELECT id, round(sum(CASE channel WHEN 'text' THEN 0.4 ELSE 0.3 END / (60 + rank)), 8) AS score FROM rk WHERE rank <= 100 GROUP BY id")
def r11_episode_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.fused_episodes(_document_ranks(spark, d, 100), {"text": 0.4, "overlap": 0.3, "vector": 0.3}).select("id", F.round("score", 8).alias("score"))


@query("r19_resolution_weights", f"WITH {_CUR} SELECT id, round(importance * CASE resolution WHEN 'granular' THEN 1.0 WHEN 'narrative' THEN 0.65 WHEN 'identity' THEN 0.7 ELSE 1.0 END, 6) AS score FROM cur WHERE importance IS NOT NULL")
def r19_resolution_weights(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "importance", "resolution").where("importance is not null")
    return m.select("id", F.round(R.weighted(F.col("importance"), F.col("resolution")), 6).alias("score"))


@query("r20_threshold", f"WITH {_V}, t AS (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 100) SELECT id, score FROM t WHERE score >= 0.3")
def r20_threshold(spark: SparkSession, d: str) -> DataFrame:
    return R.over_threshold(R.top(_scored(spark, d).select("id", "score"), 100), 0.3)


@query("r27_event_text_in_ids", "WITH src AS (SELECT DISTINCT id, content FROM scenarios WHERE kind = 'event'), " + _bm25_sql("src", "id", "content", ["collar", "bowl"]) + " SELECT id, round(score, 5) AS score FROM b WHERE id IN (SELECT min(id) FROM scenarios WHERE kind = 'event' GROUP BY session_id)")
def r27_event_text_in_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("kind = 'event'")
    ids = e.groupBy("session_id").agg(F.min("id").alias("id")).select("id")
    found = R.bm25(e.select("id", "content").distinct(), "id", "content", ["collar", "bowl"])
    return found.join(ids, "id", "left_semi").select("id", F.round("score", 5).alias("score"))


@query(
    "r4_batch",
    f"WITH w AS (SELECT doc_id, {_AUTO.format('text')} AS ws FROM documents WHERE text IS NOT NULL), p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(ws) AS term, len(ws) AS dl FROM w) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), c AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w), q AS (SELECT DISTINCT item_id, unnest({_AUTO.format('query')}) AS term FROM eval_items), "
    "s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN df USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5",
)
def r4_batch(spark: SparkSession, d: str) -> DataFrame:
    index = N.text_index(table(spark, d, "documents"), "doc_id", "text")
    found = N.bm25_batch(index, table(spark, d, "eval_items").select(F.col("item_id").alias("query"), F.col("query").alias("text")), 5)
    return found.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 5).alias("score"), "rank")


_IDS = r"list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array({0}, '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda x: strlen(x) >= 4 AND regexp_matches(x, '[0-9]')), lambda x: lower(x)))"
_SEES = "(q.agent_id IS NULL OR r.agent_id IS NULL OR r.agent_id = q.agent_id)"


@query(
    "r21_batch",
    f"WITH {_CUR}, r AS (SELECT id, content, user_id, agent_id FROM cur WHERE {_ACTIVE} AND content IS NOT NULL UNION ALL SELECT DISTINCT id, content, user_id, agent_id FROM scenarios WHERE kind = 'event' AND content IS NOT NULL), "
    f"q AS (SELECT item_id AS query, query AS text, user_id, agent_id FROM eval_items), w AS (SELECT id, {_AUTO.format('content')} AS ws FROM r), p AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, unnest(ws) AS term, len(ws) AS dl FROM w) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), c AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w), "
    f"t AS (SELECT DISTINCT query, unnest({_AUTO.format('text')}) AS term FROM q), s AS (SELECT 'text' AS channel, t.query, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM t JOIN df USING (term) JOIN p USING (term) JOIN r ON r.id = p.id JOIN q ON q.query = t.query AND q.user_id = r.user_id AND {_SEES} CROSS JOIN c GROUP BY 2, 3 "
    f"UNION ALL SELECT 'overlap', query, id, len(list_filter(ws, lambda x: contains(lower(content), x))) / CAST(len(ws) AS DOUBLE) FROM (SELECT q.query, r.id, r.content, list_distinct({_TOK.format('q.text')}) AS ws FROM q JOIN r ON r.user_id = q.user_id AND {_SEES}) WHERE len(ws) > 0 AND len(list_filter(ws, lambda x: contains(lower(content), x))) > 0 "
    f"UNION ALL SELECT 'identifier', q.query, r.id, CAST(len(list_intersect({_IDS.format('q.text')}, {_IDS.format('r.content')})) AS DOUBLE) FROM q JOIN r ON r.user_id = q.user_id AND {_SEES} WHERE len(list_intersect({_IDS.format('q.text')}, {_IDS.format('r.content')})) > 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY round(score, 9) DESC, id) AS rk FROM s), f AS (SELECT query, id, sum(CASE channel WHEN 'text' THEN 0.35 WHEN 'overlap' THEN 0.15 ELSE 1.05 END / (30 + rk)) AS score, bool_or(channel = 'identifier' AND rk = 1) AS top_ FROM k WHERE rk <= 30 GROUP BY 1, 2), "
    "g AS (SELECT query, id, CASE WHEN top_ THEN max(score) OVER (PARTITION BY query) + 1 ELSE score END AS score FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM g) SELECT query, id, round(score, 6) AS score, rank FROM o WHERE rank <= 10",
)
def r21_batch(spark: SparkSession, d: str) -> DataFrame:
    active = memories(spark, d, "content", "user_id", "agent_id", "superseded_by", "expiration_date", "valid_until").where(P.active(now()))
    events = table(spark, d, "scenarios").where("kind = 'event'").select("id", "content", "user_id", "agent_id").distinct()
    rows = written(active.select("id", "content", "user_id", "agent_id").unionByName(events))
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("query"), F.col("query").alias("text"), "user_id", "agent_id")
    return N.search_batch(asked, rows).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("m29_vector_table", f"WITH {_V} SELECT id, user_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 4) AS total FROM v")
def m29_vector_table(spark: SparkSession, d: str) -> DataFrame:
    t = N.vector_table(memories(spark, d, "embedding", "user_id"), "id", "embedding", 64, "user_id")
    return t.select("id", "user_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


# ---- the write path


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored facts: the current rows of even versions; a batch of new ones: every row of the table of an odd version."""
    m = table(spark, d, "memories").where("id is not null")
    base = memories(spark, d, "user_id", "agent_id", "content", "embedding", "metadata", "importance", "hash", "stability", "created_at", "updated_at", "sync_version").where("sync_version % 2 = 0")
    odd = m.where("sync_version % 2 = 1").groupBy(F.concat(F.lit("new-"), "id").alias("id"), F.col("sync_version").alias("seq")).agg(*[F.min(c).alias(c) for c in ("user_id", "agent_id", "content", "metadata", "importance")])
    return base, odd.withColumn("id", F.concat_ws("-", "id", "seq")).withColumn("embedding", F.lit(None).cast("array<float>"))


_M1 = (
    f"WITH {_CUR}, base AS (SELECT * FROM cur WHERE sync_version % 2 = 0), bt AS (SELECT 'new-' || id || '-' || sync_version AS id, sync_version AS seq, min(user_id) AS user_id, min(agent_id) AS agent_id, min(content) AS content FROM memories WHERE id IS NOT NULL AND sync_version % 2 = 1 GROUP BY id, sync_version), "
    "g AS (SELECT * FROM bt WHERE content IS NOT NULL AND trim(content) <> ''), x AS (SELECT g.id, min(base.id) AS into_ FROM g JOIN base ON g.user_id IS NOT DISTINCT FROM base.user_id AND g.agent_id IS NOT DISTINCT FROM base.agent_id AND g.content = base.content AND base.hash = md5(g.content) GROUP BY 1), "
    "f AS (SELECT id, first_value(id) OVER (PARTITION BY user_id, agent_id, content ORDER BY seq, id) AS first_ FROM g), p AS (SELECT g.id, g.seq, g.user_id, coalesce(x.into_, f.first_) AS into_ FROM g JOIN f USING (id) LEFT JOIN x USING (id)) "
    "SELECT into_ AS id, user_id, CASE WHEN id = into_ THEN 'ADD' ELSE 'UPDATE' END AS event, (SELECT coalesce(max(sync_version), 0) FROM base) + row_number() OVER (ORDER BY seq, id) AS version FROM p"
)


@query("m1_add", _M1)
def m1_add(spark: SparkSession, d: str) -> DataFrame:
    base, batch = _halves(spark, d)
    return W.added(written(base), written(batch), 64, now()).history.select("id", "user_id", "event", "version")


@query("m2_add_batch")
def m2_add_batch(spark: SparkSession, d: str) -> DataFrame:
    base, batch = _halves(spark, d)
    own = table(spark, d, "memories").where("id is not null").groupBy(F.concat(F.lit("new-"), "id").alias("id"), F.col("sync_version").alias("seq")).agg(F.min("embedding").alias("embedding"))
    batch = batch.drop("embedding").join(own.withColumn("id", F.concat_ws("-", "id", "seq")).drop("seq"), "id")
    return W.added(written(base), written(batch), 64, now()).memories.select("id", "user_id", "content", "sync_version")


@query("m4_supersede")
def m4_supersede(spark: SparkSession, d: str) -> DataFrame:
    m = written(memories(spark, d, "user_id", "agent_id", "content", "embedding", "superseded_by", "valid_until", "created_at"))
    new = m.where(P.stored_time(F.col("created_at")) >= F.lit("2024-01-01").cast("timestamp")).select("id")
    links = G.linked_memories(m, table(spark, d, "entities").where("entity_type = 'pet'"))
    out = W.superseded(m.withColumn("valid_until", P.stored_time(F.col("valid_until"))), new, written(links), 64, now())
    return out.select("id", "superseded_by").join(m.where("superseded_by is null").select("id"), "id", "left_semi").where("superseded_by is not null")


@query("m6_refresh", f"WITH {_CUR}, u AS (SELECT superseded_by AS id, max(importance) AS i FROM memories WHERE superseded_by IS NOT NULL GROUP BY 1) SELECT id, coalesce(i, importance) AS importance, CASE WHEN u.id IS NOT NULL THEN true ELSE pinned END AS pinned FROM cur LEFT JOIN u USING (id)")
def m6_refresh(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "memories").where("superseded_by is not null").select(F.col("superseded_by").alias("id"), "importance")
    return W.refreshed(memories(spark, d, "importance", "pinned"), u, "id", ["importance"], ("pinned", F.lit(True)))


@query("m16_relations", "WITH e AS (SELECT user_id, lower(name) AS n, min(id) AS id FROM entities WHERE name IS NOT NULL GROUP BY 1, 2), o AS (SELECT DISTINCT user_id, n, lead(n) OVER (PARTITION BY user_id ORDER BY n) AS m FROM (SELECT DISTINCT user_id, n FROM e)) SELECT DISTINCT a.id AS source, b.id AS target, 'beside' AS kind, o.user_id FROM o JOIN e a ON a.user_id = o.user_id AND a.n = o.n JOIN e b ON b.user_id = o.user_id AND b.n = o.m WHERE a.id <> b.id")
def m16_relations(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "entities").where("name is not null")
    names = e.select("user_id", F.lower("name").alias("a")).distinct().withColumn("b", F.lead("a").over(Window.partitionBy("user_id").orderBy("a"))).where("b is not null")
    none = e.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("beside").alias("kind"), "user_id").where("false")
    once = W.with_relations(none, names, e, "beside")
    return W.with_relations(written(once), names, e, "beside")  # a second time adds nothing


@query("m16_cascade", f"WITH {_EDGES} SELECT source, target, kind FROM e WHERE source NOT IN ('n1', 'n2') AND target NOT IN ('n1', 'n2')")
def m16_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = _nodes(spark, d).where("id in ('n1', 'n2')")
    return W.without_entity(_nodes(spark, d), _edges(spark, d), gone)[1]


@query("m17_link", "SELECT DISTINCT id, lower(name) AS name FROM (SELECT user_id AS id, name FROM entities WHERE entity_type = 'pet' UNION ALL SELECT user_id, upper(name) FROM entities WHERE name LIKE 'B%') WHERE id IS NOT NULL AND name IS NOT NULL")
def m17_link(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select(F.col("user_id").alias("id"), "name", "entity_type")
    return W.linked(e.where("entity_type = 'pet'"), e.where("name like 'B%'").withColumn("name", F.upper("name")))


@query("s10_import", f"WITH {_CUR} SELECT id, user_id FROM cur WHERE user_id = '{USER}' UNION ALL SELECT id, user_id FROM cur WHERE user_id IS NULL OR user_id <> '{USER}'")
def s10_import(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "user_id")
    return W.inserted_if_absent(m.where(F.col("user_id") == USER), m, ["id"])


@query("s12_versions", f"WITH {_CUR} SELECT id, (SELECT max(sync_version) FROM memories) + row_number() OVER (ORDER BY id) AS sync_version FROM cur WHERE superseded_by IS NOT NULL")
def s12_versions(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "superseded_by").where("superseded_by is not null").select("id")
    return W.next_versions(m, table(spark, d, "memories"), "id").select("id", "sync_version")


# ---- sessions, episodes, logs


@query("m18_sessions", "WITH a AS (SELECT session_id, user_id, min(id) AS started_at FROM scenarios WHERE session_id IS NOT NULL GROUP BY 1, 2) SELECT session_id, arg_min(user_id, struct_pack(s := started_at, u := user_id)) AS user_id, min(started_at) AS started_at FROM a GROUP BY 1")
def m18_sessions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "scenarios").where("session_id is not null").groupBy("session_id", "user_id").agg(F.min("id").alias("started_at"))
    return T.sessions_opened(a.where("false"), a)[0]


@query("m18_refused", "WITH a AS (SELECT session_id, user_id, min(id) AS started_at FROM scenarios WHERE session_id IS NOT NULL GROUP BY 1, 2), o AS (SELECT session_id, arg_min(user_id, struct_pack(s := started_at, u := user_id)) AS owner FROM a GROUP BY 1) SELECT a.* FROM a JOIN o USING (session_id) WHERE user_id IS DISTINCT FROM owner")
def m18_refused(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "scenarios").where("session_id is not null").groupBy("session_id", "user_id").agg(F.min("id").alias("started_at"))
    return T.sessions_opened(a.where("false"), a)[1].select("session_id", "user_id", "started_at")


@query("m18_notes", "WITH n AS (SELECT user_id AS session_id, event_id AS at_, event_type || ';' AS note FROM events) SELECT session_id, substr('#' || string_agg(note, '' ORDER BY at_, note), 1, 2000) AS structured_notes FROM n GROUP BY 1")
def m18_notes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sessions = e.select(F.col("user_id").alias("session_id")).distinct().withColumn("structured_notes", F.lit("#"))
    return T.notes_appended(sessions, e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("at"), F.concat("event_type", F.lit(";")).alias("note")))


@query("m18_queried", "SELECT user_id AS session_id, 2 + count(CASE WHEN event_type = 'view' THEN 1 END) AS queried_count, epoch_us(max(CASE WHEN event_type = 'view' THEN ts END)) AS last_queried_at FROM events GROUP BY 1")
def m18_queried(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_type", micros("ts").alias("at"))
    sessions = e.select("session_id").distinct().select("session_id", F.lit(2).cast("bigint").alias("queried_count"), F.lit(None).cast("bigint").alias("last_queried_at"))
    return T.counted_up(sessions, "session_id", e.where("event_type = 'view'"), "queried_count", "last_queried_at")


@query("m19_reinforce", "WITH r AS (SELECT user_id AS id, count(*) AS n, max(event_id) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT DISTINCT e.user_id AS id, coalesce(n, 0) AS recall_count, m AS last_recalled, round(CASE WHEN n IS NULL THEN 1.5 ELSE least(10.0, 1.5 * pow(1.1, n)) END, 6) AS storage_strength FROM events e LEFT JOIN r ON r.id = e.user_id")
def m19_reinforce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").alias("at"))
    episodes = e.select("id").distinct().select("id", F.lit(0).cast("bigint").alias("recall_count"), F.lit(None).cast("bigint").alias("last_recalled"), F.lit(1.5).alias("storage_strength"))
    return T.reinforced_episodes(episodes, e.where("event_type = 'purchase'")).withColumn("storage_strength", F.round("storage_strength", 6))


@query("m19_meditated", f"SELECT DISTINCT session_id, CASE WHEN session_id IN (SELECT session_id FROM memories) THEN '{NOW}' END AS last_meditated_at FROM scenarios WHERE session_id IS NOT NULL")
def m19_meditated(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scenarios").where("session_id is not null").select("session_id").distinct().withColumn("last_meditated_at", F.lit(None).cast("string"))
    return T.stamped(s, "session_id", table(spark, d, "memories").where("session_id is not null"), "last_meditated_at", F.lit(NOW))


@query("m20_traits", f"WITH {_CUR}, t AS (SELECT id, content, confidence FROM cur WHERE resolution = 'identity'), u AS (SELECT id, 0.9 AS c FROM t WHERE confidence < 0.7) SELECT t.id, content, coalesce(u.c, confidence) AS confidence FROM t LEFT JOIN u USING (id) WHERE t.id NOT IN (SELECT superseded_by FROM memories WHERE superseded_by IS NOT NULL)")
def m20_traits(spark: SparkSession, d: str) -> DataFrame:
    t = memories(spark, d, "content", "confidence", "resolution").where("resolution = 'identity'").drop("resolution")
    news = t.where("confidence < 0.7").select("id", F.lit(0.9).alias("confidence"))
    gone = table(spark, d, "memories").where("superseded_by is not null").select(F.col("superseded_by").alias("id"))
    return L.deleted(W.refreshed(t, news, "id", ["confidence"]), gone, "id")


@query("m21_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def m21_latest(spark: SparkSession, d: str) -> DataFrame:
    return T.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("m21_feedback", "WITH f AS (SELECT user_id AS recall_id, arg_max(event_type, event_id) AS feedback FROM events WHERE event_type IN ('click', 'error') GROUP BY 1) SELECT DISTINCT e.user_id AS recall_id, coalesce(f.feedback, 'none') AS feedback FROM events e LEFT JOIN f ON f.recall_id = e.user_id")
def m21_feedback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    recalls = e.select(F.col("user_id").alias("recall_id")).distinct().withColumn("feedback", F.lit("none"))
    return T.with_feedback(recalls, e.where("event_type in ('click', 'error')").select(F.col("user_id").alias("recall_id"), F.col("event_id").alias("at"), F.col("event_type").alias("feedback")))


@query("m22_tag", f"WITH {_CUR}, t AS (SELECT superseded_by AS id, max(session_id) AS s, max(id) AS e FROM memories WHERE superseded_by IS NOT NULL GROUP BY 1) SELECT id, coalesce(t.s, session_id) AS session_id, t.e AS episode_id FROM cur LEFT JOIN t USING (id)")
def m22_tag(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "memories").where("superseded_by is not null").select(F.col("superseded_by").alias("id"), "session_id", F.col("id").alias("episode_id"))
    return T.tagged(memories(spark, d, "session_id"), tags)


@query("m23_processed", "SELECT DISTINCT id, session_id IN (SELECT session_id FROM memories WHERE session_id IS NOT NULL) AND session_id IS NOT NULL AS processed FROM scenarios WHERE kind = 'event'")
def m23_processed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("kind = 'event'").select("id", "session_id").distinct()
    log = e.join(table(spark, d, "memories").select("session_id"), "session_id", "left_semi")
    return T.processed(e, log).select("id", "processed")


@query("m24_traces", f"WITH {_CUR} SELECT id, round(greatest(0.0, least(1.0, pow(1 + greatest((epoch(TIMESTAMP '{NOW}') - epoch({_TIME.format('updated_at')})) / 86400.0, 0) / (5.0 * greatest(coalesce(stability, 1.0), 0.01)), -0.5))), 5) AS retention FROM cur WHERE id IN (SELECT superseded_by FROM memories)")
def m24_traces(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "memories").where("superseded_by is not null").select(F.col("superseded_by").alias("id"))
    rows, _log = T.traces(memories(spark, d, "stability", "updated_at"), ids, now(), P.stored_time(F.col("updated_at")))
    return rows.select("id", F.round("retention", 5).alias("retention"))


@query("m26_closed", "WITH s AS (SELECT user_id AS session_id, min(event_id) AS started_at FROM events GROUP BY 1), c AS (SELECT user_id AS session_id, max(event_id) AS ended_at FROM events WHERE event_type = 'error' GROUP BY 1) SELECT session_id, started_at, ended_at FROM s LEFT JOIN c USING (session_id)")
def m26_closed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type")
    s = e.groupBy("session_id").agg(F.min("event_id").alias("started_at")).withColumn("ended_at", F.lit(None).cast("bigint"))
    return T.sessions_closed(s, e.where("event_type = 'error'").select("session_id", F.col("event_id").alias("ended_at")))


@query("m27_layer_import", "SELECT DISTINCT id, name FROM entities WHERE entity_type = 'pet' UNION SELECT DISTINCT id, min(name) FROM entities WHERE id NOT IN (SELECT id FROM entities WHERE entity_type = 'pet') GROUP BY id")
def m27_layer_import(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select("id", "name", "entity_type")
    return W.inserted_if_absent(e.where("entity_type = 'pet'").select("id", "name").distinct(), e.select("id", "name"), ["id"])


@query("c36_categories", f"WITH {_CUR} SELECT id, '[' || array_to_string(list_transform(categories, lambda c: '\"' || c || '\"'), ',') || ']' AS formatted, len(categories) AS n FROM cur WHERE categories IS NOT NULL")
def c36_categories(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.text import formatted_list, parsed_list

    m = memories(spark, d, "categories").where("categories is not null").select("id", formatted_list(F.col("categories")).alias("formatted"))
    return m.withColumn("n", F.size(parsed_list(F.col("formatted"))))


@query("c37_append_ids", "WITH e AS (SELECT DISTINCT user_id, id FROM scenarios WHERE kind = 'event' AND user_id IS NOT NULL), b AS (SELECT user_id, list(id ORDER BY id)[1:2] AS ids FROM e GROUP BY 1), n AS (SELECT user_id, list(id ORDER BY id)[1:5] AS more FROM e GROUP BY 1) SELECT user_id, array_to_string(list_concat(ids, list_filter(more, lambda x: NOT list_contains(ids, x))), ',') AS ids FROM b JOIN n USING (user_id)")
def c37_append_ids(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "scenarios").where("kind = 'event' and user_id is not null").select("user_id", "id").distinct()
    first = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("id"))).where("r <= 5")
    base = first.where("r <= 2").groupBy("user_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return T.ids_appended(base, "user_id", "ids", first.select("user_id", "id")).select("user_id", F.array_join("ids", ",").alias("ids"))


# ---- exports


@query("s7_sessions_of", "WITH m AS (SELECT DISTINCT session_id AS c, id, role, content FROM scenarios WHERE session_id IS NOT NULL AND regexp_matches(content, '[^\\s\\p{Z}]')) SELECT 'import-own-' || c AS session_id, count(*) AS n FROM m GROUP BY 1")
def s7_sessions_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("session_id is not null").select(F.col("session_id").alias("conversation"), F.col("id").alias("message_id"), "role", "content", F.lit(None).cast("double").alias("at"))
    return S.sessions_of(e, "own", USER)[0].select("session_id", "n")


@query("s9_full_roundtrip", f"WITH {_CUR} SELECT 'memories' AS layer, count(*) AS n FROM cur UNION ALL SELECT 'owners', count(*) FROM owners UNION ALL SELECT 'faults', count(DISTINCT session_id) FROM (SELECT user_id AS session_id FROM cur WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM owners))")
def s9_full_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    layers = {"memories": memories(spark, d), "owners": table(spark, d, "owners")}
    keys = {"memories": "id", "owners": "user_id"}
    sent = written(S.full_export(layers, keys))
    got, faults = S.full_import(sent, {k: df.where("false") for k, df in layers.items()}, keys, [("memories", "user_id", "owners", "user_id")])
    parts = {**got, "faults": faults}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("layer"), "n") for k, df in parts.items()])

"""Queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.functions.instants import with_instant
from tidemark.operators import analytics as A
from tidemark.operators import episodes as E
from tidemark.operators import filters as P
from tidemark.operators import graph as G
from tidemark.operators import lifecycle as L
from tidemark.operators import retrieval as R
from tidemark.plans.core_queries import with_owner_clock
from tidemark.sources import exports as S
from tidemark.tables import current_memories, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

USER, AGENT, NOW = "owner-00000", "pet-0000", "2024-06-01 00:00:00"
COLUMNS = ["content", "user_id", "agent_id", "run_id", "app_id", "importance", "access_count", "hash", "created_at", "updated_at", "metadata", "immutable", "expiration_date", "categories", "memory_type", "stability", "privacy", "session_id", "resolution", "superseded_by", "valid_from", "valid_until", "confidence", "sync_version", "device_id", "pinned"]

_CUR = "cur AS (SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sync_version DESC) AS rn_ FROM memories WHERE id IS NOT NULL) WHERE rn_ = 1)"
_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[\s[:punct:]]+'), lambda x: x <> '')"
_CJK = r"\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}\x{{f900}}-\x{{faff}}"
_CJKTOK = r"regexp_extract_all(lower({0}), '[" + _CJK + r"]|[^" + _CJK + r"\s[:punct:]]+')"
_AUTO = r"CASE WHEN regexp_matches({0}, '[" + _CJK + r"]') THEN " + _CJKTOK + " ELSE " + _TOK + " END"
_TIME = (
    "(TRY_CAST(substr(replace(CASE WHEN regexp_full_match(trim({0}), '[0-9]{{4}}') THEN trim({0}) || '-01-01' WHEN regexp_full_match(trim({0}), '[0-9]{{4}}-[0-9]{{2}}') THEN trim({0}) || '-01' ELSE trim({0}) END, 'T', ' '), 1, 19) AS TIMESTAMP)"
    " - to_minutes(CASE WHEN length(trim({0})) > 19 AND regexp_matches({0}, '[+-][0-9]{{2}}:?[0-9]{{2}}$') THEN CAST(regexp_extract({0}, '([+-])([0-9]{{2}}):?([0-9]{{2}})$', 2) AS INT) * 60 + CAST(regexp_extract({0}, '([+-])([0-9]{{2}}):?([0-9]{{2}})$', 3) AS INT) ELSE 0 END * CASE WHEN regexp_extract({0}, '([+-])([0-9]{{2}}):?([0-9]{{2}})$', 1) = '-' THEN -1 ELSE 1 END))"
)
_ACTIVE = f"superseded_by IS NULL AND (expiration_date IS NULL OR {_TIME.format('expiration_date')} > TIMESTAMP '{NOW}') AND (valid_until IS NULL OR {_TIME.format('valid_until')} > TIMESTAMP '{NOW}')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def memories(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_memories(table(spark, d, "memories"), *(columns or COLUMNS))


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


# ---- scans, filters, projections


@query("s2_list_memories", f"WITH {_CUR} SELECT id, importance, updated_at FROM cur WHERE user_id = '{USER}' AND agent_id = '{AGENT}' AND importance >= 0.5 ORDER BY replace(replace(updated_at, 'T', ' '), 'Z', '') DESC, id LIMIT 50")
def s2_list_memories(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d, "user_id", "agent_id", "importance", "updated_at").where(P.in_scope(USER, AGENT) & (F.col("importance") >= 0.5))
    return rows.orderBy(F.desc(F.replace(F.replace("updated_at", F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))), "id").limit(50).select("id", "importance", "updated_at")


@query("s3_list_events", "SELECT event_id, event_type, epoch_us(ts) AS at_us FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id LIMIT 100")
def s3_list_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts >= timestamp_ntz '2024-01-10' and ts < timestamp_ntz '2024-01-20' and event_type in ('error', 'purchase')")
    return e.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type", micros("ts").alias("at_us"))


@query("s4_point_lookup", f"WITH {_CUR} SELECT id, content FROM cur WHERE id IN (SELECT max(id) FROM memories)")
def s4_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "content")
    return m.join(table(spark, d, "memories").agg(F.max("id").alias("id")), "id", "left_semi").select("id", "content")


@query("s5_fetch_by_ids", "SELECT DISTINCT id, role FROM scenarios WHERE kind = 'event' AND id IN (SELECT superseded_by FROM memories UNION SELECT min(id) FROM scenarios WHERE kind = 'event' GROUP BY user_id)")
def s5_fetch_by_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("kind = 'event'").select("id", "role", "user_id")
    ids = table(spark, d, "memories").select(F.col("superseded_by").alias("id")).union(e.groupBy("user_id").agg(F.min("id").alias("id")).select("id"))
    return e.join(ids.where("id is not null").distinct(), "id", "left_semi").select("id", "role").distinct()


@query("s8_export_privacy", f"WITH {_CUR} SELECT id, privacy, created_at FROM cur WHERE privacy IS NULL OR privacy <> 'local'")
def s8_export_privacy(spark: SparkSession, d: str) -> DataFrame:
    return S.export_memories(memories(spark, d, "privacy", "created_at"), include_local=False).select("id", "privacy", "created_at")


@query("s9_broken_references", "SELECT DISTINCT 'memories.superseded_by' AS rule, superseded_by AS id FROM memories WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM memories) UNION ALL SELECT DISTINCT 'memories.session_id', session_id FROM memories WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM scenarios WHERE session_id IS NOT NULL) UNION ALL SELECT DISTINCT 'scenarios.user_id', user_id FROM scenarios WHERE user_id NOT IN (SELECT user_id FROM owners)")
def s9_broken_references(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: table(spark, d, t) for t in ("memories", "scenarios", "owners")}
    return S.broken_references(tables, [("memories", "superseded_by", "memories", "id"), ("memories", "session_id", "scenarios", "session_id"), ("scenarios", "user_id", "owners", "user_id")])


@query("s11_change_feed", "WITH last AS (SELECT user_id AS id, arg_max(event_type, event_id) AS event, max(event_id) AS version FROM events GROUP BY 1), m AS (SELECT 'x' || o_custkey AS id, o_orderkey AS sync_version FROM orders) SELECT id, 'UPSERT' AS op, max(sync_version) AS version FROM m WHERE sync_version > 500 GROUP BY id UNION ALL SELECT 'x' || id, 'DELETE', version FROM last WHERE event = 'error' AND version > 500 AND 'x' || id NOT IN (SELECT id FROM m)")
def s11_change_feed(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(F.concat(F.lit("x"), F.col("o_custkey")).alias("id"), F.col("o_orderkey").alias("sync_version"))
    event = F.when(F.col("event_type") == "error", "DELETE").otherwise("ADD")
    h = table(spark, d, "events").select(F.concat(F.lit("x"), F.col("user_id")).alias("id"), event.alias("event"), F.col("event_id").alias("version"))
    return S.change_feed(m, h, 500)


@query("s14_storage_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("documents", "entities", "memories", "owners", "scenarios")))
def s14_storage_stats(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("documents", "entities", "memories", "owners", "scenarios")])


@query("s19_config_latest", "SELECT props AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY props")
def s19_config_latest(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_config(table(spark, d, "events").select(F.col("props").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("written_at")))


@query("f3_events_as_memories", f"WITH {_CUR} SELECT id, content, importance, stability, resolution FROM cur UNION ALL SELECT DISTINCT id, content, 0.5, 1.0, 'granular' FROM scenarios WHERE kind = 'event'")
def f3_events_as_memories(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("kind = 'event'").select("id", "content").distinct()
    e = e.select("id", "content", F.lit(0.5).alias("importance"), F.lit(1.0).alias("stability"), F.lit("granular").alias("resolution"))
    return memories(spark, d, "content", "importance", "stability", "resolution").unionByName(e)


FILTER = {"and": [{"field": "importance", "op": "gte", "value": 0.4}, {"or": [{"field": "memory_type", "op": "in", "value": ["preference", "short_term"]}, {"field": "content", "op": "icontains", "value": "COLLAR"}]}, {"field": "resolution", "op": "ne", "value": "identity"}]}


@query("f4_filter", f"WITH {_CUR} SELECT id FROM cur WHERE importance >= 0.4 AND (memory_type IN ('preference', 'short_term') OR contains(lower(content), 'collar')) AND resolution <> 'identity'")
def f4_filter(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "importance", "memory_type", "content", "resolution").where(P.compiled(FILTER)).select("id")


@query("f5_metadata_path", f"WITH {_CUR} SELECT id, json_extract_string(metadata, '$.attr') AS attr FROM cur WHERE TRY_CAST(json_extract_string(metadata, '$.rev') AS DOUBLE) >= 1 AND json_extract_string(metadata, '$.attr') <> 'vet'")
def f5_metadata_path(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "metadata").where(P.compiled({"and": [{"field": "rev", "op": "gte", "value": 1}, {"field": "attr", "op": "ne", "value": "vet"}]}))
    return m.select("id", F.get_json_object("metadata", "$.attr").alias("attr"))


@query("f6_categories", f"WITH {_CUR} SELECT id FROM cur WHERE list_contains(categories, 'food') OR len(list_filter(categories, lambda x: contains(lower(x), 'eal'))) > 0")
def f6_categories(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "categories").where(P.compiled({"or": [{"field": "categories", "op": "contains", "value": "food"}, {"field": "categories", "op": "icontains", "value": "EAL"}]})).select("id")


@query("f7_merged_scope", f"WITH {_CUR} SELECT id, agent_id FROM cur WHERE user_id = '{USER}' AND (agent_id = '{AGENT}' OR agent_id IS NULL)")
def f7_merged_scope(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "user_id", "agent_id").where(P.in_scope(USER, AGENT, merged=True)).select("id", "agent_id")


@query("f8_active", f"WITH {_CUR} SELECT id FROM cur WHERE {_ACTIVE}")
def f8_active(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "superseded_by", "expiration_date", "valid_until").where(P.active(now())).select("id")


@query("f10_date_ranges", f"WITH {_CUR} SELECT id FROM cur WHERE CAST({_TIME.format('created_at')} AS DATE) BETWEEN DATE '2023-02-01' AND DATE '2023-02-10' OR CAST({_TIME.format('created_at')} AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'")
def f10_date_ranges(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "created_at").where(P.day_ranges(P.stored_time(F.col("created_at")), [("2023-02-01", "2023-02-10"), ("2024-01-01", "2024-01-31")])).select("id")


@query("f11_entity_search", "SELECT DISTINCT id, name FROM entities WHERE contains(lower(name), 'park') AND entity_type = 'place'")
def f11_entity_search(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_search(table(spark, d, "entities"), "PARK", F.col("entity_type") == "place").select("id", "name").distinct()


@query("f15_invalid_rows", "SELECT id, CASE WHEN content IS NULL OR NOT regexp_matches(content, '[^\\s\\p{Z}]') THEN 'empty content' ELSE 'unknown role' END AS reason FROM (SELECT DISTINCT id, role, content FROM scenarios WHERE kind = 'event') WHERE content IS NULL OR NOT regexp_matches(content, '[^\\s\\p{Z}]') OR role IS NULL OR lower(trim(role)) NOT IN ('user', 'human', 'assistant', 'model', 'bot', 'system', 'tool')")
def f15_invalid_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("kind = 'event'").select("id", "role", "content").distinct()
    empty = F.col("content").isNull() | ~F.col("content").rlike("[^\\s\\p{Z}]")
    odd = F.col("role").isNull() | ~F.lower(F.trim("role")).isin("user", "human", "assistant", "model", "bot", "system", "tool")
    return e.where(empty | odd).select("id", F.when(empty, "empty content").otherwise("unknown role").alias("reason"))


# ---- joins


@query("j3_shared_entities", "WITH l AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS name FROM lineitem) SELECT x.id AS a, y.id AS b, count(DISTINCT x.name) AS shared FROM l x JOIN l y ON x.name = y.name AND x.id < y.id GROUP BY 1, 2 HAVING count(DISTINCT x.name) >= 2")
def j3_shared_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.shared_entities(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("name")).distinct(), 2)


@query("j6_degrees", "WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT s_suppkey AS id, count(e.dst) AS degree FROM supplier LEFT JOIN e ON e.src = s_suppkey GROUP BY 1")
def j6_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    n = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return G.degrees(n, e).select(F.substring("id", 2, 20).cast("bigint").alias("id"), "degree")


@query("j9_sessions_without_memory", "SELECT DISTINCT session_id FROM scenarios WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM memories WHERE session_id IS NOT NULL)")
def j9_sessions_without_memory(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scenarios").where("session_id is not null").select("session_id").distinct()
    return s.join(table(spark, d, "memories").select("session_id"), "session_id", "left_anti")


@query("j10_category_members", f"WITH {_CUR} SELECT category, count(*) AS n FROM (SELECT id, unnest(list_distinct(categories)) AS category FROM cur) GROUP BY category")
def j10_category_members(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "categories").select("id", F.explode(F.array_distinct("categories")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("j12_events_per_session", f"WITH {_CUR}, e AS (SELECT session_id, count(DISTINCT id) AS n FROM scenarios WHERE session_id IS NOT NULL GROUP BY 1) SELECT m.session_id, coalesce(max(e.n), 0) AS n, count(*) AS facts FROM cur m LEFT JOIN e USING (session_id) WHERE m.session_id IS NOT NULL GROUP BY 1")
def j12_events_per_session(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("session_id is not null").groupBy("session_id").agg(F.count_distinct("id").alias("n"))
    m = memories(spark, d, "session_id").where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("facts"))
    return m.join(e, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n"), "facts")


@query("j13_last_event", "SELECT user_id, arg_max(event_type, event_id) AS event, max(event_id) AS event_id FROM events GROUP BY 1")
def j13_last_event(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event"), F.max("event_id").alias("event_id"))


@query("j15_name_to_id", "SELECT DISTINCT e.id, e.user_id FROM entities e JOIN entities f ON lower(e.name) = lower(f.name) AND e.user_id <> f.user_id")
def j15_name_to_id(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select("id", "user_id", F.lower("name").alias("k")).distinct()
    owners = e.groupBy("k").agg(F.count_distinct("user_id").alias("n")).where("n > 1")
    return e.join(owners, "k", "left_semi").select("id", "user_id").distinct()


# ---- aggregations


@query("a1_user_summary", f"WITH {_CUR} SELECT user_id, count(*) AS total, count(DISTINCT agent_id) AS agents, min(created_at) AS first_at, max(created_at) AS last_at FROM cur GROUP BY 1")
def a1_user_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.user_summary(memories(spark, d, "user_id", "agent_id", "created_at"))


for _g in ("day", "week", "month"):
    QUERIES[f"a2_frequency_{_g}"] = lambda spark, d, g=_g: A.frequency(table(spark, d, "events"), "ts", g)
    SQL[f"a2_frequency_{_g}"] = f"SELECT CAST(date_trunc('{_g}', ts) AS DATE) AS period, count(*) AS n FROM events GROUP BY 1"


@query("a3_event_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a3_event_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(table(spark, d, "events"), "event_type")


@query("a4_top_entities", "WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT src AS id, count(*) AS degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a4_top_entities(spark: SparkSession, d: str) -> DataFrame:
    return j6_degrees(spark, d).orderBy(F.desc("degree"), "id").limit(10)


@query("a5_counts", "SELECT user_id, count(DISTINCT id) AS events, count(DISTINCT CASE WHEN session_id IS NULL THEN id END) AS loose FROM scenarios WHERE kind = 'event' GROUP BY 1")
def a5_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scenarios").where("kind = 'event'").groupBy("user_id").agg(F.count_distinct("id").alias("events"), F.count_distinct(F.when(F.col("session_id").isNull(), F.col("id"))).alias("loose"))


@query("a7_max_version", "SELECT coalesce(max(sync_version), 0) AS version, coalesce(max(CASE WHEN user_id = 'nobody' THEN sync_version END), 0) AS none FROM memories")
def a7_max_version(spark: SparkSession, d: str) -> DataFrame:
    none = F.max(F.when(F.col("user_id") == "nobody", F.col("sync_version")))
    return table(spark, d, "memories").agg(F.coalesce(F.max("sync_version"), F.lit(0)).alias("version"), F.coalesce(none, F.lit(0)).alias("none"))


@query("a12_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def a12_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.percentiles(table(spark, d, "events"), "value", ["event_type"])


@query("a13_episode_ids", "SELECT session_id, array_to_string(list(id ORDER BY id), ',') AS ids, count(*) AS n FROM (SELECT DISTINCT session_id, id FROM scenarios WHERE session_id IS NOT NULL) GROUP BY 1")
def a13_episode_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("session_id is not null").select("session_id", "id").distinct()
    return e.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("n"))


@query("a14_rollup_text", "SELECT session_id, array_to_string(list_slice(list(coalesce(content, '') ORDER BY id), 1, 5), ' | ') AS summary FROM (SELECT DISTINCT session_id, id, content FROM scenarios WHERE session_id IS NOT NULL) GROUP BY 1")
def a14_rollup_text(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("session_id is not null").select("session_id", "id", F.coalesce("content", F.lit("")).alias("content")).distinct()
    first = e.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).where("r <= 5")
    return first.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "content"))), lambda m: m.content), " | ").alias("summary"))


# ---- windows, order, sets


@query("w2_session_cap", f"WITH {_CUR} SELECT id FROM (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, id) AS r FROM cur) WHERE session_id IS NULL OR r <= 1")
def w2_session_cap(spark: SparkSession, d: str) -> DataFrame:
    return R.session_cap(memories(spark, d, "session_id", "importance").withColumnRenamed("importance", "score"), 1).select("id")


@query("w3_token_budget", "WITH e AS (SELECT DISTINCT session_id, id, content FROM scenarios WHERE session_id IS NOT NULL AND content IS NOT NULL), s AS (SELECT *, sum(strlen(content) // 4 + 10) OVER (PARTITION BY session_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT session_id, id FROM s WHERE s <= 120")
def w3_token_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("session_id is not null and content is not null").select("session_id", "id", "content").distinct()
    return L.budget_suffix(e, "session_id", [F.desc("id")], X.token_estimate(F.col("content")), 120).select("session_id", "id")


@query("w4_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def w4_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return L.first_by(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("w5_titles", "SELECT session_id, CASE WHEN length(c) > 60 THEN substr(c, 1, 60) || '...' ELSE c END AS title FROM (SELECT session_id, arg_min(content, id) AS c FROM scenarios WHERE session_id IS NOT NULL AND content IS NOT NULL AND lower(trim(role)) = 'user' GROUP BY 1)")
def w5_titles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scenarios").where("session_id is not null and content is not null and lower(trim(role)) = 'user'")
    return e.groupBy("session_id").agg(F.min_by("content", "id").alias("c")).select("session_id", X.preview(F.col("c"), 60).alias("title"))


@query("w6_cooldown", "SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 6 HOURS")
def w6_cooldown(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", micros("ts"))
    before = F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return e.withColumn("p", before).where("p is null or at - p >= 21600000000").select("event_id", "user_id")


@query("t2_paging", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 40 OFFSET 80")
def t2_paging(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").offset(80).limit(40).select("event_id")


@query("t3_nulls_last", f"WITH {_CUR} SELECT id, memory_type FROM cur ORDER BY memory_type DESC NULLS LAST, id LIMIT 200")
def t3_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "memory_type").orderBy(F.desc_nulls_last("memory_type"), "id").limit(200).select("id", "memory_type")


@query("t4_nostalgia")
def t4_nostalgia(spark: SparkSession, d: str) -> DataFrame:
    old = memories(spark, d, "created_at", "importance").where((L.days_between(P.stored_time(F.col("created_at")), now()) > 90) & (F.col("importance") >= 0.6))
    return old.orderBy(F.rand(7), "id").limit(10).select("id")


@query("t6_prune_victims", f"WITH {_CUR}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_ FROM cur), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance, id) AS r_ FROM n WHERE NOT immutable) SELECT id, user_id FROM r WHERE r_ <= n_ - 10")
def t6_prune_victims(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "user_id", "importance", "immutable")
    order = L.pruned(m.withColumn("_imm", F.coalesce("immutable", F.lit(True))), ["user_id"], 10, "importance", F.col("_imm"))
    return order.select("id", "user_id")


@query("u2_scoped_branches", f"WITH {_CUR}, a AS (SELECT id, importance FROM cur WHERE user_id = '{USER}' AND agent_id = '{AGENT}' ORDER BY importance DESC, id LIMIT 20), b AS (SELECT id, importance FROM cur WHERE user_id = '{USER}' AND agent_id IS NULL ORDER BY importance DESC, id LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b")
def u2_scoped_branches(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "user_id", "agent_id", "importance").where(F.col("user_id") == USER)
    best = lambda c: m.where(c).orderBy(F.desc("importance"), "id").limit(20).select("id", "importance")
    return best(F.col("agent_id") == AGENT).unionByName(best(F.col("agent_id").isNull()))


# ---- functions


@query("c1_tokens", f"SELECT doc_id, array_to_string({_TOK.format('text')}, ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def c1_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query("c3_auto_tokens", f"SELECT doc_id, len({_AUTO.format('text')}) AS n, md5(array_to_string({_AUTO.format('text')}, ' ')) AS h FROM documents WHERE text IS NOT NULL")
def c3_auto_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", X.auto_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


@query("c4_overlap", f"WITH {_CUR} SELECT id, round((CAST(contains(lower(content), 'collar') AS INT) + CAST(contains(lower(content), 'blue') AS INT) + CAST(contains(lower(content), 'export') AS INT)) / 3.0, 6) AS score FROM cur WHERE content IS NOT NULL")
def c4_overlap(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "content").where("content is not null").select("id", F.round(X.overlap_score(F.col("content"), ["collar", "blue", "export"]), 6).alias("score"))


@query("c5_identifiers", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: strlen(x) >= 4 AND regexp_matches(x, '[0-9]')))), ' ') AS ids FROM documents WHERE text IS NOT NULL")
def c5_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.sort_array(X.identifiers(F.col("text"))), " ").alias("ids"))


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1 AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query("c6_content_hash", f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN lower(lpad(hex(CAST({_FNV} AS UBIGINT)), 16, '0')) END AS h FROM documents")
def c6_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("h"))


@query("c8_candidate_entities")
def c8_candidate_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(X.candidate_entities(F.col("text"))).alias("name"))


@query("c9_token_estimate", "SELECT doc_id, strlen(text) // 4 + 10 AS n FROM documents WHERE text IS NOT NULL")
def c9_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("n"))


@query("c10_first_date", r"SELECT DISTINCT id, nullif(regexp_extract(content, '\b((?:19|20)[0-9]{2}(?:-[0-9]{2}(?:-[0-9]{2})?)?)\b', 1), '') AS found FROM scenarios WHERE content IS NOT NULL")
def c10_first_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scenarios").where("content is not null").select("id", X.first_date(F.col("content")).alias("found")).distinct()


@query("c13_markers", "SELECT id, " + " OR ".join(f"contains(lower(content), '{m.replace(chr(39), chr(39) * 2)}')" for m in X.NEGATIONS) + " AS negated, " + " OR ".join(f"contains(lower(content), '{m}')" for m in X.PREFERENCES) + " AS changed FROM (SELECT DISTINCT id, content FROM memories WHERE content IS NOT NULL)")
def c13_markers(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").where("content is not null").select("id", "content").distinct()
    return m.select("id", X.contains_any(F.col("content"), X.NEGATIONS).alias("negated"), X.contains_any(F.col("content"), X.PREFERENCES).alias("changed"))


@query("c19_days_since", f"WITH {_CUR} SELECT id, round(greatest((epoch(TIMESTAMP '{NOW}') - epoch({_TIME.format('updated_at')})) / 86400.0, 0), 4) AS days FROM cur")
def c19_days_since(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "updated_at").select("id", F.round(L.days_between(P.stored_time(F.col("updated_at")), now()), 4).alias("days"))


@query("c22_partial_dates", f"SELECT DISTINCT id, valid_from, epoch_us({_TIME.format('valid_from')}) AS at_us FROM memories WHERE valid_from IS NOT NULL")
def c22_partial_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").where("valid_from is not null").select("id", "valid_from", F.unix_micros(P.stored_time(F.col("valid_from"))).alias("at_us")).distinct()


_RET = "greatest(0.0, least(1.0, pow(1 + {0} / (CASE resolution WHEN 'identity' THEN 10.0 WHEN 'granular' THEN 5.0 WHEN 'narrative' THEN 3.0 ELSE 5.0 END * greatest(stability, 0.01)), -0.5)))"
_DAYS = f"greatest((epoch(TIMESTAMP '{NOW}') - epoch({_TIME.format('updated_at')})) / 86400.0, 0)"


@query("c25_retention", f"WITH {_CUR} SELECT id, round({_RET.format(_DAYS)}, 5) AS kept FROM cur WHERE stability IS NOT NULL")
def c25_retention(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "updated_at", "stability", "resolution").where("stability is not null")
    return m.select("id", F.round(L.retention(L.days_between(P.stored_time(F.col("updated_at")), now()), F.col("stability"), F.col("resolution")), 5).alias("kept"))


@query("c26_interference", f"WITH {_CUR} SELECT user_id, count(*) AS n, round(CASE WHEN count(*) < 50 THEN 1.0 ELSE greatest(0.70, 1 / (1 + 0.15 * log2(count(*) / 50.0))) END, 6) AS discount FROM cur GROUP BY 1")
def c26_interference(spark: SparkSession, d: str) -> DataFrame:
    n = memories(spark, d, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", F.round(L.interference(F.col("n")), 6).alias("discount"))


@query("c28_reinforce", f"WITH {_CUR} SELECT id, round(least(365.0, stability * (1 + 0.3 * (1 - {_RET.format(_DAYS)}))), 5) AS stability FROM cur WHERE stability IS NOT NULL")
def c28_reinforce(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "updated_at", "stability", "resolution").where("stability is not null")
    kept = L.retention(L.days_between(P.stored_time(F.col("updated_at")), now()), F.col("stability"), F.col("resolution"))
    return m.select("id", F.round(L.reinforced(F.col("stability"), kept), 5).alias("stability"))


def _contradiction_sql(a: str, b: str, newer: str) -> str:
    """The contradiction score of texts ``a`` (old) and ``b`` (new)."""
    quoted = lambda m: "'" + m.replace("'", "''") + "'"
    has = lambda t, ms: "(" + " OR ".join(f"contains(lower({t}), {quoted(m)})" for m in ms) + ")"
    lone = lambda t, p, q: f"contains(lower({t}), {quoted(p)}) AND NOT contains(lower({t}), {quoted(q)})"
    opposed = " OR ".join(f"({lone(a, p, q)} AND {lone(b, q, p)}) OR ({lone(a, q, p)} AND {lone(b, p, q)})" for p, q in X.ANTONYMS)
    numbers = lambda t: f"list_filter(list_transform(regexp_extract_all({t}, '[0-9][0-9.,]*'), lambda x: TRY_CAST(rtrim(replace(x, ',', ''), '.') AS DOUBLE)), lambda x: x > 0)"
    changed = f"len(list_filter({numbers(a)}, lambda x: len(list_filter({numbers(b)}, lambda y: x <> y AND greatest(x, y) / least(x, y) < 10)) > 0)) > 0"
    terms = [(f"{has(a, X.NEGATIONS)} <> {has(b, X.NEGATIONS)}", 0.3), (opposed, 0.2), (has(b, X.PREFERENCES), 0.2), (changed, 0.15), (newer, 0.15)]
    return " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for c, w in terms)


@query("c33_contradiction", f"WITH {_CUR}, p AS (SELECT o.id, o.superseded_by, round({_contradiction_sql('o.content', 'n.content', 'n.created_at > o.created_at')}, 4) AS contradiction FROM cur o JOIN cur n ON n.id = o.superseded_by AND o.superseded_by <> o.id) SELECT * FROM p WHERE contradiction >= 0.3")
def c33_contradiction(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "content", "superseded_by", "created_at")
    new = m.select(F.col("id").alias("superseded_by"), F.col("content").alias("new_content"), F.col("created_at").alias("new_at"))
    pairs = m.where("superseded_by <> id").join(new, "superseded_by")
    return L.contradictions(pairs, "content", "new_content", F.col("new_at") > F.col("created_at"), 0.3).select("id", "superseded_by", "contradiction")


# ---- retrieval


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The stated query: the vector of id 0."""
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query("r1_vector_topk", f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings e WHERE vec_id <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def r1_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id <> 0")
    return R.top(R.vector_channel(e, "vec_id", "embedding", _query_vector(spark, d)), 10).select("id", F.round("score", 6).alias("score"))


@query("r1_vector_filtered", f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings e WHERE vec_id <> 0 AND label IN (1, 2) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def r1_vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id <> 0 and label in (1, 2)")
    return R.top(R.vector_channel(e, "vec_id", "embedding", _query_vector(spark, d)), 10).select("id", F.round("score", 6).alias("score"))


_PAIRCOS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


def _all_topk_sql(rows: str) -> str:
    ranked = f"SELECT q.vec_id, e.vec_id AS id, {_PAIRCOS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_PAIRCOS} DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id AND {rows}"
    return f"SELECT vec_id, id, round(s, 6) AS score FROM ({ranked}) WHERE r <= 10"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("r1_vector_topk_all", _all_topk_sql("true"))
def r1_vector_topk_all(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    return R.best_matches(e.where("id % 100 = 0"), e, 10).select(F.col("query").alias("vec_id"), "id", F.round("score", 6).alias("score"))


@query("r1_vector_filtered_all", _all_topk_sql("e.label IN (1, 2)"))
def r1_vector_filtered_all(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    return R.best_matches(e.where("id % 100 = 0"), e.where("label in (1, 2)"), 10).select(F.col("query").alias("vec_id"), "id", F.round("score", 6).alias("score"))


def _bm25_sql(source: str, id_col: str, text: str, terms: list[str]) -> str:
    tf = lambda t: f"len(list_filter(ws, lambda w: w = '{t}'))"
    df = lambda t: f"(SELECT count(*) FROM w WHERE list_contains(ws, '{t}'))"
    avg = "(SELECT avg(len(ws)) FROM w)"
    n = "(SELECT count(*) FROM w)"
    parts = " + ".join(f"ln(1 + ({n} - {df(t)} + 0.5) / ({df(t)} + 0.5)) * {tf(t)} * 2.2 / ({tf(t)} + 1.2 * (0.25 + 0.75 * len(ws) / {avg}))" for t in sorted(terms))
    hit = " OR ".join(f"list_contains(ws, '{t}')" for t in terms)
    return f"w AS (SELECT {id_col} AS id, {_AUTO.format(text)} AS ws FROM {source} WHERE {text} IS NOT NULL), b AS (SELECT id, {parts} AS score FROM w WHERE {hit})"


@query("r4_bm25", f"WITH {_bm25_sql('documents', 'doc_id', 'text', ['collar', 'lighthouse'])} SELECT id, round(score, 5) AS score FROM b ORDER BY score DESC, id LIMIT 30")
def r4_bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.top(R.bm25(table(spark, d, "documents"), "doc_id", "text", ["collar", "lighthouse"]), 30).select("id", F.round("score", 5).alias("score"))


@query("r4_postings", f"SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_AUTO.format('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2) GROUP BY 1")
def r4_postings(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_FUSE = (
    f"{_bm25_sql('documents', 'doc_id', 'text', ['collar', 'lighthouse'])}, "
    "o AS (SELECT doc_id AS id, (CAST(contains(lower(text), 'collar') AS INT) + CAST(contains(lower(text), 'lighthouse') AS INT)) / 2.0 AS score FROM documents WHERE text IS NOT NULL), "
    "rk AS (SELECT 'text' AS channel, id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM b UNION ALL SELECT 'overlap', id, row_number() OVER (ORDER BY score DESC, id) FROM o WHERE score > 0)"
)


def _document_ranks(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = table(spark, d, "documents")
    text = R.bm25(docs, "doc_id", "text", ["collar", "lighthouse"]).select("id", F.round("score", 9).alias("score"))
    return R.ranked({"text": text, "overlap": R.overlap_channel(docs, "doc_id", "text", ["collar", "lighthouse"])}, k)


@query("r10_rrf", f"WITH {_FUSE} SELECT id, round(sum(CASE channel WHEN 'text' THEN 0.35 ELSE 0.15 END / (30 + rank)), 8) AS score FROM rk WHERE rank <= 100 GROUP BY id ORDER BY sum(CASE channel WHEN 'text' THEN 0.35 ELSE 0.15 END / (30 + rank)) DESC, id LIMIT 10")
def r10_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.top(R.rrf(_document_ranks(spark, d, 100), R.WEIGHTS), 10).select("id", F.round("score", 8).alias("score"))


@query("r11_combmax", f"WITH {_FUSE} SELECT id, round(max(CASE channel WHEN 'text' THEN 0.35 ELSE 0.15 END / rank), 8) AS score FROM rk WHERE rank <= 100 GROUP BY id")
def r11_combmax(spark: SparkSession, d: str) -> DataFrame:
    return R.combmax(_document_ranks(spark, d, 100), R.WEIGHTS).select("id", F.round("score", 8).alias("score"))


@query("r12_temporal_boost", f"WITH {_CUR} SELECT id, round(CASE WHEN CAST({_TIME.format('created_at')} AS DATE) BETWEEN DATE '2023-03-01' AND DATE '2023-03-31' THEN importance * 1.5 ELSE importance END, 6) AS score FROM cur")
def r12_temporal_boost(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "created_at", "importance")
    return m.select("id", F.round(R.boosted(F.col("importance"), P.stored_time(F.col("created_at")), "2023-03-01", "2023-03-31"), 6).alias("score"))


_HIERARCHY = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


@query("r14_spread", f"WITH RECURSIVE e AS ({_HIERARCHY}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT 's' || min(s_suppkey) AS id, 0 AS hops FROM supplier UNION SELECT b.dst, r.hops + 1 FROM r JOIN b ON b.src = r.id WHERE r.hops < 4) SELECT id, min(hops) AS hops FROM r GROUP BY 1")
def r14_spread(spark: SparkSession, d: str) -> DataFrame:
    def edges(t: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, d, t).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))

    e = edges("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edges("supplier", "n", "s_nationkey", "s", "s_suppkey")).unionByName(edges("customer", "n", "c_nationkey", "c", "c_custkey"))
    start = table(spark, d, "supplier").agg(F.concat(F.lit("s"), F.min("s_suppkey")).alias("id"))
    return G.neighbourhood(e, start, 4, undirected=True)


@query("r15_superseding_chain", "WITH RECURSIVE e AS (SELECT DISTINCT id AS src, superseded_by AS dst FROM memories WHERE superseded_by IS NOT NULL), s AS (SELECT DISTINCT src AS id FROM e WHERE src NOT IN (SELECT dst FROM e)), r AS (SELECT id, 0 AS hops FROM s UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.id WHERE r.hops < 4) SELECT id, min(hops) AS hops FROM r GROUP BY 1")
def r15_superseding_chain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "memories").where("superseded_by is not null").select(F.col("id").alias("src"), F.col("superseded_by").alias("dst")).distinct()
    start = e.select(F.col("src").alias("id")).join(e.select(F.col("dst").alias("id")), "id", "left_anti").distinct()
    return G.neighbourhood(e, start, 4)


_LINKS = r"l AS (SELECT DISTINCT cur.id, e.name FROM cur JOIN (SELECT DISTINCT user_id, name FROM entities WHERE name IS NOT NULL) e ON e.user_id = cur.user_id AND contains(lower(content), lower(name)) AND regexp_matches(lower(content), '(^|[^\p{L}\p{N}])' || regexp_escape(lower(name)) || '($|[^\p{L}\p{N}])'))"


@query("r7_entity_links", f"WITH {_CUR}, {_LINKS} SELECT id, name FROM l")
def r7_entity_links(spark: SparkSession, d: str) -> DataFrame:
    return G.linked_memories(memories(spark, d, "user_id", "content"), table(spark, d, "entities"))


@query("r18_forgetting_scores", f"WITH {_CUR}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_ FROM cur) SELECT id, round(importance * (0.7 * {_RET.format(_DAYS)} * CASE WHEN n_ < 50 THEN 1.0 ELSE greatest(0.70, 1 / (1 + 0.15 * log2(n_ / 50.0))) END + 0.3 * importance), 5) AS score FROM n WHERE stability IS NOT NULL")
def r18_forgetting_scores(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "user_id", "updated_at", "stability", "resolution", "importance")
    n = m.groupBy("user_id").agg(F.count("*").alias("n"))
    kept = L.retention(L.days_between(P.stored_time(F.col("updated_at")), now()), F.col("stability"), F.col("resolution"))
    scored = m.where("stability is not null").join(n, "user_id")
    return scored.select("id", F.round(L.forgetting_score(F.col("importance"), kept, L.interference(F.col("n")), F.col("importance")), 5).alias("score"))


@query("r21_hybrid_search")
def r21_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date

    from tidemark.functions.timephrases import time_ranges

    text, scope = "blue collar PETFACT-001531", P.in_scope(USER, AGENT, merged=True) & P.active(now())
    m = written(memories(spark, d, "content", "embedding", "user_id", "agent_id", "session_id", "superseded_by", "expiration_date", "valid_until", "importance", "stability", "resolution", "updated_at", "event_time"))
    e = table(spark, d, "scenarios").where("kind = 'event'").dropDuplicates(["id"]).select("id", "content", "user_id", "agent_id", "session_id", "timestamp", "event_time")
    e = written(e.select("*", *[F.lit(None).cast("string").alias(c) for c in ("superseded_by", "expiration_date", "valid_until")]))  # events are always active
    first = m.where((F.col("user_id") == USER) & F.col("embedding").isNotNull() & (F.size("embedding") == 64)).orderBy("id").first()
    vector = list(first["embedding"]) if first else None
    names = table(spark, d, "entities").where((F.col("user_id") == USER) & (F.col("entity_type") == "pet"))
    linked = G.linked_memories(m.where(scope), names).groupBy("id").agg(F.count("*").cast("double").alias("score"))
    hits = written(R.hybrid_search(m, text, vector, scope, 10, entities=linked, events=e))
    clocked = with_owner_clock(e.where(scope).join(F.broadcast(hits.select("id")), "id", "left_semi"), table(spark, d, "owners"))  # ten hits
    for c in ("timestamp", "event_time"):
        clocked = with_instant(clocked, c, c, F.col("home_zone"), F.col("month_first"))
    stated = [F.lit(0.5).alias("importance"), F.lit(1.0).alias("stability"), F.lit("granular").alias("resolution")]
    said = clocked.select("id", "session_id", F.timestamp_micros("timestamp").alias("updated_at"), F.timestamp_micros("event_time").alias("event_time"), *stated)
    held = m.where(scope).select("id", "session_id", P.stored_time(F.col("updated_at")).alias("updated_at"), P.stored_time(F.col("event_time")).alias("event_time"), "importance", "stability", "resolution")
    ranges = [(str(a), str(b)) for a, b in time_ranges(text, date.fromisoformat(NOW[:10]))]
    found = R.rescored(hits, held.unionByName(said), m.where(F.col("user_id") == USER).count(), now(), 10, ranges)
    return found.select("id", F.round("score", 8).alias("score"))


# ---- modification and lifecycle


@query("m3_exact_duplicates", "SELECT md5(text) AS h, min(doc_id) AS kept, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def m3_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    dup = L.exact_duplicates(docs, [], "text", "doc_id")
    return dup.join(docs.select(F.col("doc_id").alias("kept"), F.md5("text").alias("h")), "kept").select("h", "kept", "copies")


@query("m5_merge_latest", "SELECT id, max(sync_version) AS sync_version FROM memories GROUP BY id")
def m5_merge_latest(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").select("id", "sync_version", "immutable")
    halves = F.pmod("sync_version", F.lit(2)) == 0
    return L.merged(m.where(halves), m.where(~halves), "id", "sync_version").select("id", "sync_version")


@query("m7_guarded_delete", f"WITH {_CUR}, x AS (SELECT superseded_by AS id FROM cur WHERE superseded_by IS NOT NULL) SELECT id FROM cur WHERE coalesce(immutable, false) OR id NOT IN (SELECT id FROM x)")
def m7_guarded_delete(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "immutable", "superseded_by")
    gone = m.where("superseded_by is not null").select(F.col("superseded_by").alias("id"))
    return L.deleted(m, gone, "id", F.col("immutable")).select("id")


@query("m10_consolidate", f"WITH {_CUR}, s AS (SELECT id, greatest(0.0, importance - 0.001 * {_DAYS}) AS imp, coalesce(pinned, false) OR coalesce(immutable, false) AS held, importance FROM cur) SELECT id, round(CASE WHEN held THEN importance ELSE imp END, 5) AS importance FROM s WHERE held OR imp >= 0.05")
def m10_consolidate(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "importance", "updated_at", "pinned", "immutable")
    held = F.coalesce("pinned", F.lit(False)) | F.coalesce("immutable", F.lit(False))
    faded = L.decayed(F.col("importance"), L.days_between(P.stored_time(F.col("updated_at")), now()), 0.001)
    return m.where(held | (faded >= 0.05)).select("id", F.round(F.when(held, F.col("importance")).otherwise(faded), 5).alias("importance"))


@query("m11_expired", f"WITH {_CUR} SELECT id FROM cur WHERE {_TIME.format('expiration_date')} <= TIMESTAMP '{NOW}'")
def m11_expired(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "expiration_date").where(P.stored_time(F.col("expiration_date")) <= now()).select("id")


@query("m16_entity_upsert", "SELECT user_id, lower(name) AS name, min(id) AS id, count(DISTINCT id) AS n FROM entities WHERE name IS NOT NULL GROUP BY 1, 2")
def m16_entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").groupBy("user_id", F.lower("name").alias("name")).agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))


@query("m25_hash_lookup", f"WITH {_CUR} SELECT user_id, hash, count(*) AS n FROM cur WHERE hash = md5(content) GROUP BY 1, 2")
def m25_hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "user_id", "hash", "content").where(F.col("hash") == F.md5("content")).groupBy("user_id", "hash").agg(F.count("*").alias("n"))


# ---- streams


@query("x5_session_state", "SELECT session_id, count(DISTINCT id) AS n, count(DISTINCT id) >= 6 AS compact_needed FROM scenarios WHERE session_id IS NOT NULL GROUP BY 1")
def x5_session_state(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.ingest import session_counts

    return session_counts(table(spark, d, "scenarios").where("session_id is not null").select("session_id", "id").distinct(), "session_id", 6)


@query("x9_cooccurrence", "WITH l AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS name FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS r FROM l), t AS (SELECT id, name FROM r WHERE r <= 5) SELECT x.name AS a, y.name AS b, count(*) AS n FROM t x JOIN t y ON x.id = y.id AND x.name < y.name GROUP BY 1, 2")
def x9_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return G.cooccurrence(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("name")).distinct(), cap=5)


@query("x9_cooccurrence_all", "WITH l AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS name FROM lineitem) SELECT x.name AS a, y.name AS b, count(*) AS n FROM l x JOIN l y ON x.id = y.id AND x.name < y.name GROUP BY 1, 2")
def x9_cooccurrence_all(spark: SparkSession, d: str) -> DataFrame:
    return G.cooccurrence(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("name")).distinct())


@query("x_windowed_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")


@query("x_gap_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM k GROUP BY user_id, k")
def x_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.ingest import gap_sessions

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return gap_sessions(e, "ts", "2 hours", "user_id").select("user_id", F.unix_micros("start").alias("start_us"), "n")


# ---- episodes, context, erasure, more retrieval

_EV = "ev AS (SELECT DISTINCT session_id, id, user_id, role, content, length(content) AS at_ FROM scenarios WHERE session_id IS NOT NULL AND content IS NOT NULL)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Event rows in a stated order that SQL can repeat: by the length of the content, then id."""
    e = table(spark, d, "scenarios").where("session_id is not null and content is not null")
    return e.select("session_id", "id", "user_id", "role", "content", F.char_length("content").cast("bigint").alias("at"))


@query("x6_compact", f"WITH {_EV} SELECT session_id, min(user_id) AS user_id, arg_min(CASE WHEN lower(trim(role)) = 'user' THEN (CASE WHEN length(content) > 60 THEN substr(content, 1, 60) || '...' ELSE content END) END, CASE WHEN lower(trim(role)) = 'user' THEN struct_pack(a := at_, id := id) END) AS title, substr(array_to_string(list_slice(list(content ORDER BY at_, id), 1, 5), chr(10)), 1, 2000) AS summary, count(*) AS n, sum(strlen(content) // 4 + 10) AS tokens, min(at_) AS start_at, max(at_) AS end_at, sum(strlen(content) // 4 + 10) < 200 AS small FROM ev GROUP BY 1")
def x6_compact(spark: SparkSession, d: str) -> DataFrame:
    return E.compacted(_events(spark, d))


@query("x13_session_context", f"WITH {_EV}, o AS (SELECT * FROM ev WHERE session_id = (SELECT min(session_id) FROM ev)), s AS (SELECT *, sum(strlen(content) // 4 + 10) OVER (ORDER BY at_ DESC, id DESC ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT id, role, content, at_ AS \"at\" FROM s WHERE s <= 150")
def x13_session_context(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return E.session_context(e, e.agg(F.min("session_id")).first()[0], 150)


def _timed_events(spark: SparkSession, d: str) -> DataFrame:
    """Event rows with the instant of their timestamp as ``at``, in microseconds; null where it is not one instant."""
    e = table(spark, d, "scenarios").where("kind = 'event' and session_id is not null and content is not null")
    clocked = with_owner_clock(e.select("session_id", "id", "user_id", "role", "content", "timestamp"), table(spark, d, "owners"))
    return with_instant(clocked, "timestamp", "at", F.col("home_zone"), F.col("month_first")).select("session_id", "id", "user_id", "role", "content", "at")


@query("x6_compact_timed")
def x6_compact_timed(spark: SparkSession, d: str) -> DataFrame:
    return E.compacted(written(_timed_events(spark, d)))


@query("x13_session_context_timed")
def x13_session_context_timed(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "scenarios").where("kind = 'event' and content is not null").agg(F.min("session_id")).first()[0]
    return E.session_context(_timed_events(spark, d), first, 150)


@query("w7_chunks", r"WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?。！？])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS ss FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, ss, unnest(range(0, greatest(len(ss) - 2, 0) + 1, 4)) AS a FROM s WHERE len(ss) > 0) SELECT doc_id, a // 4 AS chunk_no, array_to_string(list_slice(ss, a + 1, a + 5), ' ') AS chunk FROM c")
def w7_chunks(spark: SparkSession, d: str) -> DataFrame:
    return E.chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 5, 1).select("doc_id", "chunk_no", "chunk")


@query("j11_episode_priority", "WITH q AS (SELECT session_id, count(DISTINCT id) AS queried_count FROM memories WHERE session_id IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT user_id AS id, session_id FROM scenarios WHERE session_id IS NOT NULL) SELECT id, coalesce(max(queried_count), 0) AS queried FROM e LEFT JOIN q USING (session_id) GROUP BY 1")
def j11_episode_priority(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "memories").where("session_id is not null").groupBy("session_id").agg(F.count_distinct("id").alias("queried_count"))
    links = table(spark, d, "scenarios").where("session_id is not null").select(F.col("user_id").alias("id"), "session_id").distinct()
    return E.most_queried(links, q)


@query("m3_near_duplicates", f"WITH {_CUR}, v AS (SELECT user_id, id, CAST(embedding AS DOUBLE[]) AS e FROM cur WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) SELECT a.user_id, a.id AS a, b.id AS b, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.user_id = b.user_id AND a.id < b.id WHERE 1 - list_cosine_similarity(a.e, b.e) < 0.15")
def m3_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    found = L.near_duplicates(memories(spark, d, "user_id", "embedding"), "user_id", "id", "embedding", 64, 0.15)
    return found.select("user_id", "a", "b", F.abs(F.round("distance", 6)).alias("distance"))


@query("m8_scoped_delete", f"WITH {_CUR} SELECT id, 'DELETE' AS event, content AS old_content FROM cur WHERE user_id = '{USER}' AND agent_id = '{AGENT}' AND NOT coalesce(immutable, false)")
def m8_scoped_delete(spark: SparkSession, d: str) -> DataFrame:
    return E.scoped_delete(memories(spark, d, "user_id", "agent_id", "immutable", "content"), P.in_scope(USER, AGENT))[1]


@query("m13_access", f"WITH {_CUR}, l AS (SELECT superseded_by AS id, count(*) AS reads FROM memories WHERE superseded_by IS NOT NULL GROUP BY 1) SELECT id, access_count + coalesce(reads, 0) AS access_count, round(CASE WHEN reads IS NULL THEN stability ELSE least(365.0, stability * (1 + 0.3 * (1 - {_RET.format(_DAYS)}))) END, 5) AS stability FROM cur LEFT JOIN l USING (id) WHERE stability IS NOT NULL AND access_count IS NOT NULL")
def m13_access(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "access_count", "stability", "resolution", "updated_at").where("stability is not null and access_count is not null")
    log = table(spark, d, "memories").where("superseded_by is not null").select(F.col("superseded_by").alias("id"))
    out = E.accessed(m, log, L.days_between(P.stored_time(F.col("updated_at")), now()))
    return out.select("id", "access_count", F.round("stability", 5).alias("stability"))


@query("m15_erase_user", f"SELECT 'memories' AS table_name, count(*) AS n FROM memories WHERE user_id IS NULL OR user_id <> '{USER}' UNION ALL SELECT 'scenarios', count(*) FROM scenarios WHERE user_id IS NULL OR user_id <> '{USER}' UNION ALL SELECT 'links', count(*) FROM (SELECT DISTINCT id, superseded_by FROM memories WHERE superseded_by IS NOT NULL) l WHERE superseded_by NOT IN (SELECT id FROM memories WHERE user_id = '{USER}')")
def m15_erase_user(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories")
    links = m.where("superseded_by is not null").select(F.col("id").alias("src"), "superseded_by").distinct()
    out = E.erased({"memories": m, "scenarios": table(spark, d, "scenarios"), "links": links}, USER, {"links": ("superseded_by", "memories")})
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in out.items()])


@query("c12_numbers", r"SELECT DISTINCT id, len(n) AS n, round(list_sum(n), 2) AS total FROM (SELECT id, list_filter(list_transform(regexp_extract_all(content, '[0-9][0-9.,]*'), lambda x: TRY_CAST(rtrim(replace(x, ',', ''), '.') AS DOUBLE)), lambda x: x > 0) AS n FROM memories WHERE content IS NOT NULL) WHERE len(n) > 0")
def c12_numbers(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").where("content is not null").select("id", X.numbers(F.col("content")).alias("v")).where("size(v) > 0")
    return m.select("id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("total")).distinct()


@query("c32_lexical_embedding")
def c32_lexical_embedding(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "content").select("id", V.lexical_embedding()(F.col("content")).alias("embedding"))


@query("r6_temporal_channel", f"WITH {_CUR} SELECT id FROM cur WHERE CAST({_TIME.format('created_at')} AS DATE) BETWEEN DATE '2023-03-01' AND DATE '2023-03-31' OR CAST({_TIME.format('created_at')} AS DATE) = DATE '2023-05-17'")
def r6_temporal_channel(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date

    from tidemark.functions.timephrases import time_ranges

    ranges = [(str(a), str(b)) for a, b in time_ranges("what happened in March 2023 and on 2023-05-17", date(2024, 6, 1))]
    return memories(spark, d, "created_at").where(P.day_ranges(P.stored_time(F.col("created_at")), ranges)).select("id")


@query("r16_graph_search", f"WITH RECURSIVE e AS ({_HIERARCHY}), h AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey IN (1, 2)), r AS (SELECT id, 0 AS hops FROM h UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.id WHERE r.hops < 2) SELECT id, min(hops) AS hops FROM r GROUP BY 1")
def r16_graph_search(spark: SparkSession, d: str) -> DataFrame:
    def edges(t: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, d, t).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))

    e = edges("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edges("supplier", "n", "s_nationkey", "s", "s_suppkey")).unionByName(edges("customer", "n", "c_nationkey", "c", "c_custkey"))
    named = G.entity_search(table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("name")), "", F.col("n_nationkey").isin(1, 2))
    return G.neighbourhood(e, named.select(F.concat(F.lit("n"), "name").alias("id")), 2)


@query("r22_episode_search", f"WITH {_EV}, ep AS (SELECT session_id, substr(array_to_string(list_slice(list(content ORDER BY at_, id), 1, 5), chr(10)), 1, 2000) AS summary FROM ev GROUP BY 1), {_bm25_sql('ep', 'session_id', 'summary', ['collar', 'lighthouse'])} SELECT id, round(score, 5) AS score FROM b ORDER BY round(score, 9) DESC, id LIMIT 10")
def r22_episode_search(spark: SparkSession, d: str) -> DataFrame:
    found = R.bm25(E.compacted(_events(spark, d)), "session_id", "summary", ["collar", "lighthouse"])
    return R.top(found.select("id", F.round("score", 9).alias("score")), 10).select("id", F.round("score", 5).alias("score"))


@query("r22_episode_search_timed")
def r22_episode_search_timed(spark: SparkSession, d: str) -> DataFrame:
    found = R.bm25(E.compacted(written(_timed_events(spark, d))), "session_id", "summary", ["collar", "lighthouse"])
    return R.top(found.select("id", F.round("score", 9).alias("score")), 10).select("id", F.round("score", 5).alias("score"))


@query("r24_session_discovery", f"SELECT label, round(min(1 - {_COS}), 6) AS distance FROM embeddings e WHERE vec_id <> 0 GROUP BY 1")
def r24_session_discovery(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id <> 0")
    scored = e.withColumn("s", V.similarity_to(_query_vector(spark, d))("embedding"))
    return scored.groupBy("label").agg(F.round(F.min(1 - F.col("s")), 6).alias("distance"))


@query("r24_session_discovery_all", f"SELECT q.vec_id, e.label, round(min(1 - {_PAIRCOS}), 6) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id GROUP BY 1, 2")
def r24_session_discovery_all(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    return R.best_matches(e.where("id % 100 = 0"), e, 1, "label").select(F.col("query").alias("vec_id"), "label", F.round(1 - F.col("score"), 6).alias("distance"))


@query("a10_channel_confidence", f"WITH {_FUSE}, sc AS (SELECT 'text' AS channel, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM b UNION ALL SELECT 'overlap', score, row_number() OVER (ORDER BY score DESC, id) FROM o WHERE score > 0) SELECT channel, round(avg(score) / (1 + coalesce(stddev_samp(score), 0)), 5) AS confidence FROM sc WHERE rank <= 10 GROUP BY 1")
def a10_channel_confidence(spark: SparkSession, d: str) -> DataFrame:
    return R.channel_confidence(_document_ranks(spark, d, 100), 10).select("channel", F.round("confidence", 5).alias("confidence"))


@query("m2_greedy_dedupe")
def m2_greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "user_id", "embedding", "created_at")
    pairs = L.near_duplicates(m, "user_id", "id", "embedding", 64, 0.35)
    at = m.select("id", "created_at")
    timed = pairs.join(at.select(F.col("id").alias("a"), F.col("created_at").alias("ta")), "a").join(at.select(F.col("id").alias("b"), F.col("created_at").alias("tb")), "b")
    swap = (F.col("ta") > F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") > F.col("b")))
    return L.greedy_duplicates(timed.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")))


@query("r13_graph_augmented", f"WITH {_CUR}, {_bm25_sql('cur', 'id', 'content', ['collar', 'bowl'])}, {_LINKS}, h AS (SELECT id, score FROM b ORDER BY round(score, 9) DESC, id LIMIT 30), f AS (SELECT id FROM h ORDER BY round(score, 9) DESC, id LIMIT 10), x AS (SELECT id, count(DISTINCT name) AS n FROM l WHERE name IN (SELECT name FROM l WHERE id IN (SELECT id FROM f)) AND id NOT IN (SELECT id FROM h) GROUP BY 1 ORDER BY n DESC, id LIMIT 10) SELECT id, round(score, 6) AS score FROM h UNION ALL SELECT id, round((SELECT min(score) FROM h) * n / (1.0 + n), 6) FROM x")
def r13_graph_augmented(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "user_id", "content")
    links = G.linked_memories(m, table(spark, d, "entities"))
    found = R.bm25(m, "id", "content", ["collar", "bowl"]).select("id", F.round("score", 9).alias("score"))
    return R.graph_augmented(R.top(found, 30), links).select("id", F.round("score", 6).alias("score"))

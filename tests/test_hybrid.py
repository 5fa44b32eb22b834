"""Hybrid search over memories and events, and its later stages."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import retrieval as R
from tidemark.plans.memory_queries import AGENT, COLUMNS, USER, now
ROWS = "id string, importance double, stability double, resolution string, session_id string, updated_at string, event_time string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROWS).withColumns({c: F.col(c).cast("timestamp") for c in ("updated_at", "event_time")})


def test_events_come_out_of_the_recall_channels(spark):
    m = spark.createDataFrame([("m1", "blue bowl", "u"), ("m2", "red leash", "u")], "id string, content string, user_id string")
    e = spark.createDataFrame([("e1", "a blue collar PETFACT-000007", "u"), ("e2", "blue collar PETFACT-000007", "v"), ("e3", "nothing", "u")], "id string, content string, user_id string")
    got = R.hybrid_search(m, "blue collar PETFACT-000007", None, F.col("user_id") == "u", 5, events=e).collect()
    assert [r.id for r in got] == ["e1", "m1"] and got[0].score > 1


def test_later_stages(spark):
    hits = spark.createDataFrame([("a", 1.0), ("b", 0.8), ("c", 0.4), ("gone", 9.0)], "id string, score double")
    held = rows(
        spark, ("a", 0.5, 1.0, "granular", "s", "2024-06-01 00:00:00", "2024-03-05 10:00:00"),
        ("b", None, None, "narrative", "s", "2024-05-02 00:00:00", "2024-04-30 23:00:00"), ("c", 1.0, 2.0, "identity", None, None, None),
    )
    score = lambda sim, kept, imp, weight: sim * (0.7 * kept + 0.3 * imp) * weight
    want = {"a": score(1, 1, 0.5, 1), "b": score(0.8, (1 + 30 / 3) ** -0.5, 0.5, 0.65), "c": score(0.4, 1, 1, 0.7)}
    assert {r.id: r.score for r in R.rescored(hits, held, 10, now()).where("id <> 'gone'").collect()} == pytest.approx(want)
    boosted = {r.id: r.score for r in R.rescored(hits, held, 10, now(), ranges=[("2024-04-01", "2024-04-30")]).collect()}
    assert boosted["b"] == pytest.approx(want["b"] / 0.8) and boosted["a"] == pytest.approx(want["a"] / 1.2)
    assert [r.id for r in R.rescored(hits, held, 10, now(), per_session=1).collect()] == ["a", "c"]
    assert [r.id for r in R.rescored(hits, held, 10, now(), least=0.5).collect()] == ["a"]
    assert R.rescored(hits, held, 200, now()).first().score == pytest.approx(0.7 / (1 + 0.15 * 2) + 0.15)


def test_registered_search_reads_events_in_scope(spark, tmp_path):
    kinds = {"importance": "double", "access_count": "bigint", "immutable": "boolean", "categories": "array<string>", "stability": "double", "confidence": "double", "sync_version": "bigint", "pinned": "boolean"}
    schema = ", ".join(["id string", "embedding array<float>", "event_time string"] + [f"{c} {kinds.get(c, 'string')}" for c in COLUMNS])
    given = [{"id": "m1", "content": "blue bowl", "user_id": USER, "agent_id": AGENT, "updated_at": "2024-05-30T00:00:00Z", "resolution": "granular"}, {"id": "m2", "content": "blue collar of Rex", "user_id": USER, "agent_id": "other"}]
    names = [f.split()[0] for f in schema.split(", ")]
    spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], schema).write.parquet(f"{tmp_path}/memories.parquet")
    e = [("e1", "event", USER, None, "s", "a blue collar", "2024-05-31T12:00:00+02:00", None)] * 2 + [("e2", "event", "v", None, "s", "blue collar", None, None), ("x", "memory", USER, None, None, "blue collar", None, None)]
    spark.createDataFrame(e, "id string, kind string, user_id string, agent_id string, session_id string, content string, timestamp string, event_time string").write.parquet(f"{tmp_path}/scenarios.parquet")
    spark.createDataFrame([(USER, "Rex", "pet")], "user_id string, name string, entity_type string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([(USER, "UTC", "en-GB")], "user_id string, home_zone string, locale string").write.parquet(f"{tmp_path}/owners.parquet")
    got = entry.queries()["r21_hybrid_search"](spark, str(tmp_path)).collect()
    assert [r.id for r in got] == ["e1", "m1"]
    assert got[0].score == pytest.approx(0.7 * (1 + 14 / 24 / 5) ** -0.5 + 0.15, abs=1e-8)

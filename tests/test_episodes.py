from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timephrases import asks_for_time, time_ranges
from tidemark.operators import episodes as E
from tidemark.sources.store import Store

ANCHOR = date(2026, 4, 8)


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("what happened yesterday", "2026-04-07", "2026-04-07"), ("昨天发生了什么", "2026-04-07", "2026-04-07"), ("what did I do last week", "2026-04-01", "2026-04-08"), ("上周的事情", "2026-04-01", "2026-04-08"),
        ("tell me about last month", "2026-03-01", "2026-03-31"), ("上个月做了什么", "2026-03-01", "2026-03-31"), ("in march", "2026-03-01", "2026-03-31"), ("in March 2025", "2025-03-01", "2025-03-31"), ("2025 march", "2025-03-01", "2025-03-31"),
        ("on 2026-04-10", "2026-04-10", "2026-04-10"), ("3 days ago", "2026-04-05", "2026-04-05"), ("3天前", "2026-04-05", "2026-04-05"), ("三月的记录", "2026-03-01", "2026-03-31"), ("十一月", "2026-11-01", "2026-11-30"), ("12月", "2026-12-01", "2026-12-31"),
        ("events from last year", "2025-01-01", "2025-12-31"), ("去年的事", "2025-01-01", "2025-12-31"), ("today", "2026-04-08", "2026-04-08"), ("2 weeks ago", "2026-03-25", "2026-04-08"), ("this week", "2026-04-06", "2026-04-12"), ("本月", "2026-04-01", "2026-04-30"), ("2 months ago", "2026-02-01", "2026-02-28"),
    ],
)
def test_time_phrases(text, start, end):
    assert time_ranges(text, ANCHOR) == [(date.fromisoformat(start), date.fromisoformat(end))]


@pytest.mark.parametrize("text", ["tell me about cats", "maybe later", "", "2026-13-45", "9" * 30 + " days ago"])
def test_no_time_phrase(text):
    assert time_ranges(text, ANCHOR) == []


def test_january_and_intent():
    assert time_ranges("last month", date(2026, 1, 5)) == [(date(2025, 12, 1), date(2025, 12, 31))]
    assert asks_for_time("when did we meet", ANCHOR) and asks_for_time("多久了", ANCHOR) and not asks_for_time("tell me about cats", ANCHOR)


EVENTS = "session_id string, id string, user_id string, role string, content string, at bigint"


def test_compaction_and_context(spark):
    rows = [("s", f"e{k}", "u", "user" if k % 2 else "assistant", f"message {k} " + "x" * 60, k) for k in range(8)] + [("s", "e1", "u", "user", "message 1 " + "x" * 60, 1), (None, "z", "u", "user", "x", 1), ("t", "a", "u", "user", None, 1)]
    df = spark.createDataFrame(rows, EVENTS)
    [r] = E.compacted(df, spark.createDataFrame([("e0",)], "id string")).collect()
    assert (r.session_id, r.n, r.start_at, r.end_at, r.small) == ("s", 7, 1, 7, True)  # 7 * 27 tokens
    assert r.title.startswith("message 1") and r.title.endswith("...") and r.summary.count("\n") == 4
    got = [x.id for x in E.session_context(df, "s", 60).collect()]
    assert got == ["e6", "e7"]


def test_chunks_overlap(spark):
    df = spark.createDataFrame([(1, "A. B! C? D. E."), (2, ""), (3, None)], "id int, t string")
    assert [(r.chunk_no, r.chunk) for r in E.chunks(df, "t", 3, 1).orderBy("chunk_no").collect()] == [(0, "A. B! C?"), (1, "C? D. E.")]


def test_priorities_accesses_and_reranking(spark):
    ep = spark.createDataFrame([("a", ["s1", "s2"], 0.1), ("b", ["s3"], 0.9), ("c", [], None)], "id string, session_ids array<string>, significance double")
    q = spark.createDataFrame([("s1", 2), ("s2", 7)], "session_id string, queried_count int")
    assert [(r.id, r.queried) for r in E.priorities(ep, q).collect()] == [("a", 7), ("b", 0), ("c", 0)]
    m = spark.createDataFrame([("x", 1.0, "granular", None), ("y", 1.0, "granular", 4)], "id string, stability double, resolution string, access_count int")
    got = {r.id: r for r in E.accessed(m, spark.createDataFrame([("x",), ("x",), ("gone",)], "id string"), F.lit(30.0)).collect()}
    assert got["x"].access_count == 2 and got["x"].stability > 1 and (got["y"].access_count, got["y"].stability) == (4, 1.0)
    hits = spark.createDataFrame([("p", 0.1, "aa"), ("q", 0.9, "a"), ("r", 0.5, None)], "id string, score double, content string")
    assert [r.id for r in E.reranked(hits, "a", None, 2).collect()] == ["q", "r"]
    assert [r.id for r in E.reranked(hits, "a", lambda q, t: F.length(t), 3).collect()] == ["p", "q", "r"]


def test_deletes_and_erasure(spark):
    m = spark.createDataFrame([("a", "u", True, "x"), ("b", "u", False, "y"), ("c", "v", None, "z")], "id string, user_id string, immutable boolean, content string")
    kept, history = E.scoped_delete(m, F.col("user_id") == "u")
    assert sorted(r.id for r in kept.collect()) == ["a", "c"] and [r.id for r in history.collect()] == ["b"]
    assert sorted(r.id for r in E.scoped_delete(m, F.col("user_id") == "u", force=True)[0].collect()) == ["c"]
    links = spark.createDataFrame([("a", "e"), ("c", "e")], "memory_id string, entity_id string")
    out = E.erased({"m": m, "links": links}, "u", {"links": ("memory_id", "m")})
    assert [r.id for r in out["m"].collect()] == ["c"] and [r.memory_id for r in out["links"].collect()] == ["c"]


def test_answers(spark):
    rows = [(1, '["a", "b"]'), (2, '```json\n{"facts": [{"text": "c"}, {"fact": "d", "event": "update"}, {"text": "e", "op": "zap"}]}\n```'), (3, "no json"), (4, None), (5, '{"memory": [{"content": "f", "event": "NONE",}]}')]
    got = sorted((r.id, r.fact, r.op) for r in E.facts_from_answers(spark.createDataFrame(rows, "id int, a string"), "a").collect())
    assert got == [(1, "a", "ADD"), (1, "b", "ADD"), (2, "c", "ADD"), (2, "d", "UPDATE"), (5, "f", "NONE")]


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.commit({"m": spark.createDataFrame([("a",)], "id string"), "n": spark.range(3)})
    s.backup("one")
    s.commit({"m": s.table("m").unionByName(spark.createDataFrame([("b",)], "id string"))})
    assert s.stats() == {"m": 2, "n": 3}
    s.restore("one")
    assert s.stats() == {"m": 1, "n": 3}
    with pytest.raises(ValueError):
        s.restore("none")

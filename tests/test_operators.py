import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import analytics as A
from tidemark.operators import filters as P
from tidemark.operators import graph as G
from tidemark.operators import lifecycle as L
from tidemark.operators import retrieval as R
from tidemark.sources import exports as S


def value(spark, column, **fields):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in fields.items()) or "x int"
    df = spark.createDataFrame([tuple(v for _, v in fields.values()) or (1,)], schema)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [("Hello, World! How are you?", ["hello", "world", "how", "are", "you"]), ("don't stop! it's ok.", ["don", "t", "stop", "it", "s", "ok"]), ("", []), ("...", [])],
)
def test_tokens(spark, text, want):
    assert value(spark, X.tokens(F.col("t")), t=("string", text)) == want


def test_cjk_tokens(spark):
    assert value(spark, X.auto_tokens(F.col("t")), t=("string", "我喜欢coffee")) == ["我", "喜", "欢", "coffee"]
    assert value(spark, X.auto_tokens(F.col("t")), t=("string", None)) is None


def test_overlap_is_by_substring(spark):
    score = X.overlap_score(F.col("t"), ["coffee", "shop", "tokyo"])
    assert value(spark, score, t=("string", "I went to a coffee shop")) == pytest.approx(2 / 3)
    assert value(spark, X.overlap_score(F.col("t"), ["not"]), t=("string", "nothing")) == 1.0
    assert value(spark, X.overlap_score(F.col("t"), []), t=("string", "x")) == 0.0


@pytest.mark.parametrize("text, want", [("moved on 2023-05-07", "2023-05-07"), ("in 2020-03", "2020-03"), ("since 2019", "2019"), ("12020 days", None), (None, None)])
def test_first_date(spark, text, want):
    assert value(spark, X.first_date(F.col("t")), t=("string", text)) == want


def test_small_text_functions(spark):
    t = lambda s: {"t": ("string", s)}
    assert value(spark, X.identifiers(F.col("t")), **t("(PETFACT-001531), abc1 x1 PETFACT-001531")) == ["PETFACT-001531", "abc1"]
    assert value(spark, X.token_estimate(F.col("t")), **t("abcdefgh")) == 12
    assert value(spark, X.numbers(F.col("t")), **t("$400,000 and 37 coins. 7.5, 0")) == [400000.0, 37.0, 7.5]
    assert value(spark, X.chinese_numbers(F.col("t")), **t("三百二十五块和十二个")) == [325.0, 12.0]
    assert value(spark, X.partial_date(F.col("t")), **t("2023-05")) == "2023-05-01"
    assert value(spark, X.date_prefix(F.col("t")), **t("[Date: 2023-05-01] x")) == "2023-05-01"
    assert value(spark, X.preview(F.col("t"), 3), **t("abcdef")) == "abc..."
    assert json.loads(value(spark, X.repaired_json(F.col("t")), **t("<think>no</think>```json\n{\"a\": True, \"b\": [1, 2,],}\n```"))) == {"a": True, "b": [1, 2]}
    assert value(spark, X.content_hash(F.col("t")), **t("a")) == "af63dc4c8601ec8c"
    assert value(spark, X.candidate_entities(F.col("t")), **t('We met Anna Smith and "blue box".')) == ["blue box", "Anna Smith"]


@pytest.mark.parametrize(
    "old, new, newer, want",
    [
        ("I like tea", "I don't like tea", True, 0.45),
        ("I love cats", "I hate cats", False, 0.20),
        ("uses vim", "switched to emacs", True, 0.35),
        ("has 37 coins", "has 38 coins", False, 0.15),
        ("我喜欢茶", "我讨厌茶，改成咖啡", True, 0.55),
        ("same", "same", False, 0.0),
    ],
)
def test_contradiction(spark, old, new, newer, want):
    got = value(spark, X.contradiction_score(F.col("a"), F.col("b"), F.col("c")), a=("string", old), b=("string", new), c=("boolean", newer))
    assert got == pytest.approx(want)


def test_vectors(spark):
    pair = {"a": ("array<float>", [1.0, 0.0]), "b": ("array<float>", [0.0, 2.0])}
    assert value(spark, V.cosine_distance(F.col("a"), F.col("b")), **pair) == pytest.approx(1)
    assert value(spark, V.cosine_distance(F.col("a"), F.col("a")), **pair) == pytest.approx(0)
    assert value(spark, V.cosine_similarity(F.col("a"), F.col("b")), a=("array<float>", [0.0, 0.0]), b=("array<float>", [1.0, 0.0])) == 0
    assert value(spark, V.cosine_similarity(F.col("a"), F.col("b")), a=("array<float>", [1.0]), b=("array<float>", [1.0, 0.0])) == 0
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(V.similarity_to([2.0, 0.0])("v")).collect()] == [1.0, 0.0, 0.0, None]
    e = value(spark, V.lexical_embedding()(F.col("t")), t=("string", "Blue collar"))
    assert len(e) == 256 and math.isclose(sum(x * x for x in e), 1, rel_tol=1e-5)


MEMORY = "id string, content string, user_id string, agent_id string, app_id string, run_id string, categories array<string>, metadata string, importance double, superseded_by string, expiration_date string, valid_until string"


def memory(id_, content="x", user="u", agent=None, categories=None, metadata=None, importance=0.5, superseded=None, expires=None, until=None):
    return (id_, content, user, agent, None, None, categories, metadata, importance, superseded, expires, until)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_filters(spark):
    df = spark.createDataFrame(
        [memory("a", "Blue 100%", agent="p", categories=["Food"], metadata='{"n": 3, "s": "x"}'), memory("b", "blue 100x", categories=["play"], metadata='{"n": "3"}', importance=0.9), memory("c", None, metadata="broken")],
        MEMORY,
    )
    f = lambda name, op, v: P.compiled({"field": name, "op": op, "value": v})
    assert ids(df.where(P.compiled({"and": []}))) == ["a", "b", "c"] and ids(df.where(P.compiled({"or": []}))) == []
    assert ids(df.where(f("content", "contains", "blue"))) == ["b"]
    assert ids(df.where(f("content", "icontains", "BLUE 100%"))) == ["a"]
    assert ids(df.where(f("categories", "contains", "Food"))) == ["a"]
    assert ids(df.where(f("categories", "icontains", "foo"))) == ["a"]
    assert ids(df.where(f("n", "gte", 3))) == ["a", "b"]
    assert ids(df.where(f("s", "ne", "y"))) == ["a"]
    assert ids(df.where(f("bad-name", "eq", "y"))) == []
    assert ids(df.where(f("importance", "in", [0.9]))) == ["b"] and ids(df.where(f("importance", "in", []))) == []
    with pytest.raises(ValueError):
        f("content", "like", "x")
    assert ids(df.where(P.in_scope("u", "p"))) == ["a"] and ids(df.where(P.in_scope("u", "p", merged=True))) == ["a", "b", "c"]


def test_active_rows(spark):
    rows = [memory("a"), memory("b", superseded="a"), memory("c", expires="2024-01-01"), memory("d", until="2024-07-01T00:00:00Z"), memory("e", until="2024-06-01 01:00:00+05:00")]
    assert ids(spark.createDataFrame(rows, MEMORY).where(P.active(F.lit("2024-06-01 00:00:00").cast("timestamp")))) == ["a", "d"]


def test_rrf_values(spark):
    ranks = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "b", 1), ("y", "a", 2)], "channel string, id string, rank int")
    one = {r.id: r.score for r in R.rrf(ranks.where("channel = 'x'"), {"x": 1.0}, 60).collect()}
    assert one == pytest.approx({"a": 1 / 61, "b": 1 / 62})
    both = {r.id: r.score for r in R.rrf(ranks, {"x": 0.7, "y": 0.3}, 60).collect()}
    assert both == pytest.approx({"a": 0.7 / 61 + 0.3 / 62, "b": 0.7 / 62 + 0.3 / 61})
    assert {r.id: r.score for r in R.combmax(ranks, {"x": 0.7, "y": 0.3}).collect()} == pytest.approx({"a": 0.7, "b": 0.35})


def test_bm25_prefers_rare_terms_and_short_texts(spark):
    docs = spark.createDataFrame([(1, "fox dog"), (2, "dog dog dog cat"), (3, "dog fox " + "x " * 50), (4, None), (5, "")], "id int, t string")
    got = [r.id for r in R.top(R.bm25(docs, "id", "t", ["fox", "dog"]), 10).collect()]
    assert got[0] == 1 and set(got) == {1, 2, 3}
    assert R.bm25(docs, "id", "t", ["none"]).count() == 0 and R.bm25(docs, "id", "t", []).count() == 0


def test_hybrid_search_puts_identifiers_first_and_keeps_the_scope(spark):
    rows = [(f"m{k:03}", f"fact PETFACT-{k:06} shared memory", "u" if k % 2 else "v", [1.0, float(k)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, content string, user_id string, embedding array<float>")
    got = R.hybrid_search(df, "PETFACT-000031 shared memory", [1.0, 3.0], F.col("user_id") == "u", 5).collect()
    assert got[0].id == "m031" and got[0].score > 1
    assert all(int(r.id[1:]) % 2 for r in got) and len(got) == 5


def test_session_cap(spark):
    df = spark.createDataFrame([("a", "s", 3.0), ("b", "s", 2.0), ("c", None, 1.0), ("d", None, 1.0)], "id string, session_id string, score double")
    assert ids(R.session_cap(df, 1)) == ["a", "c", "d"] and ids(R.session_cap(df, 0)) == ["a", "b", "c", "d"]


def test_graph(spark):
    edges = spark.createDataFrame([("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r9", "r1"), ("x", "x")], "src string, dst string")
    start = spark.createDataFrame([("r1",)], "id string")
    assert {r.id: r.hops for r in G.neighbourhood(edges, start, 5).collect()} == {"r1": 0, "r2": 1, "r3": 2}
    assert {r.id: r.hops for r in G.neighbourhood(edges, start, 1, undirected=True).collect()} == {"r1": 0, "r2": 1, "r3": 1, "r9": 1}
    nodes = spark.createDataFrame([("r1",), ("x",), ("lone",)], "id string")
    assert {r.id: r.degree for r in G.degrees(nodes, edges).collect()} == {"r1": 3, "x": 1, "lone": 0}
    mem = spark.createDataFrame([("m1", "u", "I want to start painting"), ("m2", "u", "ART and AI (art)"), ("m3", "v", "art")], "id string, user_id string, content string")
    names = spark.createDataFrame([("u", "art"), ("u", "AI"), ("u", None)], "user_id string, name string")
    links = G.linked_memories(mem, names)
    assert sorted((r.id, r.name) for r in links.collect()) == [("m2", "AI"), ("m2", "art")]
    assert [tuple(r) for r in G.cooccurrence(links).collect()] == [("AI", "art", 1)]


def test_forgetting(spark):
    col = lambda c, **f: value(spark, c, **f)
    days, s, r = ("double", 50.0), ("double", 1.0), ("string", "granular")
    assert col(L.retention(F.col("d"), F.col("s"), F.col("r")), d=days, s=s, r=r) == pytest.approx((1 + 50 / 5) ** -0.5)
    assert col(L.retention(F.col("d"), F.col("s")), d=("double", 0.0), s=("double", 0.0)) == 1
    assert col(L.interference(F.lit(49))) == 1 and col(L.interference(F.lit(10**9))) == pytest.approx(0.70)
    assert col(L.reinforced(F.lit(400.0), F.lit(0.5))) == 365
    assert col(L.decayed(F.lit(0.2), F.lit(30.0), 0.01)) == 0


def test_merges(spark):
    base = spark.createDataFrame([("a", 1, "old", False), ("b", 1, "old", True), ("c", 5, "old", None)], "id string, v int, t string, imm boolean")
    new = spark.createDataFrame([("a", 2, "new", False), ("a", 3, "newer", False), ("b", 2, "new", False), ("c", 4, "late", None), ("d", 1, "add", None)], base.schema)
    got = {r.id: r.t for r in L.merged(base, new, "id", "v", F.col("imm")).collect()}
    assert got == {"a": "newer", "b": "old", "c": "old", "d": "add"}
    assert ids(L.deleted(base, spark.createDataFrame([("a",), ("b",), ("a",)], "id string"), "id", F.col("imm"))) == ["b", "c"]


def test_budget_suffix_cuts_at_the_first_overflow(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 2, 50), ("k", 3, 10), ("k", 4, 10)], "key string, t int, n int")
    assert [r.t for r in L.budget_suffix(df, "key", [F.desc("t")], F.col("n"), 30).orderBy("t").collect()] == [3, 4]


def test_frequency_rejects_other_granularities(spark):
    with pytest.raises(ValueError):
        A.frequency(spark.range(1), "id", "hour")


def test_chat_exports(spark, tmp_path):
    node = lambda i, p, c, t, role, text: (i, {"parent": p, "children": c, "message": {"author": {"role": role}, "create_time": t, "content": {"parts": [text]}}})
    tree = {"id": "t", "mapping": dict([("r", {"parent": None, "children": ["a"], "message": None}), node("a", "r", ["b", "c"], 10, "user", "hi"), node("b", "a", [], 30, "assistant", "late"), node("c", "a", [], 20, "assistant", "early")])}
    (tmp_path / "t.json").write_text(json.dumps([tree, {"uuid": "f", "chat_messages": [{"sender": "human", "text": "yo", "created_at": "2024-01-01T00:00:00Z"}, {"sender": "assistant", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}, {"sender": "human", "text": " "}]}]))
    (tmp_path / "bad.json").write_text("{not json")
    got = [(r.conversation, r.role, r.content) for r in S.read_exports(spark, str(tmp_path)).collect()]
    assert got == [("t", "user", "hi"), ("t", "assistant", "early"), ("t", "assistant", "late"), ("f", "user", "yo"), ("f", "assistant", "a\nb")]


def test_change_feed(spark):
    m = spark.createDataFrame([("a", 1), ("b", 7)], "id string, sync_version bigint")
    h = spark.createDataFrame([("c", "ADD", 2), ("c", "DELETE", 8), ("b", "DELETE", 3), ("d", "DELETE", 1), ("e", "DELETE", 8), ("e", "ADD", 9)], "id string, event string, version bigint")
    assert sorted(tuple(r) for r in S.change_feed(m, h, 5).collect()) == [("b", "UPSERT", 7), ("c", "DELETE", 8)]


def test_broken_references(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "9"), ("3", None)], "id string, ref string")
    assert [tuple(r) for r in S.broken_references({"a": a}, [("a", "ref", "a", "id")]).orderBy("id").collect()] == [("a.ref", "9"), ("a.ref", "x")]


def test_near_duplicates_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        v = rng.normal(size=4)
        rows += [("hot" if k % 3 else f"u{k % 9}", f"m{k:03}", [float(x) for x in v])]
    rows += [("hot", "null", None), ("hot", "zero", [0.0] * 4), ("hot", "nan", [float("nan")] * 4), ("hot", "short", [1.0]), (None, "lost", [1.0] * 4)]
    df = spark.createDataFrame(rows, "user string, id string, v array<float>")
    good = [(u, i, np.array(v, np.float32).astype(float)) for u, i, v in rows[:300]]
    want = set()
    for x in range(300):
        for y in range(x + 1, 300):
            (u, i, a), (w, j, b) = good[x], good[y]
            if u == w and 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b) < 0.05:
                want.add((u, i, j))
    for block in (2000, 25):
        got = [(r.user, r.a, r.b) for r in L.near_duplicates(df, "user", "id", "v", 4, 0.05, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert L.near_duplicates(df.where("false"), "user", "id", "v", 4, 0.05).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_greedy_duplicates_match_one_by_one(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a < b}
    kept, fallen = set(), {}
    for b in range(60):
        earlier = sorted(a for a, x in pairs if x == b and a in kept)
        if earlier:
            fallen[b] = earlier[0]
        else:
            kept.add(b)
    got = {}
    for r in L.greedy_duplicates(spark.createDataFrame(sorted(pairs), "a int, b int")).collect():
        got[r.id] = min(r.kept, got.get(r.id, r.kept))
    assert set(got) == set(fallen) and all(k in kept for k in got.values())
    assert L.greedy_duplicates(spark.createDataFrame([], "a int, b int")).count() == 0


def test_graph_augmentation_adds_below_the_hits(spark):
    hits = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "id string, score double")
    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "x"), ("c", "y"), ("d", "x"), ("b", "x"), ("e", "z")], "id string, name string")
    got = {r.id: r.score for r in R.graph_augmented(hits, links).collect()}
    assert set(got) == {"a", "b", "c", "d"} and 0.5 > got["c"] > got["d"] > 0

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import filters as P
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.operators import search_index as N
from tidemark.operators import state as S
from tidemark.operators import writes as W
from tidemark.sources import exports as E


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_sessions_belong_to_their_first_user(spark):
    schema = "session_id string, user_id string, started_at int"
    have = spark.createDataFrame([("s1", "u1", 1)], schema)
    asked = spark.createDataFrame([("s1", "u2", 0), ("s1", "u1", 9), ("s2", "u2", 5), ("s2", "u3", 4), ("s2", "u3", 4)], schema)
    opened, refused = S.sessions_opened(have, asked)
    assert rows(opened) == [("s1", "u1", 1), ("s2", "u3", 4)]
    assert rows(refused, "session_id", "user_id") == [("s1", "u2"), ("s2", "u2")]


def test_notes_are_cut_and_cleared(spark):
    s = spark.createDataFrame([("a", None), ("b", "x")], "session_id string, structured_notes string")
    notes = spark.createDataFrame([("a", 2, "zwei"), ("a", 1, "eins "), ("a", 3, "y" * 3000), ("a", 4, "never"), ("b", 1, "")], "session_id string, at int, note string")
    got = dict(rows(S.notes_appended(s, notes)))
    assert got["a"] == ("eins zwei" + "y" * 3000)[:2000] and got["b"] == "x"
    assert dict(rows(S.notes_cleared(s, spark.createDataFrame([("b",)], "session_id string"))))["b"] is None


def test_listings_logs_and_tags(spark):
    t = spark.createDataFrame([("a", "u", None), ("b", "u", 0.5), ("c", "v", 0.9)], "id string, user_id string, confidence double")
    assert [r.id for r in S.listed(t, "traits").collect()] == ["c", "b", "a"]
    assert [r.id for r in S.listed(t, "traits", "u", 1, 1).collect()] == ["a"]
    log = spark.createDataFrame([("k", 1, "x"), ("k", 2, "a"), (None, 3, "z")], "key string, at int, v string")
    assert rows(S.latest(log, "key", "at")) == [("k", 2, "a")]
    m = spark.createDataFrame([("a", "s0"), ("b", None)], "id string, session_id string")
    tags = spark.createDataFrame([("a", None, "e1"), ("b", "s9", None)], "id string, session_id string, episode_id string")
    assert rows(S.tagged(m, tags), "id", "session_id", "episode_id") == [("a", "s0", "e1"), ("b", "s9", None)]
    arrays = spark.createDataFrame([("a", ["1"]), ("b", None)], "k string, ids array<string>")
    assert rows(S.ids_appended(arrays, "k", "ids", spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3")], "k string, id string"))) == [("a", ["1", "2"]), ("b", ["3"])]
    assert rows(S.fetched(m, ["b", "none", "a", "b"]), "pos", "id") == [(1, "b"), (3, "a"), (4, "b")]


def test_full_import_skips_known_rows_and_names_faults(spark):
    users = spark.createDataFrame([("u1", "x")], "user_id string, name string")
    facts = spark.createDataFrame([("f1", "u1", 1.5), ("f2", "u2", None)], "id string, user_id string, score double")
    keys = {"users": "user_id", "facts": "id"}
    sent = E.full_export({"users": users, "facts": facts}, keys)
    bad = spark.createDataFrame([("facts", "f9", "no json"), ("facts", "f8", '{"id": null}'), ("pets", "p", "{}"), ("facts", "f7", '{"id": "f7", "user_id": "u1", "score": 1}'), ("facts", "f7", '{"id": "f7", "user_id": "u1", "score": 2}')], "layer string, id string, body string")
    into = {"users": users.where("false"), "facts": facts.where("id = 'f1'")}
    got, faults = E.full_import(sent.unionByName(bad), into, keys, [("facts", "user_id", "users", "user_id")])
    assert rows(got["users"]) == [("u1", "x")] and rows(got["facts"]) == [("f1", "u1", 1.5)]
    assert rows(faults) == [("facts repeated", "f7"), ("facts unreadable", "f8"), ("facts unreadable", "f9"), ("facts.user_id", "f2"), ("layer pets", "p")]
    assert E.full_export({"facts": facts}, keys, "u2").count() == 1


def test_events_with_faults(spark):
    df = spark.createDataFrame(
        [("ok", "user", "x", ["a b", "c_d"]), ("ok", "user", "x", ["a b", "c_d"]), ("", "user", "x", None), ("y" * 257, "bot", "x", None), ("r", "narrator", "x", None), ("e", "user", "　", None), ("c", "user", "x", ["a;b"]), ("d", "user", "x", None), ("d", "user", "y", None), (None, "user", "x", None)],
        "id string, role string, content string, categories array<string>",
    )
    got = {(r.id or "")[:3]: r.fault for r in P.event_faults(df).collect() if r.id}
    assert got == {"yyy": "id length", "r": "unknown role", "e": "empty content", "c": "category", "d": "conflicting rows"}


def test_masks_queries_and_thresholds(spark):
    df = spark.createDataFrame([("1", "u", "granular", "text", "2024", 0.5, "x")], "id string, user_id string, resolution string, content string, created_at string, importance double, junk string")
    assert tuple(P.masked_fields(df, ["importance"]).first()) == ("1", "u", "granular", "", "", 0.5, None)
    q = spark.createDataFrame([('birthday OR "pea nut" \x01x\x01',), ("",), (None,)], "q string")
    assert [r[0] for r in q.select(P.text_query(F.col("q"))).collect()] == ['"birthday" OR """pea" OR "nut""" OR "x"', "", None]
    v = spark.createDataFrame([(0.5,), (float("nan"),), (float("inf"),), (None,), (0.4,)], "v double")
    assert [r.v for r in v.where(P.at_least(F.col("v"), 0.5)).collect()] == [0.5]
    with pytest.raises(ValueError):
        P.at_least(F.col("v"), float("nan"))
    hits = spark.createDataFrame([("a", 0.2), ("b", 0.6)], "id string, score double")
    assert rows(R.over_threshold(hits, 0.5), "id") == [("b",)] and rows(R.over_threshold(hits, 0.5, distance=True), "id") == [("a",)] and R.over_threshold(hits, None).count() == 2


def test_a_single_channel_of_episodes_passes_through(spark):
    one = spark.createDataFrame([("text", "a", 1, 7.0), ("text", "b", 2, 3.0)], "channel string, id string, rank int, score double")
    assert rows(R.fused_episodes(one, {"text": 0.4})) == [("a", 7.0), ("b", 3.0)]
    two = one.unionByName(spark.createDataFrame([("vector", "a", 1, 0.5)], one.schema))
    assert rows(R.fused_episodes(two, {"text": 0.4, "vector": 0.3}))[0] == ("a", 0.4 / 61 + 0.3 / 61)


def test_links_of_a_hot_user_and_odd_names(spark):
    m = spark.createDataFrame([(f"m{k}", "u", f"today Anna-Lena {k} met C++ and O'Hara", "x") for k in range(50)] + [("n", "v", "Anna-Lena", "x"), ("o", "u", None, "x")], "id string, user_id string, content string, name string")
    names = spark.createDataFrame([("u", "anna-lena"), ("u", "Anna"), ("u", "o'hara"), ("u", "Lena 7"), ("u", "+"), ("u", None), ("v", "Hara")], "user_id string, name string")
    got = rows(G.linked_memories(m, names))
    assert len(got) == 151 and {n for _, n in got} == {"anna-lena", "Anna", "o'hara", "Lena 7"} and ("m7", "Lena 7") in got


def test_incident_edges_and_mentions(spark):
    e = spark.createDataFrame([("a", "b", "k"), ("b", "b", "loop"), ("c", "d", "k")], "source string, target string, kind string")
    assert rows(G.incident(e, spark.createDataFrame([("b",)], "id string"))) == [("b", "a", "k"), ("b", "b", "loop")]
    r = spark.createDataFrame([("1", "u", "The Blue Bowl", None), ("2", "u", "x", "bo"), ("3", "v", "bowl", "")], "id string, user_id string, title string, summary string")
    names = spark.createDataFrame([("u", "BOWL"), ("u", "bo"), ("u", "")], "user_id string, name string")
    assert rows(G.mentioning(r, names, "title", "summary"), "id") == [("1",), ("2",)]


def test_stored_indexes_follow_changes(spark):
    index = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "id string, vector array<float>")
    changed = spark.createDataFrame([("b", [9.0]), ("d", [4.0])], index.schema)
    assert rows(N.index_changed(index, changed, spark.createDataFrame([("c",), ("d",)], "id string"))) == [("a", [1.0]), ("b", [9.0])]
    docs = spark.createDataFrame([("a", "red bowl"), ("b", None), ("c", "red red leash")], "id string, text string")
    q = spark.createDataFrame([(1, "red"), (2, "nothing"), (3, None)], "query int, text string")
    got = N.bm25_batch(N.text_index(docs, "id", "text"), q, 5)
    want = {r.id: r.score for r in R.bm25(docs, "id", "text", ["red"]).collect()}
    assert {(r["query"], r.id) for r in got.collect()} == {(1, "a"), (1, "c")} and all(abs(want[r.id] - r.score) < 1e-9 for r in got.collect())
    empty = N.text_index(docs.where("false"), "id", "text")
    assert N.bm25_batch(empty, q, 5).count() == 0


def test_batched_search_minds_scopes(spark):
    schema = "id string, content string, user_id string, agent_id string"
    data = spark.createDataFrame([("1", "blue bowl", "u", "p"), ("2", "blue bowl", "u", "q"), ("3", "blue bowl", "v", None), ("4", "a PETFACT-000007 note", "u", None), ("5", None, "u", None)], schema)
    asked = spark.createDataFrame([(1, "blue bowl", "u", "p"), (2, "PETFACT-000007 blue", "u", None), (3, "", "u", None), (4, None, "u", None)], "query int, text string, user_id string, agent_id string")
    got = {}
    for r in N.search_batch(asked, data).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r.id
    assert got == {1: {1: "1"}, 2: {1: "4", 2: "1", 3: "2"}}


def test_json_is_mended_outside_of_strings_only(spark):
    import json

    cases = {
        "<think>{no}</think>{'a': True, 'b': [1, 2,],}": {"a": True, "b": [1, 2]},
        '{"said": "True, None and a comma,]", "x": None}': {"said": "True, None and a comma,]", "x": None},
        "Here: ```json\n[\"it's\", 'don\\'t',]\n``` bye": ["it's", "don't"],
        '```{"a": False}```': {"a": False},
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.j for r in df.select("t", X.repaired_json(F.col("t")).alias("j")).collect()}
    assert {k: json.loads(got[k]) for k in cases} == cases and got[None] is None


def test_counters_and_rows_of_hits(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "id string, v string")
    b = spark.createDataFrame([("1", "x"), ("2", "z"), ("4", "n")], "id string, v string")
    assert tuple(S.counters(a, b, "id", ["v"]).first()) == (1, 1, 1, 1)
    assert tuple(S.counters(a.where("false"), b.where("false"), "id", ["v"]).first()) == (0, 0, 0, 0)
    hits = spark.createDataFrame([("1", 0.1), ("1", 0.7), ("9", 1.0)], "id string, score double")
    assert rows(N.rows_of_hits(hits, a), "id", "score", "v") == [("1", 0.7, "x")]
    assert rows(W.linked(spark.createDataFrame([("1", "A"), ("1", "a"), (None, "b")], "id string, name string"), spark.createDataFrame([("1", "a"), ("2", "B")], "id string, name string"))) == [("1", "a"), ("2", "b")]

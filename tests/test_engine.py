import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions import models as M


def Words():  # noqa: N802
    class Words:
        """Vectors by words, for tests."""

        dimensions, name = 32, "words"

        def embed(self, texts):
            out = np.zeros((len(texts), 32), np.float32)
            for k, t in enumerate(texts):
                for w in t.lower().split():
                    out[k, sum(w.encode()) % 32] += 1
            return out.tolist()

    return Words()


def Told():  # noqa: N802
    class Told:
        """A model that answers by what it is asked for."""

        def answer(self, prompts, temperature):
            def one(p):
                if p.startswith("List the facts"):
                    return 'Well: ```json\n{"facts": ["Momo sleeps in the attic",]}\n```'
                if p.startswith("List the relations"):
                    return '[{"subject": "Momo", "predicate": "owns", "object": "Bowl"}]' if temperature > 0 else "no idea"
                if p.startswith("What follows"):
                    return '{"principles": ["Momo is calm", " "]}'
                return '{"summary": "a short one"}'

            return [one(p) for p in prompts]

    return Told()


def facts(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq bigint, id string, user_id string, content string")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, "file://" + str(tmp_path / "store"), Words())
    e.now = "2024-06-01 00:00:00"
    return e


def test_facts_from_add_to_erasure(spark, engine, tmp_path):
    engine.add(facts(spark, [("a", "u1", "Momo likes the blue bowl"), ("b", "u1", "PETFACT-001531 shared memory"), ("c", "u2", "Momo likes the blue bowl"), ("d", "u1", "Momo likes the blue bowl"), ("e", "u1", " ")]))
    assert sorted((r.id, r.event) for r in engine.store.table("history").collect()) == [("a", "ADD"), ("a", "UPDATE"), ("b", "ADD"), ("c", "ADD")]
    assert [r.id for r in engine.search("PETFACT-001531", "u1", k=2).collect()][0] == "b"
    assert {r.id for r in engine.search("blue bowl", "u1").collect()} == {"a", "b"}
    assert [r.id for r in engine.search("blue bowl", "u1", filter={"field": "content", "op": "contains", "value": "blue"}).collect()] == ["a"]
    ids = spark.createDataFrame([("a",), ("nothing",)], "id string")
    assert [r.id for r in engine.get(ids).collect()] == ["a"]
    assert {r.id: r.access_count for r in engine.list("u1").collect()}["a"] == 1
    engine.update(spark.createDataFrame([("a", 0.9, True)], "id string, importance double, immutable boolean"), ["importance", "immutable"])
    assert engine.list("u1", filter={"field": "importance", "op": "gte", "value": 0.8}).first().id == "a"
    engine.update(spark.createDataFrame([("a", 0.1)], "id string, importance double"), ["importance"])  # immutable by now
    assert engine.list("u1", filter={"field": "id", "op": "eq", "value": "a"}).first().importance == 0.9
    assert [r.id for r in engine.delete(F.col("user_id") == "u1").collect()] == ["b"]
    assert [r.event for r in engine.history(spark.createDataFrame([("b",)], "id string")).collect()] == ["ADD", "DELETE"]
    engine.erase("u1")
    assert [r.id for r in engine.memories().collect()] == ["c"] and engine.store.table("history").where("user_id = 'u1'").count() == 0
    stats = {r.table_name: (r.rows, r.bytes > 0, r.dimensions) for r in engine.stats().collect()}
    assert stats["memories"] == (1, True, 32)
    with pytest.raises(ValueError):
        Engine(spark, engine.store.root, M.MockEmbedder(16))
    again = Engine(spark, engine.store.root, Words())
    assert [r.id for r in again.memories().collect()] == ["c"]


def test_only_touched_parts_are_written_again(spark, engine):
    engine.add(facts(spark, [("a", "u1", "one thing"), ("b", "u2", "another matter")]))
    before = engine.store._read("manifest")["memories"]["parts"]
    engine.add(facts(spark, [("c", "u1", "quite different words here")]))
    after = engine.store._read("manifest")["memories"]["parts"]
    assert sum(before[p] == after[p] for p in before) == 1 and len(after) == 2


def test_events_become_episodes_and_facts(spark, engine):
    schema = "id string, session_id string, user_id string, role string, content string, at bigint"
    rows = [(f"e{k}", f"s{k // 4}", f"u{k // 4}", ["user", "assistant"][k % 2], f"message {k}", k) for k in range(8)]
    assert {r.kind for r in engine.append(spark.createDataFrame(rows, schema)).collect()} == {"new"}
    more = [rows[0], (*rows[1][:4], "changed", 1), ("e9", "s1", "u1", "user", "late", 9)]
    assert {r.id: r.kind for r in engine.append(spark.createDataFrame(more, schema)).collect()} == {"e0": "replayed", "e1": "conflict", "e9": "new"}
    with pytest.raises(ValueError):
        engine.append(spark.createDataFrame([("x", "s", "u", "narrator", "y", 1)], schema))
    assert {r.id for r in engine.search("message", "u0").collect()} == {"e0", "e1", "e2", "e3"}  # searchable before compaction
    made = {r.user_id: (r.title, r.n) for r in engine.compact().collect()}
    assert made == {"u0": ("message 0", 4), "u1": ("message 4", 5)} and engine.compact().count() == 0
    assert engine.memories().where("resolution = 'narrative'").count() == 2
    assert engine.recompute().count() == 2 and engine.store.table("episodes").count() == 2


def test_meditation_fades_expires_and_draws(spark, engine):
    engine.add(facts(spark, [("a", "u1", "an old thing"), ("b", "u1", "quite another matter"), ("c", "u2", "pinned stays forever")]))
    engine.update(spark.createDataFrame([("b", 0.051), ("c", 0.051)], "id string, importance double"), ["importance"])
    engine.update(spark.createDataFrame([("c", True)], "id string, pinned boolean"), ["pinned"])
    engine.now = "2024-06-11 00:00:00"
    told = engine.meditate(cooldown_hours=1).first()
    assert (told.created, told.updated, told.deleted, told.unchanged) == (0, 1, 1, 1)
    assert engine.meditate(cooldown_hours=1) is None
    schema = "id string, session_id string, user_id string, role string, content string, at bigint"
    engine.append(spark.createDataFrame([("e1", "s1", "u1", "user", "Momo sleeps", 1)], schema))
    engine.compact()
    engine.model = Told()
    engine.meditate()
    assert engine.memories().where("content = 'Momo sleeps in the attic'").count() == 1
    engine.draw_graph(spark.createDataFrame([("u1", "Momo owns a bowl")], "user_id string, content string"))
    engine.draw_graph(spark.createDataFrame([("u1", "Momo owns a bowl")], "user_id string, content string"))
    assert engine.store.table("entities").count() == 2 and engine.store.table("relations").count() == 1
    assert [r.new_content for r in engine.reflect("u1").collect()] == ["Momo is calm"]
    assert {r.part: r.fine for r in engine.diagnose().collect()} == {"store": True, "embedder": True, "model": True}


def test_missing_vectors_are_asked_for_again(spark, engine):
    engine.add(facts(spark, [("a", "u1", "one thing")]))
    rows = engine.memories().withColumn("embedding", F.lit(None).cast("array<float>"))
    engine.store.commit({"memories": engine._as_given("memories", rows)})
    assert engine.backfill() == 1 and engine.backfill() == 0
    assert engine.memories().where("embedding is null").count() == 0


def test_missing_columns_are_added(spark, engine):
    engine.add(facts(spark, [("a", "u1", "one thing")]))
    engine.store.commit({"memories": engine._as_given("memories", engine.memories().drop("pinned"))})
    again = Engine(spark, engine.store.root, Words())
    assert again.memories().first().pinned is None


def test_mock_vectors_and_answers(spark):
    mock = M.MockEmbedder(16)
    a, b, c = mock.embed(["same", "same", "other"])
    assert a == b != c and np.isclose(np.linalg.norm(a), 1, atol=1e-5) and mock.embed([""])[0] != a
    df = spark.createDataFrame([("x",), (None,)], "t string")
    assert [r.v is None for r in df.select(M.embedded(mock)(F.col("t")).alias("v")).collect()] == [False, True]
    asked = df.select(M.answered(Told(), list)(F.concat(F.lit("List the relations "), "t")).alias("a")).collect()
    assert [json.loads(r.a) if r.a else None for r in asked] == [[{"subject": "Momo", "predicate": "owns", "object": "Bowl"}], None]
    assert df.select(M.answered(M.SilentAnswerer())(F.col("t")).alias("a")).where("a is not null").count() == 0
    t = spark.createDataFrame([('{"traits": [{"type": "mood", "content": "calm", "confidence": 7}, {"content": " "}]}',)], "a string")
    got = t.select(M.traits_from_answers(F.col("a")).alias("x")).first().x
    assert [(r.trait_type, r.content, r.confidence) for r in got] == [("mood", "calm", 1.0)]
    assert M.tokenizer("auto") is not None
    with pytest.raises(ValueError):
        M.tokenizer("none")

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import writes as W
from tidemark.tables import numbered

BASE = "id string, user_id string, agent_id string, content string, embedding array<float>, metadata string, importance double, hash string, stability double, created_at timestamp, updated_at timestamp, sync_version bigint, extra string"
BATCH = "id string, seq bigint, user_id string, agent_id string, content string, embedding array<float>, metadata string, importance double"


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def unit(v):
    v = np.asarray(v, float)
    return v / np.linalg.norm(v)


def brute(base, batch, size):
    """base: {id: (scope, content, vector)}; batch: (id, seq, scope, content, vector); vectors as they were before the batch."""
    into, kept, seen = {}, [], {}
    fits = lambda v: v is not None and len(v) == size and np.isfinite(v).all() and np.any(v)
    rows = sorted(batch, key=lambda r: (r[1], r[0]))
    for i, _, scope, content, vector in rows:
        if not content or not content.strip():
            continue
        same = sorted(b for b, (s, c, _) in base.items() if s == scope and c == content)
        if same:
            into[i] = same[0]
            continue
        if (scope, content) in seen:
            into[i] = into.get(seen[scope, content], seen[scope, content])
            continue
        seen[scope, content] = i
        near = sorted((1 - unit(vector) @ unit(v), b) for b, (s, _, v) in base.items() if s == scope and fits(v)) if fits(vector) else []
        if near and near[0][0] < W.DUPLICATE:
            into[i] = near[0][1]
            continue
        earlier = sorted(k for k, s, v in kept if s == scope and fits(v) and fits(vector) and 1 - unit(vector) @ unit(v) < W.DUPLICATE)
        if earlier:
            into[i] = earlier[0]
            continue
        kept.append((i, scope, vector))
    return into


@pytest.mark.parametrize("seed", range(2))
def test_a_batch_matches_one_by_one(spark, seed):
    rng, size = np.random.default_rng(seed), 8
    pick = random.Random(seed)
    centres = rng.normal(size=(12, size))
    vector = lambda: [float(np.float32(x)) for x in centres[rng.integers(12)] + 0.12 * rng.normal(size=size)]
    odd = lambda: pick.choice([None, [], [0.0] * size, [float("nan")] * size])
    scope = lambda: pick.choice([("u1", "a"), ("u1", None), ("u2", "a")])
    import hashlib

    base, batch = [], []
    for k in range(60):
        u, a = scope()
        text = f"fact {k}"
        base.append((f"b{k:03}", u, a, text, vector() if k % 9 else odd(), "{}", 0.5, hashlib.md5(text.encode()).hexdigest(), 1.0, None, None, k, "x"))
    for k in range(120):
        u, a = scope()
        text = pick.choice([f"fact {pick.randrange(60)}", f"news {pick.randrange(40)}", f"news {k + 100}", " ", None])
        batch.append((f"n{k:03}", k, u, a, text, vector() if k % 7 else odd(), pick.choice([None, '{"k": %d}' % k]), pick.choice([None, 0.9])))
    got = W.added(spark.createDataFrame(base, BASE), spark.createDataFrame(batch, BATCH), size, now())
    into = brute({r[0]: ((r[1], r[2]), r[3], r[4]) for r in base}, [(r[0], r[1], (r[2], r[3]), r[4], r[5]) for r in batch], size)
    told = [r for r in batch if r[4] and r[4].strip()]
    history = sorted((r.version, r.id, r.event, r.new_content) for r in got.history.collect())
    assert history == [(59 + k + 1, into.get(r[0], r[0]), "UPDATE" if r[0] in into else "ADD", r[4]) for k, r in enumerate(sorted(told, key=lambda r: r[1]))]
    rows = {r.id: r for r in got.memories.collect()}
    assert set(rows) == {r[0] for r in base} | {r[0] for r in told if r[0] not in into}
    for i, row in rows.items():
        own = [r for r in told if into.get(r[0], r[0]) == i]
        if own:
            last = own[-1]
            said = [r[6] for r in own if r[6] is not None]
            assert row.content == last[4] and row.sync_version == next(h[0] for h in reversed(history) if h[1] == i)
            assert row.metadata == (said[-1] if said else "{}" if i[0] == "b" else None)
            assert row.stability == (1.0 if i[0] == "b" else 3.0 if own[0][7] == 0.9 else 1.5)
        else:
            assert row.extra == "x" and row.updated_at is None


def test_an_empty_batch_changes_nothing(spark):
    base = spark.createDataFrame([("b", "u", "a", "x", [1.0, 0.0], "{}", 0.5, "h", 1.0, None, None, 4, "x")], BASE)
    got = W.added(base, spark.createDataFrame([], BATCH), 2, now())
    assert got.history.count() == 0 and [r.id for r in got.memories.collect()] == ["b"]


@pytest.mark.parametrize("block", [4000, 7])
def test_nearest_in_scope_matches_brute_force_in_a_hot_scope(spark, block):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 6)).astype(np.float32)
    scopes = ["hot" if k % 3 else f"s{k % 9}" for k in range(150)]
    df = spark.createDataFrame([(scopes[k], f"v{k:03}", [float(x) for x in vectors[k]]) for k in range(150)] + [(None, "n", [1.0] * 6), ("hot", "z", None)], "scope string, id string, vector array<float>")
    got = {}
    for r in W.nearest_in_scope(df.where("id < 'v030'"), df, 6, 0.8, 3, block).collect():
        got.setdefault(r.query, []).append((round(r.distance, 5), r.id))
    unit_rows = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(30):
        want = sorted((round(float(1 - unit_rows[q].astype(float) @ unit_rows[k].astype(float)), 5), f"v{k:03}") for k in range(150) if k != q and scopes[k] == scopes[q])
        assert sorted(got.get(f"v{q:03}", [])) == [w for w in want if w[0] <= 0.8][:3]


def test_corrections_supersede(spark):
    schema = "id string, user_id string, agent_id string, content string, embedding array<float>, superseded_by string, valid_until timestamp"
    rows = [
        ("1", "u", "a", "Momo does not like the red bowl", [1.0, 0.0], None, None),
        ("2", "u", "a", "Momo now prefers the red bowl, she loves it 3 times", [0.95, 0.1], None, None),
        ("3", "u", "a", "The weather is fine", [0.0, 1.0], None, None),
        ("4", "w", "a", "Momo does not like the red bowl", [1.0, 0.0], None, None),
        ("5", "u", "a", "an old one that hates bowls, not 4", [1.0, 0.0], "9", None),
    ]
    df = spark.createDataFrame(rows, schema)
    links = spark.createDataFrame([("1", "Momo"), ("2", "momo"), ("4", "Momo")], "id string, name string")
    new = spark.createDataFrame([("2",)], "id string")
    got = {r.id: (r.superseded_by, r.valid_until is not None) for r in W.superseded(df, new, links, 2, now()).collect()}
    assert got == {"1": ("2", True), "2": (None, False), "3": (None, False), "4": (None, False), "5": ("9", False)}
    none = links.where("false")
    assert {r.id: r.superseded_by for r in W.superseded(df, new, none, 2, now()).collect()}["1"] == "2"  # by its vector


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 5000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 7919) % 1000))
    got = [(r.k, r.n) for r in numbered(df, "n", "k", "id").collect()]
    assert sorted(n for _, n in got) == list(range(5000)) and [k for k, _ in sorted(got, key=lambda r: r[1])] == sorted(k for k, _ in got)


def test_inserts_are_by_key_and_repeatable(spark):
    base = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 5)], "k string, v int")
    once = W.inserted_if_absent(base, rows, ["k"])
    assert sorted((r.k, r.v) for r in once.collect()) == [("a", 1), ("b", 2)] == sorted((r.k, r.v) for r in W.inserted_if_absent(once, rows, ["k"]).collect())

import numpy as np
import pytest

from tidemark.llm.neighbours import Tree, close_pairs, nearest, similar_pairs, unit


def clustered(n, seed=0, size=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, size))
    rows = np.repeat(centres, 8, axis=0)[:n] + rng.normal(size=(n, size)) * rng.choice([0.1, 0.25, 1.0], size=(n, 1))
    return unit(rows)


def brute_pairs(ids, rows, least, k):
    sims = rows.astype(np.float64) @ rows.T.astype(np.float64)
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a and sims[a, b] >= least), key=lambda b: (-sims[a, b], ids[b]))
        out |= {tuple(sorted((ids[a], ids[b]))) for b in order[:k]}
    return out


def frame(spark, ids, rows):
    return spark.createDataFrame([(i, [float(x) for x in r] if r is not None else None, "x") for i, r in zip(ids, rows, strict=True)], "id string, vector array<float>, class string")


def test_pairs_exact_and_relaxed(spark):
    rows = clustered(600)
    ids = [f"v{k:04}" for k in range(600)]
    want = brute_pairs(ids, rows, 0.93, 10)
    df = frame(spark, ids, rows)
    exact = {(r.id_a, r.id_b) for r in similar_pairs(df, 64, 0.93, factor=1.0, shards=8).collect()}
    assert exact == want and len(want) > 300
    relaxed = {(r.id_a, r.id_b) for r in similar_pairs(df, 64, 0.93, shards=8).collect()}
    assert relaxed <= want and len(relaxed) >= 0.97 * len(want)


def test_unusable_vectors_and_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    rows = [base, base * 3, None, np.zeros(64), np.full(64, np.nan), base[:32], np.where(np.arange(64) == 3, np.inf, base), rng.normal(size=64)]
    got = [(r.id_a, r.id_b) for r in similar_pairs(frame(spark, [f"v{k}" for k in range(8)], rows), 64, 0.93).collect()]
    assert got == [("v0", "v1")]
    assert similar_pairs(frame(spark, [], []), 64, 0.93).count() == 0


def test_a_hot_class_of_copies_stays_linear(spark):
    base = np.random.default_rng(2).normal(size=64)
    ids = [f"c{k:04}" for k in range(1500)]
    got = {(r.id_a, r.id_b) for r in similar_pairs(frame(spark, ids, [base] * 1500), 64, 0.93, 10).collect()}
    want = {tuple(sorted((i, j))) for i in ids for j in [x for x in ids[:11] if x != i][:10]}
    assert got == want


def test_close_pairs_splits_without_loss():
    rows = clustered(3000, 3, 8)
    i, j, _ = close_pairs(rows, 0.99, np.sqrt(2 - 2 * 0.99) / 2 + 1e-5, leaf=100)
    sims = rows @ rows.T
    a, b = np.nonzero(np.triu(sims >= 0.99, 1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))


def test_tree_factor_one_is_exact_and_smaller_ones_keep_recall():
    rows = clustered(5000, 4)
    queries = rows[::50]
    sims = queries @ rows.T
    want = np.sort(sims, axis=1)[:, ::-1][:, :10]
    at, d = Tree(rows).nearest(queries, 10, 1.0)
    assert np.allclose(np.sort(1 - d**2 / 2, axis=1)[:, ::-1], want, atol=1e-4)
    at, _ = Tree(rows).nearest(queries, 10, 0.6)
    truth = np.argsort(-sims, axis=1, kind="stable")[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(at.tolist(), truth.tolist(), strict=True)])
    assert recall >= 0.9


@pytest.mark.parametrize("block", [1000, 7])
def test_nearest_over_shards_matches_brute_force(spark, block):
    rows = clustered(400, 5)
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "id bigint, vector array<float>")
    got = {}
    for r in nearest(df.where("id % 20 = 0"), df, 64, 3, factor=1.0, block=block, shard_rows=150).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    sims = rows @ rows.T
    np.fill_diagonal(sims, -2)
    for q in range(0, 400, 20):
        assert [got[q][k] for k in (1, 2, 3)] == np.argsort(-sims[q], kind="stable")[:3].tolist()
    assert nearest(df.where("false"), df, 64).count() == 0


def test_a_dense_shard_gives_k_pairs_a_row():
    rng = np.random.default_rng(6)
    rows = unit(rng.normal(size=64) + 0.01 * rng.normal(size=(3000, 64)))
    i, j, s = close_pairs(rows, 0.93, 0.03, k=10)
    assert len(i) <= 30_000
    sims = rows @ rows.T
    np.fill_diagonal(sims, -2)
    want = {tuple(sorted((a, b))) for a in range(3000) for b in np.argsort(-sims[a], kind="stable")[:10].tolist()}
    assert len(want & set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.999 * len(want)  # equal up to rounding


def test_the_first_of_equals_is_kept():
    rows = unit(np.repeat(np.eye(64)[:2], 6, axis=0))
    i, j, _ = close_pairs(rows, 0.93, 0.03, k=2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {tuple(sorted((a, b))) for o in (0, 6) for a in range(o, o + 6) for b in [x for x in range(o, o + 6) if x != a][:2]}


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (0.5, 0.9)])
def test_routed_search_with_a_hot_leaf(spark, factor, least):
    rows = clustered(1600, 7)
    rows[::3] = rows[0]  # a third of all rows are alike and share a leaf
    df = spark.createDataFrame([(f"v{k:05}", [float(x) for x in r], "x") for k, r in enumerate(rows)], "id string, vector array<float>, cell string")
    got = {}
    for r in nearest(df.where("substring(id, 6) = '7'"), df, 64, 5, factor=factor, shard_rows=100).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["similarity"]
    sims = rows.astype(np.float64) @ rows.T.astype(np.float64)
    np.fill_diagonal(sims, -2)
    asked = [k for k in range(1600) if f"v{k:05}"[5:] == "7"]
    good = sum(np.isclose(sorted(got[f"v{q:05}"].values(), reverse=True), np.sort(sims[q])[::-1][:5], atol=1e-4).sum() for q in asked)
    assert len(got) == len(asked) and good >= least * 5 * len(asked)

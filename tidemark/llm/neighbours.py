"""Most similar vectors: vantage-point trees in shards, with relaxed triangle-inequality pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import written

#: Rows that the routing tree is fitted on: SAMPLE, or SAMPLE_LEAF a leaf if that is more, so that the medians of deep
#: levels are not those of a few rows; MOST at most. Every row is indexed whatever their number.
SAMPLE, SAMPLE_LEAF, MOST = 20_000, 64, 500_000
#: Vectors under which a node is compared in full.
LEAF = 2048
#: Candidates among which a node's vantage point is chosen, and vectors their spread is measured on.
TRIES, SPREAD_ON = 24, 256
#: Leaves of the routing tree, so that a shard holds SHARD vectors at most, and SHARDS shards at least.
SHARDS, SHARD = 32, 100_000
#: Vectors of one cell of the search for stated queries.
NEAR_SHARD = 20_000


def usable(column: Column, size: int) -> Column:
    """Whether a vector has ``size`` finite values that are not all zero; false for null."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) == size) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one; very large and small values keep their direction."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (rows @ point), 0))


def vantage(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The point whose distances to the rows spread most, among rows and differences of rows."""
    some = rows[rng.integers(0, len(rows), SPREAD_ON)]
    picks = rows[rng.integers(0, len(rows), TRIES)]
    far = picks - rows[rng.integers(0, len(rows), TRIES)]
    far = far[np.linalg.norm(far, axis=1) > 1e-3]
    centred = some - some.mean(axis=0)
    main = np.linalg.eigh(centred.T @ centred)[1][:, -3:].T
    tries = np.concatenate([picks, far / np.linalg.norm(far, axis=1, keepdims=True), main]).astype(np.float32)
    return tries[np.argmax(np.sqrt(np.maximum(2 - 2 * (some @ tries.T), 0)).std(axis=0))]


def routing_tree(sample: np.ndarray, depth: int, seed: int = 7) -> list[tuple[np.ndarray, float] | None]:
    """A balanced tree of ``depth`` levels, as a heap of (vantage point, median distance)."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[np.ndarray, float] | None] = [None] * (2**depth - 1)
    parts = {0: sample}
    for k in range(len(nodes)):
        rows = parts.pop(k)
        if len(rows) < 2:
            rows = sample
        point = vantage(rows, rng)
        d = distances(rows, point)
        mid = float(np.median(d))
        nodes[k] = (point, mid)
        parts[2 * k + 1], parts[2 * k + 2] = rows[d <= mid], rows[d > mid]
    return nodes


def routed(rows: np.ndarray, nodes: list, depth: int, reach: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf a row is a member of: both sides within ``reach`` of a median, one for all or for each row."""
    reach = np.broadcast_to(np.asarray(reach, np.float32), len(rows))
    out_rows, out_leaves = [], []
    todo = [(0, 0, np.arange(len(rows)))]
    while todo:
        k, level, who = todo.pop()
        if not len(who):
            continue
        if level == depth:
            out_rows.append(who)
            out_leaves.append(np.full(len(who), k - (2**depth - 1), np.int32))
            continue
        point, mid = nodes[k]
        off = distances(rows[who], point) - mid
        todo.append((2 * k + 1, level + 1, who[off <= reach[who]]))
        todo.append((2 * k + 2, level + 1, who[off > -reach[who]]))
    if not out_rows:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(out_rows), np.concatenate(out_leaves)


def _best(left: np.ndarray, right: np.ndarray, skip: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the k best of ``right`` for every row of ``left``, of at least ``least``; the first of equals.

    Row i of ``left`` is row skip + i of ``right`` and no partner of itself.
    """
    n = len(left)
    held_s, held_j = np.empty((n, 0), np.float32), np.empty((n, 0), np.int64)
    for b in range(0, len(right), 4096):
        sims = left @ right[b : b + 4096].T
        own = np.arange(n) + skip - b
        inside = (own >= 0) & (own < sims.shape[1])
        sims[np.flatnonzero(inside), own[inside]] = -2
        hit = sims >= least
        count = hit.sum(axis=1)
        if not count.any() and not held_s.size:
            continue
        width = min(k, int(count.max()))
        if width:
            if count.max() > k:  # more than k: the k-th value, and of those equal to it the first
                kth = np.partition(sims, -k, axis=1)[:, -k : sims.shape[1] - k + 1]
                above, equal = sims > kth, sims == kth
                hit &= above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
                count = hit.sum(axis=1)
            i, j = np.nonzero(hit)
            place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            new_s, new_j = np.full((n, width), -2, np.float32), np.full((n, width), -1)
            new_s[i, place], new_j[i, place] = sims[i, j], b + j
            held_s, held_j = np.concatenate([held_s, new_s], axis=1), np.concatenate([held_j, new_j], axis=1)
            if held_s.shape[1] > k:
                order = np.argsort(-held_s, axis=1, kind="stable")[:, :k]
                held_s, held_j = np.take_along_axis(held_s, order, 1), np.take_along_axis(held_j, order, 1)
    i, at = np.nonzero(held_s >= least) if held_s.size else (np.empty(0, np.int64),) * 2
    return i, held_j[i, at], held_s[i, at]


def close_pairs(rows: np.ndarray, least: float, reach: float, leaf: int = LEAF, seed: int = 7, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j, similarity), i < j, of at least ``least`` that share a leaf of the shard's own tree.

    With ``k``, only those of which one is among the k best of the other in a leaf: k a row and leaf, however dense the shard.
    """
    rng = np.random.default_rng(seed)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = [np.arange(len(rows))]
    while todo:
        who = todo.pop()
        if len(who) > leaf:
            own = rows[who]
            point = vantage(own, rng)
            d = distances(own, point)
            mid = np.median(d)
            near, far = who[d <= mid + reach], who[d > mid - reach]
            if len(near) ** 2 + len(far) ** 2 < 0.9 * len(who) ** 2:  # else splitting costs more than comparing
                todo += [near, far]
                continue
        own = rows[who]
        for a in range(0, len(who), 1024):  # a node that does not split is compared in blocks
            i, j, s = _best(own[a : a + 1024], own, a, least, k or len(who))
            found.append((who[a + i], who[j], s))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.float32)
    i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
    low, high = np.minimum(i, j), np.maximum(i, j)
    _, first = np.unique(low * len(rows) + high, return_index=True)
    return low[first], high[first], s[first]


def _matrix(values: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, size)


def _fitted(rows: DataFrame, n: int, depth: int, size: int) -> tuple[list, int]:
    """A routing tree over ``rows(unit)``, of no levels where there are too few of them."""
    wanted = min(MOST, max(SAMPLE, SAMPLE_LEAF * 2**depth))
    sample = rows.select("unit").sample(min(1.0, 0.9 * wanted / max(1, n)), seed=7) if n > wanted else rows.select("unit")
    fitted = [bytes(r.unit) for r in sample.limit(wanted).toLocalIterator()]
    if depth < 1 or len(fitted) < 2:
        return [], 0
    return routing_tree(np.frombuffer(b"".join(fitted), np.float32).reshape(-1, size), depth), depth


def similar_pairs(vectors: DataFrame, size: int, least: float, k: int = 10, factor: float = 0.15, shards: int | None = None) -> DataFrame:
    """``(id_a, id_b, similarity)``, id_a < id_b: pairs of cosine similarity ``least`` or more of which one is among the ``k`` most similar of the other.

    ``vectors`` has ``id`` (string, unique) and ``vector``. A vantage-point tree fitted on at most SAMPLE rows
    routes every vector to a shard; each shard splits further by a tree of its own. Two vectors within distance
    r differ by r at most in their distance from any vantage point, so if both sides take what lies within r / 2
    of the median, they stay together: ``factor`` one is exact. In many dimensions the difference is far
    smaller as a rule, so smaller factors prune more and miss little.

    Vectors with the same values up to length are one class: one row of it is indexed, its first k + 1 members
    (by id) stand for it, and every further member gets the first k of its class as neighbours, so that a class
    that holds a large part of all rows costs no more than its rows. A shard gives k pairs a row at most. Equally similar vectors rank by id. Null,
    zero, too short or long and non-finite vectors are left out, as are null ids. Empty inputs give no rows.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    reach = factor * radius / 2 + 1e-5
    clean = vectors.where(F.col("id").isNotNull() & usable(F.col("vector"), size)).select("id", "vector")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                rows = unit(np.stack(pdf["vector"].to_numpy()))
                yield pd.DataFrame({"id": pdf["id"], "unit": [r.tobytes() for r in rows], "class": [r.tobytes() for r in np.round(rows * 1e5).astype(np.int32)]})

    packed = clean.mapInPandas(pack, "id string, unit binary, class binary")
    packed = packed.select("id", "unit", F.xxhash64("class").alias("h1"), F.hash("class").alias("h2")).withColumn("class", F.concat_ws("-", "h1", "h2")).drop("h1", "h2")
    packed = written(packed)
    ranked = packed.select("id", "class").withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("id")))
    first = ranked.where(F.col("at") <= k + 1)
    several = packed.groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    heads = packed.join(several.select("id", "class", "n"), ["id", "class"])
    heads = written(heads.select("id", "class", "unit", "n"))
    n = heads.count()
    depth = int(np.ceil(np.log2(shards or max(SHARDS, 3 * n / SHARD))))
    nodes, depth = _fitted(heads, n, depth, size)
    sent = spark.sparkContext.broadcast(nodes)  # 2 ** depth - 1 points, whatever the number of rows in a shard

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row, leaf = routed(_matrix(pdf["unit"], size), sent.value, depth, reach)
                yield pd.DataFrame({"shard": leaf, "id": pdf["id"].to_numpy()[row], "unit": pdf["unit"].to_numpy()[row]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, rows = pdf["id"].to_numpy(), _matrix(pdf["unit"], size)
        i, j, s = close_pairs(rows, least - 1e-6, reach, k=k)
        return pd.DataFrame({"a": ids[i], "b": ids[j], "s": s.astype(np.float64)})

    sharded = heads.select("id", "unit").mapInPandas(route, "shard int, id string, unit binary")
    met = sharded.repartition(2**depth, "shard").groupBy("shard").applyInPandas(compare, "a string, b string, s double")
    met = met.groupBy("a", "b").agg(F.max("s").alias("s"))
    met = written(met)
    # From classes back to members: those that can be among the k best of another are the first k + 1 of each.
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    classes = heads.select("id", "class")
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= k)
    best = best.join(classes.select(F.col("id").alias("a"), F.col("class").alias("ca")), "a").join(classes.select(F.col("id").alias("b"), F.col("class").alias("cb")), "b")
    inside = first.select(F.col("class").alias("ca"), F.col("id").alias("y"), "at").join(several.where("n > 1").select(F.col("class").alias("ca")), "ca")
    in_class = ranked.select(F.col("class").alias("ca"), F.col("id").alias("x")).join(inside.select("ca", "y"), "ca").where("x <> y").select("x", "y", F.lit(1.0).alias("s"))
    across = best.select("ca", "cb", "s").join(first.select(F.col("class").alias("cb"), F.col("id").alias("y")), "cb").join(ranked.select(F.col("class").alias("ca"), F.col("id").alias("x")), "ca").select("x", "y", "s")
    near = in_class.unionByName(across).withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("s"), "y"))).where(F.col("r") <= k)
    pairs = near.where(F.col("s") >= least - 1e-9).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "s")
    return pairs.groupBy("id_a", "id_b").agg(F.max("s").alias("similarity"))


class Tree:
    """A vantage-point tree over one shard, for the k nearest of blocks of queries."""

    def __init__(self, rows: np.ndarray, leaf: int = 256, seed: int = 7):
        self.rows, self.leaf, self.rng = rows, leaf, np.random.default_rng(seed)
        self.root = self._node(np.arange(len(rows)))

    def _node(self, who: np.ndarray) -> tuple:
        if len(who) <= self.leaf:
            return (who,)
        own = self.rows[who]
        point = vantage(own, self.rng)
        d = distances(own, point)
        mid = float(np.median(d))
        inner = d <= mid
        if inner.all() or not inner.any():
            return (who,)
        return (point, mid, self._node(who[inner]), self._node(who[~inner]))

    def nearest(self, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest, padded with -1; the bound of a query prunes by ``factor`` of itself.

        ``bound`` is a distance for every query beyond which nothing is looked for.
        """
        best = np.full((len(queries), k), np.inf, np.float32)
        if bound is not None:
            best[:] = bound[:, None]
        at = np.full((len(queries), k), -1, np.int64)

        def visit(node: tuple, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(node) == 1:
                d = np.sqrt(np.maximum(2 - 2 * (queries[who] @ self.rows[node[0]].T), 0))
                both = np.concatenate([best[who], d], axis=1)
                ids = np.concatenate([at[who], np.broadcast_to(node[0], d.shape)], axis=1)
                order = np.lexsort((ids, both), axis=1)[:, :k]
                best[who], at[who] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
                return
            point, mid, inner, outer = node
            d = distances(queries[who], point)
            left = d <= mid
            visit(inner, who[left])
            visit(outer, who[~left])
            cross = np.abs(d - mid) <= factor * best[who, k - 1] + 1e-5
            visit(outer, who[left & cross])
            visit(inner, who[~left & cross])

        visit(self.root, np.arange(len(queries)))
        return at, best


def _answers(members: DataFrame, asked: DataFrame, kind: str, size: int, k: int, factor: float, block: int) -> DataFrame:
    """``(query, neighbour, d)``: the k nearest of every query among the members of its cell.

    ``members`` has ``cell``, ``id`` and ``unit``, ``asked`` also ``bound``. Rows are sorted by cell with the members ahead of
    the queries: a task holds the members of one cell, which are bounded, and lets the queries stream by.
    """
    flow = members.select("cell", F.lit(0).alias("asks"), "id", "unit", F.lit(0.0).alias("bound")).unionByName(asked.select("cell", F.lit(1).alias("asks"), "id", "unit", "bound"))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, tree, ids = None, [], None, None
        for pdf in batches:
            cells = pdf["cell"].to_numpy()
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(pdf)]
            for part in (pdf.iloc[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a):
                if part["cell"].iloc[0] != cell:
                    cell, held, tree = part["cell"].iloc[0], [], None
                own = part["asks"].to_numpy() == 0
                if own.any():
                    held.append(part[own])
                queries = part[~own]
                if not len(queries) or not held:
                    continue
                if tree is None:
                    whole = pd.concat(held).sort_values("id", kind="stable")
                    ids, tree = whole["id"].to_numpy(), Tree(_matrix(whole["unit"], size))
                for a in range(0, len(queries), block):
                    some = queries.iloc[a : a + block]
                    at, d = tree.nearest(_matrix(some["unit"], size), k, factor, some["bound"].to_numpy(np.float32))
                    q, c = np.nonzero(at >= 0)
                    yield pd.DataFrame({"query": some["id"].to_numpy()[q], "neighbour": ids[at[q, c]], "d": d[q, c].astype(np.float64)})

    return flow.repartition("cell").sortWithinPartitions("cell", "asks").mapInPandas(answer, f"query {kind}, neighbour {kind}, d double")


def nearest(queries: DataFrame, vectors: DataFrame, size: int, k: int = 10, factor: float = 0.5, block: int = 20_000, shard_rows: int = NEAR_SHARD) -> DataFrame:
    """``(query, neighbour, similarity, rank)``: the ``k`` most similar of ``vectors`` for every query.

    Both frames have ``id`` and ``vector``; a vector is no neighbour of the query with its own id. Vectors lie in the
    leaves of a routing tree, a leaf of more than ``shard_rows`` (equal vectors cannot be told apart) in several
    cells. A query is first answered in its own leaf; then it visits the leaves that its ball of the k-th
    distance so far reaches, the radius times ``factor``, and there the same rule prunes the tree of the cell. ``factor``
    one is exact; smaller ones visit and compare less. Queries are never collected; they stream by the members of a
    cell, ``block`` at a time at most. Equally similar vectors rank by id. Unusable vectors and null ids are left out; empty inputs give no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()

    def units(df: DataFrame) -> DataFrame:
        def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"id": pdf["id"], "unit": [r.tobytes() for r in unit(np.stack(pdf["vector"].to_numpy()))]})

        return df.where(F.col("id").isNotNull() & usable(F.col("vector"), size)).select("id", "vector").mapInPandas(scale, f"id {kind}, unit binary")

    rows, asked = written(units(vectors)), written(units(queries))
    n = rows.count()
    nodes, depth = _fitted(rows, n, max(0, int(np.ceil(np.log2(max(1, n) / shard_rows)))), size)
    sent = spark.sparkContext.broadcast(nodes)  # as many points as leaves, shard_rows vectors each

    def to_leaves(df: DataFrame) -> DataFrame:
        """Each row with its leaf, and with the leaves that its ``reach`` touches."""

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    row, leaf = routed(_matrix(pdf["unit"], size), sent.value, depth, pdf["reach"].to_numpy(np.float32))
                    yield pdf.iloc[row].assign(leaf=leaf).drop(columns="reach")

        return df.mapInPandas(route, f"id {kind}, unit binary, bound double, home int, leaf int")

    at_home = lambda df: to_leaves(df.select("id", "unit", F.lit(9.0).alias("bound"), F.lit(-1).alias("home"), F.lit(0.0).alias("reach")))
    members, asked = written(at_home(rows)), written(at_home(asked))
    cells = members.groupBy("leaf").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("cells"))  # one row a leaf
    cells = F.broadcast(cells)
    name = lambda salt: F.concat_ws("-", "leaf", salt).alias("cell")
    members = members.join(cells, "leaf").select(name(F.pmod(F.xxhash64("id"), F.col("cells"))), "id", "unit")
    visits = lambda df: df.join(cells, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(name("salt"), "id", "unit", "bound")
    first = written(_answers(members, visits(asked), kind, size, k + 1, factor, block).where("query <> neighbour"))
    bounds = first.groupBy("query").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # k + 1 a cell of its leaf at most
    bounds = bounds.select(F.col("query").alias("id"), F.when(F.size("ds") >= k, F.get("ds", F.lit(k - 1))).alias("own_bound"))
    told = asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("own_bound", F.lit(9.0)))
    away = to_leaves(told.select("id", "unit", "bound", F.col("leaf").alias("home"), (F.col("bound") * factor + 1e-5).alias("reach"))).where("leaf <> home")
    found = first.unionByName(_answers(members, visits(away.withColumn("bound", F.col("bound") + 1e-5)), kind, size, k + 1, factor, block)).where("query <> neighbour")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "neighbour"))).where(F.col("rank") <= k)
    return ranked.select("query", "neighbour", (1 - F.col("d") * F.col("d") / 2).alias("similarity"), "rank")

"""Forgetting, consolidation, deduplication and merges of memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import contradiction_score

#: Days per unit of stability after which retention falls, by resolution.
DECAY = {"identity": 10.0, "granular": 5.0, "narrative": 3.0}
RESOLUTION_WEIGHT = {"granular": 1.0, "narrative": 0.65, "identity": 0.7}


def days_between(then: Column, now: Column) -> Column:
    """Days from ``then`` to ``now``, 0 at least."""
    return F.greatest((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0, F.lit(0.0))


def by_value(col: Column, values: dict[str, float], default: float) -> Column:
    return reduce(lambda out, kv: F.when(col == kv[0], kv[1]).otherwise(out), values.items(), F.lit(default))


def retention(days: Column, stability: Column, resolution: Column | None = None) -> Column:
    """(1 + t / (c s)) ** -0.5 within 0 and 1; c by resolution, 5 without one."""
    c = F.lit(5.0) if resolution is None else by_value(resolution, DECAY, 5.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(1 + days / (c * F.greatest(stability, F.lit(0.01))), F.lit(-0.5))))


def interference(n: Column) -> Column:
    """1 / (1 + 0.15 log2(n / 50)), 0.70 at least; 1 below 50 rows."""
    return F.when(n < 50, 1.0).otherwise(F.greatest(F.lit(0.70), 1 / (1 + 0.15 * F.log2(n / 50))))


def initial_stability(importance: Column) -> Column:
    return F.when(importance >= 0.8, 3.0).when(importance >= 0.5, 1.5).otherwise(1.0)


def reinforced(stability: Column, kept: Column, gain: float = 0.3) -> Column:
    """Stability after an access: the more was forgotten, the more it grows; a year at most."""
    return F.least(F.lit(365.0), stability * (1 + gain * (1 - kept)))


def decayed(importance: Column, days: Column, rate: float) -> Column:
    return F.greatest(F.lit(0.0), importance - rate * days)


def forgetting_score(similarity: Column, kept: Column, discount: Column, importance: Column, weight: float = 0.7) -> Column:
    return similarity * (weight * kept * discount + (1 - weight) * importance)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def exact_duplicates(df: DataFrame, scope: list[str], content: str, id_col: str) -> DataFrame:
    """``(*scope, kept, copies)``: rows of equal content in a scope, by the first id."""
    keyed = df.where(F.col(content).isNotNull()).groupBy(*scope, F.md5(content).alias("_h"), F.xxhash64(content).alias("_x"))
    return keyed.agg(F.min(id_col).alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("_h", "_x")


def merged(base: DataFrame, updates: DataFrame, key: str, version: str, guard: Column | None = None) -> DataFrame:
    """``base`` with ``updates``: per key the row of the largest version; rows under ``guard`` keep the base row.

    Both frames have the same columns. Repeated keys in ``updates`` resolve the same way.
    """
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    held = guard if guard is not None else F.lit(False)
    order = Window.partitionBy(key).orderBy(F.desc((F.col("_new") == 0) & F.coalesce(held, F.lit(False))), F.desc(version), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new")


def deleted(base: DataFrame, ids: DataFrame, key: str, guard: Column | None = None) -> DataFrame:
    """``base`` without the named ids; rows under ``guard`` stay."""
    gone = ids.select(key).distinct()
    if guard is None:
        return base.join(gone, key, "left_anti")
    kept = base.where(F.coalesce(guard, F.lit(False)))
    return base.where(~F.coalesce(guard, F.lit(False))).join(gone, key, "left_anti").unionByName(kept)


def pruned(df: DataFrame, scope: list[str], keep: int, strategy: str, guard: Column) -> DataFrame:
    """Rows to drop so that each scope keeps ``keep`` rows: the least used, important or stable go first."""
    order = {"lru": [F.asc("updated_at")], "importance": [F.asc("importance")], "decay": [F.asc("stability"), F.asc("importance")]}[strategy]
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*scope)))
    free = counted.where(~F.coalesce(guard, F.lit(False))).withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(*order, F.asc("id"))))
    return free.where(F.col("_r") <= F.col("_n") - keep).drop("_r", "_n")


def contradictions(pairs: DataFrame, old: str, new: str, is_newer: Column, threshold: float = 0.5) -> DataFrame:
    """``pairs`` with their score, where ``new`` contradicts ``old``."""
    scored = pairs.withColumn("contradiction", F.round(contradiction_score(F.col(old), F.col(new), is_newer), 4))
    return scored.where(F.col("contradiction") >= threshold)


def budget_suffix(df: DataFrame, key: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Of every key the newest rows, as long as their sizes together stay within ``budget``; ``order`` is newest first."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_s", F.sum(size).over(run)).where(F.col("_s") <= budget).drop("_s")


def near_duplicates(df: DataFrame, scope: str, id_col: str, vector: str, size: int, distance: float, block: int = 2000) -> DataFrame:
    """``(scope, a, b, distance)``, a < b: rows of one scope whose vectors are nearer than ``distance`` (cosine).

    A scope is cut into blocks of about ``block`` rows, and each pair of blocks is compared by one matrix
    product in one task, so that no task holds more than two blocks however large a scope is. Vectors that are
    null, of another length, not finite or zero are left out.
    """
    import numpy as np
    import pandas as pd

    col = F.col(vector)
    fits = F.coalesce((F.size(col) == size) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(col, lambda x: x != 0), F.lit(False))
    rows = df.where(fits & F.col(scope).isNotNull()).select(F.col(scope).alias("s"), F.col(id_col).alias("id"), col.alias("v"))
    counts = rows.groupBy("s").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = rows.join(counts, "s").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("s", "id", "v", "own", other).select("s", "id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        left, right = (np.flatnonzero(pdf["own"] == pdf[k]) for k in ("i", "j"))
        far = 1 - x[left] @ x[right].T
        a, b = np.nonzero(far < distance)
        ids = pdf["id"].to_numpy()
        out = pd.DataFrame({"s": pdf["s"].iloc[0], "a": ids[left[a]], "b": ids[right[b]], "distance": far[a, b]})
        swap = out["a"] > out["b"]
        out.loc[swap, ["a", "b"]] = out.loc[swap, ["b", "a"]].to_numpy()
        return out[out["a"] != out["b"]].drop_duplicates(["a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    found = spread.groupBy("s", "i", "j").applyInPandas(compare, f"s {rows.schema['s'].dataType.simpleString()}, a {kind}, b {kind}, distance double")
    return found.select(F.col("s").alias(scope), "a", "b", "distance")


def greedy_duplicates(pairs: DataFrame) -> DataFrame:
    """``(id, kept)``: rows that fall to an earlier kept row, as if rows were added one after the other.

    ``pairs(a, b)`` are near duplicates, ``a`` the earlier row. A row without any earlier near duplicate left is
    kept, its later ones fall; what then still has an earlier one waits for the next round. Only pairs take part,
    and each round decides all rows whose earlier ones are decided. A row that several kept rows strike goes to
    the first of them. Nulls and loops are ignored; an empty input gives an empty result.
    """
    from tidemark.tables import cut

    open_pairs = cut(pairs.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    fallen = None
    while not open_pairs.isEmpty():
        kept = open_pairs.select(F.col("a").alias("id")).distinct().join(open_pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        hit = cut(open_pairs.join(kept.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("kept")))
        if hit.isEmpty():  # the pairs run in a ring, so no order was given
            break
        fallen = hit if fallen is None else fallen.unionByName(hit)
        gone = hit.select("id")
        rest = open_pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        open_pairs = cut(rest.select("a", "b"))
    return fallen if fallen is not None else pairs.select(F.col("b").alias("id"), F.col("a").alias("kept")).where("false")

"""Components of graphs in which every node names at most one successor, by distributed pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import cut


def _double(state: DataFrame) -> DataFrame:
    """Let every node jump to where its target already points, keeping the least id on the way."""
    ahead = state.select(F.col("id").alias("_to"), F.col("to").alias("_next"), F.col("least").alias("_least"), F.col("rooted").alias("_rooted"))
    joined = state.join(ahead, F.col("to") == F.col("_to"))
    return joined.select("id", F.col("_next").alias("to"), F.least("least", "_least").alias("least"), F.col("_rooted").alias("rooted"))


def functional_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``links(id, next)``; ``component`` is one id of the component.

    Each ``id`` may have one row at most; targets that are no ``id`` are nodes too. Rows with a null in either
    column are ignored, an empty input gives an empty result, and loops and cycles are components like any
    other. A chain of n nodes takes log2(n) rounds; a node that many others point to costs no more than
    another one, since only the pointing side holds its rows. No ids reach the driver, only counts.
    """
    links = links.where("id is not null and next is not null").select("id", "next")
    roots = links.select(F.col("next").alias("id")).distinct().join(links.select("id"), "id", "left_anti")
    stepping = F.col("id") != F.col("next")
    state = links.select("id", F.col("next").alias("to"), F.least("id", "next").alias("least"), (~stepping).alias("rooted"))
    state = cut(state.unionByName(roots.select("id", F.col("id").alias("to"), F.col("id").alias("least"), F.lit(True).alias("rooted"))))
    left = state.where("not rooted").count()
    while left:
        state = cut(_double(state))
        now = state.where("not rooted").count()
        if now == left:  # no chain is longer, so what is left runs into cycles
            break
        left = now
    done = state.where("rooted").select("id", F.col("to").alias("component"))
    if not left:
        return done
    ring = state.where("not rooted")
    known = links.join(ring.select("id"), "id", "left_semi")
    while True:
        at = ring.select(F.col("id").alias("_to"), F.col("least").alias("component"))
        labels = cut(ring.join(at, F.col("to") == F.col("_to")).select("id", "component"))
        far = labels.select(F.col("id").alias("next"), F.col("component").alias("_far"))
        if not known.join(labels, "id").join(far, "next").where("component <> _far").limit(1).count():
            return done.unionByName(labels)
        ring = cut(_double(ring))

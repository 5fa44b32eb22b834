"""Entity graphs: degrees, neighbourhoods, spreading and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.tables import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge ``(src, dst)`` from either end, without repeats."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, degree)``: edges that start or end at each node; a loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, undirected: bool = False) -> DataFrame:
    """``(id, hops)``: nodes reached from ``start(id)`` in at most ``depth`` steps, with the fewest steps.

    Edges are followed from source to target, with ``undirected`` either way. Each hop joins the last frontier
    only and drops what was seen before; lineage is cut every hop.
    """
    steps = both_ways(edges) if undirected else edges.select("src", "dst").distinct()
    seen = cut(start.select("id", F.lit(0).alias("hops")).distinct())
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(steps, frontier["id"] == steps["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def linked_memories(memories: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, name)``: memories whose text holds a listed name of their user, as whole words whatever the case.

    Names meet the texts of their user that hold their first word, so the join is an equality on user and word, and
    the rows of one user fall on as many keys as they have words; what met is checked for the whole name.
    Names without a letter or digit are none. Repeated rows count once; nulls give no rows.
    """
    low = names.where("name is not null").select("user_id", "name", F.get(_words(F.lower("name")), F.lit(0)).alias("_word")).where("_word is not null").distinct()
    bound = F.concat(F.lit("(?i)(?<![\\p{L}\\p{N}])\\Q"), F.col("name"), F.lit("\\E(?![\\p{L}\\p{N}])"))
    words = memories.where("content is not null").select("id", "user_id", "content", F.explode(F.array_distinct(_words(F.lower("content")))).alias("_word"))
    joined = words.join(low, ["user_id", "_word"]).where(F.lower("content").contains(F.lower("name")))
    return joined.where(F.rlike("content", bound)).select("id", "name").distinct()


def _words(text: Column) -> Column:
    """The runs of letters and digits of a text."""
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def cooccurrence(links: DataFrame, cap: int | None = None) -> DataFrame:
    """``(a, b, n)``: how many rows hold both names; with ``cap``, from the first names of each row in sort order only."""
    every = F.sort_array(F.collect_set("name"))
    names = links.groupBy("id").agg((every if cap is None else F.slice(every, 1, cap)).alias("names"))
    left = names.select("id", F.posexplode("names").alias("i", "a"), "names")
    pairs = left.select("id", "i", "a", F.posexplode("names").alias("j", "b")).where("i < j")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def shared_entities(links: DataFrame, least: int = 1) -> DataFrame:
    """``(a, b, shared)``, a < b: memories that share at least ``least`` names, by way of the names' rows.

    Links are made distinct first, so that pairs are counted while they are joined, without another shuffle of names.
    Every pair of a name is a result, so a name of n memories gives n (n - 1) / 2 pairs; leave out names of no meaning.
    """
    once = links.select("id", "name").distinct()
    left, right = once.select(F.col("id").alias("a"), "name"), once.select(F.col("id").alias("b"), "name")
    return left.join(right, "name").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def entity_search(entities: DataFrame, text: str, scope: Column | None = None) -> DataFrame:
    """Entities whose name contains a text, whatever the case; wildcards have no meaning."""
    hit = F.lower("name").contains(text.lower())
    return entities.where(hit if scope is None else hit & scope)


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, other, kind)``: every edge ``(source, target, kind)`` of the ``nodes(id)``, from the node's end.

    "source = id or target = id" as an equi-join: each edge goes out from both its ends, a loop once.
    """
    ends = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))
    turned = edges.select("kind", F.explode(F.array_distinct(ends)).alias("e")).select("e.id", "e.other", "kind")
    return turned.join(nodes.select("id").distinct(), "id", "left_semi")


def with_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges(source, target, ...)`` with ``source_name`` and ``target_name`` from ``nodes(id, name)``; edges of unknown nodes are left out."""
    named = nodes.groupBy("id").agg(F.min("name").alias("_name"))
    out = edges
    for c in ("source", "target"):
        out = out.join(named.select(F.col("id").alias(c), F.col("_name").alias(f"{c}_name")), c)
    return out.select(*edges.columns, "source_name", "target_name")


def dictionary(entities: DataFrame) -> DataFrame:
    """``(user_id, name)``: the names of every user's entities in lower case, once each."""
    return entities.where("name is not null").select("user_id", F.lower("name").alias("name")).distinct()


def searched(entities: DataFrame, edges: DataFrame, text: str, depth: int, first: int = 10, undirected: bool = False) -> DataFrame:
    """``(id, hops)``: the ``first`` entities whose name contains a text, by name and id, and what is reached from them."""
    start = entity_search(entities, text).select("id", "name").distinct().orderBy(F.lower("name"), "id").limit(first)
    return neighbourhood(edges, start.select("id"), depth, undirected)


def mentioning(rows: DataFrame, names: DataFrame, *texts: str) -> DataFrame:
    """``rows`` of a user of which a text contains one of the user's ``names(user_id, name)``, whatever the case, as a substring.

    Candidates meet by user and the name's first three letters, which a text that contains the name contains.
    """
    low = names.where("name <> ''").select("user_id", F.lower("name").alias("_name")).distinct().withColumn("_lead", F.substring("_name", 1, 3))
    body = rows.select("id", "user_id", F.lower(F.concat_ws("\u0001", *texts)).alias("_text"))
    places = F.sequence(F.lit(1), F.greatest(F.char_length("_text"), F.lit(1)))
    grams = lambda n: F.transform(places, lambda i: F.substring(F.col("_text"), i, F.lit(n)))
    leads = body.withColumn("_lead", F.explode(F.array_distinct(F.concat(*[grams(n) for n in (1, 2, 3)]))))
    hit = leads.join(low, ["user_id", "_lead"]).where(F.col("_text").contains(F.col("_name"))).select("id").distinct()
    return rows.join(hit, "id", "left_semi")

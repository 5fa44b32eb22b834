"""Conversations from message rows, assembled from overlapping fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.tables import cut, numbered, written

#: The roles and their spellings.
ROLES = {"user": "u", "human": "u", "assistant": "a", "model": "a", "bot": "a", "system": "s", "tool": "t"}

#: Characters that show nothing though Unicode does not class them as blank or format.
INVISIBLE = "\\p{Z}\\p{Cc}\\p{Cf}\\u115f\\u1160\\u2800\\u3164\\uffa0\\ufe00-\\ufe0f\\u034f"

#: Messages of one fragment, and how many of them the next one repeats.
FRAGMENT, OVERLAP = 64, 4


def role_code(role: Column) -> Column:
    """One letter for a readable role, whatever its case and surrounding blanks; null for any other."""
    text = F.lower(F.regexp_replace(role, "^[\\s\\p{Z}\\p{Cf}]+|[\\s\\p{Z}\\p{Cf}]+$", ""))
    spellings = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.try_element_at(spellings, text)


def visible(content: Column) -> Column:
    """Whether a text has a visible character; false for null."""
    return F.coalesce(content.rlike(f"[^{INVISIBLE}\\s]"), F.lit(False))


def overlaps(fragments: DataFrame) -> DataFrame:
    """Suffix-prefix matches ``(conv, a, b, n)``: the last n hashes of fragment a are the first n of fragment b.

    ``fragments`` has ``conv``, ``frag`` and ``hashes`` (array<bigint>). Only the first hash of each fragment
    is looked up among the positions of the others, so no two fragments are compared that share nothing there.
    A match that holds all of ``b`` marks it as contained (``n`` is its whole length).
    """
    places = fragments.select("conv", F.col("frag").alias("a"), F.size("hashes").alias("a_n"), F.posexplode("hashes").alias("at", "hash"))
    heads = fragments.select("conv", F.col("frag").alias("b"), F.size("hashes").alias("b_n"), F.element_at("hashes", 1).alias("hash"))
    met = places.join(heads, ["conv", "hash"]).where("a <> b").withColumn("n", F.least(F.col("a_n") - F.col("at"), F.col("b_n")))
    of = lambda k: fragments.select("conv", F.col("frag").alias(k), F.col("hashes").alias(f"{k}_h"))
    both = met.join(of("a"), ["conv", "a"]).join(of("b"), ["conv", "b"])
    same = F.slice("a_h", F.col("at") + 1, F.col("n")) == F.slice("b_h", F.lit(1), F.col("n"))
    whole = (F.col("n") == F.col("b_n")) & ((F.col("at") + F.col("n") < F.col("a_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b"))) | ((F.col("at") > 0) & (F.col("at") + F.col("n") == F.col("a_n"))))
    suffix = F.col("at") + F.col("n") == F.col("a_n")
    return both.where(same & (suffix | whole)).select("conv", "a", "b", "n", whole.alias("contained"))


def assemble(fragments: DataFrame) -> DataFrame:
    """Place fragments on the paths of their overlap graph: ``(conv, frag, offset, skip, told, whole)``.

    Contained fragments are dropped. An edge is kept if it is the one longest overlap out of its left and into
    its right fragment; where two are equally long the path is ambiguous and both are left out. Paths are
    walked by pointer doubling, which sums the offsets. ``offset`` is the position of a fragment's first new
    message in its conversation, ``skip`` the messages it repeats from the one before, and ``told`` the sum of the
    ``weights`` (array<int>, optional, one a message) of all messages ahead of the fragment's first one; ``whole``
    is false where a conversation falls into several paths, that is, has a gap. Fragments without hashes are ignored.
    """
    fragments = fragments.where(F.size("hashes") > 0)
    if "weights" not in fragments.columns:
        fragments = fragments.withColumn("weights", F.array_repeat(F.lit(0), F.size("hashes")))
    found = cut(overlaps(fragments))
    inner = found.where("contained").select("conv", F.col("b").alias("frag")).distinct()
    kept = fragments.select("conv", "frag", F.size("hashes").alias("n_frag")).join(inner, ["conv", "frag"], "left_anti")
    live = lambda k: kept.select("conv", F.col("frag").alias(k))
    edges = found.where("not contained and n > 0").groupBy("conv", "a", "b").agg(F.max("n").alias("n"))
    edges = edges.join(live("a"), ["conv", "a"], "left_semi").join(live("b"), ["conv", "b"], "left_semi")

    def only_best(e: DataFrame, side: str, other: str) -> DataFrame:
        best = e.groupBy("conv", side).agg(F.max("n").alias("n"))
        top = e.join(best, ["conv", side, "n"])
        return top.groupBy("conv", side, "n").agg(F.count("*").alias("_c"), F.min(other).alias(other)).where("_c = 1").drop("_c")

    out, into = only_best(edges, "a", "b"), only_best(edges, "b", "a")
    sure = out.join(into, ["conv", "a", "b", "n"]).select("conv", "a", F.col("b").alias("frag"), F.col("n").alias("skip"))
    sizes = fragments.select("conv", F.col("frag").alias("a"), F.size("hashes").alias("a_n"), "weights")
    ahead_of = F.aggregate(F.slice("weights", F.lit(1), F.col("a_n") - F.col("skip")), F.lit(0).cast("bigint"), lambda x, w: x + w)
    steps = sure.join(sizes, ["conv", "a"]).select("conv", "frag", F.col("a").alias("to"), (F.col("a_n") - F.col("skip")).alias("shift"), "skip", ahead_of.alias("told"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    state = cut(kept.join(steps, ["conv", "frag"], "left").select("conv", "frag", F.coalesce("to", "frag").alias("to"), zero("shift"), zero("skip"), zero("told")))
    moving = state.where("to <> frag").count()
    while moving:
        ahead = state.select("conv", F.col("frag").alias("to"), F.col("to").alias("_to"), F.col("shift").alias("_shift"), F.col("told").alias("_told"))
        step = state.join(ahead, ["conv", "to"]).withColumn("_moved", F.col("to") != F.col("_to"))
        state = cut(step.select("conv", "frag", F.col("_to").alias("to"), (F.col("shift") + F.col("_shift")).alias("shift"), "skip", (F.col("told") + F.col("_told")).alias("told"), "_moved"))
        now = state.where("_moved").count()
        state = state.drop("_moved")
        if now == moving:  # what still moves runs in a ring
            break
        moving = now
    paths = state.groupBy("conv").agg((F.count_distinct("to") == 1).alias("_one"), F.max((F.col("frag") == F.col("to")).cast("int")).alias("_headed"))
    return state.join(paths, "conv").select("conv", "frag", (F.col("shift") + F.col("skip")).alias("offset"), "skip", "told", (F.col("_one") & (F.col("_headed") == 1)).alias("whole"))


def fragments_of(messages: DataFrame, fragment: int, overlap: int) -> DataFrame:
    """``(session_id, frag, ms)``: runs of a session's messages in order, each repeating the last of the one before.

    ``messages`` has ``session_id`` and ``m``, a struct that begins with what orders the messages of a session. They are
    sorted in ranges over all sessions and numbered from end to end (each range counts its own rows, and adds
    those of the ranges before it, one number a range); every ``fragment`` numbers make one fragment, or several
    where sessions meet. No session, however long, comes together in one task. What the next fragment repeats
    is marked by ``own`` false there. A fragment may hold repeated messages only.
    """
    numbered_rows = numbered(messages, "_at", "session_id", "m")
    home = F.floor(F.col("_at") / fragment).cast("bigint")
    repeated = F.col("_at") % fragment >= fragment - overlap
    places = F.when(repeated, F.array(home, home + 1)).otherwise(F.array(home))
    placed = numbered_rows.select("session_id", "m", home.alias("_home"), F.explode(places).alias("frag"))
    one = F.struct("m", (F.col("_home") == F.col("frag")).alias("own"))
    return placed.groupBy("session_id", "frag").agg(F.sort_array(F.collect_list(one)).alias("ms"))


def conversations(messages: DataFrame, fragment: int = FRAGMENT, overlap: int = OVERLAP) -> DataFrame:
    """The messages of every whole session in order: ``(session_id, turn_no, id, role)``.

    ``messages`` has ``session_id``, ``id``, ``user_id``, ``role``, ``content`` and ``at`` (bigint instant).
    Rows with the same session and id are one message; where they differ, the one with the greatest instant, user
    and role counts. A session is whole if all its messages have one user, a readable role, an instant that no other
    has, and visible content, and if its user and assistant messages alternate from user first to assistant
    last, with one of each at least. Rows without session or id are ignored; an empty table gives an empty
    result; columns besides these are not read.

    Every session, short or long, comes as fragments of ``fragment`` messages at most, of which each repeats
    the last ``overlap`` of the one before; the overlap graph of their message hashes puts them together again. Whether
    speakers alternate is told within each fragment, from the number of turns on the path ahead of it.
    """
    code = role_code(F.col("role")).alias("role")
    rows = messages.where("session_id is not null and trim(session_id) <> '' and id is not null").select("session_id", "id", "user_id", "at", code, visible(F.col("content")).alias("seen"))
    rows = rows.groupBy("session_id", "id").agg(F.max(F.struct("at", "user_id", "role", "seen")).alias("m"))
    m = F.struct("m.at", "id", "m.role", "m.user_id", "m.seen", F.xxhash64("session_id", "id", "m.at", "m.role").alias("hash"))
    fragments = fragments_of(written(rows.select("session_id", m.alias("m"))), fragment, overlap)  # written, as the ranges are fitted on it
    said = F.array_join(F.transform(F.filter("ms", lambda x: x.m.role.isin("u", "a")), lambda x: x.m.role), "")
    own = lambda test: F.size(F.filter("ms", lambda x: x.own & test(x.m)))
    bad = lambda x: x.at.isNull() | x.user_id.isNull() | x.role.isNull() | ~x.seen
    users = F.transform("ms", lambda x: x.m.user_id)
    fragments = written(
        fragments.select(
            F.col("session_id").alias("conv"), "frag", F.transform("ms", lambda x: F.struct(x.m.id.alias("id"), x.m.role.alias("role"))).alias("ms"),
            F.transform("ms", lambda x: x.m.hash).alias("hashes"), F.transform("ms", lambda x: x.m.role.isin("u", "a").cast("int")).alias("weights"),
            said.alias("said"), own(lambda x: x.role == "u").alias("n_u"), own(lambda x: x.role == "a").alias("n_a"),
            ((own(bad) == 0) & (F.size(F.array_distinct(F.transform("ms", lambda x: x.m.at))) == F.size("ms"))).alias("good"), F.array_min(users).alias("u0"), F.array_max(users).alias("u1"),
        )
    )
    fit = fragments.groupBy("conv").agg(F.min("good").alias("good"), F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.sum("n_u").alias("n_u"), F.sum("n_a").alias("n_a"))
    fit = fit.where("good and u0 = u1 and n_u = n_a and n_u > 0").select("conv")
    fragments = fragments.join(fit, "conv", "left_semi")
    placed = assemble(fragments.select("conv", "frag", "hashes", "weights"))
    next_role = F.when(F.col("told") % 2 == 0, "u").otherwise("a")
    joined = fragments.select("conv", "frag", "ms", "said").join(placed, ["conv", "frag"])
    turns = F.col("whole") & ~F.col("said").rlike("uu|aa") & ((F.col("said") == "") | (F.substring("said", 1, 1) == next_role))
    joined = written(joined.select("conv", "ms", "offset", "skip", turns.alias("ok")))
    whole = joined.groupBy("conv").agg(F.min("ok").alias("ok")).where("ok").select("conv")
    out = joined.join(whole, "conv", "left_semi").select("conv", "offset", "skip", F.posexplode("ms").alias("at", "m")).where("at >= skip")
    return out.select(F.col("conv").alias("session_id"), (F.col("offset") + F.col("at") - F.col("skip")).cast("bigint").alias("turn_no"), F.col("m.id").alias("id"), F.col("m.role").alias("role"))

"""Filter expressions, scopes and visibility as column predicates."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import partial_date

#: Fields of a memory that filters may name; any other name is a path into its metadata.
FIELDS = {
    "id", "content", "user_id", "agent_id", "run_id", "app_id", "importance", "access_count", "hash", "created_at", "updated_at", "immutable", "expiration_date", "categories",
    "memory_type", "stability", "privacy", "event_time", "session_id", "resolution", "superseded_by", "valid_from", "valid_until", "confidence", "sync_version", "device_id", "pinned",
}
ARRAYS = {"categories"}


def field(name: str, like: Any = None) -> Column:
    """The column of a field; of the metadata's JSON, in the type of the literal; null for names with odd characters."""
    if name in FIELDS:
        return F.col(name)
    if not all(c.isalnum() or c in "_." for c in name):
        return F.lit(None)
    path = F.get_json_object(F.col("metadata"), "$." + name)
    if isinstance(like, bool):
        return F.expr(f"try_cast(get_json_object(metadata, '$.{name}') as boolean)")
    if isinstance(like, (int, float)):
        return F.expr(f"try_cast(get_json_object(metadata, '$.{name}') as double)")
    return path


def compiled(expr: dict) -> Column:
    """A predicate from ``{"and": [...]}``, ``{"or": [...]}`` or ``{"field", "op", "value"}``.

    Operators: eq, ne, gt, gte, lt, lte, in, contains, icontains. An empty "and" is true, an empty "or" false.
    ``contains`` minds the case and takes its value literally; on ``categories`` it asks for a member.
    """
    for key, empty, join in (("and", True, lambda a, b: a & b), ("or", False, lambda a, b: a | b)):
        if key in expr:
            return reduce(join, [compiled(e) for e in expr[key]]) if expr[key] else F.lit(empty)
    name, op, value = expr["field"], expr["op"], expr.get("value")
    col = field(name, value[0] if op == "in" and value else value)
    if op == "in":
        return col.isin(list(value)) if value else F.lit(False)
    if name in ARRAYS:
        if op == "contains":
            return F.array_contains(col, value)
        if op == "icontains":
            return F.exists(col, lambda x: F.lower(x).contains(value.lower()))
    simple = {"eq": col == value, "ne": col != value, "gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value} if op in {"eq", "ne", "gt", "gte", "lt", "lte"} else {}
    if op in simple:
        return simple[op]
    if op == "contains":
        return col.contains(value)
    if op == "icontains":
        return F.lower(col).contains(value.lower())
    raise ValueError(f"unknown operator {op}")


def in_scope(user_id: str, agent_id: str | None = None, app_id: str | None = None, run_id: str | None = None, merged: bool = False) -> Column:
    """Rows of a user and, where named, of an agent, app and run; ``merged`` adds the user's rows without agent."""
    out = F.col("user_id") == user_id
    if agent_id is not None:
        own = F.col("agent_id") == agent_id
        out = out & ((own | F.col("agent_id").isNull()) if merged else own)
    for name, value in (("app_id", app_id), ("run_id", run_id)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def stored_time(text: Column) -> Column:
    """A stored time (ISO, T or blank, with or without offset; date, month or year alone) as a UTC timestamp; null if unreadable."""
    full = partial_date(F.trim(text))
    spelled = F.replace(F.substring(full, 1, 19), F.lit("T"), F.lit(" "))
    base = F.try_to_timestamp(spelled, F.when(F.char_length(spelled) > 10, F.lit("yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("yyyy-MM-dd")))
    sign = F.regexp_extract(full, "([+-])([0-9]{2}):?([0-9]{2})$", 1)
    part = lambda k: F.regexp_extract(full, "([+-])([0-9]{2}):?([0-9]{2})$", k).cast("int")
    shift = F.when((sign != "") & (F.char_length(full) > 19), (part(2) * 60 + part(3)) * F.when(sign == "-", -1).otherwise(1)).otherwise(0)
    return F.timestamp_seconds(F.unix_timestamp(base) - shift * 60)


def active(now: Column) -> Column:
    """Rows that are not superseded, not expired and still valid."""
    later = lambda c: F.col(c).isNull() | (stored_time(F.col(c)) > now)
    return F.col("superseded_by").isNull() & later("expiration_date") & later("valid_until")


def day_ranges(time: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a time lies on one of the days of closed date ranges."""
    days = [(F.to_date(time) >= F.lit(a).cast("date")) & (F.to_date(time) <= F.lit(b).cast("date")) for a, b in ranges]
    return reduce(lambda x, y: x | y, days) if days else F.lit(False)


#: Columns of a result that are always there.
ALWAYS = ("id", "user_id", "resolution")


def masked_fields(df: DataFrame, wanted: list[str]) -> DataFrame:
    """``df`` with all columns, but values only in the ``wanted`` ones and those of ALWAYS; "memory" names the content.

    Texts that every result has (content, created_at, updated_at) become empty, all others null.
    """
    keep = {*ALWAYS, *wanted, *(["content"] if "memory" in wanted else [])}
    blank = lambda c: F.lit("") if c in ("content", "created_at", "updated_at") else F.lit(None).cast(df.schema[c].dataType)
    return df.select(*[F.col(c) if c in keep else blank(c).alias(c) for c in df.columns])


def text_query(text: Column) -> Column:
    """Every word of a query in quotes, joined by OR; the word OR itself is left out, control characters around words go."""
    words = F.filter(F.transform(F.split(text, "\\s+"), lambda w: F.regexp_replace(w, "^\\p{Cc}+|\\p{Cc}+$", "")), lambda w: (w != "") & (w != "OR"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def event_faults(events: DataFrame) -> DataFrame:
    """``(id, fault)``: why event rows ``(id, role, content, categories)`` are refused; one row a fault.

    Empty content, ids of no or more than 256 bytes, unknown roles, one id with different rows, and categories with
    other characters than letters, digits, blanks, ``-``, ``_`` and ``/``. Equal rows count once.
    """
    once = events.select("id", "role", "content", "categories").distinct()
    size = F.octet_length("id")
    odd = F.exists(F.coalesce("categories", F.array().cast("array<string>")), lambda c: ~F.coalesce(c.rlike("^[\\p{L}\\p{N} _/-]+$"), F.lit(False)))
    tests = {
        "empty content": F.col("content").isNull() | ~F.col("content").rlike("[^\\s\\p{Z}]"),
        "id length": F.col("id").isNull() | ~size.between(1, 256),
        "unknown role": F.col("role").isNull() | ~F.lower(F.trim("role")).isin("user", "human", "assistant", "model", "bot", "system", "tool"),
        "category": odd,
    }
    faults = once.select("id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("fault"))
    twice = once.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("conflicting rows").alias("fault"))
    return faults.unionByName(twice).distinct()


def between_times(time: Column, since: str | None = None, until: str | None = None) -> Column:
    """Whether a time lies between two, ends included; null is no time. An open end is none."""
    out = time.isNotNull()
    if since is not None:
        out = out & (time >= F.lit(since).cast("timestamp"))
    return out if until is None else out & (time <= F.lit(until).cast("timestamp"))


def at_least(value: Column, least: float) -> Column:
    """Whether a number reaches a threshold; NaN, infinite and null ones do not, and no threshold may be one."""
    import math

    if not math.isfinite(least):
        raise ValueError("the threshold must be finite")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")) & (value >= least), F.lit(False))

"""Readers of chat exports, writers of change feeds, and checked imports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "conversation string, message_id string, role string, content string, at double"


def _parts(content: object) -> str:
    """The text of a message: a string, a list of parts, or blocks with a text."""
    if isinstance(content, str):
        return content
    if isinstance(content, dict):
        return _parts(content.get("parts") or content.get("text") or content.get("content") or "")
    if isinstance(content, list):
        return "\n".join(x for x in (_parts(c) for c in content) if x)
    return ""


def _seconds(value: object) -> float | None:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value) / (1000 if value > 1e11 else 1)
    if isinstance(value, str):
        t = pd.to_datetime(value, utc=True, errors="coerce")
        return None if pd.isna(t) else t.timestamp()
    return None


def _role(value: object) -> str:
    low = str(value or "").strip().lower()
    return {"human": "user", "model": "assistant", "bot": "assistant", "ai": "assistant"}.get(low, low or "user")


def _tree(doc: dict) -> Iterator[tuple]:
    """Nodes by id with parent and children, from the roots down; equal times keep that order."""
    nodes = doc.get("mapping") or {}
    roots = [k for k, n in nodes.items() if n.get("parent") not in nodes]
    stack, out = roots[::-1], []
    seen: set[str] = set()
    while stack:
        k = stack.pop()
        if k in seen or k not in nodes:
            continue
        seen.add(k)
        m = nodes[k].get("message")
        if m:
            text = _parts(m.get("content"))
            if text.strip():
                out.append((k, _role((m.get("author") or {}).get("role")), text, _seconds(m.get("create_time"))))
        stack += list(nodes[k].get("children") or [])[::-1]
    yield from sorted(out, key=lambda r: float("-inf") if r[3] is None else r[3])


def _flat(doc: dict) -> Iterator[tuple]:
    """A list of messages under one of the usual names."""
    for k, m in enumerate(doc.get("messages") or doc.get("chat_messages") or doc.get("turns") or []):
        text = _parts(m.get("content") or m.get("text") or m.get("parts"))
        if text.strip():
            yield str(m.get("id") or m.get("uuid") or k), _role(m.get("role") or m.get("sender") or m.get("author")), text, _seconds(m.get("timestamp") or m.get("created_at") or m.get("create_time"))


def parse_conversations(raw: str) -> list[tuple]:
    """(conversation, message id, role, content, seconds) of one export; unreadable JSON has none."""
    try:
        doc = json.loads(raw)
    except ValueError:
        return []
    docs = doc if isinstance(doc, list) else doc.get("conversations", [doc]) if isinstance(doc, dict) else []
    out = []
    for k, d in enumerate(x for x in docs if isinstance(x, dict)):
        name = str(d.get("id") or d.get("uuid") or d.get("conversation_id") or k)
        out += [(name, *m) for m in (_tree(d) if "mapping" in d else _flat(d))]
    return out


def read_exports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Messages of chat exports: tree or nested JSON, one document a file, or with ``lines`` one a line."""
    raw = spark.read.text(path, wholetext=not lines)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for t in pdf["value"] for r in parse_conversations(t)]
            yield pd.DataFrame(rows, columns=["conversation", "message_id", "role", "content", "at"])

    return raw.mapInPandas(parse, MESSAGES)


def change_feed(memories: DataFrame, history: DataFrame, since: int) -> DataFrame:
    """``(id, op, version)``: rows changed after a version, and the deletes of rows that are gone.

    ``history`` has ``id``, ``event`` and ``version``; the last event of an id that is no row any more counts.
    """
    changed = memories.where(F.col("sync_version") > since).groupBy("id").agg(F.max("sync_version").alias("version")).select("id", F.lit("UPSERT").alias("op"), "version")
    last = history.groupBy("id").agg(F.max_by("event", "version").alias("event"), F.max("version").alias("version")).where((F.col("event") == "DELETE") & (F.col("version") > since))
    gone = last.join(memories.select("id").distinct(), "id", "left_anti").select("id", F.lit("DELETE").alias("op"), "version")
    return changed.unionByName(gone)


def export_memories(memories: DataFrame, include_local: bool) -> DataFrame:
    """Memories for an export; local ones only on request."""
    return memories if include_local else memories.where("privacy is null or privacy <> 'local'")


def sessions_of(messages: DataFrame, source: str, user_id: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, events) of imported messages: one session ``import-<source>-<conversation>`` a conversation.

    ``messages`` is what the readers give. Messages without text are left out, equal rows count once; an event's id
    is its session's and its own.
    """
    name = F.concat_ws("-", F.lit("import"), F.lit(source), "conversation")
    rows = messages.where(F.col("content").rlike("[^\\s\\p{Z}]")).distinct().withColumn("session_id", name)
    sessions = rows.groupBy("session_id").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("*").alias("n")).withColumn("user_id", F.lit(user_id))
    events = rows.select(F.concat_ws("-", "session_id", "message_id").alias("id"), "session_id", F.lit(user_id).alias("user_id"), "role", "content", "at")
    return sessions, events


def full_export(tables: dict[str, DataFrame], keys: dict[str, str], user_id: str | None = None) -> DataFrame:
    """``(layer, id, body)``: all rows of all layers as JSON, one row each; of one user where asked for.

    ``keys`` names the id column of every layer. Null fields are written, so that an import finds every column.
    """
    out = None
    for layer, df in tables.items():
        own = df.where(F.col("user_id") == user_id) if user_id is not None and "user_id" in df.columns else df
        part = own.select(F.lit(layer).alias("layer"), F.col(keys[layer]).cast("string").alias("id"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def full_import(exported: DataFrame, into: dict[str, DataFrame], keys: dict[str, str], rules: list[tuple[str, str, str, str]] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """(all layers after the import, faults ``(rule, id)``): rows whose key a layer lacks are added, others skipped.

    A body that cannot be read, has no key, or repeats one with other values is a fault, and so is a reference by
    ``rules`` (layer, column, target layer, target column) that points at nothing. A row at fault is not imported.
    """
    from pyspark.sql import types as T

    read: dict[str, DataFrame] = {}
    faults = exported.where(~F.col("layer").isin(list(into))).select(F.concat(F.lit("layer "), "layer").alias("rule"), "id")
    for layer, base in into.items():
        key = keys[layer]
        schema = T.StructType([*base.schema.fields, T.StructField("_corrupt_record", T.StringType())])
        rows = exported.where(F.col("layer") == layer).select("id", F.from_json("body", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).distinct()
        fine = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull() & F.col(f"r.{key}").isNotNull()
        faults = faults.unionByName(rows.where(~F.coalesce(fine, F.lit(False))).select(F.lit(f"{layer} unreadable").alias("rule"), "id"))
        good = rows.where(fine).select(*[F.col(f"r.{c}").alias(c) for c in base.columns])
        twice = good.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
        faults = faults.unionByName(twice.select(F.lit(f"{layer} repeated").alias("rule"), F.col(key).cast("string").alias("id")))
        good = good.join(twice, key, "left_anti")
        read[layer] = good.join(base.select(key), key, "left_anti").select(*base.columns)
    for layer, column, target, key in rules:
        known = into[target].select(F.col(key).alias(column)).unionByName(read[target].select(F.col(key).alias(column))).distinct()
        loose = read[layer].where(F.col(column).isNotNull()).join(known, column, "left_anti").select(*read[layer].columns)
        faults = faults.unionByName(loose.select(F.lit(f"{layer}.{column}").alias("rule"), F.col(keys[layer]).cast("string").alias("id")))
        read[layer] = read[layer].where(F.col(column).isNull()).unionByName(read[layer].join(known, column, "left_semi").select(*read[layer].columns))
    return {layer: base.unionByName(read[layer]) for layer, base in into.items()}, faults.distinct()


def broken_references(tables: dict[str, DataFrame], rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """``(rule, id)``: values that point at nothing, by rules (table, column, target table, target column)."""
    out = None
    for name, column, target, key in rules:
        bad = tables[name].where(F.col(column).isNotNull()).select(F.col(column).alias("id")).join(tables[target].select(F.col(key).alias("id")), "id", "left_anti").distinct()
        part = bad.select(F.lit(f"{name}.{column}").alias("rule"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def latest_config(entries: DataFrame) -> DataFrame:
    """``(key, value)``: the last value written of every key."""
    return entries.groupBy("key").agg(F.max_by("value", "written_at").alias("value"))

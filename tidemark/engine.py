"""One memory store: the operators behind the verbs of an application, over versioned tables.

Facts are kept in parts by a hash of their user, and a write rewrites only the parts of the users it touches. Every verb
takes and gives DataFrames, so that one call serves one fact or a billion.
"""

from __future__ import annotations

import json
import time
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.models import Answerer, Embedder, SilentAnswerer, answered, embedded, graph_from_answers, principles_from_answers
from tidemark.functions.timephrases import time_ranges
from tidemark.operators import episodes as E
from tidemark.operators import filters as P
from tidemark.operators import graph as G
from tidemark.operators import lifecycle as L
from tidemark.operators import retrieval as R
from tidemark.operators import state as S
from tidemark.operators import writes as W
from tidemark.sources.store import Append, Store
from tidemark.streaming.ingest import payload_hash, split_batch
from tidemark.tables import written

#: Version of the tables' columns, and parts that facts and events are kept in.
SCHEMA, PARTS = 1, 256

MEMORIES = (
    "id string, content string, embedding array<float>, user_id string, agent_id string, run_id string, app_id string, importance double, access_count bigint, hash string, created_at timestamp, updated_at timestamp, metadata string, immutable boolean,"
    " expiration_date string, categories array<string>, memory_type string, stability double, privacy string, event_time string, session_id string, episode_id string, resolution string, superseded_by string, valid_from string, valid_until timestamp, confidence double, sync_version bigint, pinned boolean"
)
EVENTS = "id string, session_id string, user_id string, role string, content string, at bigint, embedding array<float>, payload string"
TABLES = {
    "memories": MEMORIES, "events": EVENTS, "history": "id string, user_id string, event string, old_content string, new_content string, version bigint", "links": "id string, name string", "episodes": "id string, user_id string, title string, summary string, n bigint, start_at bigint, end_at bigint",
    "processed": "id string", "entities": "id string, name string, entity_type string, user_id string", "relations": "source string, target string, kind string, user_id string", "runs": "started_at timestamp, kind string, created bigint, updated bigint, deleted bigint, unchanged bigint", "config": "key string, value string, written_at timestamp",
}
PARTED = {"memories", "events"}


def part_of(user: str = "user_id") -> Column:
    """The part of a user's rows."""
    return F.pmod(F.xxhash64(user), F.lit(PARTS)).cast("int")


class Engine:
    """A store opened with an embedder, and a language model where there is one; ``now`` is the time of the next verb, if not the clock's."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, model: Answerer | None = None):
        self.spark, self.store, self.embedder, self.model = spark, Store(spark, root), embedder, model
        self.now: str | None = None
        have = set(self.store.tables())
        if not have:
            self.store.commit({k: self._as_given(k, self._empty(k)) for k in TABLES})
            self.configure({"schema": str(SCHEMA), "dimensions": str(embedder.dimensions)})
            return
        known = self.config()
        if int(known.get("dimensions", 0)) != embedder.dimensions:
            raise ValueError(f"the store holds vectors of {known.get('dimensions')} values, the embedder gives {embedder.dimensions}")
        if int(known.get("schema", 0)) > SCHEMA:
            raise ValueError("the store was written by a later version")
        self.migrate(have)

    # ---- tables

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def _as_given(self, name: str, rows: DataFrame, touched: list[int] | None = None) -> DataFrame | tuple[DataFrame, Column, list[int]]:
        return (rows, part_of(), list(range(PARTS)) if touched is None else touched) if name in PARTED else rows

    def migrate(self, have: set[str]) -> None:
        """Add missing tables, and missing columns as nulls; what is there stays."""
        changed = {k: self._as_given(k, self._empty(k)) for k in TABLES if k not in have}
        for name in have & set(TABLES):
            rows, wanted = self.store.table(name), T.StructType.fromDDL(TABLES[name])
            missing = [f for f in wanted if f.name not in rows.columns]
            if missing:
                changed[name] = self._as_given(name, rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]))
        if changed:
            self.store.commit(changed)

    def time(self) -> Column:
        return F.current_timestamp() if self.now is None else F.lit(self.now).cast("timestamp")

    def memories(self, touched: list[int] | None = None) -> DataFrame:
        return self.store.table("memories", touched).select(*T.StructType.fromDDL(MEMORIES).names)

    def _touched(self, rows: DataFrame) -> list[int]:
        """The parts of some users; PARTS at most."""
        return sorted(r[0] for r in rows.select(part_of().alias("p")).distinct().collect())

    def config(self) -> dict[str, str]:
        """The settings, a handful of rows."""
        return {r.key: r.value for r in S.latest(self.store.table("config"), "key", "written_at").collect()}

    def configure(self, values: dict[str, str]) -> None:
        rows = self.spark.createDataFrame(list(values.items()), "key string, value string").withColumn("written_at", F.current_timestamp())
        self.store.commit({"config": Append(rows)})

    # ---- facts

    def add(self, facts: DataFrame) -> DataFrame:
        """Add facts with ``user_id`` and ``content``, and any other columns of MEMORIES; gives the history rows.

        Missing ids are made, missing vectors asked of the embedder, and facts are taken in the order of ``seq`` or
        else of id. New facts supersede what they contradict.
        """
        own = T.StructType.fromDDL(MEMORIES)
        rows = facts.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in own if f.name not in facts.columns])
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit(0).cast("bigint"))
        rows = rows.withColumns({"id": F.coalesce("id", F.expr("uuid()")), "resolution": F.coalesce("resolution", F.lit("granular")), "privacy": F.coalesce("privacy", F.lit("syncable"))})
        rows = written(rows)  # once, for the ids are made
        rows = written(rows.withColumn("embedding", F.coalesce("embedding", embedded(self.embedder)(F.col("content")))))
        touched = self._touched(rows)
        base = self.memories(touched)
        got = W.added(base, rows, self.embedder.dimensions, self.time())
        history, memories = written(got.history), written(got.memories)
        new = history.where("event = 'ADD'").select("id")
        links = self.store.table("links")
        named = G.linked_memories(memories.join(new, "id", "left_semi"), self.store.table("entities"))
        fresh = written(W.linked(links.where("false"), named).join(links, ["id", "name"], "left_anti"))
        memories = W.superseded(memories, new, links.unionByName(fresh), self.embedder.dimensions, self.time())
        self.store.commit({"memories": self._as_given("memories", memories, touched), "history": Append(history), "links": Append(fresh)})
        return history

    def search(self, text: str, user_id: str, agent_id: str | None = None, filter: dict | None = None, k: int = 10, per_session: int = 0, least: float | None = None, augment: int = 0, scorer: object = None) -> DataFrame:  # noqa: A002
        """``(id, score, content, ...)``: the best facts and events of a user for a query, through all channels and stages.

        The filter holds for every channel; with one, events are left out. ``augment`` adds up to so many facts that share
        entities with the first ten. ``scorer`` reranks by a function of query and text.
        """
        m = self.memories(self._touched(self.spark.createDataFrame([(user_id,)], "user_id string")))
        scope = P.in_scope(user_id, agent_id, merged=True) & P.active(self.time())
        if filter is not None:
            scope = scope & F.coalesce(P.compiled(filter), F.lit(False))
        # stored times are timestamps here; the predicates read text
        m = written(m.withColumn("valid_until", F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss")))
        events = None
        if filter is None:
            e = self.store.table("events", self._touched(self.spark.createDataFrame([(user_id,)], "user_id string")))
            none = F.lit(None).cast("string")
            events = written(e.select("id", "content", "user_id", "session_id", "at", none.alias("agent_id"), *[none.alias(c) for c in ("superseded_by", "expiration_date", "valid_until")]))
        vector = self.embedder.embed([text])[0]
        links = self.store.table("links")
        linked = links.join(G.dictionary(self.store.table("entities")).where(F.col("user_id") == user_id).where(F.lit(text.lower()).contains(F.col("name"))), "name").groupBy("id").agg(F.count("*").cast("double").alias("score"))
        hits = written(R.hybrid_search(m, text, vector, scope, 3 * k, pool=3 * k, entities=linked.join(m.where(scope).select("id"), "id", "left_semi"), events=events))
        if augment:
            hits = written(R.graph_augmented(hits, links.join(m.where(scope).select("id"), "id", "left_semi"), n=augment))
        said = [] if events is None else [events.select("id", "content", "session_id", F.timestamp_micros("at").alias("updated_at"), F.timestamp_micros("at").alias("event_time"), F.lit(0.5).alias("importance"), F.lit(1.0).alias("stability"), F.lit("granular").alias("resolution"))]
        held = m.where(scope).select("id", "content", "session_id", "updated_at", P.stored_time(F.col("event_time")).alias("event_time"), "importance", "stability", "resolution")
        rows = held if not said else held.unionByName(said[0])
        count = m.where(F.col("user_id") == user_id).count()
        today = date.fromisoformat(self.now[:10]) if self.now else date.today()
        found = R.rescored(hits, rows, count, self.time(), k, [(str(a), str(b)) for a, b in time_ranges(text, today)], per_session, least)
        out = found.join(rows.select("id", "content", "session_id", "resolution"), "id").dropDuplicates(["id"])
        return E.reranked(out, text, scorer, k)

    def get(self, ids: DataFrame) -> DataFrame:
        """Facts by id with their retention; the reads are counted and make them stabler."""
        rows, log = S.traces(self.memories(), ids, self.time(), F.col("updated_at"))
        rows = written(rows)
        touched = self._touched(rows)
        base = self.memories(touched)
        days = L.days_between(F.col("updated_at"), self.time())
        self.store.commit({"memories": self._as_given("memories", E.accessed(base, written(log), days).select(*base.columns), touched)})
        return rows

    def list(self, user_id: str, filter: dict | None = None, pinned: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:  # noqa: A002, A003
        rows = self.memories(self._touched(self.spark.createDataFrame([(user_id,)], "user_id string"))).where(F.col("user_id") == user_id)
        rows = rows if filter is None else rows.where(P.compiled(filter))
        rows = rows.where("pinned") if pinned else rows
        return rows.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)

    def update(self, changes: DataFrame, columns: list[str]) -> None:
        """Set the given columns by id where the changes have values; immutable facts stay. The version is raised."""
        free = self.memories().where("not coalesce(immutable, false)").join(changes.select("id").distinct(), "id", "left_semi").select("id", "user_id")
        touched = self._touched(free)
        base = self.memories(touched)
        mine = changes.join(free.select("id"), "id", "left_semi")
        numbers = W.next_versions(mine.select("id").distinct(), base, "id")
        news = written(mine.join(numbers.select("id", "sync_version"), "id").select("id", *columns, "sync_version"))
        self.store.commit({"memories": self._as_given("memories", W.refreshed(base, news, "id", [*columns, "sync_version"], ("updated_at", self.time())), touched)})

    def delete(self, scope: Column, force: bool = False) -> DataFrame:
        """Delete the facts of a scope; immutable ones only by force. Gives the history rows."""
        stay, gone = E.scoped_delete(self.memories(), scope, force)
        gone = written(gone.join(self.memories().select("id", "user_id"), "id"))
        touched = self._touched(gone)
        most = self.memories().agg(F.coalesce(F.max("sync_version"), F.lit(0)).alias("m")).first()[0]
        rows = gone.select("id", "user_id", "event", "old_content", F.lit(None).cast("string").alias("new_content"), F.lit(most + 1).cast("bigint").alias("version"))
        left = self.memories(touched).join(gone.select("id"), "id", "left_anti")
        self.store.commit({"memories": self._as_given("memories", left.select(*stay.columns), touched), "history": Append(rows), "links": self.store.table("links").join(gone.select("id"), "id", "left_anti")})
        return rows

    def history(self, ids: DataFrame) -> DataFrame:
        return self.store.table("history").join(ids.select("id").distinct(), "id", "left_semi").orderBy("id", "version")

    def stats(self) -> DataFrame:
        """``(table_name, rows, bytes, dimensions)`` of the version in force."""
        sizes, dims = self.store.sizes(), self.embedder.dimensions
        return self.spark.createDataFrame([(t, n, sizes[t], dims) for t, n in self.store.stats().items()], "table_name string, rows bigint, bytes bigint, dimensions int")

    def erase(self, user_id: str) -> None:
        """Remove everything of a user, immutable or not, from all tables."""
        every = {t: self.store.table(t) for t in TABLES if t not in ("config", "runs")}
        mine = {c: every[c].where(F.col("user_id") == user_id).select("id") for c in ("memories", "events")}
        out = E.erased({k: df for k, df in every.items() if k not in PARTED}, user_id)
        out["links"] = out["links"].join(mine["memories"], "id", "left_anti")
        out["processed"] = out["processed"].join(mine["events"], "id", "left_anti")
        touched = self._touched(self.spark.createDataFrame([(user_id,)], "user_id string"))
        parted = {c: self._as_given(c, self.store.table(c, touched).where(F.col("user_id").isNull() | (F.col("user_id") != user_id)), touched) for c in PARTED}
        self.store.commit({**out, **parted})

    # ---- events, episodes, upkeep

    def append(self, events: DataFrame) -> DataFrame:
        """Append events ``(id, session_id, user_id, role, content, at)`` once a key; gives ``(id, kind)`` new, replayed or conflict.

        Events with faults are refused before anything is written. Vectors that the embedder could not give stay null
        for ``backfill``.
        """
        bad = P.event_faults(events.select("id", "role", "content", F.lit(None).cast("array<string>").alias("categories")))
        if not bad.isEmpty():
            raise ValueError(f"events refused: {[(r.id, r.fault) for r in bad.limit(5).collect()]}")
        batch = written(payload_hash(events, ["session_id", "user_id", "role", "content", "at"]))
        touched = self._touched(batch)
        base = self.store.table("events", touched)
        new, replayed, conflict = split_batch(base, batch, "id")
        rows = written(new.withColumn("embedding", embedded(self.embedder)(F.col("content"))))
        out = written(rows.select("id", F.lit("new").alias("kind")).unionByName(replayed.select("id", F.lit("replayed").alias("kind"))).unionByName(conflict.select("id", F.lit("conflict").alias("kind"))))
        self.store.commit({"events": self._as_given("events", base.unionByName(rows.select(*base.columns)), touched)})
        return out

    def backfill(self) -> int:
        """Ask again for the vectors of events and facts that have none; gives how many got one."""
        done, changed = 0, {}
        for name in sorted(PARTED):
            pending = self.store.table(name).where("embedding is null and content is not null").select("user_id")
            touched = self._touched(pending)
            if touched:
                rows = self.store.table(name, touched)
                filled = written(rows.withColumn("embedding", F.coalesce("embedding", embedded(self.embedder)(F.col("content")))))
                done += rows.where("embedding is null").count() - filled.where("embedding is null").count()
                changed[name] = self._as_given(name, filled, touched)
        if changed:
            self.store.commit(changed)
        return done

    def compact(self) -> DataFrame:
        """Make episodes and narrative facts of the sessions' unprocessed events; gives the new episodes.

        Small sessions are summed up by their first messages. Larger ones too, unless a model gives a summary.
        """
        events, done = self.store.table("events"), self.store.table("processed")
        open_events = written(events.join(done.select("id"), "id", "left_anti").drop("embedding"))
        made = E.compacted(open_events)
        if self.model is not None:
            told = answered(self.model, dict)(F.when(~F.col("small"), F.concat(F.lit("Sum up as JSON with a summary: "), "summary")))
            made = made.withColumn("summary", F.coalesce(F.get_json_object(told, "$.summary"), "summary"))
        made = written(made.withColumn("id", F.concat_ws("-", F.lit("episode"), "session_id", "start_at")))
        episodes = made.select("id", "user_id", "title", "summary", "n", "start_at", "end_at")
        fresh = written(episodes.join(self.store.table("episodes").select("id"), "id", "left_anti"))
        touched = self._touched(made)
        base = self.memories(touched)
        facts = made.select(F.concat_ws("-", F.lit("narrative"), "id").alias("id"), F.col("summary").alias("content"), "user_id", "session_id", F.col("id").alias("episode_id"), F.lit("narrative").alias("resolution"))
        facts = facts.withColumns({"embedding": embedded(self.embedder)(F.col("content")), "created_at": self.time(), "updated_at": self.time(), "importance": F.lit(0.5), "stability": F.lit(1.5), "hash": F.md5("content"), "privacy": F.lit("syncable")})
        fields = T.StructType.fromDDL(MEMORIES)
        facts = written(W.next_versions(facts, base, "id"))
        facts = facts.select(*[(F.col(f.name) if f.name in facts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        self.store.commit({"episodes": Append(fresh), "processed": Append(open_events.select("id").distinct()), "memories": self._as_given("memories", W.inserted_if_absent(base, facts, ["id"]), touched)})
        return episodes

    def recompute(self) -> DataFrame:
        """Forget episodes and narrative facts, and make them again from all events."""
        touched = self._touched(self.memories().where("resolution = 'narrative'").select("user_id"))
        left = self.memories(touched).where("coalesce(resolution, '') <> 'narrative'")
        self.store.commit({"episodes": self._empty("episodes"), "processed": self._empty("processed"), "memories": self._as_given("memories", left, touched)})
        return self.compact()

    def meditate(self, rate: float = 0.001, floor: float = 0.05, cooldown_hours: float = 0.0, keep: int | None = None) -> DataFrame | None:
        """Fade, expire, prune and, with a model, draw facts from new episodes; gives the counts of the run, None within the cooldown.

        Pinned and immutable facts do not fade. Facts of a retention under .05 that are older than thirty days go.
        """
        runs = self.store.table("runs").where("kind = 'meditate'")
        since = F.unix_timestamp(self.time()) - cooldown_hours * 3600
        if cooldown_hours and not runs.where(F.unix_timestamp("started_at") >= since).isEmpty():
            return None
        before = written(self.memories())
        held = F.coalesce("pinned", F.lit(False)) | F.coalesce("immutable", F.lit(False))
        days = L.days_between(F.col("updated_at"), self.time())
        faded = F.when(held, F.col("importance")).otherwise(L.decayed(F.coalesce("importance", F.lit(0.5)), days, rate))
        kept = L.retention(days, F.coalesce("stability", F.lit(1.0)))
        lost = ~held & ((faded < floor) | ((kept < 0.05) & (days > 30)) | F.coalesce(P.stored_time(F.col("expiration_date")) <= self.time(), F.lit(False)))
        rows = before.withColumn("_lost", F.coalesce(lost, F.lit(False))).withColumn("importance", faded).where("not _lost").drop("_lost")
        if keep is not None:
            gone = L.pruned(rows, ["user_id"], keep, "importance", held)
            rows = rows.join(gone.select("id"), "id", "left_anti").select(*before.columns)
        after = written(rows)
        told = written(S.counters(before, after, "id", ["content", "importance"]))
        self.store.commit({"memories": self._as_given("memories", after), "runs": Append(told.select(self.time().alias("started_at"), F.lit("meditate").alias("kind"), "created", "updated", "deleted", "unchanged"))})
        if self.model is not None:
            self.add(self.drawn_facts())
        return told

    def drawn_facts(self) -> DataFrame:
        """Facts that the model draws from the episodes, for ``add``; empty without a model."""
        asked = self.store.table("episodes").withColumn("answer", answered(self.model or SilentAnswerer())(F.concat(F.lit("List the facts as JSON: "), "summary")))
        facts = E.facts_from_answers(asked.where("answer is not null").select("id", "answer"), "answer").where("op in ('ADD', 'UPDATE')")
        return facts.join(asked.select("id", "user_id"), "id").select("user_id", F.col("fact").alias("content"))

    def draw_graph(self, texts: DataFrame) -> None:
        """Entities and relations that the model reads from ``texts(user_id, content)``; known ones are not repeated."""
        told = answered(self.model or SilentAnswerer())(F.concat(F.lit("List the relations as JSON: "), "content"))
        found = written(texts.select("user_id", F.explode(graph_from_answers(told)).alias("r")).select("user_id", "r.*"))
        names = found.select("user_id", F.explode(F.array("source", "target")).alias("name"))
        base = self.store.table("entities")
        known = base.select("user_id", F.lower("name").alias("_n")).distinct()
        fresh = names.withColumn("_n", F.lower("name")).join(known, ["user_id", "_n"], "left_anti").groupBy("user_id", "_n").agg(F.min("name").alias("name"))
        fresh = fresh.select(F.md5(F.concat_ws("|", "user_id", "_n")).alias("id"), "name", F.lit(None).cast("string").alias("entity_type"), "user_id")
        entities = written(base.unionByName(fresh))
        relations = self.store.table("relations")
        end = lambda c: entities.select("user_id", F.lower("name").alias(f"_{c}"), F.col("id").alias(c)).groupBy("user_id", f"_{c}").agg(F.min(c).alias(c))
        ids = found.select("user_id", F.lower("source").alias("_source"), F.lower("target").alias("_target"), F.col("relation").alias("kind")).join(end("source"), ["user_id", "_source"]).join(end("target"), ["user_id", "_target"])
        self.store.commit({"entities": entities, "relations": W.inserted_if_absent(relations, ids.select(*relations.columns).distinct(), relations.columns)})

    def reflect(self, user_id: str, k: int = 50) -> DataFrame:
        """Principles that the model draws from a user's most important facts, added as identity facts; gives the history rows."""
        top = self.list(user_id, limit=k).agg(F.array_join(F.collect_list("content"), "\n").alias("t"))  # k facts
        told = answered(self.model or SilentAnswerer())(F.concat(F.lit("What follows? Give principles as JSON: "), "t"))
        rows = top.select(F.explode(principles_from_answers(told)).alias("content")).withColumns({"user_id": F.lit(user_id), "resolution": F.lit("identity")})
        return self.add(rows)

    def diagnose(self) -> DataFrame:
        """``(part, fine, detail, ms)``: whether store, embedder and model answer, and how fast."""
        out = []
        for name, probe in {
            "store": lambda: json.dumps(self.store.stats()),
            "embedder": lambda: str(len(self.embedder.embed(["probe"])[0]) == self.embedder.dimensions),
            "model": lambda: "none" if self.model is None else self.model.answer(["probe"], 0.0)[0][:80],
        }.items():
            began = time.perf_counter()
            try:
                detail, fine = probe(), True
            except Exception as e:  # noqa: BLE001  # a part that is down is what is asked for
                detail, fine = str(e)[:200], False
            out.append((name, fine, detail, (time.perf_counter() - began) * 1000))
        return self.spark.createDataFrame(out, "part string, fine boolean, detail string, ms double")

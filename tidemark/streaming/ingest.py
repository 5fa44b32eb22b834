"""Idempotent ingest and session state on Structured Streaming."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


#: Parts of the store by a hash of the key.
PARTS = 64


def payload_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``payload``: a hash of the named columns, nulls told from empty texts."""
    return df.withColumn("payload", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def split_batch(stored: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, replayed, conflicting) rows of a batch, both with ``payload``.

    A key that the store has with the same payload is a replay, with another one a conflict; keys that differ
    within the batch conflict as well, equal rows of it count once.
    """
    kinds = batch.groupBy(key).agg(F.count_distinct("payload").alias("_kinds"))
    once = batch.dropDuplicates([key, "payload"]).join(kinds, key)
    clean, torn = once.where("_kinds = 1").drop("_kinds"), once.where("_kinds > 1").drop("_kinds")
    known = stored.select(key, F.col("payload").alias("_stored")).distinct()
    new = clean.join(known.select(key), key, "left_anti")
    met = clean.join(known, key)
    return new, met.where("payload = _stored").drop("_stored"), met.where("payload <> _stored").drop("_stored").unionByName(torn)


def ingest(spark: SparkSession, source: DataFrame, key: str, columns: list[str], store: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the parquet ``store`` exactly once a key; conflicts go to ``rejected``.

    The store is partitioned by batch and by a hash of the key. A micro-batch reads back only the parts that its own
    keys fall on, and of these the key and the payload. Each batch writes folders of its own, which a retry of
    it overwrites and does not read, so a batch that failed half way repeats neither rows nor conflicts.
    """
    keyed = payload_hash(source, columns)
    stored_schema = T.StructType([keyed.schema[key], keyed.schema["payload"], T.StructField("batch_id", T.LongType()), T.StructField("key_part", T.IntegerType())])
    empty = spark.createDataFrame([], stored_schema)
    part_of = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(store)
        exists = path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).exists(path)
        batch = batch.withColumn("key_part", part_of).persist()
        touched = [r.key_part for r in batch.select("key_part").distinct().collect()]  # PARTS at most
        stored = session.read.schema(stored_schema).parquet(store) if exists else empty
        stored = stored.where(F.col("key_part").isin(touched) & (F.col("batch_id") != batch_id)).select(key, "payload")
        new, _replayed, conflict = split_batch(stored, batch, key)
        conflict.drop("key_part").write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
        new.write.mode("overwrite").partitionBy("key_part").parquet(f"{store}/batch_id={batch_id}")
        batch.unpersist()

    return keyed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(events: DataFrame, session: str, threshold: int) -> DataFrame:
    """``(session, n, compact_needed)``: unprocessed events a session; on streams in update mode."""
    return events.groupBy(session).agg(F.count("*").alias("n")).withColumn("compact_needed", F.col("n") >= threshold)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts by tumbling windows under a watermark of ``late``; an addition to explicit sessions."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def gap_sessions(events: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    """Sessions that end after ``gap`` without events."""
    return events.groupBy(by, F.session_window(time, gap)).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def hooked(changes: DataFrame, hooks: list[tuple[set[str], object]], checkpoint: str) -> StreamingQuery:
    """Call every hook (events it wants, function of a list of rows) with the changes of each batch, by partition.

    A hook that fails is skipped and the failure logged: hooks are told, they do not decide. ``changes`` has ``event``, ``id`` and ``data``.
    """

    def fire(rows) -> None:
        batch: list = []

        def send() -> None:
            for wanted, call in hooks:
                try:
                    mine = [r for r in batch if r.event in wanted]
                    if mine:
                        call(mine)
                except Exception:  # noqa: BLE001
                    logging.getLogger("tidemark").exception("hook %s failed on %d changes", getattr(call, "__name__", call), len(mine))
            batch.clear()

        for r in rows:
            batch.append(r)
            if len(batch) == 500:
                send()
        send()

    return changes.writeStream.foreachBatch(lambda df, _: df.foreachPartition(fire)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

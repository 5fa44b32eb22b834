"""A store of parquet tables in versioned directories: snapshots, backups, restores."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "manifest"
#: Folders that appends to a table may leave; more are written together.
FOLDERS = 64


class Append(NamedTuple):
    """Rows to add to a table, whose other rows stay where they are."""

    rows: DataFrame


class Store:
    """Tables under one root; a version is a set of table directories named by a manifest that is written last.

    Manifests are numbered and never changed: the one of the highest number is in force, and a new one appears by one
    rename, so a reader always finds a whole one. A writer that fails leaves the old one in force; of two writers at
    once the second is refused. Backups are manifests of their own and keep their directories.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _last(self, name: str) -> int:
        """The highest number of a manifest; 0 without one."""
        found = self._fs.globStatus(self._path(f"{self.root}/{name}-*.json")) or []
        return max((int(f.getPath().getName()[len(name) + 1 : -5]) for f in found), default=0)

    def _read(self, name: str) -> dict:
        last = self._last(name)
        if not last:
            return {}
        rows = self.spark.read.text(f"{self.root}/{name}-{last:012d}.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def _write(self, name: str, tables: dict) -> None:
        to = self._path(f"{self.root}/{name}-{self._last(name) + 1:012d}.json")
        made = self._path(f"{self.root}/{name}-{uuid.uuid4().hex}.new")
        stream = self._fs.create(made, True)
        stream.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        stream.close()
        if self._fs.exists(to) or not self._fs.rename(made, to):
            raise RuntimeError("another writer was first")

    def tables(self) -> list[str]:
        return sorted(self._read(MANIFEST))

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or of one that is kept in parts only the named ones."""
        held = self._read(MANIFEST)[name]
        if isinstance(held, list):
            return self.spark.read.parquet(*[f"{self.root}/{f}" for f in held])
        schema = StructType.fromJson(json.loads(held["schema"]))
        folders = [f"{self.root}/{f}" for p, f in held["parts"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, changed: dict[str, DataFrame | Append | tuple[DataFrame, Column, list[int]]]) -> None:
        """Write the changed tables beside the old ones, then let the manifest name them, all at once.

        A table kept in parts is given as (rows, part of a row, parts that change): its other parts stay where they are
        and are not written again. Rows of parts besides those named are an error of the caller and are left out.
        """
        now = self._read(MANIFEST)
        for name, given in changed.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            if isinstance(given, (DataFrame, Append)):
                before = now.get(name, []) if isinstance(given, Append) else []
                rows = given if isinstance(given, DataFrame) else given.rows
                if len(before) >= FOLDERS:
                    rows, before = self.table(name).unionByName(rows), []
                rows.write.parquet(f"{self.root}/{folder}")
                now[name] = [*before, folder]
                continue
            rows, part, touched = given
            rows.withColumn("_part", part).where(F.col("_part").isin(touched)).write.partitionBy("_part").parquet(f"{self.root}/{folder}")
            parts = dict(now[name]["parts"]) if isinstance(now.get(name), dict) else {}
            for p in touched:
                at = f"{folder}/_part={p}"
                if self._fs.exists(self._path(f"{self.root}/{at}")):
                    parts[str(p)] = at
                else:
                    parts.pop(str(p), None)
            now[name] = {"schema": rows.schema.json(), "parts": parts}
        self._write(MANIFEST, now)

    def backup(self, label: str) -> None:
        self._write(f"backup-{label}", self._read(MANIFEST))

    def restore(self, label: str) -> None:
        kept = self._read(f"backup-{label}")
        if not kept:
            raise ValueError(f"no backup {label}")
        self._write(MANIFEST, kept)

    def stats(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in self.tables()}

    def sizes(self) -> dict[str, int]:
        """Bytes of every table of the version in force."""
        out = {}
        for name, held in self._read(MANIFEST).items():
            folders = held if isinstance(held, list) else list(held["parts"].values())
            out[name] = sum(int(self._fs.getContentSummary(self._path(f"{self.root}/{f}")).getLength()) for f in folders)
        return out

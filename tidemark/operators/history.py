"""Histories of changing attributes: a k-way merge of co-partitioned, key-sorted snapshots."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.tables import written

#: Rows of one snapshot that are handed to the merge at a time; a task holds one such block of every snapshot.
BLOCK = 4096


def _plain(value: object) -> tuple:
    """A value in a form that sorts as the engine does: nulls first, NaN last, nested values field by field."""
    if value is None:
        return (0, 0)
    if isinstance(value, float) and value != value:
        return (2, 0)
    if isinstance(value, dict):
        value = tuple(_plain(v) for v in value.values())
    elif isinstance(value, (list, tuple)):
        value = tuple(_plain(v) for v in value)
    return (1, value)


def _keys(batch: pa.RecordBatch, order: list[str]) -> list[tuple]:
    """The sort key of every row; the first two columns are never null."""
    columns = [batch.column(c).to_pylist() for c in order]
    return list(zip(*columns[:2], *[map(_plain, c) for c in columns[2:]], strict=True))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(block) as source:
        return source.read_next_batch()


def sorted_blocks(batches: Iterator[pa.RecordBatch], order: list[str], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The key-sorted runs of a partition, one after the other, as blocks: key of the first row, and the rows packed.

    Rows whose keys are equal are one row; the last of them stays. Keys inside a run therefore only grow, and no
    two blocks of one run overlap.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        sources, keys = batch.column("_src").to_pylist(), _keys(batch, order)
        last = [i for i in range(len(keys) - 1) if (sources[i], keys[i]) != (sources[i + 1], keys[i + 1])]
        held = batch.slice(batch.num_rows - 1)
        for a in range(0, len(last), size):
            part = last[a : a + size]
            cuts = [k for k in range(1, len(part)) if sources[part[k]] != sources[part[k - 1]]]
            for x, z in zip([0, *cuts], [*cuts, len(part)], strict=True):
                yield _as_block(batch.take(pa.array(part[x:z])), order)
    if held is not None:
        yield _as_block(held, order)


def _as_block(rows: pa.RecordBatch, order: list[str]) -> pa.RecordBatch:
    first = [rows.column(c).slice(0, 1) for c in order]
    return pa.RecordBatch.from_arrays([*first, pa.array([_packed(rows)], pa.binary())], [*order, "_block"])


def merged_runs(blocks: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """The rows of all runs in key order, as slices with their keys.

    ``blocks`` come by their first key. A block is opened when the merge reaches that key, so one block at most
    of every run is open. The run with the least key gives all rows up to the next run's, found by bisection.
    """
    heap: list[tuple] = []
    open_blocks: dict[int, tuple[pa.RecordBatch, list[tuple]]] = {}
    number = 0

    def read() -> tuple[pa.RecordBatch, list[tuple]] | None:
        block = next(blocks, None)
        return None if block is None else (block, _keys(block, order))

    ahead = read()
    while heap or ahead is not None:
        while ahead is not None and (not heap or ahead[1][0] <= heap[0][0]):
            heappush(heap, (ahead[1][0], number, 0))
            open_blocks[number] = ahead
            number, ahead = number + 1, read()
        _, n, at = heappop(heap)
        block, keys = open_blocks[n]
        bound = min([heap[0][0]] if heap else [], default=None)
        if ahead is not None and (bound is None or ahead[1][0] < bound):
            bound = ahead[1][0]
        stop = len(keys) if bound is None else bisect_right(keys, bound, at)
        yield block.slice(at, stop - at), keys[at:stop]
        if stop < len(keys):
            heappush(heap, (keys[stop], n, stop))
        else:
            del open_blocks[n]


def _chunks(slices: Iterator[tuple[pa.RecordBatch, list[tuple]]], size: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    rows, keys = [], []
    for batch, own in slices:
        rows.append(batch)
        keys.extend(own)
        if len(keys) >= size:
            yield pa.concat_batches(rows), keys
            rows, keys = [], []
    if rows:
        yield pa.concat_batches(rows), keys


def closed_versions(slices: Iterator[tuple[pa.RecordBatch, list[tuple]]], n_tie: int, part: int) -> Iterator[pa.RecordBatch]:
    """Versions of merged rows: one is closed as soon as entity or payload changes; only the open one is held."""
    held: pa.RecordBatch | None = None
    held_end: int | None = None
    said: tuple | None = None
    first = True

    def out(rows: pa.RecordBatch, ends: list, until: list, tail: bool) -> pa.RecordBatch:
        nonlocal first
        n = rows.num_rows
        head = [first and k == 0 for k in range(n)]
        first = False
        columns = {c: rows.column(c) for c in rows.schema.names if c not in ("_src", "own_end")}
        known = [u is not None for u in until]
        more = {"own_end": pa.array(ends, pa.int64()), "until": pa.array(until, pa.int64()), "_until_known": pa.array(known), "_head": pa.array(head), "_tail": pa.array([tail] * n), "_part": pa.array([part] * n, pa.int32())}
        columns |= more
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    for rows, keys in _chunks(slices, BLOCK):
        ends = rows.column("own_end").to_pylist()
        starts = []
        for i, key in enumerate(keys):
            own = (key[0], key[2 + n_tie :])
            if own != said:
                starts.append(i)
                said = own
        if held is not None and (not starts or starts[0] > 0):
            held_end = ends[starts[0] - 1 if starts else -1]
        if not starts:
            continue
        versions = rows.take(pa.array(starts))
        own_ends = [ends[z - 1] for z in [*starts[1:], len(ends)]]
        if held is not None:
            versions, own_ends = pa.concat_batches([held, versions]), [held_end, *own_ends]
        entity, begin = versions.column("_e").to_pylist(), versions.column("from").to_pylist()
        until = [begin[k + 1] if entity[k] == entity[k + 1] else None for k in range(len(begin) - 1)]
        held, held_end = versions.slice(len(begin) - 1), own_ends[-1]
        if until:
            yield out(versions.slice(0, len(until)), own_ends[:-1], until, False)
    if held is not None:
        yield out(held, [held_end], [None], True)


def _stitched(pdf: pd.DataFrame, payload: list[str]) -> pd.DataFrame:
    """Close the versions at the edges of partitions, at most two per partition and entity."""
    pdf = pdf.sort_values(["_part", "_tail"], kind="stable").reset_index(drop=True)
    keep: list[dict] = []
    for row in pdf.to_dict("records"):
        last = keep[-1] if keep else None
        same = last is not None and last["_tail"] and all(_same(last[c], row[c]) for c in payload)
        if same:  # the version runs on across the edge
            last.update({k: row[k] for k in ("until", "_until_known", "_tail", "own_end")})
            continue
        if last is not None and last["_tail"]:
            last.update(until=row["from"], _until_known=True)
        keep.append(row)
    return pd.DataFrame(keep, columns=pdf.columns).astype({"until": "Int64", "own_end": "Int64"})


def _same(a: object, b: object) -> bool:
    if hasattr(a, "tolist"):
        a = a.tolist()
    if hasattr(b, "tolist"):
        b = b.tolist()
    return _plain(a) == _plain(b) or (not isinstance(a, (list, dict)) and not isinstance(b, (list, dict)) and bool(pd.isna(a) and pd.isna(b)))


def build_history(snapshots: list[DataFrame], entity: str, start: str, payload: list[str], end: str | None = None, tie: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Every version of every entity with the period ``[from, until)`` in which it held.

    ``snapshots`` are frames that all have the columns ``entity``, ``start`` (bigint), ``payload`` and, if named,
    ``end`` (bigint); other columns are ignored. One exchange co-partitions them by the same ranges of (entity,
    start), in which every snapshot is sorted by itself; a task then merges these runs k ways, a block of
    ``block`` rows of each at a time, and emits a version as soon as the payload changes. It holds a block of
    every snapshot and one open version, never a history, and an entity that holds a large part of all rows is
    spread over several ranges. What the tasks give is written once, since another evaluation could cut the
    ranges elsewhere; the versions at their edges, two per range and entity, are stitched afterwards.

    A version ends where the next one of its entity begins; the last one ends at its last row's ``end``, else
    it is open (null). Repeated rows and rows whose payload did not change add no version. Rows of equal start
    follow ``tie``, then payload; all but the last of them get periods of no length. Rows with a null entity or
    start are dropped; null payloads are values like any other. Empty inputs give an empty result.
    """
    tie = [c for c in (tie or []) if c not in payload]
    reserved = {"_e", "_src", "_block", "from", "until", "own_end", "_until_known", "_head", "_tail", "_part"} & {*payload, *tie} | {entity} & {*payload, *tie, "from", "until"}
    if reserved:
        raise ValueError(f"reserved column names: {sorted(reserved)}")
    end_col = F.col(end).cast("bigint") if end else F.lit(None).cast("bigint")
    parts = [
        s.select(F.lit(k).alias("_src"), F.col(entity).alias("_e"), F.col(start).cast("bigint").alias("from"), *[F.col(c) for c in [*tie, *payload]], end_col.alias("own_end"))
        for k, s in enumerate(snapshots)
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("_e is not null and `from` is not null")
    order = ["_e", "from", *tie, *payload]
    runs = rows.repartitionByRange("_e", "from").sortWithinPartitions("_src", *order, "own_end")
    block_schema = T.StructType([*[runs.schema[c] for c in order], T.StructField("_block", T.BinaryType())])
    extra = [T.StructField("until", T.LongType()), T.StructField("_until_known", T.BooleanType()), T.StructField("_head", T.BooleanType()), T.StructField("_tail", T.BooleanType()), T.StructField("_part", T.IntegerType())]
    schema = T.StructType([*[f for f in runs.schema.fields if f.name != "_src"], *extra])
    n_tie = len(tie)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = (_unpacked(b) for batch in batches for b in batch.column("_block").to_pylist())
        yield from closed_versions(merged_runs(blocks, order), n_tie, TaskContext.get().partitionId())

    blocks = runs.mapInArrow(lambda batches: sorted_blocks(batches, order, block), block_schema)
    out = written(blocks.sortWithinPartitions(*order).mapInArrow(merge, schema))
    edge = F.col("_head") | F.col("_tail")
    stitched = out.where(edge).groupBy("_e").applyInPandas(lambda pdf: _stitched(pdf, payload), schema)
    final = out.where(~edge).unionByName(stitched)
    return final.select(F.col("_e").alias(entity), *payload, "from", F.when(F.col("_until_known"), F.col("until")).otherwise(F.col("own_end")).alias("until"))

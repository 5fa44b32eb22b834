"""Packing of texts into containers of fixed token capacity, by harmonic classes."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folder of the public tokenizers, and the vocabulary that texts are measured with.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Reciprocal classes; what is shorter than capacity / CLASSES is filled in by running sums.
CLASSES = 64
#: Pieces of one class that one task packs.
GROUP = 50_000


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _vocabulary(folder: str, vocabulary: str) -> bytes:
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return f.read()


def encoding(folder: str, vocabulary: str):
    """The tokenizer of a file of base64 tokens and ranks."""
    return _encoding(_vocabulary(folder, vocabulary))


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document; null texts have none and are left out, empty ones count 0.

    The vocabulary is read by the driver and sent along, so that executors need not have the file.
    """
    slim = documents.select("doc_id", "text").where("text is not null")
    kind = slim.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(_vocabulary(folder, vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _encoding(sent.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": pd.Series([len(own.encode_ordinary(t)) for t in pdf["text"]], dtype="int64")})

    return slim.mapInPandas(count, f"doc_id {kind}, n_tokens bigint")


def pack(sizes: DataFrame, capacities: list[tuple[int, int]], classes: int = CLASSES, group: int = GROUP) -> DataFrame:
    """``(budget_id, bin_id, doc_id, piece, start_token, n_tokens)``: the pieces of every document in containers of each capacity.

    ``sizes`` has ``doc_id`` and ``n_tokens``; ``capacities`` are (budget_id, tokens), a short stated list. A
    document longer than a capacity is cut into full containers and a rest; no other is cut. A piece of a size
    in (C / (k + 1), C / k] is of class k, and every container of class k holds k of them; pieces up to
    C / ``classes`` are filled in one after the other while the running sum stays below C - C / ``classes``,
    which leaves room for the last. A container of class k is filled to k / (k + 1) at least.

    Classes are packed independently, and a class of many pieces by several tasks of ``group`` pieces each, so
    none grows with the data; each leaves one container at most that is not full. The single piece of a class-1
    container leaves a gap; where the gap is C / q or more, the container takes one piece of class q besides, as
    long as there are any: both are numbered within (q, task), and equal numbers share a container. Null sizes and sizes of 0 take no room and give no rows; repeated rows are packed each.
    Empty inputs give an empty result.
    """
    if not capacities:
        return sizes.select(F.lit(0).alias("budget_id"), F.lit("").alias("bin_id"), "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start_token"), "n_tokens").where("false")
    budgets = F.array(*[F.struct(F.lit(int(b)).alias("budget_id"), F.lit(int(c)).cast("bigint").alias("capacity")) for b, c in capacities])
    each = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(budgets).alias("b")).select("doc_id", "n_tokens", "b.*")
    cuts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("bigint"))
    pieces = each.select("doc_id", "budget_id", "capacity", "n_tokens", F.explode(cuts).alias("piece"))
    start = (F.col("piece") * F.col("capacity")).alias("start_token")
    pieces = pieces.select("budget_id", "capacity", "doc_id", "piece", start, F.least("capacity", F.col("n_tokens") - start).alias("n_tokens"))
    kind = F.least(F.floor(F.col("capacity") / F.col("n_tokens")), F.lit(classes)).cast("int")
    pieces = pieces.withColumn("class", kind)
    full = pieces.where("n_tokens = capacity").withColumn("bin_id", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), "piece"))
    parts = pieces.where("n_tokens < capacity")
    gap = F.ceil(F.col("capacity") / (F.col("capacity") - F.col("n_tokens"))).cast("int")
    parts = parts.withColumn("one", F.col("class") == 1).withColumn("q", F.least(F.when(F.col("one"), gap).otherwise(F.col("class")), F.lit(classes)))
    counts = parts.groupBy("budget_id", "q").agg(F.ceil(F.count("*") / group).alias("tasks"))  # classes * budgets rows at most
    salted = parts.join(F.broadcast(counts), ["budget_id", "q"]).withColumn("task", F.pmod(F.xxhash64("doc_id", "piece"), F.col("tasks")))
    slot = Window.partitionBy("budget_id", "q", "task")
    salted = salted.withColumn("rank", F.row_number().over(slot.orderBy(F.desc("one"), F.desc("n_tokens"), "doc_id", "piece")) - 1)
    small = F.when(F.col("one"), F.lit(0)).otherwise(F.col("n_tokens"))
    before = F.sum(small).over(slot.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - small
    salted = salted.withColumns({"ones": F.sum(F.col("one").cast("int")).over(slot.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "before": before})
    room = F.col("capacity") - F.floor(F.col("capacity") / classes)
    nth = F.col("rank") - F.col("ones")  # the large pieces come first, so `ones` counts them all here
    shared = (F.col("q") < classes) & (nth < F.col("ones"))
    name = lambda *parts: F.concat_ws("-", *[x.cast("string") for x in parts])
    c = F.col
    bin_id = (
        F.when(c("one"), name(F.lit(1), c("q"), c("task"), c("rank")))
        .when(shared, name(F.lit(1), c("q"), c("task"), nth))
        .when(c("q") < classes, name(c("q"), c("task"), F.floor((nth - c("ones")) / c("q"))))
        .otherwise(name(c("q"), c("task"), F.floor(c("before") / room)))
    )
    packed = salted.withColumn("bin_id", bin_id)
    cols = ["budget_id", "bin_id", "doc_id", "piece", "start_token", "n_tokens"]
    return full.select(*cols).unionByName(packed.select(*cols))


def usage(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """``(budget_id, capacity, bins, tokens, used, largest)`` of a packing; ``used`` is the share of the room taken."""
    budgets = F.create_map(*[F.lit(int(x)) for kv in capacities for x in kv])
    bins = packed.groupBy("budget_id", "bin_id").agg(F.sum("n_tokens").alias("held"))
    out = bins.groupBy("budget_id").agg(F.count("*").alias("bins"), F.sum("held").alias("tokens"), F.max("held").alias("largest"))
    return out.withColumn("capacity", budgets[F.col("budget_id")]).withColumn("used", F.col("tokens") / (F.col("bins") * F.col("capacity")))

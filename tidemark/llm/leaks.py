"""Held-out passages inside training texts: SimHash windows, Hamming blocks, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.normal import characters, tokens
from tidemark.tables import written

#: Runs of successive tokens that are compared: words, and single characters of Chinese texts.
RUN = {False: 3, True: 4}
#: Runs in one fingerprint. Between two stretches that a copy keeps, RUN - 1 runs at least are broken (by a word
#: put in or taken out; a changed one breaks RUN). A copy that keeps half of all runs therefore keeps RUN - 1
#: successive ones somewhere, and its window there is one of the passage, unless the passage is short.
WINDOW = {False: 2, True: 3}
#: Runs under which half a passage may be kept in stretches shorter than a window; there each run is one.
SHORT = {False: 5, True: 13}
#: Bits in which fingerprints may differ; they are cut into one block more.
RADIUS = 1
#: Characters of passages that one pass may hold in a task; more passages are searched for in several passes.
PASSAGE_CHARS = 20_000_000

_TABLE_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hashes(found: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` successive tokens."""
    if len(found) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(found) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _scramble(out * _MIX + found[k : len(found) - n + 1 + k] + np.uint64(k + 1))
    return out


def fingerprints(runs: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every ``window`` successive runs: each bit is that of the majority, and set where it ties.

    Of two runs that is the bitwise OR of their hashes; of three a true majority.
    """
    if window == 1 or len(runs) < window:
        return runs if window == 1 else np.empty(0, np.uint64)
    out = []
    for a in range(0, len(runs) - window + 1, 100_000):
        part = runs[a : a + 100_000 + window - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        count = len(part) - window + 1
        total = bits[:count].copy()
        for k in range(1, window):
            total += bits[k : count + k]
        out.append(np.packbits(total * 2 >= window, axis=1).reshape(-1).view(np.uint64))
    return np.concatenate(out)


class _Hasher:
    """64-bit hashes of tokens, each computed once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in found], np.uint64)


def passage_runs(text: str | None, hasher: _Hasher) -> tuple[bool, np.ndarray]:
    """Whether a passage is mostly Chinese, and the hashes of its runs in order."""
    found = tokens(text or "")
    chinese = sum(1 for w in found if len(w) == 1 and "㐀" <= w) * 2 > len(found)
    return chinese, run_hashes(hasher(characters(found) if chinese else found), RUN[chinese])


class Passages:
    """The passages of one pass, with the block index of their fingerprints; several may be of one item.

    ``items`` are (item, text) or (item, text, counts): how many items have each of the passage's distinct runs, by the
    run's hash as a signed number; without them all runs weigh the same.
    """

    def __init__(self, items: list[tuple], radius: int = RADIUS):
        hasher = _Hasher()
        self.radius = radius
        self.items: list[int] = []
        self.runs: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        prints: dict[tuple[bool, int], list[tuple[np.ndarray, int]]] = {}
        for item, text, *more in items:
            counts = more[0] if more else None
            chinese, runs = passage_runs(text, hasher)
            if not len(runs):
                continue
            window = WINDOW[chinese] if len(runs) >= SHORT[chinese] else 1
            distinct = np.unique(runs)
            prints.setdefault((chinese, window), []).append((np.unique(fingerprints(runs, window)), len(self.items)))
            self.items.append(item)
            self.runs.append(distinct)
            self.weights.append(np.ones(len(distinct)) if counts is None else 1 / np.array([counts[r] for r in distinct.view(np.int64).tolist()]))
        self.index = {key: self._blocks(rows) for key, rows in prints.items()}

    def _blocks(self, rows: list[tuple[np.ndarray, int]]) -> tuple:
        values = np.concatenate([p for p, _ in rows])
        owners = np.concatenate([np.full(len(p), i, np.int64) for p, i in rows])
        blocks = []
        for b in range(self.radius + 1):
            keys = self.block(values, b)
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[self.slot(keys)] = True
            blocks.append((table, keys[order], order))
        return values, owners, blocks

    def block(self, values: np.ndarray, b: int) -> np.ndarray:
        """The ``b``-th of radius + 1 blocks of bits: at least one of them agrees within the radius."""
        low, high = 64 * b // (self.radius + 1), 64 * (b + 1) // (self.radius + 1)
        return (values >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def near(self, prints: np.ndarray, key: tuple[bool, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and passages of all fingerprints within the radius of one of a passage."""
        values, owners, blocks = self.index[key]
        places, items = [], []
        for b, (table, keys, order) in enumerate(blocks):
            own = self.block(prints, b)
            hit = np.flatnonzero(table[self.slot(own)])
            first, last = np.searchsorted(keys, own[hit], "left"), np.searchsorted(keys, own[hit], "right")
            count = last - first
            at = np.repeat(hit, count)
            entry = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(hit) else np.empty(0, np.int64)
            entry = order[entry]
            close = np.bitwise_count(values[entry] ^ prints[at]) <= self.radius
            places.append(at[close])
            items.append(owners[entry[close]])
        return np.concatenate(places), np.concatenate(items)

    def held(self, passage: int, runs: np.ndarray) -> float:
        """The weighted share of a passage's distinct runs that are among ``runs``."""
        weights = self.weights[passage]
        return float(weights[np.isin(self.runs[passage], runs)].sum() / weights.sum())

    def search(self, texts: list[str], share: float, hasher: _Hasher) -> list[tuple[int, int, float]]:
        """(place of the text, item, share held) for all texts that hold at least ``share`` of an item."""
        words = [tokens(t) for t in texts]
        out = []
        for chinese in (False, True):
            windows = [w for c, w in self.index if c == chinese]
            if not windows:
                continue
            n = RUN[chinese]
            who = [k for k, w in enumerate(words) if len(w) >= n and (not chinese or any(len(x) == 1 and "㐀" <= x for x in w))]
            runs = [run_hashes(hasher(characters(words[k]) if chinese else words[k]), n) for k in who]
            if not runs:
                continue
            size = np.array([len(r) for r in runs])
            joined, text_of = np.concatenate(runs), np.repeat(np.arange(len(runs)), size)
            pairs: set[tuple[int, int]] = set()
            for w in windows:
                prints = fingerprints(joined, w)
                at, passage = self.near(prints, (chinese, w))
                inside = text_of[at] == text_of[at + w - 1]
                pairs |= set(zip(text_of[at[inside]].tolist(), passage[inside].tolist(), strict=True))
            for k, passage in pairs:
                got = self.held(passage, runs[k])
                if got >= share:
                    out.append((who[k], self.items[passage], got))
        return out


def run_counts(items: DataFrame) -> DataFrame:
    """``(item_id, passage, counts)``: for the distinct runs of every passage, how many of all items have each (map<bigint, bigint>)."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["passage"], strict=True):
                chinese, found = passage_runs(text, hasher)
                yield pd.DataFrame({"item_id": item, "passage": text, "chinese": chinese, "run": np.unique(found).view(np.int64)})

    each = written(items.mapInPandas(runs, "item_id bigint, passage string, chinese boolean, run bigint"))
    known = each.groupBy("chinese", "run").agg(F.count_distinct("item_id").alias("n"))
    return each.join(known, ["chinese", "run"]).groupBy("item_id", "passage").agg(F.map_from_entries(F.collect_list(F.struct("run", "n"))).alias("counts"))


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, radius: int = RADIUS, rarity: bool = False, passage_chars: int = PASSAGE_CHARS) -> DataFrame:
    """``(item_id, doc_id, held)``: every document that holds ``share`` or more of an item's passage, and how much.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` (bigint) and ``passage``. What is held
    is counted in distinct runs of three words (four characters where most of a passage is Chinese), each
    weighing the same, or with ``rarity`` less the more of all items have it. Documents are read once and nothing but
    the found pairs is shuffled. The items are the stated query set: they go to the tasks in blocks of at most
    ``passage_chars`` characters, one pass over the documents a block. Fingerprints only select what the exact
    count is made for. Null and blank texts, and passages of fewer words than a run, give no rows; repeated rows
    count once; columns besides these are not read. Empty inputs give an empty result.
    """
    slim = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("passage")).where("item_id is not null and passage is not null").distinct()
    total = slim.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // passage_chars))
    if rarity:
        slim = written(run_counts(slim))
    texts = documents.select("doc_id", "text").where("text is not null")
    kind = texts.schema["doc_id"].dataType.simpleString()
    spark = documents.sparkSession

    def one_pass(b: int) -> DataFrame:
        part = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r.item_id, r.passage, r.counts if rarity else None) for r in part.toLocalIterator()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            passages, hasher = Passages(sent.value, radius), _Hasher()
            for pdf in batches:
                ids, all_texts, a = pdf["doc_id"].to_numpy(), pdf["text"].tolist(), 0
                while a < len(all_texts):
                    z, chars = a, 0
                    while z < len(all_texts) and (z == a or chars + len(all_texts[z]) < 500_000):
                        chars += len(all_texts[z])
                        z += 1
                    found = passages.search(all_texts[a:z], share, hasher)
                    if found:
                        yield pd.DataFrame({"item_id": np.array([f[1] for f in found], np.int64), "doc_id": [ids[a + f[0]] for f in found], "held": [f[2] for f in found]})
                    a = z

        return texts.mapInPandas(search, f"item_id bigint, doc_id {kind}, held double")

    found = reduce(DataFrame.unionByName, [one_pass(b) for b in range(blocks)])
    return found.groupBy("item_id", "doc_id").agg(F.max("held").alias("held"))

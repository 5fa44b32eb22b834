"""Vector functions as column expressions and Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is zero or the lengths differ; null for null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def similarity_to(query: list[float]):
    """A pandas UDF: cosine similarity of a vector column to one query; null for null, 0 for other lengths."""
    q = np.asarray(query, np.float64)
    length = float(np.linalg.norm(q))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        fits = vectors.map(lambda v: v is not None and len(v) == len(q)).to_numpy(bool)
        out = np.where(vectors.isna(), np.nan, 0.0)
        if fits.any() and length:
            rows = np.stack([np.asarray(v, np.float64) for v in vectors[fits]])
            norms = np.linalg.norm(rows, axis=1)
            with np.errstate(all="ignore"):
                out[fits] = np.where(norms > 0, rows @ q / np.where(norms > 0, norms, 1) / length, 0.0)
        return pd.Series(out).astype("Float64")

    return score


def lexical_embedding(dims: int = 256):
    """A pandas UDF: words (weight 2) and character 1-, 2- and 3-grams (.25, .75, 1) hashed into buckets, length one."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import xxhash

        def one(t: str) -> list[float]:
            low = t.lower()
            v = np.bincount([xxhash.xxh64_intdigest(w) % dims for w in low.split()], minlength=dims) * 2.0
            points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            grams = np.zeros(len(points), np.uint64)
            for n, weight in ((1, 0.25), (2, 0.75), (3, 1.0)):  # each n-gram's hash from that of the one shorter
                if len(points) < n:
                    break
                with np.errstate(over="ignore"):
                    grams = (grams[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                    grams ^= grams >> np.uint64(29)
                v += weight * np.bincount((grams % np.uint64(dims)).astype(np.int64), minlength=dims)
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).astype(np.float32).tolist()

        return texts.map(one, na_action="ignore")

    return embed

"""Extension points for models: embedders, language models, rerankers and tokenizers, and deterministic stand-ins.

An extension is a plain object with one method over a list of texts; it travels to the executors with the function that
calls it once an Arrow batch. No model is called here, and none is needed: the stand-ins make every operator testable.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import _mended, auto_tokens

#: Tries of a structured answer, and how much warmer each is asked for.
TRIES, WARMER = 3, 0.1


class Embedder(Protocol):
    """Vectors of texts, all of ``dimensions`` values."""

    dimensions: int
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Answerer(Protocol):
    """A language model: one answer a prompt."""

    def answer(self, prompts: list[str], temperature: float) -> list[str]: ...


class MockEmbedder:
    """Vectors that depend on nothing but the bytes of a text; equal texts have equal vectors, others hardly similar ones.

    Each value comes from 32-bit arithmetic over the bytes, seeded by its place; the vector has length one.
    """

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.name = dimensions, f"mock-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        place = np.arange(self.dimensions, dtype=np.uint32)
        with np.errstate(over="ignore"):
            value = place * np.uint32(2654435761)  # fixed values: the multipliers of the mixing
            for at, byte in enumerate(text.encode()):
                value = value + np.uint32(byte) * (np.uint32(at & 0xFFFFFFFF) + place + np.uint32(1))
                value = (value ^ (value >> np.uint32(16))) * np.uint32(0x045D9F3B)
        x = value.astype(np.float32) / np.float32(2**32 - 1) * 2 - 1
        norm = np.linalg.norm(x)
        return (x / norm if norm else x).tolist()


class SilentAnswerer:
    """Answers nothing; operators then take their way without a model."""

    def answer(self, prompts: list[str], temperature: float) -> list[str]:
        return ["" for _ in prompts]


def embedded(embedder: Embedder) -> Callable[[Column], Column]:
    """A function of a text column: its vectors, asked for once an Arrow batch; null for null."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        given = texts[texts.notna()]
        vectors = embedder.embed(given.tolist())
        if any(len(v) != embedder.dimensions for v in vectors):
            raise ValueError(f"{embedder.name} gave vectors of another length than {embedder.dimensions}")
        return pd.Series(vectors, index=given.index, dtype=object).reindex(texts.index).where(texts.notna(), None)

    return embed


def answered(model: Answerer, schema: type | tuple[type, ...] = (dict, list), tries: int = TRIES, temperature: float = 0.0) -> Callable[[Column], Column]:
    """A function of a prompt column: the model's answers as JSON, mended; null where none could be read.

    Prompts whose answer is no JSON of the wanted kind are asked again, a little warmer, ``tries`` times in all.
    """

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        left = prompts[prompts.notna()]
        for k in range(tries):
            if not len(left):
                break
            for at, raw in zip(left.index, model.answer(left.tolist(), temperature + k * WARMER), strict=True):
                fixed = _mended(raw or "")
                try:
                    if isinstance(json.loads(fixed), schema):
                        out[at] = fixed
                except ValueError:
                    continue
            left = left[out[left.index].isna()]
        return out

    return ask


#: Tokenizers by name: functions of a text column that give an array of words. Others may be added.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"auto": auto_tokens}


def tokenizer(name: str) -> Callable[[Column], Column]:
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name}")
    return TOKENIZERS[name]


def graph_from_answers(answer: Column) -> Column:
    """``array<struct<source, relation, target>>`` from answers with ``relations``, ``triples`` or a bare list; null where there is none.

    A relation may name its parts source, relation and target, or subject, predicate and object.
    """
    item = "array<struct<source string, relation string, target string, subject string, predicate string, object string>>"
    body = F.coalesce(F.get_json_object(answer, "$.relations"), F.get_json_object(answer, "$.triples"), F.when(answer.startswith("["), answer))
    parsed = F.transform(F.from_json(body, item), lambda x: F.struct(F.coalesce(x.source, x.subject).alias("source"), F.coalesce(x.relation, x.predicate).alias("relation"), F.coalesce(x.target, x.object).alias("target")))
    return F.filter(parsed, lambda x: x.source.isNotNull() & x.relation.isNotNull() & x.target.isNotNull())


def traits_from_answers(answer: Column) -> Column:
    """``array<struct<trait_type, content, confidence>>`` from answers with ``traits`` or a bare list; confidence within 0 and 1, .5 if missing."""
    item = "array<struct<trait_type string, type string, content string, confidence double>>"
    body = F.coalesce(F.get_json_object(answer, "$.traits"), F.when(answer.startswith("["), answer))
    sure = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.confidence, F.lit(0.5))))
    parsed = F.transform(F.from_json(body, item), lambda x: F.struct(F.coalesce(x.trait_type, x.type, F.lit("other")).alias("trait_type"), x.content.alias("content"), sure(x).alias("confidence")))
    return F.filter(parsed, lambda x: F.coalesce(F.trim(x.content), F.lit("")) != "")


def principles_from_answers(answer: Column) -> Column:
    """``array<string>`` of what a reflection concludes: ``principles``, ``insights`` or a bare list; blank ones are left out."""
    body = F.coalesce(F.get_json_object(answer, "$.principles"), F.get_json_object(answer, "$.insights"), F.when(answer.startswith("["), answer))
    return F.filter(F.from_json(body, "array<string>"), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")

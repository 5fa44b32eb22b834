"""Personal data in free text: found by the character tagger, replaced by typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.pii_labels import KINDS
from tidemark.llm.tagger import Tagger, load, model_bytes

_WORDY = re.compile(r"[\p{Latin}\p{M}\d]")
_EMAILY = re.compile(r"[A-Za-z0-9._+\-]")
#: Digits in groups of three, two and four: a social number, never a telephone.
_SOCIAL = re.compile(r"\d{3}([\- ])\d\d\1\d{4}")
#: Articles and possessives, with which no full name begins.
_ARTICLE = re.compile(r"(?:the|an?|my|your|his|her|our|mon|ma|mes|la|le|les|une?|el|los|las|una|der|die|das|eine?)\s")
#: Texts that one call of the tagger gets.
CHUNK = 4096


def _whole(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact bounds of a tagged span, and whether it can be what it is tagged as; None if not."""
    while a < b and (text[a].isspace() or (text[a] in ",;:!?<>\"'“”„«»。、，：；（(" and not (kind == "phone" and text[a] in "（("))):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:!?<>\"'“”„«»。、，：；"):
        b -= 1
    if a >= b:
        return None
    inner = _EMAILY if kind == "email" else _WORDY
    if inner.match(text[a]):
        while a > 0 and inner.match(text[a - 1]):
            a -= 1
    if kind == "email":
        while a < b and text[a] in "._+-":
            a += 1
    if kind == "phone":
        while a > 0 and text[a - 1] in "+＋(（":
            a -= 1
    if inner.match(text[b - 1]):
        while b < len(text) and inner.match(text[b]):
            b += 1
    span = text[a:b]
    digits = sum(c.isdigit() for c in span)
    if kind == "name":
        words = re.findall(r"\p{L}[\p{L}\p{M}'’\-]*", span)
        fits = not digits and not _ARTICLE.match(span) and (len(words) >= 2 or bool(re.search(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]{2}", span)))
    elif kind == "email":
        fits = len(span) >= 6 and bool(re.search(r"[@＠]|\bat\b", span, re.I))
    elif kind == "phone":
        fits = 7 <= digits <= 17 and not re.search(r"\p{L}", span)
    elif kind == "id_number":
        fits = digits >= 5
    else:
        fits = digits >= 1 and bool(re.search(r"\p{L}", span))
    return (a, b) if fits else None


def spans_of(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a tagged text, in order and without overlaps."""
    raw: list[list] = []
    for p in np.flatnonzero(tags):
        kind, begins = KINDS[(tags[p] - 1) // 2], tags[p] % 2 == 1
        last = raw[-1] if raw else None
        if last and last[2] == kind and (p == last[1] or (p - last[1] <= 2 and not begins)) and not (begins and p - last[0] > 2 and p == last[1] and kind != "phone"):
            last[1] = int(p) + 1
        else:
            raw.append([int(p), int(p) + 1, kind])
    out: list[tuple[int, int, str]] = []
    for a, b, kind in raw:
        exact = _whole(text, a, b, kind)
        if exact and (not out or exact[0] >= out[-1][1]):
            out.append((*exact, "id_number" if kind == "phone" and _SOCIAL.fullmatch(text, *exact) else kind))
    return out


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of every text; equal texts are tagged once."""
    known: dict[str, list] = {}
    new = list(dict.fromkeys(t for t in texts if t))
    for a in range(0, len(new), CHUNK):
        part = new[a : a + CHUNK]
        for t, tags in zip(part, tagger.tags(part), strict=True):
            known[t] = spans_of(t, tags) if tags.any() else []
    return [known.get(t, []) if t else [] for t in texts]


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in capitals and brackets; the rest is unchanged."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``(*keys, kind, start_at, end_at)``: every personal datum in ``text``; positions count code points from 0.

    Every row is tagged on its own, whole, by the trained model, so nothing is shuffled; texts longer than a
    window are decoded in overlapping windows and put together. Rows with a null, empty or blank text give no
    rows; repeated rows give theirs again; columns besides keys and text are not read. Tags are checked for what
    their kind must have (digits, letters, an at sign) and widened to whole words.
    """
    if {"kind", "start_at", "end_at", "_text"} & {*keys}:
        raise ValueError("keys must not be named kind, start_at, end_at or _text")
    slim = df.select(*keys, F.col(text).alias("_text")).where("_text is not null")
    fields = [slim.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("kind", T.StringType()), T.StructField("start_at", T.LongType()), T.StructField("end_at", T.LongType())])
    sent = df.sparkSession.sparkContext.broadcast(model_bytes())

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = load(sent.value)
        for pdf in batches:
            found = tagged_spans(tagger, pdf["_text"].tolist())
            row = np.repeat(np.arange(len(pdf)), [len(f) for f in found])
            flat = [s for f in found for s in f]
            if not flat:
                continue
            out = pd.DataFrame({k: pdf[k].to_numpy()[row] for k in keys}, columns=keys)
            out["kind"] = [s[2] for s in flat]
            out["start_at"] = np.array([s[0] for s in flat], np.int64)
            out["end_at"] = np.array([s[1] for s in flat], np.int64)
            yield out

    return slim.mapInPandas(find, schema)


def mask_pii(df: DataFrame, text: str, out: str = "masked") -> DataFrame:
    """``df`` with a column ``out``: ``text`` with placeholders for personal data; null stays null.

    A column named ``out`` is replaced; all others stay as they are.
    """
    sent = df.sparkSession.sparkContext.broadcast(model_bytes())

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = load(sent.value)
        for texts in batches:
            found = tagged_spans(tagger, texts.tolist())
            yield pd.Series([masked(t, f) if t is not None else None for t, f in zip(texts, found, strict=True)], dtype=object)

    return df.withColumn(out, mask(F.col(text)))

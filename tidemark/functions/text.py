"""Text functions as column expressions."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are words of their own.
CJK = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff"
_GAP = "[\\s\\p{Punct}]+"

# The words that the contradiction score looks for.
NEGATIONS = [
    "not", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "cannot", "never", "no longer", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "shouldn't", "couldn't",
    "不", "没有", "没", "从不", "并非", "未", "别", "不再", "不会", "无法",
]
ANTONYMS = [
    ("like", "dislike"), ("love", "hate"), ("good", "bad"), ("open", "close"), ("start", "stop"), ("buy", "sell"), ("agree", "disagree"), ("always", "never"), ("happy", "sad"), ("fast", "slow"),
    ("hot", "cold"), ("big", "small"), ("easy", "hard"), ("right", "wrong"), ("win", "lose"), ("accept", "reject"), ("allow", "forbid"), ("connect", "disconnect"), ("include", "exclude"), ("increase", "decrease"),
    ("喜欢", "讨厌"), ("好", "坏"), ("开", "关"), ("买", "卖"), ("同意", "反对"), ("总是", "从不"), ("快乐", "悲伤"), ("快", "慢"), ("热", "冷"), ("大", "小"),
    ("容易", "困难"), ("对", "错"), ("赢", "输"), ("接受", "拒绝"), ("允许", "禁止"), ("连接", "断开"), ("包含", "排除"), ("增加", "减少"), ("开始", "结束"), ("爱", "恨"),
]
PREFERENCES = [
    "switched to", "changed to", "now prefer", "now prefers", "moved to", "replaced with", "no longer use", "no longer uses", "stopped using", "instead of", "gave up", "switched from", "transitioned to",
    "改成", "改成了", "改为", "换成", "换成了", "现在用", "不再用", "转向了", "替换成", "放弃了", "改用了", "从此用", "不用了",
]


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-case words between white space and ASCII punctuation."""
    return _filled(F.split(F.lower(text), _GAP))


def cjk_tokens(text: Column) -> Column:
    """Each CJK character by itself, other runs as words."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{CJK}]|[^{CJK}\\s\\p{{Punct}}]+"), F.lit(0))


def auto_tokens(text: Column) -> Column:
    """CJK tokens for texts that hold such characters, else words."""
    return F.when(text.rlike(f"[{CJK}]"), cjk_tokens(text)).otherwise(tokens(text))


def overlap_score(text: Column, query: list[str]) -> Column:
    """Share of the query's tokens that the lower-case text contains, as substrings; 0 without tokens."""
    if not query:
        return F.lit(0.0)
    hits = reduce(lambda a, b: a + b, [F.lower(text).contains(q).cast("int") for q in query])
    return F.coalesce(hits / F.lit(float(len(query))), F.lit(0.0))


def identifiers(text: Column) -> Column:
    """Distinct tokens of four bytes or more with a digit, trimmed of punctuation but for inner marks."""
    words = F.transform(F.split(text, "\\s+"), lambda x: F.regexp_replace(x, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    return F.array_distinct(F.filter(words, lambda x: (F.octet_length(x) >= 4) & x.rlike("[0-9]")))


def token_estimate(text: Column) -> Column:
    """A rough token count: a quarter of the bytes, and ten."""
    return F.floor(F.octet_length(text) / 4) + 10


def first_date(text: Column) -> Column:
    """The first ISO date, month or year (19xx or 20xx) of a text; null without one."""
    found = F.regexp_extract(text, "\\b((?:19|20)[0-9]{2}(?:-[0-9]{2}(?:-[0-9]{2})?)?)\\b", 1)
    return F.nullif(found, F.lit(""))


def date_prefix(text: Column) -> Column:
    """What a leading ``[Date: ...]`` says; null without one."""
    return F.nullif(F.regexp_extract(text, "^\\[Date: ([^\\]]*)\\]", 1), F.lit(""))


def numbers(text: Column) -> Column:
    """Positive numbers in digits, with commas and decimals, as doubles."""
    raw = F.regexp_extract_all(text, F.lit("[0-9][0-9.,]*"), F.lit(0))
    values = F.transform(raw, lambda x: F.rtrim(F.replace(x, F.lit(","), F.lit("")), F.lit(".")).try_cast("double"))
    return F.filter(values, lambda x: x > 0)


def contains_any(text: Column, markers: list[str]) -> Column:
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, [lower.contains(m) for m in markers])


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters, with dots where something is cut."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def partial_date(text: Column) -> Column:
    """A year or month alone as its first day; anything else unchanged."""
    return F.when(text.rlike("^[0-9]{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)


_LITERALS = {"True": "true", "False": "false", "None": "null"}
_JSON_PIECE = re.compile(r"""(?P<double>"(?:[^"\\]|\\.)*")|(?P<single>'(?:[^'\\]|\\.|'(?!\s*(?:[,:}\]]|$)))*'(?=\s*(?:[,:}\]]|$)))|(?P<word>[A-Za-z_]+)|(?P<comma>,(?=\s*[}\]]))|(?P<other>.)""", re.S)


def _mended(answer: str) -> str:
    """One pass over strings, words and marks; what is inside a string stays as it is."""
    thought = answer.rfind("</think>")
    body = answer[thought + 8 :] if thought >= 0 else answer
    fence = body.find("```")
    if fence >= 0:
        start = body.find("\n", fence) + 1 if body[fence + 3 :].lstrip(" ").startswith(("json", "\n")) and "\n" in body[fence:] else fence + 3
        end = body.find("```", start)
        body = body[start : end if end >= 0 else None]
    out = []
    for m in _JSON_PIECE.finditer(body):
        piece = m[0]
        if m["single"]:
            piece = json.dumps(re.sub(r"\\(.)", r"\1", piece[1:-1]), ensure_ascii=False)
        elif m["word"]:
            piece = _LITERALS.get(piece, piece)
        elif m["comma"]:
            continue
        out.append(piece)
    return "".join(out).strip()


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """JSON out of a model's answer: thoughts and code fences go, Python literals, quotes and trailing commas are mended.

    Strings are left as they are, whatever they hold; null stays null. What is no JSON after this is for the caller.
    """
    return texts.map(_mended, na_action="ignore")


@F.pandas_udf(T.StringType())
def content_hash(texts: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits over the UTF-8 bytes, in 16 hex digits; null for null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return texts.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def chinese_numbers(texts: pd.Series) -> pd.Series:
    """Numbers below a thousand in Chinese numerals; null for null."""
    import re

    digits = {c: k for k, c in enumerate("零一二三四五六七八九")} | {"两": 2}

    def value(run: str) -> float:
        total = 0
        for hundreds, tens, rest in [re.fullmatch(r"(?:(.*)百)?(?:(.*?)十)?(.*)", run).groups()]:
            last = lambda s: digits.get(s[-1], 1) if s else 1
            total = (100 * last(hundreds) if hundreds is not None else 0) + (10 * last(tens) if tens is not None else 0) + (digits.get(rest[-1], 0) if rest else 0)
        return float(total)

    return texts.map(lambda t: [value(r) for r in re.findall("[零一二两三四五六七八九十百]+", t)], na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def candidate_entities(texts: pd.Series) -> pd.Series:
    """Names that a text seems to hold: quoted strings of 2 to 50 bytes, and runs of capitalised words not at its start."""
    import re

    stop = {"I", "The", "A", "An", "This", "That", "It", "We", "He", "She", "They", "You", "In", "On", "At", "And", "But", "Or", "If", "So"}
    quoted = re.compile("[\"“「]([^\"”」]+)[\"”」]")
    run = re.compile(r"(?<=\s)(?:[A-Z][A-Za-z0-9]+(?:\s|$)){1,4}")

    def one(t: str) -> list[str]:
        found = [q for q in quoted.findall(t) if 2 <= len(q.encode()) <= 50]
        for r in run.findall(re.sub(r"([.,!?;:])", r" \1 ", t)):
            words = [w for w in r.split() if w not in stop]
            if words:
                found.append(" ".join(words))
        return list(dict.fromkeys(found))

    return texts.map(one, na_action="ignore")


def contradiction_score(old: Column, new: Column, is_newer: Column) -> Column:
    """How much ``new`` speaks against ``old``: .30 negation, .20 antonyms, .20 preference, .15 numbers, .15 time."""
    neg = contains_any(old, NEGATIONS) != contains_any(new, NEGATIONS)
    a, b = F.lower(old), F.lower(new)
    opposed = reduce(
        lambda x, y: x | y,
        [(a.contains(p) & ~a.contains(q) & b.contains(q) & ~b.contains(p)) | (a.contains(q) & ~a.contains(p) & b.contains(p) & ~b.contains(q)) for p, q in ANTONYMS],
    )
    changed = F.exists(numbers(old), lambda x: F.exists(numbers(new), lambda y: (x != y) & (F.greatest(x, y) / F.least(x, y) < 10)))
    term = lambda cond, w: F.when(cond, w).otherwise(0.0)
    return term(neg, 0.30) + term(opposed, 0.20) + term(contains_any(new, PREFERENCES), 0.20) + term(changed, 0.15) + term(is_newer, 0.15)


def parsed_list(text: Column) -> Column:
    """A list of texts from JSON, or from words between commas; blank ones are left out, null stays null."""
    plain = F.transform(F.split(text, ","), F.trim)
    return _filled(F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(plain))


def formatted_list(values: Column) -> Column:
    """A list of texts as JSON; null stays null."""
    return F.to_json(values)

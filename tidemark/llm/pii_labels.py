"""Labelled spans to train the tagger on: listed names and the shapes of personal numbers and addresses.

The rules are narrow on purpose; they label a bounded sample of rows, from which the tagger learns the
contexts. They take no part in tagging.
"""

from __future__ import annotations

import regex as re

KINDS = ["name", "email", "phone", "id_number", "address"]

_D = r"[\d０-９]"
_SEP = r"[ .\-－/]?"
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._+\-]*"
_AT = r"(?: ?[@＠] ?| ?[\(\[](?:at|AT)[\)\]] ?| AT )"
_DOT = r"(?:\.| ?[\(\[](?:dot|DOT)[\)\]] ?| DOT )"

#: Shapes of the numbers and addresses in the training rows.
SHAPES: dict[str, list[str]] = {
    "email": [rf"(?<![A-Za-z0-9._+\-]){_LOCAL}{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+"],
    "id_number": [
        r"(?<![\d\-])9\d\d([\- ]?)\d\d\1\d{4}(?![\d\-])",
        r"(?<![\p{L}\d])QQ ?\d\d ?\d\d ?\d\d ?[A-D](?!\p{L})",
        r"(?<![A-Za-z\d])[A-Z]\d[A-Z]\d\d[A-Z]\d{3}(?!\d)",
        r"(?<![\d+])\d{2} ?\d{3} ?\d{3} ?\d{3}(?![\d])(?=[^。]*$|[^。]*\p{Latin})",
        r"(?<!\d)[12] ?\d\d ?\d\d ?99 ?\d{3} ?\d{3} ?\d\d(?!\d)",
        r"(?<!\d)\d{2}\.?\d{3}\.?\d{3}-?[A-Z](?![A-Za-z])|(?<![A-Za-z])[XYZ]-?\d{7}-?[A-Z](?![A-Za-z])",
        rf"(?<!{_D})99{_D}{{4}} ?(?:19|20){_D}{{6}} ?{_D}{{3}}[\dXx０-９](?!{_D})",
        rf"(?<!{_D})(?<=(?:番号は|番号:|番号：)){_D}{{4}}[ \-]?{_D}{{4}}[ \-]?{_D}{{4}}(?!{_D})",
    ],
    "phone": [
        r"(?<![\d\-])(?:\+1[ \-.]?|1[\-. ])?(?:\(\d{3}\) ?|\d{3}[\-. ]?)555[\-. ]?01\d\d(?!\d)",
        r"(?<!\d)(?:\+44 ?(?:\(0\) ?)?|0044 ?|0)7700 ?900 ?\d{3}(?!\d)",
        r"(?<![\d])(?:\+49 ?\(?0?\)?30[ /\-]?|0049 ?30[ /\-]?|\(030\) ?|030[ /\-]?)23125[ \-]?\d{3}(?!\d)",
        rf"(?<!\d)(?:\+33 ?(?:\(0\) ?)?1|0033 ?1|01){_SEP}99{_SEP}00{_SEP}\d\d{_SEP}\d\d(?!\d)",
        r"(?<![\d])(?:\+34[ \-]?|0034[ \-]?)?900(?:[ \-.]?\d){6}(?!\d)",
        rf"(?<!{_D})(?:[+＋](?:86|８６)[ \-]?|(?:0086|００８６) ?)?[1１]{_D}{{2}}[ \-－]?[0０]{{4}}[ \-－]?{_D}{{4}}(?!{_D})",
        rf"(?<!{_D})(?:[+＋](?:81|８１)[ \-]?[9９][0０]|[0０][9９][0０])[ \-－]?[0０]{{4}}[ \-－]?{_D}{{4}}(?!{_D})",
        rf"(?<!{_D})[(（]?(?:010|０１０)[)）]?[ \-－]?(?:555|５５５){_D}(?:[ \-－]?{_D}){{3,5}}(?!{_D})",
    ],
    "address": [
        r"(?<![\p{L}\d])\d{1,4}[A-Da-d]? \p{L}+ (?i:road|street|st\.|st|lane|avenue|ave\.|ave|rd\.|ln\.|drive|court|way|close|blvd\.?|boulevard|square|terrace|crescent|row)(?!\p{L})(?:, (?i:apt|flat|unit) \d+)?(?:, \p{L}+ \d{5})?",
        r"(?<![\p{L}])\p{Lu}\p{L}*(?i:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer) \d{1,4} ?[a-d]?(?![\p{L}\d])(?:, \d{5} \p{L}+)?",
        r"(?<![\p{L}\d])\d{1,4}(?: (?:bis|ter))?,? (?i:rue|place|avenue|boulevard|bd|chemin|impasse|allée|quai|av\.)(?: (?:de la|du|des|de l'|de|d'))? ?\p{L}+(?:, \d{5} \p{L}+)?",
        r"(?<![\p{L}])(?i:c/|calle|avda\.|avenida|plaza|pza\.|paseo|camino)(?: (?:de la|del|de))? \p{L}+,? \d{1,4}(?:, \d+º ?[A-Z]?)?(?:, \d{5} \p{L}+)?",
        rf"(?:\p{{Han}}{{2}}省)?\p{{Han}}{{2}}市\p{{Han}}{{2}}[区县]\p{{Han}}{{2}}[路街巷弄道]{_D}+[号弄](?:{_D}+号)?(?:{_D}+单元)?(?:{_D}+室)?",
        rf"\p{{Han}}{{2,3}}[県都府道]\p{{Han}}{{2,4}}[市区郡]\p{{Han}}{{2,3}}[町村]{_D}+(?:[\-－]{_D}+)*",
    ],
}

_COMPILED = [(k, re.compile(p)) for k in ("email", "address", "phone", "id_number") for p in SHAPES[k]]


#: Frequent family names and characters of given names, from which names in Chinese and Japanese are made up.
_HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹"
_HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉萍红建文志国雨欣思远子涵浩宇佳怡梓轩晓"
_JA_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 松本 井上 木村 斎藤 清水 山崎 阿部 池田 橋本".split()
_JA_GIVEN = "健太 由美 翔太 美咲 大輔 陽子 拓也 さくら 直樹 恵子 誠 葵 悠斗 結衣 蓮 ひなた 和也 真由美 浩二 あかり".split()
_ONSETS = "b br c ch d dr f fr g gr h j k kl l m n p pr qu r s sh st t th tr v w y z ø".split()
_VOWELS = "a a a e e e i i o o u ai ea ia io ou á é í ó ö ü å".split()
_CODAS = ["", "", "", "n", "r", "l", "s", "nd", "rt", "ck", "sz", "ll", "m", "th", "k"]


def made_up_name(rng, kind: str) -> str:
    """A name of no list: from syllables in Latin letters, else of a family and a given name in Chinese or Japanese."""
    pick = lambda values: values[rng.integers(len(values))]
    if kind == "han":
        return pick(_HAN_FAMILY) + "".join(pick(_HAN_GIVEN) for _ in range(1 + rng.integers(2)))
    if kind == "kana":
        return pick(_JA_FAMILY) + pick(["", "", " "]) + pick(_JA_GIVEN)
    word = lambda n: "".join(pick(_ONSETS[:-1] if k else _ONSETS) + pick(_VOWELS) + pick(_CODAS) for k in range(n)).capitalize()
    first, last = word(1 + rng.integers(3)), word(1 + rng.integers(3))
    last = pick([last, last, last, last, f"Mc{last}", f"{last}-{word(1)}", f"{word(1)} {last}"])
    return pick([f"{first} {last}", f"{first} {last}", f"{first} {last}", f"{last}, {first}"])


class Labeller:
    """Spans of a text as (start, end, kind); the names are the full names of listed persons."""

    def __init__(self, names: list[str]):
        latin = [n.split() for n in names if n and n.isascii() and len(n.split()) == 2]
        first, last = ({n[k] for n in latin} for k in (0, 1))
        other = [re.escape(n) for n in names if n and not n.isascii()]
        f, s = "|".join(sorted(first, key=len, reverse=True)), "|".join(sorted(last, key=len, reverse=True))
        parts = [rf"(?<!\p{{L}})(?:(?:{f})\s+(?:{s})|(?:{s}),?\s+(?:{f}))(?!\p{{L}})"] * bool(latin) + ["|".join(sorted(other, key=len, reverse=True))] * bool(other)
        self.first, self.last, self.other = sorted(first), sorted(last), sorted(n for n in names if n and not n.isascii())
        self.names = re.compile("|".join(parts) or r"(?!)", re.I)

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        found: list[tuple[int, int, str]] = []
        for kind, pattern in [("name", self.names), *_COMPILED]:
            for m in pattern.finditer(text):
                if all(m.end() <= a or m.start() >= b for a, b, _ in found):
                    found.append((m.start(), m.end(), kind))
        return sorted(found)

    def varied(self, text: str, rng) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with other names, listed and mixed anew or made up, other digits and other spellings of its spans; with the new spans."""
        out, spans, at = [], [], 0
        length = 0
        for a, b, kind in self(text):
            span = text[a:b]
            if kind == "name" and rng.random() < 0.6:
                wide = any("\u3040" <= c <= "\u9fff" for c in span)
                japanese = wide and any("\u3040" <= c < "\u3100" for c in text)
                span = made_up_name(rng, "kana" if japanese else "han" if wide else "latin")
            elif kind == "name":
                if span.isascii() and self.first:
                    f, s = self.first[rng.integers(len(self.first))], self.last[rng.integers(len(self.last))]
                    span = [f"{f} {s}", f"{f} {s}", f"{s}, {f}", f"{f}  {s}"][rng.integers(4)]
                elif not span.isascii() and self.other:
                    span = self.other[rng.integers(len(self.other))]
            elif rng.random() < 0.3:  # other digits, but for the first
                span = span[:1] + "".join(str(rng.integers(10)) if c.isascii() and c.isdigit() else c for c in span[1:])
            if kind != "id_number":
                span = [span, span, span.lower(), span.upper()][rng.integers(4)]
            out += [text[at:a], span]
            length += a - at
            spans.append((length, length + len(span), kind))
            length += len(span)
            at = b
        return "".join([*out, text[at:]]), spans

"""Sentence boundaries in any script: standard break properties, then suppression by language, paragraph by paragraph."""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ALL = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)


def characters(kind: str) -> frozenset[str]:
    """All characters of a Unicode class."""
    return frozenset(re.findall(kind, _ALL))


#: Characters of the standard sentence-break classes: terminators, full stops that may be something else, marks after
#: which a sentence goes on; and opening and closing punctuation.
STERM, ATERM, SCONTINUE = (characters(rf"\p{{Sentence_Break={k}}}") for k in ("STerm", "ATerm", "SContinue"))
ASKING = frozenset(c for c in STERM if re.search("EXCLAMATION|QUESTION|INTERROGATION|INTERROBANG", unicodedata.name(c, "")))
FULL = STERM - ASKING
TERMINAL = STERM | ATERM | {"…"}
CLOSING = characters(r"[\p{Pe}\p{Pf}]") - {"’"}
LEADING_MARKS = characters(r"[\p{Ps}\p{Pi}\p{Pd}]") | set('"¿¡*_')

#: Abbreviations that another word follows, by language, without their full stop, in lower case. Words of
#: another script than Latin tell their language themselves.
LEADING = {
    "en": "dr prof mr mrs ms messrs st mt gen col sgt capt lt maj rev hon pres gov sen rep no nos fig figs sec secs ch chap vol vols p pp par pt ed eds cf vs v e.g i.e viz approx ca incl excl est resp dept dist jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "dr prof hr fr frl fa dipl ing nr nrn tel abs kap art ziff bd bzw z z.b u.a d.h o.ä u d o i s s.o s.u vgl sog geb gest str inkl zzgl einschl evtl ggf bzgl v.a o.g ebd ca st mio mrd abb tab jan feb mär apr jun jul aug sep sept okt nov dez",
    "fr": "m mm mme mmes mlle me dr pr st ste no nos p pp p.ex ex env éd chap tél av bd boul art cf fig vol janv févr avr juil sept oct nov déc",
    "es": "sr sra sres srta dr dra d d.ª dña prof pág págs p pp núm núms no aprox avda av cap art fig vol p.ej ej lic ing st sta sto ene feb mar abr may jun jul ago sep oct nov dic",
    "hi": "डॉ श्री श्रीमती प्रो पं",
    "ar": "د أ م ص",
    "ru": "ул д г гг кв пл пер просп корп стр рис табл гл т.е т.к т.н см ср напр им акад проф др св о тел",
}
#: Abbreviations that may also end a sentence.
EITHER = {
    "en": "inc ltd co corp llc plc bros jr sr etc u.s u.k u.n e.u u.s.a a.m p.m a.d b.c dept kg km cm mm g mg ml min hrs lb lbs oz ft",
    "de": "usw ff al kg km cm mm g mg ml min std gmbh u.s e.v jr sr inc ltd co",
    "fr": "etc kg km cm mm g mg ml min s.a u.e jr inc ltd",
    "es": "etc ee.uu ud uds vd vds cía s.a s.l a.m p.m kg km cm mm g mg ml min inc ltd",
    "hi": "",
    "ar": "",
    "ru": "т.д т.п руб коп тыс млн млрд",
}
LEADING, EITHER = ({k: frozenset(v.split()) for k, v in t.items()} for t in (LEADING, EITHER))
LATIN = ["en", "de", "fr", "es"]
#: Company forms among them, after which a name goes on unless something else says so.
COMPANIES = {"inc", "ltd", "co", "corp", "llc", "plc", "bros"}
#: Abbreviations that are words as well: only a number, or a word in lower case, shows the abbreviation.
WORDS_TOO = set("no art sec par est str ex ed ch me pt ca mar jan feb apr jun jul aug sep sept oct nov dec may fig i o u d z s".split())

#: Frequent words by which a text in Latin letters tells its language.
FREQUENT = {
    "en": "the of and to is was are were it that with for on as this by from at not has have had be which they she he we you".split(),
    "de": "der die das den dem des und ist war nicht mit ein eine einen einem einer auf für von zu im am es sich auch wurde sind hat sie er wir".split(),
    "fr": "le la les des du et est était une un dans pour pas avec sur qui que au aux ce cette il elle nous vous ne se sont".split(),
    "es": "el la los las del y es era una un en para no con por que se su al lo como más fue son está este esta ella nosotros".split(),
}
#: Words before a German ordinal number.
BEFORE_ORDINAL = set("der die das den dem des am im vom zum zur beim ein eine einen einem einer jeder jede jedes jeden dieser diese dieses ab bis seit und oder".split())

#: Fixed values, closed classes for texts whose letters have no case or where all are small. Connectives that go on after
#: an ellipsis, and words that report a quotation before them, in Chinese and Japanese.
CONNECTIVES = "最后 终于 最终 然后 后来 接着 随后 结果 但是 但 可是 不过 然而 而且 而 并且 于是 才 却 やっと ようやく ついに とうとう そして それから そのあと でも しかし だが けれど また".split()
REPORTING = "就 便 然后 接着 随后 并 说 道 问 喊 叫 答 回答 写道 表示 ， 、 と って という との".split()
#: Words that join what follows to what is before them.
JOINING = set("and or as but nor which that than whose in on at to with for of from by into onto is are was were has had be so while because und oder aber sowie wie mit als von für in an auf aus bei nach zu ist sind war wurde wurden wird werden et ou mais comme que qui de des du avec sans dans sur par pour est sont y o u e pero como con sin en por para que de del es son fue".split())
#: Determiners, pronouns, question words, auxiliaries of questions, numerals, and words of time and order that open a clause.
_OPENING_WORDS = (
    "the an? my your his her its our their this that these those such each every some any many most all both either neither one two three four five six seven eight nine ten"
    " i we you he she it they nobody everybody somebody anybody everyone someone anyone nothing everything something there here"
    " who whom whose what which when where why how is are was were am do does did has have had can could will would shall should may might must please"
    " once then now later afterwards finally first last next yesterday today tomorrow if when while although though because since until after before despite during according"
)
_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
OPENING = re.compile(
    r"(?:(?:" + "|".join(_OPENING_WORDS.split()) + r")(?: of)?\b(?!\.\p{L})|no\.|(?:in|on|at|by|around|from|with|under|over|near) (?:the|an?|this|that|then|\d|" + _DAYS + r")|v?\d)"
)

#: Quotes and brackets, and the marks that close them.
PAIRS = {"“": "”", "「": "」", "『": "』", "„": "“”", "«": "»", "‹": "›", "（": "）)", "(": ")）", "［": "］", "[": "]", "【": "】", "〈": "〉", "《": "》", "〔": "〕", "〖": "〗", "｢": "｣"}
CLOSES = {c: [o for o, ends in PAIRS.items() if c in ends] for ends in PAIRS.values() for c in ends}
BRACKETS = frozenset("（(［[【〈《〔〖")

_marks = "".join(re.escape(c) for c in sorted({*PAIRS, *CLOSES, '"'}))
_stops = "".join(re.escape(c) for c in sorted(ATERM))
_PARAGRAPH = re.compile(r"(?:(?:\r\n|[\n\r\x85\u2028])[^\S\n\r\x85\u2028\u2029]*){2,}|\u2029")
_signs = r"(?![\w ])(?:[.…]{2,}|[" + _stops + r"]|[\p{Sentence_Break=STerm}…]+|[" + _marks + "])"  # the first test passes over letters fast
_MARK = re.compile(_signs)
_MARK_THAI = re.compile(_signs + r"|(?<=\p{Thai})\s+|\s+(?=\p{Thai})")
_THAI = re.compile(r"\p{Thai}")
_QUOTE = re.compile("[" + _marks + "]")
_TAIL = re.compile(r"[\p{Extended_Pictographic}--\p{Nd}#*©®™\uFE0F\u200D\U0001F3FB-\U0001F3FF\U0001F1E6-\U0001F1FF]+", re.V1)
_MORE_EMOJI = re.compile(r"(?:[^\S\n\r]*(?:[\p{Extended_Pictographic}--[\p{Nd}#*©®™]][\uFE0F\u200D\U0001F3FB-\U0001F3FF]*|[\U0001F1E6-\U0001F1FF]{2})+)+", re.V1)
_WORD_BEFORE = re.compile(r"(?:\p{L}\p{M}*\.)*[\p{L}\p{M}ªº]+$")
_SPACED = re.compile(r"(?:^|(?<=[\s(]))((?:\p{L}\. )+\p{L})$")
_NUMBER_BEFORE = re.compile(r"(?:^|\s)(\p{L}+)\s+\d{1,4}$")
_TIME_IN_FRONT = re.compile(r"(?:^|[,;]\s*)(?:and )?at\s+\d{1,2}(?::\d\d)?\s*[ap]\.?m$", re.I)
_WORD = re.compile(r"[\p{L}\p{M}]+")
_SCRIPTS = [("hi", re.compile(r"\p{Devanagari}")), ("ar", re.compile(r"\p{Arabic}")), ("ru", re.compile(r"\p{Cyrillic}"))]


def votes(text: str) -> dict[str, int]:
    """How many frequent words of each language a text in Latin letters has."""
    counts = Counter(text.lower().split())
    return {k: sum(map(counts.__getitem__, ws)) for k, ws in FREQUENT.items()}


def told(own: dict[str, int], least: int) -> str | None:
    """The language that has ``least`` votes and twice as many as any other one, if there is such."""
    first, second = sorted(own.values())[:-3:-1]
    return max(own, key=own.__getitem__) if first >= least and first >= 2 * second else None


def _pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Where the quotes and brackets of a paragraph close, by where they open; one pass. Marks without a partner are left out.

    A straight quote after a letter or digit and before a blank (inches, or a closing one that was never opened) opens nothing.
    """
    found: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for m in _QUOTE.finditer(text, start, end):
        at, c = m.start(), m[0]
        if c == '"':
            before, after = text[at - 1] if at > start else " ", text[at + 1] if at + 1 < end else " "
            if waiting.get(c):
                found[waiting[c].pop()] = at
            elif not (before.isascii() and before.isalnum() and after.isspace()):
                waiting[c] = [at]
            continue
        open_at = max((waiting[o][-1] for o in CLOSES.get(c, ()) if waiting.get(o)), default=-1)
        if open_at >= 0:
            found[open_at] = at
            waiting[text[open_at]].pop()
        elif c in PAIRS:
            waiting.setdefault(c, []).append(at)
    return found


class _Paragraph:
    """One paragraph: finds its sentences from left to right."""

    def __init__(self, text: str, start: int, end: int, lower: bool, thai: bool, whole: Callable[[], str | None]):
        self.text, self.start, self.end, self.lower, self.whole = text, start, end, lower, whole
        self.mark = _MARK_THAI if thai else _MARK
        self.known: list[str] | None = None
        self.pairs: dict[int, int] | None = None

    def closer(self, at: int) -> int:
        """Position of the mark that closes the quote or bracket opened at ``at``; -1 if there is none."""
        if self.pairs is None:
            self.pairs = _pairs(self.text, self.start, self.end)
        return self.pairs.get(at, -1)

    @property
    def languages(self) -> list[str]:
        """The language of the paragraph, else of the text, else all in Latin letters; asked for only at abbreviations."""
        if self.known is None:
            own = told(votes(self.text[self.start : self.end]), 4) or self.whole()
            self.known = [own] if own else LATIN
        return self.known

    def abbreviated(self, begin: int, at: int, word: str, table: dict[str, frozenset[str]]) -> bool:
        """Whether the word before ``at`` is an abbreviation of its language.

        That is the language of its script, that of the paragraph, or another one if more of the words right before are in that.
        """
        own = None if word.isascii() else next((k for k, script in _SCRIPTS if script.match(word)), None)
        if own:
            return word in table[own]
        having = [k for k in LATIN if word in table[k]]
        if not having:
            return False
        if any(k in having for k in self.languages):
            return True
        said = votes(self.text[max(begin, at - 200) : at])
        return max(said[k] for k in having) > max(said[k] for k in self.languages)

    def next_at(self, k: int) -> int:
        text, end = self.text, self.end
        while k < end and (text[k].isspace() or text[k] in "​﻿"):
            k += 1
        return k

    def starts(self, k: int) -> bool:
        """Whether what stands at ``k`` can start a sentence."""
        if k >= self.end:
            return True
        c = self.text[k]
        while c in LEADING_MARKS and k + 1 < self.end:  # look behind opening marks
            k = self.next_at(k + 1)
            if k >= self.end:
                return True
            c = self.text[k]
        if c.islower():
            return self.lower or (k + 1 < self.end and c == "v" and self.text[k + 1].isdigit())
        return c.isalnum() or not (c.isascii() or c in SCONTINUE)

    def goes_on(self, k: int, words: list[str]) -> bool:
        return any(self.text.startswith(w, k, self.end) for w in words)

    def stop(self, begin: int, at: int, after: int) -> bool:
        """Whether the single full stop at ``at`` ends the sentence that began at ``begin``."""
        text = self.text
        nxt = self.next_at(after)
        before = text[at - 1] if at > begin else ""
        if nxt == after and after < self.end:  # nothing stands between
            c = text[after]
            if c.isupper() and (before.islower() or before.isdigit() or before in ')"”»'):
                return not re.match(r"[\p{L}\d_-]*[/@]|[\p{L}]{1,4}\.[\p{L}]", text[after : after + 40]) and self._not_short(begin, at, after, nxt)
            return bool(not c.isascii() and c.isalpha() and not c.islower() and not before.isdigit() and before.isascii() and c > "⺀")
        if nxt >= self.end:
            return True
        return self._not_short(begin, at, after, nxt) and self.starts(nxt)

    def _not_short(self, begin: int, at: int, after: int, nxt: int) -> bool:
        text = self.text
        left = text[max(begin, at - 40) : at]
        if self.next_at(after) >= self.end:
            return True
        c = text[nxt]
        if left[-1:].isdigit():
            m = _NUMBER_BEFORE.search(left)
            return not (m and m[1].lower() in BEFORE_ORDINAL and c.isalpha())
        m = _SPACED.search(left)
        if m and len(m[1]) > 1:
            word = m[1].replace(" ", "").lower()
            if word in ("a.m", "p.m"):
                return not c.islower()
            if self.abbreviated(begin, at, word, LEADING):
                return False
        m = _WORD_BEFORE.search(left)
        if not m:
            return True
        word = m[0].lower()
        if m.start() > 0 and left[m.start() - 1] in "'’" and len(word) == 1:
            return True
        if word in ("a.m", "p.m") and _TIME_IN_FRONT.search(text[max(begin, at - 24) : at]):
            return False
        if self.abbreviated(begin, at, word, LEADING):
            if word in WORDS_TOO:
                return not (c.isdigit() or (c.islower() and not self.lower) or len(word) == 1)
            return False
        if self.abbreviated(begin, at, word, EITHER):
            if self.lower:
                if c in LEADING_MARKS or OPENING.match(text, nxt):
                    return True
                follow = _WORD.match(text, nxt)
                joins = follow and follow[0] in JOINING and text[follow.end() : follow.end() + 1] != "-"  # but "est-ce", "sont-ils" ask
                return not (word in COMPANIES or joins)
            return True
        single = len(m[0]) == 1 and (m[0].isupper() or self.lower)
        if single and m[0].isascii():
            return False  # an initial
        return not (len(m[0]) == 1 and not m[0].isascii() and m[0].isupper())

    def after_quote(self, begin: int, opened: int, close: int, after: int) -> bool:
        """Whether a quotation that ends with a terminator ends the sentence."""
        text = self.text
        nxt = self.next_at(after)
        if nxt >= self.end:
            return True
        c, head = text[nxt], self.next_at(begin) == opened
        inner = close - 1
        while inner > opened and text[inner].isspace():
            inner -= 1
        full = text[inner] in FULL or text[inner] in ATERM
        if c in SCONTINUE or self.goes_on(nxt, REPORTING):
            return False
        before = opened - 1
        while before >= begin and text[before].isspace():
            before -= 1
        led = before >= begin and text[before] in ":：,，"
        japanese = bool(re.search(r"[\p{Hiragana}\p{Katakana}]", text[max(begin, opened - 12) : close]))
        if japanese and not head:
            return True
        if head:
            return full and c.isupper()
        if c.islower():
            return self.lower and led and full
        if c.isupper() or c.isdigit() or c in '"“„«‹¿¡([（':
            return led or full
        return led

    def spans(self) -> Iterator[tuple[int, int]]:
        text, end = self.text, self.end
        begin = self.next_at(self.start)
        k = begin
        while k < end:
            m = self.mark.search(text, k, end)
            if m is None:
                break
            at, mark = m.start(), m[0]
            after, cut = m.end(), False
            if mark.isspace():
                cut = self._thai(at, after, begin)
                after = at if cut else after
            elif mark == '"' or mark in PAIRS:
                close = self.closer(at)
                if close < 0:
                    k = at + 1
                    continue
                after = close + 1
                inner = close - 1
                while inner > at and text[inner].isspace():
                    inner -= 1
                ended = inner > at and text[inner] in TERMINAL
                if ended and mark in BRACKETS:
                    cut = at == begin
                elif ended:
                    follow = text[after : after + 1] in FULL | ATERM
                    cut = not follow and self.after_quote(begin, at, close, after)
            elif mark in CLOSES:
                pass
            elif mark in ATERM:
                cut = self.stop(begin, at, after)
            else:
                while after < end and text[after] in CLOSING:
                    after += 1
                nxt = self.next_at(after)
                if set(mark) <= {".", "…"}:
                    cut = nxt >= end or (self.starts(nxt) and not (at > begin and text[at - 1].isspace()) and not self.goes_on(nxt, CONNECTIVES))
                    cut = cut and not (nxt == after and after < end and text[after].isascii() and text[after].islower())
                elif mark[0] in FULL:
                    cut = True
                elif nxt == after and after < end and text[after].isascii():
                    cut = text[after].isupper() or text[after] in '"('
                else:
                    cut = self.starts(nxt) and not (self.lower and mark[0] == "!" and text.count(" ", begin, at) < 2 and text[nxt : nxt + 1].islower())
            if cut:
                while after < end and (text[after] in ASKING or text[after] == "…"):
                    after += 1
                e = _MORE_EMOJI.match(text, after, end)
                after = e.end() if e else after
                yield begin, after
                begin = self.next_at(after)
                after = begin
            k = max(after, k + 1) if not cut else after
        if begin < end:
            last = end
            while last > begin and (text[last - 1].isspace() or text[last - 1] in "​﻿"):
                last -= 1
            if last > begin:
                yield begin, last

    def _thai(self, at: int, after: int, begin: int) -> bool:
        """A space between Thai letters, or on the edge of a run of them, ends a Thai sentence."""
        text = self.text
        if at <= begin or after >= self.end:
            return False
        if _TAIL.match(text, after):
            return False
        return bool(re.match(r"\p{Thai}", text[at - 1])) or bool(re.match(r"[\d%)]", text[at - 1]) and re.search(r"\p{Thai}", text[begin:at]))


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """The sentences of a text as (start, end) in code points, without surrounding white space.

    Null, empty and blank texts have none. A blank line always ends a sentence, a single line break does not.
    Terminators of all scripts end a sentence unless they stand in a quotation or bracket that goes on, after
    an abbreviation, initial or ordinal, or inside a number, name of a file or address of a page. Abbreviations are
    those of the language that the paragraph's frequent words tell, else the text's, else any in the same script.
    Closing marks and emoji belong to the sentence before them. In paragraphs without capital letters, the case
    of the next word is not asked for.
    """
    if not text:
        return []
    @lru_cache(maxsize=1)
    def whole() -> str | None:
        return told(votes(text), 1)

    found, at, thai = [], 0, _THAI.search(text) is not None
    for m in [*_PARAGRAPH.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        found.extend(_Paragraph(text, at, end, part.lower() == part, thai, whole).spans())
        at = m.end() if m else end
    return found


def sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``(doc_id, start_at, end_at)`` a sentence of every document.

    Documents are independent, so the texts are read once and nothing is shuffled. Documents with a null or
    blank text give no rows, an empty table an empty result; repeated rows give their sentences again, and other
    columns are not read. A long text costs time in proportion to its length.
    """
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                for a, b in sentence_spans(t):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=pdf["doc_id"].dtype), "start_at": pd.Series(starts, dtype="int64"), "end_at": pd.Series(ends, dtype="int64")})

    return slim.mapInPandas(split, f"doc_id {kind}, start_at bigint, end_at bigint")

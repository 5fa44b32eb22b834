"""Date ranges that a question asks for, in English and Chinese; evaluated on the driver, once a query."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from datetime import date, timedelta

_MONTHS = [m.lower() for m in calendar.month_name[1:]]
_NUMERALS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二"]

Range = tuple[date, date]


def _month(year: int, month: int) -> Range:
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def _months_back(today: date, n: int) -> Range:
    at = today.year * 12 + today.month - 1 - n
    return _month(at // 12, at % 12 + 1)


def _day(d: date) -> Range:
    return d, d


def _year(y: int) -> Range:
    return date(y, 1, 1), date(y, 12, 31)


def _week(today: date) -> Range:
    monday = today - timedelta(days=today.weekday())
    return monday, monday + timedelta(days=6)


def _named(m: re.Match, today: date) -> Range:
    year = m["y_before"] or m["y_after"]
    return _month(int(year) if year else today.year, _MONTHS.index(m["month"].lower()) + 1)


#: Pattern and what it means for a given day. At one place the first pattern counts.
_RULES: list[tuple[str, Callable[[re.Match, date], Range]]] = [
    (r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)", lambda m, t: _day(date(int(m[1]), int(m[2]), int(m[3])))),
    (r"(?<!\d)(\d{4})年(\d{1,2})月(?:(\d{1,2})日)?", lambda m, t: _day(date(int(m[1]), int(m[2]), int(m[3]))) if m[3] else _month(int(m[1]), int(m[2]))),
    (r"(\d+)\s*(?:days?\s+ago\b|天前)", lambda m, t: _day(t - timedelta(days=int(m[1])))),
    (r"(\d+)\s*(?:weeks?\s+ago\b|个?(?:星期|周)前)", lambda m, t: (t - timedelta(weeks=int(m[1])), t)),
    (r"(\d+)\s*(?:months?\s+ago\b|个?月前)", lambda m, t: _months_back(t, int(m[1]))),
    (r"\byesterday\b|昨天", lambda m, t: _day(t - timedelta(days=1))),
    (r"\btoday\b|今天", lambda m, t: _day(t)),
    (r"\blast\s+week\b|上周|上个星期", lambda m, t: (t - timedelta(days=7), t)),
    (r"\blast\s+month\b|上个?月", lambda m, t: _months_back(t, 1)),
    (r"\blast\s+year\b|去年", lambda m, t: _year(t.year - 1)),
    (r"\bthis\s+week\b|[这本]周", lambda m, t: _week(t)),
    (r"\bthis\s+month\b|这个月|本月", lambda m, t: _month(t.year, t.month)),
    (r"(?:\b(?P<y_before>(?:19|20)\d{2})\s+)?\b(?P<month>" + "|".join(_MONTHS) + r")\b(?:,?\s+(?P<y_after>(?:19|20)\d{2})\b)?", _named),
    (r"(十[一二]?|[一二三四五六七八九])月(?!前)", lambda m, t: _month(t.year, _NUMERALS.index(m[1]) + 1)),
    (r"(?<!\d)(1[0-2]|[1-9])月(?!前)", lambda m, t: _month(t.year, int(m[1]))),
]
_ASKING = re.compile(r"\b(when|how long|since|before|after|until|ago|recently|lately|earlier|date|time|last|next|day|week|month|year)s?\b|什么时候|多久|最近|以前|之前|之后|几号|哪天|(?:19|20)\d{2}", re.I)


def time_ranges(text: str, today: date) -> list[Range]:
    """The closed date ranges that a text names, in the order of the text and without repeats.

    Month words count as whole words only ("maybe" is no May), numbers that are no date are skipped.
    """
    taken: list[tuple[int, int]] = []
    found: list[tuple[int, Range]] = []
    for pattern, meaning in _RULES:
        for m in re.finditer(pattern, text, re.I):
            if any(m.start() < b and m.end() > a for a, b in taken):
                continue
            try:
                found.append((m.start(), meaning(m, today)))
            except (ValueError, OverflowError):
                continue
            taken.append(m.span())
    return list(dict.fromkeys(r for _, r in sorted(found, key=lambda x: x[0])))


def asks_for_time(text: str, today: date) -> bool:
    """Whether a text names or asks for a time."""
    return bool(time_ranges(text, today) or _ASKING.search(text))

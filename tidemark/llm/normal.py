"""Text in the form in which copies of it are compared."""

from __future__ import annotations

import unicodedata

import regex as re

#: Letters of other scripts that look like Latin ones (Cyrillic and Greek, after case folding).
LOOKALIKES = str.maketrans(
    "асеорухіјѕһԁԛԝвкмнтгпьɡɑοαρυνικτχε",
    "aceopyxijshdqwbkmhtrnbgaoapuviktxe",
)
_HIDDEN = re.compile(r"[\p{Cf}\p{Cc}͏ᅟᅠ឴឵⠀ㅤ︀-️]")
_LATIN = re.compile(r"\p{Latin}")
_WORD = re.compile(r"[\p{Han}]|[\p{L}\p{M}--\p{Han}]+|\p{N}+", re.V1)


def _plain(m: re.Match) -> str:
    return " " if m[0] in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85" else ""


def tokens(text: str) -> list[str]:
    """Words, single Han characters and numbers of a text, whatever its case, punctuation, spacing and marks.

    Invisible characters are taken out, compatibility forms unified, and letters of other scripts inside or
    beside Latin words replaced by the Latin letters they look like.
    """
    text = unicodedata.normalize("NFKC", _HIDDEN.sub(_plain, text)).casefold()
    found = _WORD.findall(text)
    if not text.isascii() and _LATIN.search(text):
        found = [w if w.isascii() else w.translate(LOOKALIKES) for w in found]
    return found


def characters(found: list[str]) -> list[str]:
    """The tokens of a Chinese text: numbers fall into their digits, other words stay whole."""
    out: list[str] = []
    for w in found:
        if len(w) > 1 and w[0].isdigit():
            out.extend(w)
        else:
            out.append(w)
    return out

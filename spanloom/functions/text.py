"""Text helpers: line normalisation, keyword tests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space within a line: everything but the line feed; the second set is without the blank.
_SPACE = r" \t\x0B\f\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_OTHER = _SPACE[1:]
_OTHER_CHARS = "\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _holds(text: Column, *parts: str) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def normalize_text(text: Column) -> Column:
    """One kind of line end, single spaces, no blank lines.

    Byte searches first: the patterns run only on texts that have something to change.
    """
    spaced = _holds(text, "  ", *_OTHER_CHARS)
    ragged = _holds(text, "\r", " \n", "\n ", "\n\n") | spaced
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # a lone blank needs no replacement, so it is not matched
    single = F.when(spaced, F.regexp_replace(unix, f" [{_SPACE}]+|[{_OTHER}][{_SPACE}]*", " ")).otherwise(unix)
    lines = F.regexp_replace(single, r" ?\n[ \n]*", "\n")
    return F.btrim(F.when(ragged, lines).otherwise(text), F.lit(" \n"))


# A keyword with one of these is looked up as plain text.
_PLAIN_MARKS = (" ", "(", "_", "/", ".", "-")


def has_keyword(text: Column, keyword: str) -> Column:
    """Whole-word test for plain words, substring test for keywords with punctuation."""
    found = text.contains(keyword)
    if any(mark in keyword for mark in _PLAIN_MARKS):
        return found
    # the cheap test first; the pattern runs only on texts that hold the letters
    return found & text.rlike(rf"(?<![a-z0-9_]){re.escape(keyword)}(?![a-z0-9_])")

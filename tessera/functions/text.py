r"""Unicode text primitives as Column expressions.

Java's ``\s`` and ``trim`` know ASCII only; these follow the Unicode rules (``(?U)``), the information separators
``\x1c``-``\x1f`` counting as white space too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
INK = r"[^\s\x1c-\x1f]"
#: Characters that end a line; all are white space.
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def strip_u(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def not_blank(c: Column) -> Column:
    return c != F.lit("")


def tokens_u(c: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(c, rf"(?U){SPACE}+"), not_blank)


def lines_u(c: Column) -> Column:
    """Trimmed lines that aren't blank; lines end at any Unicode line break.

    One pass: such a line goes from a character that is no white space to the last such before a break.
    """
    return F.regexp_extract_all(c, F.lit(f"(?U){INK}(?:[^{BREAKS}]*{INK})?"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once."""
    return F.transform(F.array(value), body)[0]


def paragraphs_u(c: Column) -> Column:
    """Trimmed paragraphs that aren't blank, divided by blank lines."""
    return F.filter(F.transform(F.split(c, rf"(?U)\n{SPACE}*\n"), strip_u), not_blank)


#: An answer letter with no letter, digit or underscore beside it; a combining mark beside it is no such neighbour.
LETTER = r"(?<![\p{L}\p{N}_])([A-D])(?![\p{L}\p{N}_])"


def or_null(c: Column) -> Column:
    """Null for an empty match."""
    return F.when(c != "", c)


def first_letter(c: Column) -> Column:
    return or_null(F.regexp_extract(c, LETTER, 1))


def last_letter(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(LETTER), F.lit(1)), F.lit(-1))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def first_of(c: Column, groups: list[tuple[str, list[str]]], other: str) -> Column:
    """The name of the first group with a word that is a substring of ``c``."""
    name = F.lit(other)
    for group, words in reversed(groups):
        name = F.when(any_of(c, words), F.lit(group)).otherwise(name)
    return name

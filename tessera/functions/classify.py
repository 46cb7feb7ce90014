"""Ordered classifiers: first matching group of patterns or substrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.fixed import DOMAIN_KEYWORDS, LEVEL_PHRASES, LEVELS, SOURCE_KEYWORDS
from tessera.functions.text import SPACE, first_of

Patterns = list[tuple[str, list[str]]]


def classify_patterns(text: Column, groups: Patterns = LEVEL_PHRASES, other: str = "Remember") -> Column:
    """The first group with a pattern found anywhere, letter case apart; a space in a pattern is any white space."""
    name = F.lit(other)
    for group, patterns in reversed(groups):
        joined = "|".join(p.replace(" ", SPACE + "+") for p in patterns)
        name = F.when(text.rlike(f"(?iU)(?:{joined})"), F.lit(group)).otherwise(name)
    return name


def level_from_label(response: Column, question: Column) -> Column:
    """A level named in a model's response (in ordinal order), else by the question's patterns."""
    low, name = F.lower(response), classify_patterns(question)
    for level in reversed(LEVELS):
        name = F.when(F.contains(low, F.lit(level.lower())), F.lit(level)).otherwise(name)
    return name


def classify_domain(file_name: Column, groups: Patterns = DOMAIN_KEYWORDS, other: str = "general") -> Column:
    return first_of(F.lower(file_name), groups, other)


def classify_source(path: Column, groups: Patterns = SOURCE_KEYWORDS, other: str = "unknown") -> Column:
    return first_of(path, groups, other)


def chunk_id(file_name: Column, index: Column) -> Column:
    """``<name without .pdf, spaces as _>_chunk_0007``."""
    bare = F.replace(F.replace(file_name, F.lit(".pdf"), F.lit("")), F.lit(" "), F.lit("_"))
    return F.format_string("%s_chunk_%04d", bare, index)


def qa_id(chunk: Column, level: Column, index: Column) -> Column:
    return F.concat_ws("_", chunk, F.lower(level), index.cast("string"))


def fingerprint(text: Column) -> Column:
    """First 12 hex digits of MD5."""
    return F.substring(F.md5(text), 1, 12)

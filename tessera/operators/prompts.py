"""Prompt rendering: caller-supplied templates with named places, filled by Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def render(template: str, **places: Column | str) -> Column:
    """The template with ``{name}`` replaced by columns; nulls count as empty. An unknown place raises KeyError."""
    parts = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = places[name]
            parts.append(F.coalesce(value.cast("string"), F.lit("")) if isinstance(value, Column) else F.lit(value))
    return F.concat(*parts) if parts else F.lit("")


def candidates(answers: Column, indent: str = "") -> Column:
    """Candidate answers a line each; null counts as none."""
    return F.coalesce(F.array_join(F.transform(answers, lambda x: F.concat(F.lit(indent), x)), "\n"), F.lit(""))


def truncated(text: Column, n: int = 2000) -> Column:
    return F.substring(text, 1, n)


def visual_block(summaries: Column) -> Column:
    """A bullet for each summary that isn't empty."""
    some = F.filter(summaries, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.array_join(F.transform(some, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(""))


def context_block(context: Column, condition: str, label: str, n: int = 2000) -> Column:
    return F.concat(F.lit(label + "\n"), truncated(F.coalesce(context, F.lit("")), n)) if condition == "with_context" else F.lit("")


def answer_prompt(strategy: str, templates: dict[str, str], **places: Column | str) -> Column:
    """The prompt of a strategy: templates ``standard``, ``few_shot`` and ``cot`` (self-consistency uses the last)."""
    if strategy not in ("standard", "few_shot", "cot", "self_consistency"):
        raise ValueError(f"unknown strategy: {strategy}")
    return render(templates["cot" if strategy in ("cot", "self_consistency") else strategy], **places)

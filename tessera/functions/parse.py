"""Parsing of answers and of tagged generator and critic output, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.fixed import CRITIQUE_DIMENSIONS
from tessera.functions.text import first_letter, last_letter, not_blank, strip_u

QA_TAGS = ["question", "candidate_answers", "ground_truth", "legal_rationale"]


def extract_answer(text: Column, strategy: str) -> Column:
    """The predicted letter: the first of ten characters for direct strategies, the last of the text for reasoning ones."""
    bare = strip_u(text)
    return first_letter(F.substring(bare, 1, 10)) if strategy in ("standard", "few_shot") else last_letter(bare)


def truth_letter(text: Column) -> Column:
    return first_letter(F.substring(text, 1, 5))


def is_correct(predicted: Column, truth: Column) -> Column:
    return F.coalesce(predicted == truth, F.lit(False))


def _tag(text: Column, tag: str) -> tuple[Column, Column]:
    """Whether the tag is there, and its trimmed body."""
    pattern = rf"(?isU)<{tag}>(.*?)</{tag}>"
    return text.rlike(pattern), strip_u(F.regexp_extract(text, pattern, 1))


def parse_qa(text: Column) -> Column:
    """Array of (question, candidate_answers, ground_truth, legal_rationale): blocks with all four tags."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?isU)<qa_pair>(.*?)</qa_pair>"), F.lit(1))
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(text))

    def one(block: Column) -> Column:
        found = [_tag(block, t) for t in QA_TAGS]
        lines = F.filter(F.transform(F.split(found[1][1], "\n"), strip_u), not_blank)
        lettered = F.filter(lines, lambda x: x.rlike(r"\A[A-E][.)]"))
        answers = F.when(F.size(lettered) >= 2, lettered).otherwise(lines)
        whole = found[0][0] & found[1][0] & found[2][0] & found[3][0]
        return F.when(whole, F.struct(found[0][1].alias("question"), answers.alias("candidate_answers"), found[2][1].alias("ground_truth"), found[3][1].alias("legal_rationale")))

    return F.filter(F.transform(blocks, one), lambda x: x.isNotNull())


def parse_critique(text: Column) -> Column:
    """struct of the dimensions (0 or 1), issues, suggestions, all_pass; null where a dimension is missing."""
    found = {d: _tag(text, d) for d in CRITIQUE_DIMENSIONS}
    scores = {d: F.when(F.contains(body, F.lit("1")), F.lit(1.0)).otherwise(F.lit(0.0)) for d, (_, body) in found.items()}
    there, whole = F.lit(True), F.lit(True)
    for d in CRITIQUE_DIMENSIONS:
        there, whole = there & found[d][0], whole & (scores[d] == 1.0)
    rest = [_tag(text, t)[1].alias(t) for t in ("issues", "suggestions")]
    return F.when(there, F.struct(*(s.alias(d) for d, s in scores.items()), *rest, whole.alias("all_pass")))


def critique_passes(critique: Column, threshold: float = 1.0) -> Column:
    """Whether the share of passed dimensions reaches the threshold; false for null."""
    passed = F.lit(0)
    for d in CRITIQUE_DIMENSIONS:
        passed = passed + (critique[d] == 1.0).cast("int")
    return F.coalesce(passed / F.lit(len(CRITIQUE_DIMENSIONS)) >= threshold, F.lit(False))

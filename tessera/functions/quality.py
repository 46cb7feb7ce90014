"""Text quality predicates: metadata pages, damaged recognition, valid chunks, disposition."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.fixed import EXTRACT_KEYWORDS, PREPARE_KEYWORDS
from tessera.functions.text import INK, SPACE, let, lines_u, tokens_u

#: Marks taken off both ends of a token; marks that are noise within one (fixed values).
ENDS = r""".,;:"()\[\]{}<>!?'\-"""
NOISE = r";:!<>*&^%$#@~=+|\\"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"


def is_metadata(text: Column, keywords: list[str] = PREPARE_KEYWORDS, upper_keywords: bool = True, min_body: int | None = 80) -> Column:
    """Whether a text is a cover, contents or publisher page.

    True where it has no lines, more than 0.6 of its lines start with ``#``, two keywords are in the upper-cased text or
    (``min_body``) the other lines joined by a space are shorter than that.
    """

    def named(upper: Column) -> Column:
        hits = F.lit(0)
        for k in keywords:
            hits = hits + F.contains(upper, F.lit(k.upper() if upper_keywords else k)).cast("int")
        return hits >= 2

    def shaped(lines: Column) -> Column:
        heads = F.size(F.filter(lines, lambda l: F.startswith(l, F.lit("#"))))
        found = (F.size(lines) == 0) | (heads * 10 > F.size(lines) * 6)
        if min_body is not None:  # the other lines' lengths and the spaces between them
            body = F.aggregate(lines, F.lit(-1), lambda n, l: F.when(F.startswith(l, F.lit("#")), n).otherwise(n + 1 + F.char_length(l)))
            found = found | (body < min_body)
        return found

    # Without "#" a text of so many characters that are no white space needs no lines.
    enough = ~F.contains(text, F.lit("#")) & text.rlike(rf"(?U)\A(?:{SPACE}*+{INK}){{{min_body or 1}}}")
    return let(F.upper(text), named) | F.when(enough, F.lit(False)).otherwise(let(lines_u(text), shaped))


def is_metadata_extract(text: Column) -> Column:
    """The extraction variant: fewer keywords, matched as written, and no least body."""
    return is_metadata(text, EXTRACT_KEYWORDS, upper_keywords=False, min_body=None)


def _bad_token(t: Column) -> Column:
    upper = (F.upper(t) == t) & (F.lower(t) != t)
    skipped = (t == "") | t.rlike(r"[/\-_]") | upper
    mixed = (F.char_length(t) >= 3) & t.rlike(r"(?U)\p{Lower}") & t.rlike(DIGIT)
    noisy = t.rlike(f"[{NOISE}]") & t.rlike(r"\p{L}")
    return ~skipped & (mixed | noisy)


#: Marks and digits without which a token can't be bad.
_TOLD = ";:!<>*&^%$#@~=+|\\" + "²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉①②③④⑤⑥⑦⑧⑨" + "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Nd")


def _bad(tokens: Column) -> Column:
    """How many of the tokens are bad; patterns are tried on those with a digit or a noise mark."""
    told = F.filter(tokens, lambda t: F.translate(t, _TOLD, "") != t)
    bare = F.transform(told, lambda t: F.regexp_replace(t, rf"\A[{ENDS}]+|[{ENDS}]+\z", ""))
    return F.size(F.filter(bare, _bad_token))


def bad_tokens(text: Column) -> Column:
    """How many tokens mix lower-case letters and digits, or letters and noise marks."""
    return _bad(tokens_u(text))


def token_counts(text: Column) -> Column:
    """struct(bad, total) of a text's tokens."""
    return let(tokens_u(text), lambda t: F.struct(_bad(t).alias("bad"), F.size(t).alias("total")))


def is_bad_ocr(text: Column) -> Column:
    """More than 0.05 of the tokens are bad, or there are none."""
    return let(tokens_u(text), lambda t: (F.size(t) == 0) | (_bad(t) * 20 > F.size(t)))


def has_fields(*columns: Column) -> Column:
    """All are neither null nor empty."""
    found = F.lit(True)
    for c in columns:
        found = found & F.coalesce(c.cast("string") != "", F.lit(False))
    return found


def is_valid_chunk(chunk_id: Column, text: Column, source_doc: Column, least: int = 100) -> Column:
    return has_fields(chunk_id, text, source_doc) & (F.char_length(text) >= least) & ~is_metadata(text) & ~is_bad_ocr(text)


def disposition(text: Column, qa_present: Column | None = None) -> Column:
    """The first that holds: metadata, ocr, no_qa, kept."""
    label = F.when(is_metadata(text), F.lit("metadata")).when(is_bad_ocr(text), F.lit("ocr"))
    if qa_present is not None:
        label = label.when(~qa_present, F.lit("no_qa"))
    return label.otherwise(F.lit("kept"))


def language_gate(text: Column, label: Column | None, score: Column | None, target: str, least: float = 0.5, shortest: int = 20) -> Column:
    """struct(keep, conf): with no model or under ``shortest`` characters (true, 1), else by the target's score."""
    if label is None:
        return F.struct(F.lit(True).alias("keep"), F.lit(1.0).alias("conf"))
    bare = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    short, hit = F.char_length(bare) < shortest, label == target
    keep = F.when(short, F.lit(True)).when(hit, score >= least).otherwise(F.lit(False))
    return F.struct(keep.alias("keep"), F.when(short, F.lit(1.0)).when(hit, score).otherwise(F.lit(0.0)).alias("conf"))

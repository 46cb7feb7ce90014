"""Hierarchy-aware chunking as one fold over a document's paragraphs.

A running chunk is always a range of neighbouring paragraphs (what is carried over is the last one), so the fold keeps
numbers only: first paragraph, count, length, offset. The texts are joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fixed import SECTION_STARTS
from tessera.functions.quality import is_bad_ocr, is_metadata_extract
from tessera.functions.text import paragraphs_u, strip_u

SECTION = r"(?U)\A(?:" + "|".join(SECTION_STARTS) + ")"


def is_section_boundary(paragraph: Column, pattern: str = SECTION) -> Column:
    return strip_u(paragraph).rlike(pattern)


def kept_paragraphs(text: Column) -> Column:
    """Paragraphs that are neither metadata nor damaged, joined again by blank lines."""
    return F.array_join(F.filter(paragraphs_u(text), lambda p: ~is_metadata_extract(p) & ~is_bad_ocr(p)), "\n\n")


def _ranges(size: int, overlap: int, least: int, most: int) -> str:
    """SQL of the fold over ``paras`` (text, edge, len): an array of emitted ranges."""

    def state(out: str, at: str, cnt: str, n: str, off: str) -> str:
        return f"named_struct('out', {out}, 'at', {at}, 'cnt', {cnt}, 'n', {n}, 'off', {off})"

    def let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    def emit(s: str) -> str:
        one = f"named_struct('at', {s}.at, 'cnt', {s}.cnt, 'start_char', {s}.off - {s}.n, 'end_char', {s}.off)"
        return f"if({s}.n + 2 * greatest({s}.cnt - 1, 0) >= {least} AND {s}.cnt > 0, concat({s}.out, array({one})), {s}.out)"

    carry = 1 if overlap > 0 else 0
    cut = f"if(p.edge AND s.n > {least}, {state(emit('s'), 's.at + s.cnt', '0', '0', 's.off')}, s)"
    full = state(emit("a"), f"a.at + a.cnt - {carry}", f"{carry}", f"if({carry} = 1, paras[a.at + a.cnt - 1].len, 0)", "a.off")
    full = f"if(a.n + p.len > {most} AND a.cnt > 0, {full}, a)"
    add = state("c.out", "c.at", "c.cnt + 1", "c.n + p.len", "c.off + p.len + 2")
    done = state(emit("d"), f"d.at + d.cnt - {carry}", f"{carry}", f"if({carry} = 1, p.len, 0)", "d.off")
    done = f"if(d.n >= {size} AND NOT p.edge, {done}, d)"
    step = let(cut, "a", let(full, "c", let(add, "d", done)))
    zero = state("CAST(array() AS ARRAY<STRUCT<at: INT, cnt: INT, start_char: INT, end_char: INT>>)", "0", "0", "0", "0")
    return f"aggregate(paras, {zero}, (s, p) -> {step}, s -> {emit('s')})"


def chunk_documents(docs: DataFrame, text: Column, keys: list[str], size: int = 1500, overlap: int = 200, least: int = 200, most: int = 5000, boundary: str = SECTION, whole: Column | None = None) -> DataFrame:
    """One row per chunk: the ``keys``, chunk_index, text, start_char, end_char. Null and short texts give none.

    Where ``text`` was made from the document's, ``whole`` is that one, which then has to have the least length.
    """
    base = docs.where(F.char_length(strip_u(text if whole is None else whole)) >= least).select(*keys, text.alias("__text"))
    told = F.transform(paragraphs_u(F.col("__text")), lambda p: F.struct(p.alias("text"), p.rlike(boundary).alias("edge"), F.char_length(p).alias("len")))
    ranged = base.select(*keys, told.alias("paras")).withColumn("__ranges", F.expr(_ranges(size, overlap, least, most)))
    one = ranged.select(*keys, "paras", F.posexplode("__ranges").alias("chunk_index", "r"))
    joined = F.expr("array_join(transform(slice(paras, r.at + 1, r.cnt), p -> p.text), '\n\n')")
    return one.select(*keys, "chunk_index", joined.alias("text"), "r.start_char", "r.end_char")

"""The chunk fold against a list-based reading of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.chunking import chunk_documents, is_section_boundary, kept_paragraphs


def fold(paras, size, overlap, least, most, edge):
    """Chunks by the rules: cut at a section start, cut when too long, add, cut when long enough."""
    out, cur, off = [], [], 0

    def cut(keep_last):
        text, n = "\n\n".join(cur), sum(map(len, cur))
        if cur and len(text) >= least:
            out.append((text, off - n, off))
        cur[:] = cur[-1:] if keep_last else []

    for p in paras:
        if edge(p) and sum(map(len, cur)) > least:
            cut(False)
        if cur and sum(map(len, cur)) + len(p) > most:
            cut(overlap > 0)
        cur.append(p)
        off += len(p) + 2
        if sum(map(len, cur)) >= size and not edge(p):
            cut(overlap > 0)
    cut(False)
    return out


@pytest.mark.parametrize(("size", "overlap", "least", "most"), [(1500, 200, 200, 5000), (60, 10, 20, 100), (60, 0, 20, 100), (40, 5, 3, 45)])
def test_fold(spark, size, overlap, least, most):
    rng = random.Random(size + overlap)
    scale = size // 12
    docs = []
    for i in range(60):
        paras = [("# " if rng.random() < 0.25 else "") + "x" * rng.choice([1, scale, 3 * scale, 8 * scale, size, most + 5, least, least + 1]) for _ in range(rng.randint(0, 12))]
        docs.append((i, paras))
    df = spark.createDataFrame([(i, "\n \n".join(p)) for i, p in docs], "id int, t string")
    got = {}
    for r in chunk_documents(df, F.col("t"), ["id"], size, overlap, least, most).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append((r.text, r.start_char, r.end_char))
    for i, paras in docs:
        want = fold(paras, size, overlap, least, most, lambda p: p.startswith("# ")) if len("\n \n".join(paras).strip()) >= least else []
        assert got.get(i, []) == want, i


def test_tail_and_long_paragraph(spark):
    df = spark.createDataFrame([(1, "a" * 1500), (2, "b" * 9000 + "\n\n" + "c" * 100), (3, None), (4, "short")], "id int, t string")
    rows = chunk_documents(df, F.col("t"), ["id"]).orderBy("id", "chunk_index").collect()
    assert [(r.id, len(r.text)) for r in rows] == [(1, 1500), (1, 1500), (2, 9000), (2, 9000), (2, 9102)]


def test_boundaries_and_kept_paragraphs(spark):
    texts = ["# x", "#### x", "Phần thứ nhất", "Phần ộ", "CHƯƠNG IV", "Mục 3", "Điều 12. Nội dung", "Điều 12 Nội dung", "TIỂU MỤC 2", "phần một"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.e for r in df.select("i", is_section_boundary(F.col("t")).alias("e")).orderBy("i").collect()] == [True, False, True, True, True, True, True, False, True, False]
    one = spark.createDataFrame([("# only a heading\n\nbody one\n\nh6a x9b c\n\nbody two",)], "t string").select(kept_paragraphs(F.col("t")).alias("k")).first()
    assert one.k == "body one\n\nbody two"

"""Text predicates against an independent Python reading of the rules, and at their limits."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import classify, parse, quality
from tessera.functions.fixed import PREPARE_KEYWORDS
from tessera.functions.text import lines_u, paragraphs_u, strip_u, tokens_u



def T():  # noqa: N802
    return F.col("t")


def ask(spark, texts, **columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    return df.select("i", *(c.alias(n) for n, c in columns.items())).orderBy("i").collect()


def bad_of(text):
    """(bad, total) by the rule: marks off the ends; citations and upper case are spared."""
    n = 0
    for w in text.split():
        w = w.strip(".,;:\"()[]{}<>!?'-")
        if w and not set(w) & set("/-_") and not w.isupper():
            digits = len(w) >= 3 and any(map(str.islower, w)) and any(map(str.isdigit, w))
            n += digits or (bool(set(w) & set(";:!<>*&^%$#@~=+|\\")) and any(map(str.isalpha, w)))
    return n, len(text.split())


def metadata_of(text):
    rows = [x.strip() for x in text.splitlines() if x.strip()]
    body = [x for x in rows if x[0] != "#"]
    return not rows or 10 * (len(rows) - len(body)) > 6 * len(rows) or sum(k.upper() in text.upper() for k in PREPARE_KEYWORDS) > 1 or len(" ".join(body)) < 80


LETTERS = "abAB19 .-_/;*#\n\t \x1c éĐềộ²ÀSß"


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=60), min_size=40, max_size=40))
def test_predicates_match_the_rules(spark, texts):
    got = ask(spark, texts, s=strip_u(T()), n=F.size(tokens_u(T())), rows=lines_u(T()), bad=quality.bad_tokens(T()), ocr=quality.is_bad_ocr(T()), meta=quality.is_metadata(T()), paras=paragraphs_u(T()))
    for t, r in zip(texts, got, strict=True):
        bad, n = bad_of(t)
        assert (r.s, r.n, r.bad) == (t.strip(), n, bad), repr(t)
        assert r.rows == [x.strip() for x in t.splitlines() if x.strip()], repr(t)
        assert r.ocr == (n == 0 or bad / n > 0.05) and r.meta == metadata_of(t), repr(t)
        assert r.paras == [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()], repr(t)


@pytest.mark.parametrize(
    ("token", "bad"),
    [("QH13", 0), ("45/2013/NĐ-CP", 0), ("h6a", 1), ("km²", 1), ("**bold**", 1), ("6uonn", 1), ("...", 0), ("h6", 0), ("a;b", 1), ("(luật)", 0), ("x_1a", 0), ("Đ5ề", 1)],
)
def test_bad_tokens(spark, token, bad):
    assert ask(spark, [token], n=quality.bad_tokens(T()))[0].n == bad == bad_of(token)[0]


def test_limits(spark):
    words = "word " * 19
    assert [r.o for r in ask(spark, [words + "h6a", "word " * 18 + "h6a", "", " "], o=quality.is_bad_ocr(T()))] == [False, True, True, True]
    heads = ["## Title", "# a\n" + "b" * 90, "# a\n# b\n# c\n" + "x" * 90 + "\ny", "x" * 79, "x" * 80]
    assert [r.m for r in ask(spark, heads, m=quality.is_metadata(T()))] == [True, False, False, True, False]
    text = "luật dân sự " * 10
    valid = quality.is_valid_chunk(F.lit("c"), T(), F.lit("d"))
    assert [r.v for r in ask(spark, [text[:99], text[:100], None, "", text], v=F.coalesce(valid, F.lit(False)))] == [False, True, False, False, True]
    assert not ask(spark, [text], v=quality.is_valid_chunk(F.lit(""), T(), F.lit("d")))[0].v


def test_keyword_variants(spark):
    text = "GIÁO TRÌNH luật\nChủ biên: ông A\n" + "nội dung " * 30
    r = ask(spark, [text], x=quality.is_metadata_extract(T()), y=quality.is_metadata(T()))[0]
    assert (r.x, r.y) == (False, True)


def test_disposition_and_language(spark):
    good = "một câu văn bình thường " * 8
    rows = ask(spark, ["", good], d=quality.disposition(T(), F.lit(False)), g=quality.language_gate(T(), F.lit("vi"), F.lit(0.4), "vi"), none=quality.language_gate(T(), None, None, "vi"))
    assert [r.d for r in rows] == ["metadata", "no_qa"]
    assert [tuple(r.g) for r in rows] == [(True, 1.0), (False, 0.4)] and tuple(rows[1].none) == (True, 1.0)


def test_answers(spark):
    texts = ["Bộ luật", "Đáp án: B", "AĐ", "x_A", "123456789A", "1234567890A", "", "chọn A rồi C.", "Á́ Á", None]
    rows = ask(spark, texts, a=parse.extract_answer(T(), "standard"), b=parse.extract_answer(T(), "cot"), c=parse.truth_letter(T()))
    assert [r.a for r in rows] == [None, "B", None, None, None, None, None, "A", "A", None]
    assert [r.b for r in rows] == [None, "B", None, None, None, None, None, "C", "A", None]
    assert rows[1].c is None and rows[0].c is None


def test_qa_xml(spark):
    block = "<QA_PAIR><question> q? </question><candidate_answers>A. x\n\nB) y\nnote</candidate_answers><ground_truth>A</ground_truth><legal_rationale>vì\nthế</legal_rationale></QA_PAIR>"
    bare = block.replace("<QA_PAIR>", "").replace("</QA_PAIR>", "")
    texts = ["", block + block, block.replace("ground_truth", "truth"), bare, bare.replace("A. x", "x").replace("B) y", "y")]
    rows = [r.q for r in ask(spark, texts, q=parse.parse_qa(T()))]
    assert [len(r) for r in rows] == [0, 2, 0, 1, 1]
    assert rows[1][0].candidate_answers == ["A. x", "B) y"] and rows[4][0].candidate_answers == ["x", "y", "note"] and rows[3][0].legal_rationale == "vì\nthế"


def test_critique_xml(spark):
    from tessera.functions.fixed import CRITIQUE_DIMENSIONS as DIMS

    full = "".join(f"<{d}> 10 </{d}>" for d in DIMS)
    texts = [full, full.replace("10", "0", 1), full.replace(f"<{DIMS[0]}>", "<x>"), full.upper() + "<ISSUES>a\nb</ISSUES>"]
    rows = ask(spark, texts, c=parse.parse_critique(T()), p=parse.critique_passes(parse.parse_critique(T()), 0.8))
    assert [r.c and r.c.all_pass for r in rows] == [True, False, None, True] and [r.p for r in rows] == [True, True, False, True]
    assert rows[3].c.issues == "a\nb" and rows[0].c.suggestions == ""


def test_classifiers(spark):
    texts = ["Hãy SOẠN  THẢO văn bản", "So sánh hai luật", "Nếu A xảy ra thì phải làm gì", "là gì", "hợp đồng", "Theo Điều 5", "nếu a\nthì phải"]
    assert [r.c for r in ask(spark, texts, c=classify.classify_patterns(T()))] == ["Create", "Analyze", "Apply", "Remember", "Remember", "Remember", "Remember"]
    names = ["Luat HINH SU 1.pdf", "to tung hanh chinh.pdf", "thừa kế.pdf", "x.pdf", None]
    assert [r.c for r in ask(spark, names, c=classify.classify_domain(T()))] == ["hinh_su", "hanh_chinh", "dan_su", "general", "general"]
    assert [r.c for r in ask(spark, ["/a/institute/x", "/fdvn", "/archive_org/", "/Institute"], c=classify.classify_source(T()))] == ["institute_textbook", "university_textbook", "reference_book", "unknown"]
    r = ask(spark, ["a b.pdf.pdf"], c=classify.chunk_id(T(), F.lit(7)), q=classify.qa_id(T(), F.lit("Apply"), F.lit(0)), f=classify.fingerprint(T()), lv=classify.level_from_label(F.lit("It is ANALYZE"), T()))[0]
    assert (r.c, r.q, len(r.f), r.lv) == ("a_b_chunk_0007", "a b.pdf.pdf_apply_0", 12, "Analyze")

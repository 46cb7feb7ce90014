"""Whole plans: extraction, preparation, cleaning, benchmark and report."""

import json

from pyspark.sql import functions as F

from tessera.operators.generate import Stub
from tessera.plans import corpus, experiments
from tessera.sources.writers import write_summary

BODY = "Luật này quy định về quyền và nghĩa vụ của công dân. "


def test_extract_and_prepare(spark, tmp_path):
    text = "\n\n".join(["# Tiêu đề", "Điều 1. Phạm vi\n" + BODY * 20, "h6a x9b", "Điều 2. Đối tượng\n" + BODY * 20, BODY * 3])
    docs = spark.createDataFrame([("/data/institute/Luat hinh su.pdf", text), ("/data/x/b.pdf", "short"), ("/data/x/c.pdf", None)], "path string, markdown string")
    chunks = corpus.extract_chunks(docs).orderBy("chunk_index")
    rows = chunks.collect()
    assert [r.chunk_id for r in rows] == [f"Luat_hinh_su_chunk_{i:04d}" for i in range(len(rows))] and len(rows) >= 2
    assert {(r.source_category, r.legal_domain, r.lang_confidence) for r in rows} == {("institute_textbook", "hinh_su", 1.0)}
    assert "Tiêu đề" not in rows[0].text and "h6a" not in " ".join(r.text for r in rows)
    gated = corpus.extract_chunks(docs, F.when(F.col("text").startswith("Điều 2"), "vi").otherwise("en"), F.lit(0.9)).collect()
    assert [r.chunk_index for r in gated] == [1]  # numbered before the gate
    bad = spark.createDataFrame([("s", "x", "d"), ("m", "# a\n" * 60, "d"), ("n", BODY * 5, "")], "chunk_id string, text string, source_doc string").withColumn("legal_domain", F.lit(None).cast("string"))
    out = corpus.prepare(chunks.unionByName(bad, allowMissingColumns=True), str(tmp_path))
    assert out["short"] == 1 and out["metadata"] == 1 and out["kept"]["n"] == len(rows) and out["sources"] == 1
    assert spark.read.parquet(f"{tmp_path}/by_domain").count() == len(rows)


def test_clean_and_contexts(spark):
    rows = [(1, "a", BODY * 5, "q"), (2, "a", BODY * 5, None), (3, None, "", "q"), (4, "b", "h6a x9b", "q")]
    df = spark.createDataFrame(rows, "seq int, chunk_id string, context_text string, qa string")
    assert [r.disposition for r in corpus.clean(df).orderBy("seq").collect()] == ["kept", "no_qa", "metadata", "metadata"]
    assert [(r.chunk_id, r.seq) for r in corpus.contexts(df).orderBy("seq").collect()] == [("a", 1), (None, 3), ("b", 4)]
    assert corpus.contexts(df, limit=2).count() == 2


def test_benchmark(spark, tmp_path):
    pairs = spark.createDataFrame(
        [(f"q{i}", f"question {i}", ["A. x", "B. y"], "AB"[i % 2], ["Remember", "Create"][i % 2], "ctx") for i in range(8)],
        "qa_id string, question string, candidate_answers array<string>, ground_truth string, bloom_level string, context_text string",
    )
    templates = {"standard": "S {context_block} {question} {candidates}", "few_shot": "F {exemplars} {question}", "cot": "C {question}"}
    answer = lambda: Stub(lambda p: "A" if p.startswith(("S", "F")) else "so the answer is B")
    answers = experiments.ask_all(pairs, templates, answer, str(tmp_path / "a"), k=3)
    assert answers.count() == 8 * 2 * (3 + 3)
    predictions = experiments.score_answers(answers, "m").cache()
    assert predictions.count() == 8 * 4 * 2
    cells = {(r.level, r.strategy): r for r in experiments.result_cells(predictions).where("condition = 'with_context'").collect()}
    assert cells["Remember", "standard"].accuracy == 1.0 and cells["Create", "standard"].accuracy == 0.0 and cells["Create", "self_consistency"].sc_agreement_rate == 1.0
    traces = spark.createDataFrame([("Remember", 1, True), ("Create", 2, False)], "level string, loops int, converged boolean")
    out = experiments.report(predictions, traces)
    assert out["depth_gaps"] == {"Remember": -1.0, "Create": 1.0} and out["anova"]["n"] == 32
    assert experiments.report(predictions, condition="both")["anova"]["n"] == 64
    write_summary(out, str(tmp_path / "summary.json"))
    assert json.loads((tmp_path / "summary.json").read_text())["condition"] == "with_context"

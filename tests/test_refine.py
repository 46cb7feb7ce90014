"""Refinement passes with a scripted generator."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.fixed import CRITIQUE_DIMENSIONS
from tessera.operators import prompts
from tessera.operators.generate import Stub, generate
from tessera.operators.refine import refine_in_passes, refine_traced


def qa(v):
    return f"<question>q{v}</question><candidate_answers>A. a\nB. b</candidate_answers><ground_truth>A</ground_truth><legal_rationale>r</legal_rationale>"


def critique(ok):
    return "".join(f"<{d}>{int(ok)}</{d}>" for d in CRITIQUE_DIMENSIONS)


#: id: outcome of generation, then of each (critique, refinement).
SCRIPT = {"pass1": ["p"], "pass3": ["f", "f", "p"], "never": ["f", "f", "f"], "garbled_critique": ["x", "p"], "bad_generation": None, "bad_refinement": ["f!"]}


def steps(spark):
    def answer(prompt):
        kind, name, loop = prompt.split("|")
        plan = SCRIPT[name]
        if kind == "g":
            return "nothing" if plan is None else qa(0)
        turn = plan[min(int(loop[1:]), len(plan) - 1)] if plan else "p"
        if kind == "c":
            return "garble" if turn[0] == "x" else critique(turn[0] == "p")
        return "garble" if turn.endswith("!") else qa(int(loop[1:]) + 1)

    def step(kind):
        loop = F.lit("q0") if kind == "g" else F.col("qa.question")
        return lambda df: generate(df.withColumn("prompt", F.concat_ws("|", F.lit(kind), "chunk_id", loop)), "prompt", lambda: Stub(answer)).drop("prompt")

    jobs = spark.createDataFrame([(n, "text", "doc", "Apply") for n in SCRIPT], "chunk_id string, text string, source_doc string, level string")
    return jobs, step("g"), step("c"), step("r")


def test_passes(spark, tmp_path):
    jobs, g, c, r = steps(spark)
    got = {x.chunk_id: x for x in refine_in_passes(jobs, g, c, r, str(tmp_path / "run")).collect()}
    assert {k: (x.refinement_loops, x.converged) for k, x in got.items()} == {"pass1": (1, True), "pass3": (3, True), "never": (3, False), "garbled_critique": (2, True)}
    assert got["pass3"].question == "q2" and got["pass1"].qa_id == "pass1_apply_0" and got["pass1"].source_doc == "doc"
    # a second run takes up the written passes
    import shutil

    shutil.rmtree(tmp_path / "run" / "critique-3")
    again = {x.chunk_id: x.refinement_loops for x in refine_in_passes(jobs, g, c, r, str(tmp_path / "run")).collect()}
    assert again == {k: x.refinement_loops for k, x in got.items()}


@pytest.mark.parametrize(("mode", "loops"), [("single_pass", 0), ("fixed_2", 2), ("adaptive", 3)])
def test_traced(spark, tmp_path, mode, loops):
    jobs, g, c, r = steps(spark)
    pairs, traces = refine_traced(jobs, g, c, r, str(tmp_path / mode), mode)
    got = {x.chunk_id: (x.refinement_loops, x.converged) for x in pairs.collect()}
    assert "bad_generation" not in got
    if mode == "single_pass":
        assert set(got.values()) == {(0, True)}
    elif mode == "fixed_2":
        assert got["pass1"] == (2, False) and got["never"] == (2, False) and got["garbled_critique"] == (1, False)
    else:
        assert got == {"pass1": (1, True), "pass3": (3, True), "never": (3, False), "garbled_critique": (1, False), "bad_refinement": (3, False)}
    found = {x.chunk_id: x for x in traces.collect()}
    assert set(found) == set(got) and all(len(x.loop_records) == x.total_loops for x in found.values())


def test_generate_errors(spark):
    def answer(p):
        if p == "b":
            raise ValueError(p)
        return p.upper()

    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    assert [x.output for x in generate(df, "p", lambda: Stub(answer), on_error="").collect()] == ["A", ""]


def test_prompts(spark):
    df = spark.createDataFrame([("ctx" * 1000, ["A. x", "B. y"], ["s", "", None])], "c string, a array<string>, v array<string>")
    places = dict(question=F.lit(None), candidates=prompts.candidates(F.col("a"), "  "), context_block=prompts.context_block(F.col("c"), "with_context", "Context:", 5))
    row = df.select(prompts.answer_prompt("cot", {"cot": "{context_block}|{question}|{candidates}!"}, **places).alias("p"), prompts.visual_block(F.col("v")).alias("v")).first()
    assert row.p == "Context:\nctxct||  A. x\n  B. y!" and row.v == "- s"
    with pytest.raises(ValueError):
        prompts.answer_prompt("other", {})
    with pytest.raises(KeyError):
        prompts.render("{missing}")


def test_resume_by_key(spark, tmp_path):
    """A run with more jobs asks only for the new ones, and the result is that of all of them."""
    from pyspark.sql import functions as F

    from tessera.functions.fixed import CRITIQUE_DIMENSIONS
    from tessera.operators.refine import refine_in_passes

    asked = []

    def generator(df):
        asked.append(sorted(r.chunk_id for r in df.collect()))
        return df.withColumn("output", F.lit("<qa_pair><question>q</question><candidate_answers>A. a</candidate_answers><ground_truth>A</ground_truth><legal_rationale>r</legal_rationale></qa_pair>"))

    def critic(df):
        return df.withColumn("output", F.concat(*(F.concat(F.lit(f"<{d}>"), F.when(F.col("chunk_id") != "c2", "1").otherwise("0"), F.lit(f"</{d}>")) for d in CRITIQUE_DIMENSIONS)))

    jobs = spark.createDataFrame([(f"c{i}", "t", "s", "Apply") for i in range(4)], "chunk_id string, text string, source_doc string, level string")
    run = lambda some: {(r.chunk_id, r.refinement_loops, r.converged) for r in refine_in_passes(some, generator, critic, generator, str(tmp_path / "run"), 2).collect()}
    assert run(jobs.where("chunk_id < 'c2'")) == {("c0", 1, True), ("c1", 1, True)}
    asked.clear()
    assert run(jobs) == {("c0", 1, True), ("c1", 1, True), ("c2", 2, False), ("c3", 1, True)}
    assert ["c2", "c3"] in asked and run(jobs.where("chunk_id = 'c1'")) == {("c1", 1, True)}


def test_first_rows(spark):
    """Null order and ties lose no key and repeat none."""
    from pyspark.sql import functions as F

    from tessera.operators.relational import keep_first

    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("b", 3, 3), ("b", 3, 4), (None, 5, 5), ("", 4, 6)], "k string, seq int, x int")
    got = {r.k: r for r in keep_first(df, F.col("k"), F.col("seq")).collect()}
    assert len(got) == 3 and got["a"].x == 1 and got["b"].seq == 3 and got[""].x == 6


@pytest.mark.parametrize("mode", ["fixed_3", "adaptive"])
def test_traced_lineage(spark, tmp_path, mode):
    """A first run's pairs are those of the written passes: no join with the passes before, and each row is read once."""
    jobs, g, c, r = steps(spark)
    pairs, _ = refine_traced(jobs, g, c, r, str(tmp_path / mode), mode)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 3


def test_modes_lineage(spark):
    from oracle import SF

    from tessera.plans.queries import QUERIES

    assert "Join" not in QUERIES["q29_refine_modes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_passes_lineage(spark, tmp_path, monkeypatch):
    """Pairs of a first run, and of runs that start again with the same jobs, more or fewer, are scans of written rows, and no pass broadcasts keys."""
    from pyspark.sql import DataFrameWriter

    jobs, g, c, r = steps(spark)
    plans, write = [], DataFrameWriter.parquet

    def spied(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    want = {"pass1": 1, "pass3": 3, "never": 3, "garbled_critique": 2}
    for names in (["pass1", "never"], ["pass1", "never"], list(SCRIPT), ["pass3", "pass1"], ["never", "bad_refinement"]):
        pairs = refine_in_passes(jobs.where(F.col("chunk_id").isin(names)), g, c, r, str(tmp_path / "run"))
        assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
        assert {x.chunk_id: x.refinement_loops for x in pairs.collect()} == {k: v for k, v in want.items() if k in names}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_outcome_lineage(spark):
    from oracle import SF

    from tessera.plans.queries import QUERIES

    assert "Join" not in QUERIES["q29_refine_outcome"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()

"""Benchmark plans: every question by strategy and condition as one DataFrame, and the report over result cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.functions.fixed import CONDITIONS, STRATEGIES
from tessera.operators import evaluate, prompts, stats
from tessera.operators.generate import Generator, generate
from tessera.plans.corpus import present
from tessera.schemas import levels


def ask_all(pairs: DataFrame, templates: dict[str, str], factory: Callable[[], Generator], path: str, strategies: list[str] = STRATEGIES, conditions: list[str] = CONDITIONS, k: int = 10, exemplars: str = "", label: str = "Context:") -> DataFrame:
    """Answers of one model: qa_id, level, strategy, condition, path, output; written once under ``path`` and read back.

    Self-consistency asks ``k`` times. The matrix is a product with a few rows; no loop over cells.
    """
    spark = pairs.sparkSession
    cells = [(s, c, i) for s in strategies for c in conditions for i in range(k if s == "self_consistency" else 1)]
    asked = pairs.crossJoin(F.broadcast(spark.createDataFrame(cells, "strategy string, condition string, path int")))
    question, context = present(pairs, "question_content", "question", default=""), present(pairs, "context_text", "context_payload.text", default="")
    prompt: Column = F.lit(None).cast("string")
    for s in strategies:
        for c in conditions:
            made = prompts.answer_prompt(s, templates, question=question, candidates=prompts.candidates(F.col("candidate_answers")), context_block=prompts.context_block(context, c, label), exemplars=exemplars)
            prompt = F.when((F.col("strategy") == s) & (F.col("condition") == c), made).otherwise(prompt)
    level = F.coalesce(present(pairs, "bloom_level").cast("string"), F.lit("Unknown"))
    rows = asked.select("qa_id", level.alias("level"), "ground_truth", "strategy", "condition", "path", prompt.alias("prompt"))
    generate(rows, "prompt", factory, on_error="").drop("prompt").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def score_answers(answers: DataFrame, model_name: str) -> DataFrame:
    """Predictions: model_name, qa_id, level, strategy, condition, predicted, agreement, truth, correct."""
    direct = F.col("strategy").isin("standard", "few_shot")
    letter = F.when(direct, parse.extract_answer(F.col("output"), "standard")).otherwise(parse.extract_answer(F.col("output"), "cot"))
    keys = ["qa_id", "level", "strategy", "condition", "truth"]
    voted = evaluate.majority_vote(answers.withColumn("truth", parse.truth_letter(F.col("ground_truth"))), keys, letter, F.col("path"))
    return voted.select(F.lit(model_name).alias("model_name"), *keys, F.col("winner").alias("predicted"), "agreement", parse.is_correct(F.col("winner"), F.col("truth")).alias("correct"))


def result_cells(predictions: DataFrame) -> DataFrame:
    """One row per model, level, strategy and condition; mean agreement for self-consistency."""
    agreed = F.when(F.first("strategy") == "self_consistency", F.bround(F.avg("agreement"), 4))
    return predictions.groupBy("model_name", "level", "strategy", "condition").agg(
        F.count("*").alias("total_questions"), F.count_if(F.col("correct")).alias("correct"), F.bround(evaluate.accuracy(F.col("correct")), 4).alias("accuracy"), agreed.alias("sc_agreement_rate")
    )


def report(predictions: DataFrame, traces: DataFrame | None = None, condition: str = "with_context", model_name: str | None = None) -> dict:
    """Matrix, gaps, variance analysis and refinement statistics of one condition (``both`` takes all), as plain data."""
    spark = predictions.sparkSession
    some = predictions if condition == "both" else predictions.where(F.col("condition") == condition)
    some = some if model_name is None else some.where(F.col("model_name") == model_name)
    cells = evaluate.accuracy_cells(some, ["level", "strategy", "model_name"])
    matrix = evaluate.accuracy_matrix(cells, F.col("model_name"))
    found = {
        "condition": condition,
        "accuracy_matrix": {r["level"]: {s: r[s] for s in STRATEGIES if r[s] is not None} for r in matrix.collect()},  # a row a level
        "depth_gaps": {r["level"]: r["gap"] for r in evaluate.depth_gap(matrix, levels(spark)).collect()},
        "anova": stats.anova_two_way(stats.anova_cells(some, F.col("level"), F.col("strategy"), F.col("correct").cast("int"))),
    }
    if traces is not None:
        per_level = evaluate.refinement_stats(traces, levels(spark))
        found["refinement_analysis"] = {"levels": {r["level"]: r.asDict() for r in per_level.collect()}, "spearman": stats.spearman(per_level, "ordinal", "mean_loops")}
    return found

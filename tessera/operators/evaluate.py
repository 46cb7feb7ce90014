"""Answer evaluation: majority vote, accuracy cells, matrices and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fixed import STRATEGIES


def majority_vote(votes: DataFrame, question: list[str], answer: Column, idx: Column) -> DataFrame:
    """Per question: winner, agreement, n_valid. Nulls don't vote; ties go to the answer seen first; without a vote (null, 0).

    Two pre-aggregated steps: counts by (question, answer), then the best by (count, -first index).
    """
    cells = votes.select(*question, answer.alias("__answer"), idx.alias("__idx")).groupBy(*question, "__answer").agg(F.count("*").alias("n"), F.min("__idx").alias("first"))
    valid = F.col("__answer").isNotNull()
    best = F.max_by(F.when(valid, F.col("__answer")), F.when(valid, F.struct("n", -F.col("first"))))
    n_valid = F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0))
    most = F.coalesce(F.max(F.when(valid, F.col("n"))), F.lit(0))
    return cells.groupBy(*question).agg(best.alias("winner"), F.coalesce(F.try_divide(most, n_valid), F.lit(0.0)).alias("agreement"), n_valid.alias("n_valid"))


def accuracy(correct: Column) -> Column:
    return F.count_if(correct) / F.greatest(F.count("*"), F.lit(1))


def accuracy_cells(answers: DataFrame, keys: list[str], correct: str = "correct") -> DataFrame:
    """Per cell: total_questions, correct and accuracy."""
    return answers.groupBy(*keys).agg(F.count("*").alias("total_questions"), F.count_if(F.col(correct)).alias("correct"), accuracy(F.col(correct)).alias("accuracy"))


def accuracy_matrix(cells: DataFrame, seq: Column, strategies: list[str] = STRATEGIES, group: list[str] | None = None) -> DataFrame:
    """Levels by strategies; of several cells in one place the last by ``seq`` counts."""
    keys = [*(group or []), "level"]
    last = cells.groupBy(*keys, "strategy").agg(F.max_by("accuracy", seq).alias("accuracy"))
    return last.groupBy(*keys).pivot("strategy", strategies).agg(F.first("accuracy"))


def depth_gap(matrix: DataFrame, levels: DataFrame, high: str = "cot", low: str = "standard") -> DataFrame:
    """(level, ordinal, gap) of known levels in the matrix; a missing strategy counts as 0."""
    gap = F.coalesce(F.col(high), F.lit(0.0)) - F.coalesce(F.col(low), F.lit(0.0))
    return matrix.join(F.broadcast(levels), "level").select("level", "ordinal", gap.alias("gap")).orderBy("ordinal")


def refinement_stats(traces: DataFrame, levels: DataFrame) -> DataFrame:
    """Per known level: n, mean, median and most loops, convergence rate."""
    found = traces.groupBy("level").agg(
        F.count("*").alias("n"), F.avg("loops").alias("mean_loops"), F.median("loops").alias("median_loops"), F.max("loops").alias("max_loops"), (F.count_if(F.col("converged")) / F.count("*")).alias("convergence_rate")
    )
    return found.join(F.broadcast(levels), "level").orderBy("ordinal")


def convergence(pairs: DataFrame) -> DataFrame:
    """n_pairs, converged, convergence_rate of a run."""
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("converged")).alias("converged"), (F.count_if(F.col("converged")) / F.greatest(F.count("*"), F.lit(1))).alias("convergence_rate"))

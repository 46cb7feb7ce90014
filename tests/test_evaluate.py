"""Votes, cells, matrices, statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, relational, stats
from tessera.schemas import levels, missing_columns


@pytest.mark.parametrize(
    ("votes", "winner", "agreement"),
    [("AB", "A", 0.5), ("BA", "B", 0.5), ("ABBA", "A", 0.5), ("BAAB", "B", 0.5), (".A.", "A", 1.0), ("...", None, 0.0), ("AB.B", "B", 2 / 3)],
)
def test_majority_vote(spark, votes, winner, agreement):
    df = spark.createDataFrame([(1, i, None if v == "." else v) for i, v in enumerate(votes)], "q int, i int, v string").repartition(3)
    r = evaluate.majority_vote(df, ["q"], F.col("v"), F.col("i")).first()
    assert r.winner == winner and math.isclose(r.agreement, agreement) and r.n_valid == len(votes.replace(".", ""))


def test_matrix_gap_and_cells(spark):
    rows = [("Remember", "cot", 1, True), ("Remember", "cot", 2, False), ("Create", "standard", 1, True), ("Create", "standard", 1, False), ("Unknown", "cot", 1, True)]
    answers = spark.createDataFrame(rows, "level string, strategy string, model int, correct boolean")
    cells = evaluate.accuracy_cells(answers, ["level", "strategy", "model"])
    matrix = evaluate.accuracy_matrix(cells, F.col("model"))
    assert {r.level: r.cot for r in matrix.collect()} == {"Remember": 0.0, "Create": None, "Unknown": 1.0}  # the last model's
    gaps = evaluate.depth_gap(matrix, levels(spark)).collect()
    assert [(r.level, r.gap) for r in gaps] == [("Remember", 0.0), ("Create", -0.5)]
    one = answers.where("false").agg(evaluate.accuracy(F.col("correct")).alias("a")).first()
    assert one.a == 0.0


def grid(spark, cell_sizes, seed=1):
    rng = random.Random(seed)
    rows = [(f"a{i}", f"b{j}", i * 0.3 + j * j * 0.2 + rng.gauss(0, 1)) for (i, j), n in cell_sizes.items() for _ in range(n)]
    return rows, stats.anova_two_way(stats.anova_cells(spark.createDataFrame(rows, "a string, b string, y double"), F.col("a"), F.col("b"), F.col("y")))


def test_anova(spark):
    import numpy as np

    balanced = {(i, j): 5 for i in range(6) for j in range(4)}
    rows, table = grid(spark, balanced)
    y = np.array([r[2] for r in rows])
    total = ((y - y.mean()) ** 2).sum()
    assert math.isclose(sum(table[k]["ss"] for k in ("a", "b", "a:b", "residual")), total, rel_tol=1e-9)
    rows, table = grid(spark, {(i, j): 3 + (i * 7 + j * 5) % 9 for i in range(3) for j in range(2)})
    y, n = np.array([r[2] for r in rows]), len(rows)

    def rss(*parts):
        design = np.column_stack([np.ones(n), *parts])
        return ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum()

    a = np.array([[float(r[0] == f"a{k}") for k in (1, 2)] for r in rows])
    b = np.array([[float(r[1] == "b1")] for r in rows])
    assert math.isclose(table["a"]["ss"], rss(b) - rss(a, b), rel_tol=1e-9)
    assert math.isclose(table["b"]["ss"], rss(a) - rss(a, b), rel_tol=1e-9)
    assert math.isclose(table["a:b"]["ss"], rss(a, b) - rss(a, b, a * b), rel_tol=1e-8)
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for k in ("a", "b", "a:b"):
        want = 1 - jvm.FDistribution(float(table[k]["df"]), float(table["residual"]["df"])).cumulativeProbability(table[k]["F"])
        assert math.isclose(table[k]["p"], want, rel_tol=1e-6, abs_tol=1e-12)


def test_anova_errors(spark):
    assert "error" in grid(spark, {(0, 0): 2, (0, 1): 2, (1, 0): 2, (1, 1): 2})[1]
    assert "error" in grid(spark, {(0, 0): 9, (0, 1): 9, (1, 0): 9})[1]
    assert "error" in grid(spark, {(0, 0): 20, (1, 0): 20})[1]


def test_distributions():
    assert math.isclose(stats.f_sf(4, 3, 100), 0.0097991, rel_tol=1e-4)
    assert math.isclose(stats.t_two_sided(3, 4), 0.0399420, rel_tol=1e-5)


def test_spearman_and_refinement(spark):
    rows = [(i, lv, loops, loops < 3) for i, (lv, loops) in enumerate([("Remember", 1), ("Remember", 2), ("Apply", 2), ("Apply", 2), ("Create", 3), ("Other", 1)])]
    traces = spark.createDataFrame(rows, "id int, level string, loops int, converged boolean")
    found = evaluate.refinement_stats(traces, levels(spark))
    assert [(r.level, r.n, r.mean_loops, r.median_loops, r.convergence_rate) for r in found.collect()] == [("Remember", 2, 1.5, 1.5, 1.0), ("Apply", 2, 2.0, 2.0, 1.0), ("Create", 1, 3.0, 3.0, 0.0)]
    one = stats.spearman(found, "ordinal", "mean_loops")
    assert one["rho"] == pytest.approx(1.0) and one["direction"] == "rises"
    assert stats.spearman(found.limit(2), "ordinal", "mean_loops")["rho"] is None
    assert stats.ranks([2, 1, 2]).tolist() == [2.5, 1, 2.5]
    assert evaluate.convergence(traces.where("false")).first().convergence_rate == 0.0


def test_relational(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b"), (4, ""), (5, "a")], "seq int, k string").repartition(3)
    assert [(r.value, r.n) for r in relational.frequency(df.where("k <> ''"), F.col("k"), F.col("seq")).collect()] == [("b", 2), ("a", 2)]
    assert sorted(r.seq for r in relational.keep_first(df, F.col("k"), F.col("seq")).collect()) == [0, 1, 2]
    assert relational.first_n(df, 0, "seq").count() == 6 and [r.seq for r in relational.first_n(df, 2, "seq").collect()] == [0, 1]
    assert relational.length_stats(df.where("false"), F.col("seq")).first().mean is None
    pool = spark.createDataFrame([("Apply", i) for i in range(5)], "level string, id int")
    got = relational.exemplars_or_any(spark.createDataFrame([("Apply",), ("Create",)], "level string"), pool, 3, F.col("id")).orderBy("level", "rank").collect()
    assert [(r.level, r.id) for r in got] == [("Apply", 0), ("Apply", 1), ("Apply", 2), ("Create", 0), ("Create", 1), ("Create", 2)]
    assert missing_columns(df) and not missing_columns(df, ["k"])

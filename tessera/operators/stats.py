"""Statistics from cell aggregates: two-way analysis of variance (type II) and rank correlation.

Spark reduces any number of rows to one (n, mean, variance) row per cell; what follows is arithmetic on those few numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + t * d) or tiny)
            c = (1 + t / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def anova_cells(rows: DataFrame, a: Column, b: Column, y: Column) -> DataFrame:
    """(a, b, n, mean, m2) of each cell, m2 the squared deviations' sum; one pre-aggregated shuffle."""
    v = y.cast("double")
    return rows.groupBy(a.alias("a"), b.alias("b")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")).where("n > 0")


def _rss(design: np.ndarray, n: np.ndarray, mean: np.ndarray, within: float) -> float:
    root = np.sqrt(n)
    fit = np.linalg.lstsq(design * root[:, None], mean * root, rcond=None)[0]
    return within + float((n * (mean - design @ fit) ** 2).sum())


def anova_two_way(cells: DataFrame, least: int = 10) -> dict:
    """F, p and eta squared of both factors and their interaction, n, R squared, and a verdict; {"error": ...} where it can't be."""
    found = cells.collect()  # a row a cell
    n, mean, within = np.array([r["n"] for r in found], float), np.array([r["mean"] for r in found], float), sum(r["m2"] for r in found)
    total = n.sum()
    if total < least:
        return {"error": f"{int(total)} rows are fewer than {least}", "n": int(total)}
    a, b = sorted({r["a"] for r in found}), sorted({r["b"] for r in found})
    rest = int(total) - len(found)
    if len(a) < 2 or len(b) < 2 or rest <= 0 or len(found) < len(a) * len(b):
        return {"error": "needs two levels of each factor, no empty cell and more rows than cells", "n": int(total)}
    one = np.ones((len(found), 1))
    da = np.array([[float(r["a"] == x) for x in a[1:]] for r in found])
    db = np.array([[float(r["b"] == x) for x in b[1:]] for r in found])
    rss_a, rss_b, rss_ab = (_rss(np.hstack(x), n, mean, within) for x in ((one, da), (one, db), (one, da, db)))
    ss = {"a": max(rss_b - rss_ab, 0.0), "b": max(rss_a - rss_ab, 0.0), "a:b": max(rss_ab - within, 0.0)}
    df = {"a": len(a) - 1, "b": len(b) - 1, "a:b": (len(a) - 1) * (len(b) - 1)}
    grand = float((n * mean).sum() / total)
    sst = within + float((n * (mean - grand) ** 2).sum())
    whole, out = sum(ss.values()) + within, {}
    for k in ss:
        f = (ss[k] / df[k]) / (within / rest) if within > 0 else (math.inf if ss[k] > 0 else math.nan)
        p = f_sf(f, df[k], rest) if math.isfinite(f) else (0.0 if f == math.inf else math.nan)
        out[k] = {"ss": ss[k], "df": df[k], "F": f, "p": p, "eta_sq": ss[k] / whole if whole > 0 else math.nan}
    p = out["a:b"]["p"]
    verdict = "significant at .001" if p < 0.001 else "significant at .05" if p < 0.05 else "not significant"
    return {**out, "residual": {"ss": within, "df": rest}, "n": int(total), "r_sq": 1 - within / sst if sst > 0 else math.nan, "verdict": verdict}


def ranks(values: list[float]) -> np.ndarray:
    """Average ranks from 1."""
    v = np.asarray(values, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def spearman(pairs: DataFrame, x: str, y: str, least: int = 3) -> dict:
    """rho, two-sided p and a direction, from at most a few rows of a summary; None with fewer than ``least``."""
    found = pairs.select(x, y).collect()
    if len(found) < least:
        return {"rho": None, "p": None, "direction": "too few levels"}
    a, b = ranks([r[0] for r in found]), ranks([r[1] for r in found])
    if a.std() == 0 or b.std() == 0:
        return {"rho": math.nan, "p": math.nan, "direction": "undefined"}
    rho = float(np.corrcoef(a, b)[0, 1])
    df = len(found) - 2
    t = math.inf if abs(rho) >= 1 else rho * math.sqrt(df / (1 - rho * rho))
    return {"rho": rho, "p": 0.0 if math.isinf(t) else t_two_sided(t, df), "direction": "rises" if rho > 0 else "falls" if rho < 0 else "level"}

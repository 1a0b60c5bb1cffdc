"""Logistic regression with cluster-robust errors: each step is one aggregation over grouped design rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import dropped, staged


@dataclass(frozen=True)
class Fit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    n: int
    clusters: int
    converged: bool

    def p(self) -> list[float]:
        return [math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else 1.0 for b, s in zip(self.beta, self.se, strict=True)]


def fit_logistic(df: DataFrame, y: str, xs: list[str], cluster: str | None = None, rounds: int = 100, tol: float = 1e-9, cap: float = 4.0) -> Fit:
    """IRLS with an intercept; df's rows are summed in Spark, only k by k sums reach the driver. cluster: CR1 errors by that column."""
    names = ["intercept", *xs]
    cells = df.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in xs], *([F.col(cluster).alias("_c")] if cluster else []))
    rows = staged(cells.groupBy("_y", *xs, *(["_c"] if cluster else [])).agg(F.count(F.lit(1)).alias("_w")), "design")
    k, beta, done = len(names), np.zeros(len(names)), False
    col = [F.lit(1.0), *[F.col(x) for x in xs]]
    info = np.eye(k)
    for _ in range(rounds):
        eta = sum((float(b) * c for b, c in zip(beta, col, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))
        sums = [F.sum(F.col("_w") * (F.col("_y") - p) * c) for c in col] + [F.sum(F.col("_w") * p * (1 - p) * col[i] * col[j]) for i in range(k) for j in range(k)]
        got = np.array([v or 0.0 for v in rows.agg(*sums).first()], float)
        info = got[k:].reshape(k, k) + 1e-12 * np.eye(k)
        step = np.clip(np.linalg.solve(info, got[:k]), -cap, cap)
        beta = beta + step
        if np.abs(step).max() < tol:
            done = True
            break
    n, inv = int(rows.agg(F.sum("_w")).first()[0] or 0), np.linalg.inv(info)
    if not cluster:
        dropped(rows)
        return Fit(names, beta, np.sqrt(np.maximum(np.diag(inv), 0)), n, n, done)
    eta = sum((float(b) * c for b, c in zip(beta, col, strict=True)), F.lit(0.0))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))
    per = rows.groupBy("_c").agg(*[F.sum(F.col("_w") * (F.col("_y") - p) * c).alias(f"s{i}") for i, c in enumerate(col)])
    meat = per.agg(F.count(F.lit(1)), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)]).first()
    dropped(rows)
    g = int(meat[0])
    scale = g / max(1, g - 1) * (n - 1) / max(1, n - k)
    cov = inv @ (np.array(meat[1:], float).reshape(k, k) * scale) @ inv
    return Fit(names, beta, np.sqrt(np.maximum(np.diag(cov), 0)), n, g, done)

"""Logistic fits for many groups at once.

Every fit has two steps. First the rows are folded to bounded cells, and each group's
cells are solved in one small task. Then one pass over the full rows takes a Newton
step from that solution, which removes what the folding cost. Two scans in total,
whatever the number of groups, and no task ever holds a group's rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.maths import sigmoid
from cohortgauge.session import materialise

#: Cells per feature: one thousandth of a unit on the folded axis.
RESOLUTION = 1e-3


def newton_logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, iterations: int = 100):
    """Maximum likelihood over weighted cells, halving steps that do not improve.

    ``x`` holds one design row per cell, ``n`` its rows and ``y`` its events. Returns
    ``(beta, covariance, converged)``.
    """
    beta = np.zeros(x.shape[1])

    def likelihood(b):
        eta = x @ b
        return float(np.sum(y * eta - n * np.logaddexp(0.0, eta)))

    current = likelihood(beta)
    information = np.eye(x.shape[1])
    for _ in range(iterations):
        p = 1.0 / (1.0 + np.exp(-(x @ beta)))
        gradient = x.T @ (y - n * p)
        information = (x * (n * p * (1 - p))[:, None]).T @ x
        try:
            step = np.linalg.solve(information, gradient)
        except np.linalg.LinAlgError:
            return beta, np.full_like(information, np.nan), False
        scale = 1.0
        while scale > 1e-8 and likelihood(beta + scale * step) < current - 1e-12 * abs(current):
            scale /= 2
        beta = beta + scale * step
        current = likelihood(beta)
        if np.max(np.abs(scale * step)) < 1e-10:
            break
    else:
        return beta, np.full_like(information, np.nan), False
    try:
        covariance = np.linalg.inv(information)
    except np.linalg.LinAlgError:
        return beta, np.full_like(information, np.nan), False
    return beta, covariance, bool(np.all(np.isfinite(beta)))


def _dot(names: list[str], betas: list[str]) -> Column:
    total = F.col(betas[0])
    for name, beta in zip(names, betas[1:], strict=True):
        total = total + F.col(name) * F.col(beta)
    return total


def fit_logistic(df: DataFrame, keys: list[str], features: dict[str, Column], target: Column,
                 resolution: float = RESOLUTION) -> DataFrame:
    """``target ~ 1 + features`` per group, as one row per group and term.

    ``features`` must be bounded (a clipped logit, a decade of age, an indicator), so
    that the number of cells is bounded too. Groups with one class come back NULL.
    """
    terms = ["(intercept)", *features]
    names = [f"_x{i}" for i in range(len(features))]
    betas = ["_b"] + [f"_b{i}" for i in range(len(names))]
    rows = df.select(*keys, *[c.cast("double").alias(n) for n, c in zip(names, features.values(), strict=True)], target.cast("double").alias("_y"))
    # Incomplete rows drop out inside the sums: a filter here would make Catalyst
    # evaluate the feature expressions once more below the projection.
    complete = F.col("_y")
    for name in names:
        complete = F.when(F.col(name).isNotNull(), complete)
    rows = rows.withColumn("_y", complete)
    cells = rows.groupBy(*keys, *[F.floor(F.col(n) / resolution).alias(f"_cell{i}") for i, n in enumerate(names)]).agg(
        F.count("_y").alias("_n"), F.sum("_y").alias("_events"), *[F.avg(n).alias(n) for n in names]
    ).where("_n > 0")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    solved = cells.select(*keys, "_n", "_events", *names).groupBy(*keys).applyInPandas(
        _cell_solver(keys, names), f"{key_schema}, {', '.join(f'{b} double' for b in betas)}"
    )
    start = materialise(solved)

    # Score and information at the start, summed over the full rows.
    design = [F.lit(1.0), *[F.col(n) for n in names]]
    k = len(design)
    p = F.when(F.col("_y").isNotNull(), sigmoid(_dot(names, betas)))
    # One row per group, sent to the tasks: a join by the few groups would put a whole group into one task.
    joined = rows.join(F.broadcast(start), keys).withColumn("_p", p)
    sums = [F.sum(design[i] * (F.col("_y") - F.col("_p"))).alias(f"_g{i}") for i in range(k)]
    sums += [
        F.sum(design[i] * design[j] * F.col("_p") * (1.0 - F.col("_p"))).alias(f"_h{i}_{j}")
        for i in range(k) for j in range(i, k)
    ]
    totals = joined.groupBy(*keys, *betas).agg(F.count("_y").alias("_n"), *sums)
    return totals.groupBy(*keys).applyInPandas(
        _polisher(keys, terms, betas), f"{key_schema}, term string, coefficient double, std_error double, n long"
    )


def _cell_solver(keys, names):
    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(cells)), *[cells[n].to_numpy(float) for n in names]])
        n, y = cells["_n"].to_numpy(float), cells["_events"].to_numpy(float)
        if y.sum() in (0.0, n.sum()):
            beta = np.full(x.shape[1], np.nan)
        else:
            beta, _, converged = newton_logistic(x, n, y)
            if not converged:
                beta = np.full(x.shape[1], np.nan)
        head = [cells[k].iloc[0] for k in keys]
        columns = [*keys, "_b", *[f"_b{i}" for i in range(len(names))]]
        return pd.DataFrame([[*head, *[None if np.isnan(b) else float(b) for b in beta]]], columns=columns)

    return solve


def _polisher(keys, terms, betas):
    k = len(terms)

    def polish(block: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        beta = np.array([row[b] for b in betas], dtype=float)
        error = np.full(k, np.nan)
        if not np.isnan(beta).any():
            gradient = np.array([row[f"_g{i}"] for i in range(k)], dtype=float)
            information = np.array(
                [[row[f"_h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float
            )
            try:
                beta = beta + np.linalg.solve(information, gradient)
                error = np.sqrt(np.diag(np.linalg.inv(information)))
            except np.linalg.LinAlgError:
                beta = np.full(k, np.nan)
        out = pd.DataFrame({"term": terms, "coefficient": beta, "std_error": error, "n": int(row["_n"])})
        out = out.astype(object).where(out.notna(), None)
        for i, key in enumerate(keys):
            out.insert(i, key, row[key])
        return out

    return polish


def with_odds(fits: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Odds ratio, 95% interval and p-value beside each coefficient."""
    from cohortgauge.functions.maths import two_sided_p

    b, se = F.col("coefficient"), F.col("std_error")
    return fits.withColumns(
        {
            "odds_ratio": F.exp(b), "ci_low": F.exp(b - z * se), "ci_high": F.exp(b + z * se),
            "p_value": two_sided_p(F.try_divide(b, se)),
        }
    )


def acquisition_coupling(cohort: DataFrame) -> DataFrame:
    """Odds of an AP film per decade of age and by sex, one model per site."""
    rows = cohort.where(F.col("sex").isNotNull() & F.col("age").isNotNull())
    base = {"Female": 0.0, "Male": 1.0}
    male = F.when(F.col("sex") == "Male", base["Male"]).when(F.col("sex") == "Female", base["Female"])
    is_ap = F.coalesce(F.col("view") == "AP", F.lit(False)).cast("double")
    fits = fit_logistic(rows, ["site"], {"age_decade": F.col("age") / 10.0, "C(sex)[T.Male]": male}, is_ap)
    return with_odds(fits).where("term <> '(intercept)'").select(
        "site", "term", "odds_ratio", "ci_low", "ci_high", "p_value"
    )

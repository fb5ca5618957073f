"""Does the demographic effect on missed diagnoses depend on the view?

All predictors are categories, so the outcome cube holds the whole likelihood: the
regression on its cells is the regression on the patients.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.maths import two_sided_p
from cohortgauge.operators.cells import level_columns
from cohortgauge.operators.fairness import FairnessError
from cohortgauge.operators.ordering import union_all
from cohortgauge.operators.regression import newton_logistic

MIN_POSITIVES = 30
Z95 = 1.959963984540054
#: A fitted probability closer to 0 or 1 than this is separation, not an estimate.
SEPARATED = 1e-7


def interaction_cells(cube: DataFrame, stratum: str, min_events: int = 10) -> DataFrame:
    """Size, events and non-events per level and view, and what each cell allows."""
    cells = cube.where(F.col(stratum).isNotNull() & F.col("view").isNotNull()).groupBy(
        "site", "label", F.lit(stratum).alias("stratum"), F.col(stratum).alias("level"), "view"
    ).agg(F.sum("n_positive").alias("size"), F.sum("n_missed").alias("events"))
    fewest = F.least("events", "non_events")
    state = F.when(fewest == 0, "separated").when(fewest < min_events, "thin").otherwise("usable")
    return (
        cells.where("size > 0").withColumn("non_events", F.col("size") - F.col("events")).withColumn("state", state)
    )


def guard_notes(cube: DataFrame, stratum: str, min_events: int = 10) -> DataFrame:
    """Why a model must not be fitted, per site and label; NULL where it may be."""
    totals = cube.groupBy("site", "label").agg(
        F.sum("n_positive").alias("_pos"), F.sum("n_missed").alias("_miss")
    )
    states = interaction_cells(cube, stratum, min_events).groupBy("site", "label").agg(
        F.count(F.lit(1)).alias("_cells"), F.count_if(F.col("state") == "separated").alias("_sep"),
        F.count_if(F.col("state") == "thin").alias("_thin"),
    )
    of_cells = F.concat(F.lit(" of "), F.col("_cells").cast("string"), F.lit(" cells"))
    note = (
        F.when(F.col("_pos") < MIN_POSITIVES, F.concat(F.col("_pos").cast("string"), F.lit(" positives are too few")))
        .when((F.col("_miss") == 0) | (F.col("_miss") == F.col("_pos")), "the model made no errors, or only errors")
        .when(F.col("_sep") > 0, F.concat(F.lit("separation in "), F.col("_sep").cast("string"), of_cells))
        .when(F.col("_thin") > 0, F.concat(F.lit(f"fewer than {min_events} events or non-events in "),
                                           F.col("_thin").cast("string"), of_cells))
    )
    return totals.join(states, ["site", "label"], "left").select(
        "site", "label", F.lit(stratum).alias("stratum"), note.alias("note")
    )


def interaction_closed(cube: DataFrame, contrasts: dict[str, tuple[str, str]], min_events: int = 10) -> DataFrame:
    """Unadjusted interaction on two levels and two views, in closed form.

    The coefficient is a difference of log odds ratios and its variance the sum of
    the reciprocal cell counts.
    """
    frames = []
    for stratum in contrasts:
        cells = interaction_cells(cube, stratum, min_events)
        a, b = level_columns(contrasts)
        sides = cells.withColumns({"_a": a, "_b": b})
        side = F.when(F.col("level") == F.col("_a"), -1).when(F.col("level") == F.col("_b"), 1)
        base = F.when(F.col("view") == "AP", -1).when(F.col("view") == "PA", 1)
        sign = side * base
        odds = F.ln(F.try_divide(F.col("events").cast("double"), F.col("non_events").cast("double")))
        inverse = F.try_divide(F.lit(1.0), F.col("events")) + F.try_divide(F.lit(1.0), F.col("non_events"))
        frames.append(
            sides.where(sign.isNotNull()).groupBy("site", "label", "stratum").agg(
                F.sum(sign * odds).alias("coefficient"), F.sqrt(F.sum(inverse)).alias("std_error"),
                F.count(F.lit(1)).alias("_cells"), F.count_if(F.col("state") != "usable").alias("_bad"),
                F.sum("size").alias("_size"),
            ).where((F.col("_cells") == 4) & (F.col("_bad") == 0) & (F.col("_size") >= MIN_POSITIVES))
        )
    fitted = union_all(frames)
    beta, se = F.col("coefficient"), F.col("std_error")
    return fitted.select(
        "site", "label", "stratum", "coefficient", F.exp(beta).alias("odds_ratio"),
        F.exp(beta - Z95 * se).alias("ci_low"), F.exp(beta + Z95 * se).alias("ci_high"),
        two_sided_p(beta / se).alias("p_value"),
    )


def _levels(cells: DataFrame, columns: list[str], levels: dict[str, list[str]] | None) -> dict[str, list[str]]:
    """The levels of every column over all sites and labels; a handful of categories."""
    found = cells.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns)).first()
    given = levels or {}
    for column in columns:
        unlisted = set(found[column]) - set(given.get(column, found[column]))
        if unlisted:
            raise FairnessError(f"{column} has levels that are not listed: {sorted(unlisted)}")
    return {c: sorted(given.get(c, found[c])) for c in columns}


def _design(block: pd.DataFrame, stratum: str, adjust: list[str], levels: dict[str, list[str]]):
    """Treatment coding against the alphabetically first level, term names as formulas write them."""
    def dummies(column):
        return {f"C({column})[T.{v}]": (block[column] == v).to_numpy(float) for v in levels[column][1:]}

    main, view = dummies(stratum), dummies("view")
    columns = {"Intercept": np.ones(len(block)), **main, **view}
    for column in adjust:
        columns.update(dummies(column))
    columns.update({f"{m}:{v}": main[m] * view[v] for m in main for v in view})
    return list(columns), np.column_stack(list(columns.values()))


def _failure(block: pd.DataFrame, used: list[str], levels: dict[str, list[str]], converged: bool, x, beta) -> str | None:
    """Why a fit cannot be reported; None where it can."""
    absent = [f"{c}={v}" for c in used for v in levels[c] if not (block[c] == v).any()]
    if absent:
        return f"no positives at {', '.join(absent)}"
    if not converged:
        return "the fit did not converge"
    fitted = 1 / (1 + np.exp(-(x @ beta)))
    if np.minimum(fitted, 1 - fitted).min() < SEPARATED:
        return "separation: fitted probabilities of 0 or 1"
    return None


def fit_interactions(cube: DataFrame, stratum: str, adjust_for: list[str] | None = None, min_events: int = 10,
                     levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Coefficients and errors per site, label and term; one row with a ``note`` where a fit fails.

    ``error ~ stratum + view + adjust_for + stratum:view`` among positives. Levels hold for all
    sites and labels, so every model has the same terms: a site that lacks a level gets a note,
    not a smaller model. Models a guard rejects are absent; :func:`guard_notes` says why.
    """
    adjust = [c for c in (adjust_for or []) if c in cube.columns and c != stratum]
    used = [stratum, "view", *adjust]
    allowed = guard_notes(cube, stratum, min_events).where("note is null").select("site", "label")
    cells = cube.where("n_positive > 0")
    for column in used:
        cells = cells.where(F.col(column).isNotNull())
    cells = cells.groupBy("site", "label", *used).agg(F.sum("n_positive").alias("n"), F.sum("n_missed").alias("y"))
    known = _levels(cells, used, levels)

    def fit(block: pd.DataFrame) -> pd.DataFrame:
        names, x = _design(block, stratum, adjust, known)
        beta, covariance, converged = newton_logistic(x, block["n"].to_numpy(float), block["y"].to_numpy(float))
        note = _failure(block, used, known, converged, x, beta)
        if note:
            rows = [(None, None, None, note)]
        else:
            rows = list(zip(names, beta.tolist(), np.sqrt(np.diag(covariance)).tolist(), [None] * len(names), strict=True))
        head = (block["site"].iloc[0], block["label"].iloc[0])
        out = pd.DataFrame([(*head, *r) for r in rows], columns=["site", "label", "term", "coefficient", "std_error", "note"])
        return out.astype(object).where(out.notna(), None)

    fits = cells.join(allowed, ["site", "label"], "left_semi").groupBy("site", "label").applyInPandas(
        fit, "site string, label string, term string, coefficient double, std_error double, note string"
    )
    return fits.withColumn("stratum", F.lit(stratum))


def fitted_terms(fits: DataFrame) -> DataFrame:
    """Odds ratios, intervals and p-values of the fits that converged."""
    beta, se = F.col("coefficient"), F.col("std_error")
    return fits.where("note is null").select(
        "label", "site", "stratum", "term", "coefficient", F.exp(beta).alias("odds_ratio"),
        F.exp(beta - Z95 * se).alias("ci_low"), F.exp(beta + Z95 * se).alias("ci_high"),
        two_sided_p(F.try_divide(beta, se)).alias("p_value"),
        (F.instr("term", ":") > 0).alias("is_interaction"),
    )


def fit_notes(fits: DataFrame) -> DataFrame:
    """Site, label and stratum of the fits that failed, and why."""
    return fits.where("note is not null").select("site", "label", "stratum", "note")


def interaction_model(cube: DataFrame, stratum: str, adjust_for: list[str] | None = None, min_events: int = 10,
                      levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Adjusted logistic model of a miss among positives, one per site and label."""
    return fitted_terms(fit_interactions(cube, stratum, adjust_for, min_events, levels))

"""Temperature scaling, operating thresholds and calibration diagnostics.

Frames are long: one row per ``(site, fold, label, patient_id)`` with ``view``,
``score`` and ``truth``. Everything fitted comes from validation rows and is a small
parameter table; test rows only ever meet it through a broadcast join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.maths import log1p_exp, logit, ratio, sigmoid
from cohortgauge.operators.metrics import NLL_EPS, observed, score_bin
from cohortgauge.operators.ordering import score_curve
from cohortgauge.operators.regression import fit_logistic
from cohortgauge.session import materialise

POOLED = "__pooled__"
BOUNDS = (0.01, 100.0)
#: Width of the logit cells the first fit works on; the clipped logit spans 27.7.
CELL = 1e-3
FIT_KEYS = ["site", "fold", "label"]


class CalibrationError(ValueError):
    """Calibration or thresholding cannot be performed as asked."""


# ------------------------------------------------------------------ temperature


def scale_score(score: Column, temperature) -> Column:
    """Probability with its logit divided by the temperature; order is unchanged."""
    if isinstance(temperature, int | float):
        if temperature <= 0:
            raise CalibrationError(f"temperature must be positive, got {temperature}")
        temperature = F.lit(float(temperature))
    return sigmoid(logit(score) / temperature)


def temperature_grid(df: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Mean NLL per group at each listed temperature, and the best of them.

    The grid becomes one aggregate per temperature over a single scan; rows are never
    multiplied by the grid.
    """
    z = logit("score")
    rows = observed(df).select(*keys, z.alias("_z"), F.col("truth").alias("_y"))
    losses = [
        F.avg(log1p_exp(F.col("_z") / t) - F.col("_y") * F.col("_z") / t).alias(f"_l{i}") for i, t in enumerate(grid)
    ]
    wide = rows.groupBy(*keys).agg(*losses)
    packed = F.array(
        *[F.struct(F.round(F.col(f"_l{i}"), 9).alias("loss"), F.lit(float(t)).alias("t")) for i, t in enumerate(grid)]
    )
    best = F.array_min(packed)
    return wide.select(*keys, best["t"].alias("temperature"), best["loss"].alias("nll"))


def _solve_scale(z: np.ndarray, n: np.ndarray, events: np.ndarray) -> float:
    """The inverse temperature minimising NLL over cells; NLL is convex in it."""
    low, high = 1.0 / BOUNDS[1], 1.0 / BOUNDS[0]

    def slope(beta):
        return float(np.sum(z * (n / (1.0 + np.exp(-np.clip(beta * z, -700, 700))) - events)))

    if slope(low) >= 0:
        return low
    if slope(high) <= 0:
        return high
    for _ in range(200):
        middle = np.sqrt(low * high)
        low, high = (low, middle) if slope(middle) > 0 else (middle, high)
        if high / low < 1 + 1e-13:
            break
    return float(np.sqrt(low * high))


FIT_SCHEMA = "view string, scale double, status string, n_positive long, n_negative long"


def _fit_views(keys):
    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        head = [cells[k].iloc[0] for k in keys]
        parts = [(POOLED, cells), *[(v, c) for v, c in cells.groupby("view", sort=True)]]
        out = []
        for view, part in parts:
            n, y = part["n"].to_numpy(float), part["events"].to_numpy(float)
            positives, negatives = int(y.sum()), int(n.sum() - y.sum())
            scale, status = None, "fitted"
            if not positives or not negatives:
                status = "single-class"
            else:
                scale = _solve_scale(part["z"].to_numpy(float), n, y)
                if scale * BOUNDS[1] <= 1.0 / 0.999 or scale * BOUNDS[0] >= 1.0 / 1.001:
                    scale, status = None, "bound"
            out.append([*head, view, scale, status, positives, negatives])
        return pd.DataFrame(out, columns=[*keys, "view", "scale", "status", "n_positive", "n_negative"])

    return fit


def fit_temperatures(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Temperature per group for all rows (``__pooled__``) and for each view.

    Rows fold to logit cells of fixed width, at most 28,000 per group and class, and
    the cells are solved per group. One pass over the rows then takes a Newton step
    from there, so the result is the exact minimiser. ``status`` is ``fitted``,
    ``single-class`` or ``bound`` (no interior minimum); the last two have no temperature.
    """
    keys = keys or FIT_KEYS
    rows = observed(df).select(*keys, "view", logit("score").alias("_z"), F.col("truth").alias("_y"))
    cells = rows.groupBy(*keys, "view", F.floor(F.col("_z") / CELL).alias("_cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("events"), F.avg("_z").alias("z")
    )
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    solved = cells.drop("_cell").groupBy(*keys).applyInPandas(_fit_views(keys), f"{key_schema}, {FIT_SCHEMA}")
    start = materialise(solved)

    pooled = start.where(F.col("view") == POOLED).select(*keys, F.col("scale").alias("_pooled"))
    by_view = start.where(F.col("view") != POOLED).select(*keys, "view", F.col("scale").alias("_own"))
    z, y = F.col("_z"), F.col("_y")

    def sums(scale: str) -> list[Column]:
        p = sigmoid(z * F.col(scale))
        return [
            F.sum(z * (p - y)).alias(f"_g{scale}"), F.sum(z * z * p * (1.0 - p)).alias(f"_h{scale}")
        ]

    # A row per group against any number of rows: sent to the tasks, so that no row is shuffled and no group meets in one task.
    scored = rows.join(F.broadcast(pooled), keys).join(F.broadcast(by_view), [*keys, "view"], "left")
    totals = scored.groupBy(*keys, "view", "_pooled", "_own").agg(*sums("_pooled"), *sums("_own"))
    whole = totals.groupBy(*keys, "_pooled").agg(
        F.sum("_g_pooled").alias("_g"), F.sum("_h_pooled").alias("_h")
    ).select(*keys, F.lit(POOLED).alias("view"), (F.col("_pooled") - F.try_divide(F.col("_g"), F.col("_h"))).alias("_s"))
    own = totals.where("view is not null").select(
        *keys, "view", (F.col("_own") - F.try_divide(F.col("_g_own"), F.col("_h_own"))).alias("_s")
    )
    return start.join(whole.unionByName(own), [*keys, "view"], "left").select(
        *keys, "view", F.when(F.col("status") == "fitted", F.lit(1.0) / F.col("_s")).alias("temperature"),
        "status", "n_positive", "n_negative",
    )


def view_temperatures(fits: DataFrame, keys: list[str] | None = None, min_positives: int = 25,
                      min_negatives: int = 25) -> DataFrame:
    """Per-view temperatures; a view with too few of either class takes the pooled one."""
    keys = keys or FIT_KEYS
    pooled = fits.where(F.col("view") == POOLED).select(*keys, F.col("temperature").alias("_pooled"))
    thin = (F.col("n_positive") < min_positives) | (F.col("n_negative") < min_negatives)
    fallback = thin & (F.col("view") != POOLED)
    return fits.join(pooled, keys).select(
        *keys, "view", F.when(fallback, F.col("_pooled")).otherwise(F.col("temperature")).alias("temperature"),
        fallback.alias("pooled_fallback"), "n_positive", "n_negative",
        F.when(fallback, F.lit("fitted")).otherwise(F.col("status")).alias("status"),
    )


def require_fitted(params: DataFrame, arm: str = "view") -> DataFrame:
    """Raise where a group that will be applied has no temperature."""
    used = params if arm == "view" else params.where(F.col("view") == POOLED)
    bad = used.where(F.col("temperature").isNull()).limit(3).collect()
    if bad:
        named = [(r["label"], r["view"], r["status"]) if "label" in r else r.asDict() for r in bad]
        raise CalibrationError(f"no temperature for {named}")
    return params


def apply_temperatures(df: DataFrame, params: DataFrame, keys: list[str] | None = None, arm: str = "global") -> DataFrame:
    """Add ``calibrated``. Under ``view``, a view without its own value uses the pooled one.

    ``params`` has one row per group and view, whatever the rows, and is sent to every task: a join by the
    few groups would shuffle all rows and put a whole group into one task. Store it, or it is fitted twice.
    """
    keys = keys or FIT_KEYS
    if arm not in ("global", "view"):
        raise CalibrationError(f"unknown calibration arm: {arm!r}")
    pooled = params.where(F.col("view") == POOLED).select(*keys, F.col("temperature").alias("_pooled"))
    joined = df.join(F.broadcast(pooled), keys, "left")
    temperature = F.col("_pooled")
    if arm == "view":
        own = params.where(F.col("view") != POOLED).select(*keys, "view", F.col("temperature").alias("_own"))
        joined = joined.join(F.broadcast(own), [*keys, "view"], "left")
        temperature = F.coalesce("_own", "_pooled")
    return joined.withColumn("calibrated", scale_score(F.col("score"), temperature)).drop("_pooled", "_own")


# ------------------------------------------------------------------- thresholds


def select_threshold(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth",
                     target: float = 0.90, rule: str = "fixed_sensitivity") -> DataFrame:
    """Operating threshold and the sensitivity it reaches, per group.

    ``fixed_sensitivity`` takes the highest observed score whose sensitivity meets
    the target. ``youden`` takes the highest score maximising sensitivity plus
    specificity, compared as whole numbers so ties are exact.
    """
    if rule not in ("fixed_sensitivity", "youden"):
        raise CalibrationError(f"unknown threshold rule: {rule!r}")
    if not 0 < target <= 1:
        raise CalibrationError(f"target_sensitivity must lie in (0, 1], got {target}")
    curve = score_curve(df, keys, score, truth)
    if rule == "fixed_sensitivity":
        meets = F.try_divide(F.col("cum_pos"), F.col("all_pos")) >= F.lit(float(target))
        threshold, reached = F.max(F.when(meets, F.col("score"))), F.min(F.when(meets, F.col("cum_pos")))
    else:
        def wide(name):
            return F.col(name).cast("decimal(19,0)")

        gain = wide("cum_pos") * wide("all_neg") - wide("cum_neg") * wide("all_pos")
        top = F.max(F.struct(gain.alias("gain"), F.col("score").alias("score"), F.col("cum_pos").alias("cum_pos")))
        useful = top["gain"] > 0
        # No score beats flagging nobody: the threshold lies above every score.
        threshold = F.when(useful, top["score"]).otherwise(F.lit(float("inf")))
        reached = F.when(useful, top["cum_pos"]).otherwise(F.lit(0))
    return curve.groupBy(*keys).agg(
        threshold.alias("threshold"), ratio(reached, F.first("all_pos")).alias("achieved_sensitivity"),
        F.first("all_pos").alias("n_positive"),
    ).withColumn("threshold", F.when(F.col("n_positive") > 0, F.col("threshold")))


# --------------------------------------------------------------- whole pipeline


def calibrate(validation: DataFrame, *, arm: str = "global", target: float = 0.90, rule: str = "fixed_sensitivity",
              min_positives: int = 25, min_negatives: int = 25, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fit temperatures and thresholds for every site, fold and label together.

    Returns ``(temperatures, thresholds)``. Thresholds come from the combined
    calibrated validation rows under either arm, so the arms differ in calibration
    only. Validation rows are read several times and therefore stored first, as are
    both tables: nothing downstream can refit them. A group that cannot be fitted
    raises, or with ``strict=False`` keeps a row without values.
    """
    if arm not in ("global", "view"):
        raise CalibrationError(f"unknown calibration arm: {arm!r}")
    validation = materialise(
        validation.select(*FIT_KEYS, "view", "score", "truth")
    )
    fits = view_temperatures(fit_temperatures(validation), FIT_KEYS, min_positives, min_negatives)
    if arm == "global":
        fits = fits.where(F.col("view") == POOLED)
    temperatures = materialise(fits)
    if strict:
        require_fitted(temperatures, arm)
    scored = apply_temperatures(validation, temperatures, FIT_KEYS, arm)
    thresholds = select_threshold(scored, FIT_KEYS, "calibrated", "truth", target, rule)
    # A group without a usable calibration still has its row.
    every = temperatures.where(F.col("view") == POOLED).select(*FIT_KEYS)
    return temperatures, materialise(every.join(thresholds, FIT_KEYS, "left"))


def decide(test: DataFrame, temperatures: DataFrame, thresholds: DataFrame, arm: str = "global") -> DataFrame:
    """Add ``calibrated`` and ``predicted``.

    A row without a score is predicted negative; where the threshold itself is missing
    the prediction stays NULL, and the row stays in the table.
    """
    scored = apply_temperatures(test, temperatures, FIT_KEYS, arm)
    joined = scored.join(F.broadcast(thresholds.select(*FIT_KEYS, "threshold")), FIT_KEYS, "left")
    above = F.coalesce((F.col("calibrated") >= F.col("threshold")).cast("double"), F.lit(0.0))
    return joined.withColumn("predicted", F.when(F.col("threshold").isNotNull(), above)).drop("threshold")


def fold_parameters(temperatures: DataFrame, thresholds: DataFrame, views: list[str], arm: str) -> DataFrame:
    """One row per site, fold and label: threshold, sensitivity, one temperature column per view."""
    shown = ["global"] if arm == "global" else views
    wanted = {"global": POOLED}
    temps = temperatures.groupBy(*FIT_KEYS).agg(
        *[
            F.max(F.when(F.col("view") == wanted.get(v, v), F.col("temperature"))).alias(f"T_{v}") for v in shown
        ]
    )
    return thresholds.join(temps, FIT_KEYS).select(
        "site", "fold", F.lit(arm).alias("arm"), "label", "threshold", "achieved_sensitivity",
        *[f"T_{v}" for v in shown],
    )


def temperature_summary(params: DataFrame) -> DataFrame:
    """Spread of T_AP - T_PA over folds and labels, per site."""
    gap = F.col("T_AP") - F.col("T_PA")
    return params.groupBy("site").agg(
        F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("sd_gap"),
        F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"),
    )


def parameter_means(params: DataFrame) -> DataFrame:
    """Mean temperature, threshold and sensitivity per site and label."""
    temps = [c for c in params.columns if c.startswith("T_")]
    return params.groupBy("site", "label").agg(
        *[F.round(F.avg(c), 3).alias(c) for c in temps], F.round(F.avg("threshold"), 4).alias("threshold"),
        F.round(F.avg("achieved_sensitivity"), 3).alias("achieved_sens"),
    )


# ------------------------------------------------------------------ diagnostics


def calibration_slope(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth") -> DataFrame:
    """Outcome regressed on the logit of the score: slope 1 and intercept 0 are ideal."""
    fits = fit_logistic(observed(df, score, truth), keys, {"slope": logit(score)}, F.col(truth))
    return fits.groupBy(*keys).agg(
        F.max(F.when(F.col("term") == "slope", F.col("coefficient"))).alias("slope"),
        F.max(F.when(F.col("term") != "slope", F.col("coefficient"))).alias("intercept"),
    )


def calibration_report(decisions: DataFrame, keys: list[str], views: list[str], bins: int = 10,
                       slopes: bool = True) -> DataFrame:
    """ECE, Brier, NLL and slope before and after, and ECE within each view."""
    seen = observed(decisions)
    y = F.col("truth")

    def log_loss(score):
        p = F.least(F.greatest(F.col(score), F.lit(NLL_EPS)), F.lit(1.0 - NLL_EPS))
        return F.sum(-(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p)))

    # One scan: every measure below is a sum over (view, raw bin, calibrated bin) cells.
    cube = materialise(
        seen.groupBy(
            *keys, "view", score_bin(F.col("score"), bins).alias("bin_raw"),
            score_bin(F.col("calibrated"), bins).alias("bin_calibrated"),
        ).agg(
            F.count(F.lit(1)).alias("n"), F.sum("truth").alias("t"), F.sum("score").alias("s_raw"),
            F.sum("calibrated").alias("s_calibrated"),
            F.sum(F.pow(F.col("score") - y, F.lit(2.0))).alias("b_raw"),
            F.sum(F.pow(F.col("calibrated") - y, F.lit(2.0))).alias("b_calibrated"),
            log_loss("score").alias("l_raw"), log_loss("calibrated").alias("l_calibrated"),
        )
    )
    report = cube.groupBy(*keys).agg(
        *[
            ratio(F.sum(f"{short}_{kind}"), F.sum("n")).alias(f"{name}_{kind}")
            for kind in ("raw", "calibrated") for short, name in (("b", "brier"), ("l", "nll"))
        ]
    )

    def ece(kind: str, by: list[str], name: str) -> DataFrame:
        per_bin = cube.groupBy(*by, f"bin_{kind}").agg(
            F.sum("n").alias("n"), F.abs(F.sum("t") - F.sum(f"s_{kind}")).alias("gap")
        )
        inside = F.sum(F.when(F.col(f"bin_{kind}").isNotNull(), F.col("gap")))
        return per_bin.groupBy(*by).agg(F.coalesce(ratio(inside, F.sum("n")), F.lit(0.0)).alias(name))

    by_view = ece("calibrated", [*keys, "view"], "ece").groupBy(*keys).agg(
        *[F.max(F.when(F.col("view") == v, F.col("ece"))).alias(f"ece_{v}") for v in views]
    )
    parts = [ece("raw", keys, "ece_raw"), ece("calibrated", keys, "ece_calibrated"), by_view]
    if slopes:
        for score, suffix in (("score", "raw"), ("calibrated", "calibrated")):
            parts.append(
                calibration_slope(seen, keys, score).withColumnsRenamed(
                    {"slope": f"slope_{suffix}", "intercept": f"intercept_{suffix}"}
                )
            )
    for part in parts:
        report = report.join(part, keys, "left")
    return report

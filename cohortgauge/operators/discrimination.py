"""How well scores order patients inside each group, and the gap between two groups.

Everything is read off the score curve: counts at and above each distinct score. A patient's
placement value is the share of the other class ordered below a positive, or above a negative,
ties counting half. Their mean is the area, and their spread its variance (DeLong's), so no pair
of patients is ever formed and one aggregate over the curve gives all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.maths import ratio, two_sided_p
from cohortgauge.operators.ordering import score_curve

Z95 = 1.959963984540054


def curve_measures(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth",
                   sides: dict[str, Column] | None = None) -> DataFrame:
    """Area under the ROC curve with its variance, and average precision, per ``keys``.

    ``auroc`` and ``auprc`` are NULL where a class is absent, ``variance`` where a class has
    fewer than two members. Average precision is a step integral: tied scores are one step.
    With ``sides``, conditions by suffix, every measure exists once for each and is NULL for a side without rows.
    """
    curve = score_curve(df, keys, score, truth, sides)
    sums, measures = [], []
    for s in sides or [""]:
        as_double = lambda name: F.col(name + s).cast("double")  # noqa: E731, B023
        n_pos, n_neg, cum_pos, cum_neg = (F.col(c + s) for c in ("n_pos", "n_neg", "cum_pos", "cum_neg"))
        below = (as_double("all_neg") - cum_neg + n_neg / 2.0) / F.nullif(as_double("all_neg"), F.lit(0.0))
        above = (as_double("cum_pos") - n_pos / 2.0) / F.nullif(as_double("all_pos"), F.lit(0.0))
        # No row of the side at or above a score of another side: no step there.
        precision = F.coalesce(F.try_divide(cum_pos, cum_pos + cum_neg), F.lit(0.0))
        sums += [
            F.first(f"all_pos{s}").alias(f"_m{s}"), F.first(f"all_neg{s}").alias(f"_n{s}"),
            F.sum(n_pos * below).alias(f"_p1{s}"), F.sum(n_pos * below * below).alias(f"_p2{s}"),
            F.sum(n_neg * above).alias(f"_q1{s}"), F.sum(n_neg * above * above).alias(f"_q2{s}"),
            F.sum(n_pos * precision).alias(f"_steps{s}"),
        ]
        m, n = as_double("_m"), as_double("_n")
        spread = lambda first, second, size: F.greatest(F.lit(0.0), second - first * first / size) / ((size - 1) * size)
        variance = spread(F.col(f"_p1{s}"), F.col(f"_p2{s}"), m) + spread(F.col(f"_q1{s}"), F.col(f"_q2{s}"), n)
        some, both = (m + n) > 0, (m > 0) & (n > 0)
        measures += [
            F.when(some, F.col(f"_m{s}")).alias(f"n_positive{s}"), F.when(some, F.col(f"_n{s}")).alias(f"n_negative{s}"),
            F.when(both, ratio(F.col(f"_p1{s}"), m)).alias(f"auroc{s}"), F.when((m > 1) & (n > 1), variance).alias(f"variance{s}"),
            F.when(both, ratio(F.col(f"_steps{s}"), m)).alias(f"auprc{s}"),
        ]
    return curve.groupBy(*keys).agg(*sums).select(*keys, *measures)


def _sides(df: DataFrame, contrasts: dict[str, tuple[str, str]], score: str, truth: str) -> DataFrame:
    """Measures of both levels of every contrast, side by side, per site and label.

    One curve per site and label counts all levels, so a row is not copied for every contrast.
    """
    level = lambda stratum, k: F.col(stratum).cast("string") == contrasts[stratum][k]
    conditions = {f"_{s}{i}": level(c, k) for i, c in enumerate(contrasts) for k, s in enumerate("ab")}
    measured = curve_measures(df, ["site", "label"], score, truth, conditions)
    names = ("n_positive", "n_negative", "auroc", "variance", "auprc")
    packed = F.array(*[
        F.struct(
            F.lit(c).alias("stratum"), F.lit(a).alias("level_a"), F.lit(b).alias("level_b"),
            *[F.col(f"{n}_{s}{i}").alias(f"{n}_{s}") for n in names for s in "ab"],
        )
        for i, (c, (a, b)) in enumerate(contrasts.items())
    ])
    return measured.select("site", "label", F.inline(packed)).where("n_positive_a IS NOT NULL OR n_positive_b IS NOT NULL")


def auroc_gap(df: DataFrame, contrasts: dict[str, tuple[str, str]], score: str = "score", truth: str = "truth") -> DataFrame:
    """Area of side b minus side a with a 95 % interval. The sides share no patient, so variances add."""
    gap, error = F.col("auroc_b") - F.col("auroc_a"), F.sqrt(F.col("variance_a") + F.col("variance_b"))
    return _sides(df, contrasts, score, truth).select(
        "site", "label", "stratum", "level_a", "level_b", "n_positive_a", "n_positive_b", "n_negative_a", "n_negative_b",
        "auroc_a", "auroc_b", gap.alias("gap"), error.alias("std_error"), (gap - Z95 * error).alias("ci_low"),
        (gap + Z95 * error).alias("ci_high"), two_sided_p(F.try_divide(gap, error)).alias("p_value"),
    )


def auprc_gap(df: DataFrame, contrasts: dict[str, tuple[str, str]], score: str = "score", truth: str = "truth") -> DataFrame:
    """Average precision of side b minus side a, beside the share of positives that chance would give."""
    prevalence = lambda s: ratio(F.col(f"n_positive_{s}"), F.col(f"n_positive_{s}") + F.col(f"n_negative_{s}"))
    return _sides(df, contrasts, score, truth).select(
        "site", "label", "stratum", "level_a", "level_b", "auprc_a", "auprc_b", (F.col("auprc_b") - F.col("auprc_a")).alias("gap"),
        prevalence("a").alias("prevalence_a"), prevalence("b").alias("prevalence_b"),
    )

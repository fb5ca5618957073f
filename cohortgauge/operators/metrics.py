"""Score quality over long frames ``(keys, score, truth)``. Missing on either side drops out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.maths import ratio
from cohortgauge.operators.ordering import score_curve

NLL_EPS = 1e-9


def bin_edges(bins: int = 10) -> list[float]:
    """``i * (1 / bins)`` in binary floating point: the edges an even grid really has."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def score_bin(score: Column, bins: int = 10) -> Column:
    """Index of the bin ``(low, high]`` holding a score; the first bin is closed.

    The arithmetic guess is corrected against the exact edge, so a score on an edge
    lands where the edge comparison says. Outside [0, 1] there is no bin.
    """
    step = 1.0 / bins
    guess = F.greatest(F.ceil(score * bins) - 1, F.lit(0))
    low = guess.cast("double") * step
    high = F.when(guess == bins - 1, F.lit(1.0)).otherwise((guess + 1).cast("double") * step)
    exact = (
        F.when((score <= low) & (guess > 0), guess - 1).when(score > high, guess + 1).otherwise(guess)
    )
    return F.when((score >= 0) & (score <= 1), exact).cast("int")


def observed(df: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())


def auroc(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth") -> DataFrame:
    """Area under the ROC curve; NULL where one class is absent. Ties count half."""
    curve = score_curve(df, keys, score, truth)
    below = F.col("all_neg") - F.col("cum_neg")
    wins = F.sum(F.col("n_pos").cast("double") * (below + F.col("n_neg") / 2.0))
    pairs = F.first("all_pos").cast("double") * F.first("all_neg").cast("double")
    return curve.groupBy(*keys).agg(
        F.first("all_pos").alias("n_positive"), F.first("all_neg").alias("n_negative"),
        ratio(wins, pairs).alias("auroc"),
    )


def macro_auroc(per_label: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the labels that could be scored."""
    return per_label.groupBy(*keys).agg(
        F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("n_labels")
    )


def brier(score: Column, truth: Column) -> Column:
    return F.avg(F.pow(score - truth, F.lit(2.0)))


def nll(score: Column, truth: Column, eps: float = NLL_EPS) -> Column:
    p = F.least(F.greatest(score, F.lit(eps)), F.lit(1.0 - eps))
    return -F.avg(truth * F.ln(p) + (1.0 - truth) * F.ln(1.0 - p))


def proper_scores(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth") -> DataFrame:
    s, t = F.col(score), F.col(truth)
    return observed(df, score, truth).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), brier(s, t).alias("brier"), nll(s, t).alias("nll")
    )


def binned(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth", bins: int = 10) -> DataFrame:
    """Per bin: rows, sum of scores, sum of truths. The input to ECE and reliability."""
    return (
        observed(df, score, truth)
        .groupBy(*keys, score_bin(F.col(score), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s"), F.sum(truth).alias("t"))
    )


def expected_calibration_error(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth",
                               bins: int = 10, name: str = "ece") -> DataFrame:
    cells = binned(df, keys, score, truth, bins)
    # |t - s| / N per bin equals n/N * |t/n - s/n|; a score without a bin weighs in N only.
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("t") - F.col("s"))))
    return cells.groupBy(*keys).agg(
        F.coalesce(ratio(gap, F.sum("n")), F.lit(0.0)).alias(name)
    )


def reliability_table(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth",
                      bins: int = 10) -> DataFrame:
    """Predicted and observed rate per bin; a bin without rows is listed with ``n = 0``."""
    edges = bin_edges(bins)
    wide = binned(df, keys, score, truth, bins).groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct("n", "s", "t"))))
        ).alias("_bins")
    )
    spine = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin"), F.lit(round(lo, 3)).alias("bin_low"), F.lit(round(hi, 3)).alias("bin_high")
            )
            for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
        ]
    )
    cell = F.try_element_at("_bins", F.col("bin"))
    return wide.select(*keys, "_bins", F.inline(spine)).select(
        *keys, "bin_low", "bin_high", F.coalesce(cell["n"], F.lit(0)).alias("n"),
        ratio(cell["s"], cell["n"]).alias("mean_predicted"), ratio(cell["t"], cell["n"]).alias("observed_rate"),
    )


def positive_weights(cohort: DataFrame, labels: list[str], keys: list[str], cap: float = 20.0) -> DataFrame:
    """Negatives per positive, kept within [1, cap]; 1 where a label has no positives."""
    from cohortgauge.operators.cells import label_cube

    weight = ratio(F.col("n_negative"), F.col("n_positive"))
    bounded = F.least(F.greatest(weight, F.lit(1.0)), F.lit(float(cap)))
    return label_cube(cohort, keys, labels).select(
        *keys, "label", "n_positive", "n_negative",
        F.when(F.col("n_positive") > 0, bounded).otherwise(1.0).alias("weight"),
    )


def masked_bce(df: DataFrame, keys: list[str], logit: str = "logit", truth: str = "truth",
               weight: Column | None = None) -> DataFrame:
    """Mean binary cross-entropy over observed targets; missing ones count on neither side."""
    from cohortgauge.functions.maths import log1p_exp

    z, y = F.col(logit), F.col(truth)
    w = weight if weight is not None else F.lit(1.0)
    loss = w * y * log1p_exp(-z) + (1.0 - y) * log1p_exp(z)
    return df.groupBy(*keys).agg(
        F.coalesce(ratio(F.sum(loss), F.count(truth)), F.lit(0.0)).alias("loss"), F.count(truth).alias("n_observed")
    )

"""Counts over label x view x demographic cells.

A cohort keeps one column per label. Exploding it to one row per label would multiply
a 100 TB scan by the number of labels, so every table here first aggregates the wide
frame to its few cells and only then turns labels into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.maths import ratio, share
from cohortgauge.operators.cohort import FRONTAL_CODES

VIEWS = sorted(FRONTAL_CODES)


def _label(name: str) -> Column:
    return F.col(f"`{name}`")


def label_cube(cohort: DataFrame, dims: list[str], labels: list[str]) -> DataFrame:
    """Long counts ``(dims, label, n_rows, n_positive, n_negative, n_missing)``.

    Each row's contribution is folded map-side; the shuffle carries cells, not rows.
    """
    labels = [name for name in labels if name in cohort.columns]
    counts = [
        F.expr(text)
        for i, name in enumerate(labels)
        for text in (
            f"count_if(`{name}` = 1) AS _p{i}", f"count_if(`{name}` = 0) AS _n{i}",
            f"count_if(`{name}` IS NULL) AS _m{i}",
        )
    ]
    wide = cohort.groupBy(*dims).agg(F.expr("count(1) AS n_rows"), *counts)
    packed = ", ".join(
        f"named_struct('label', '{name}', 'n_positive', _p{i}, 'n_negative', _n{i}, 'n_missing', _m{i})"
        for i, name in enumerate(labels)
    )
    return wide.selectExpr(*dims, "n_rows", f"inline(array({packed}))")


def stack_strata(cube: DataFrame, strata: list[str], keep: list[str]) -> DataFrame:
    """One copy of each cube cell per stratum variable, as ``stratum, level``."""
    packed = ", ".join(f"named_struct('stratum', '{s}', 'level', cast({s} as string))" for s in strata)
    return cube.selectExpr(*keep, f"inline(array({packed}))")


def integrity_stats(cohort: DataFrame, labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """Counts per label and view. Both views are listed even when one is empty."""
    keys = keys or []
    cube = label_cube(cohort.where(F.col("view").isin(VIEWS)), [*keys, "view"], labels)
    names = ["n_rows", "n_positive", "n_negative", "n_missing"]
    wide = cube.groupBy(*keys, "label").agg(
        *[F.expr(f"coalesce(sum({n}) FILTER (WHERE view = '{v}'), 0) AS {n}_{v}") for v in VIEWS for n in names]
    )
    packed = ", ".join(
        f"named_struct('view', '{v}', " + ", ".join(f"'{n}', {n}_{v}" for n in names) + ")" for v in VIEWS
    )
    return wide.selectExpr(*keys, "label", f"inline(array({packed}))")


def inferential_cells(cohort: DataFrame, labels: list[str], strata: tuple[str, ...] = ("sex",),
                      age_bin: str = "age_bin") -> DataFrame:
    """One row per site, label, view and demographic level; missing keys form no cell."""
    names = [c for c in dict.fromkeys((*strata, age_bin)) if c in cohort.columns]
    cube = label_cube(cohort.where(F.col("view").isNotNull()), ["site", "view", *names], labels)
    measures = ["n_rows", "n_positive", "n_negative", "n_missing"]
    long = stack_strata(cube, names, ["site", "label", "view", *measures]).where("level is not null")
    return (
        long.groupBy("site", "label", "view", "stratum", "level")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .orderBy("site", "label", "stratum", "level", "view")
    )


def positives_by_view(cohort: DataFrame, labels: list[str]) -> DataFrame:
    cube = label_cube(cohort, ["site", "view"], labels)
    return cube.groupBy("site", "label").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("view") == v, F.col("n_positive"))), F.lit(0)).alias(v)
            for v in VIEWS
        ]
    )


def cohort_summary(cohort: DataFrame) -> DataFrame:
    """Size and composition per site.

    The exact median counts ages by distinct value (about a hundred), so its state is
    small whatever the number of patients.
    """
    return cohort.groupBy("site").agg(
        F.count(F.lit(1)).alias("patients"),
        share(F.col("view") == "AP").alias("share_ap"),
        share(F.col("sex") == "Female").alias("share_female"),
        F.median("age").alias("age_median"),
        share(F.col("`No Finding`") == 1).alias("share_no_finding"),
    )


def view_share(cohort: DataFrame, by: str, levels: list[str]) -> DataFrame:
    """P(AP) per site, one column per level of ``by``."""
    shares = [
        F.expr(f"try_divide(cast(count_if({by} = '{v}' AND view = 'AP') as double), count_if({by} = '{v}')) AS `{v}`")
        for v in levels
    ]
    return cohort.groupBy("site").agg(*shares)


def contrast_counts(cohort: DataFrame, labels: list[str], contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """Positives on either side of each contrast; cells without positives keep a zero row."""
    strata = [s for s in contrasts if s in cohort.columns]
    cube = label_cube(cohort.where(F.col("view").isNotNull()), ["site", "view", *strata], labels)
    long = stack_strata(cube, strata, ["site", "label", "view", "n_positive"])
    side_a, side_b = level_columns(contrasts)

    def side(level: Column, name: str) -> Column:
        here = F.sum(F.when(F.col("level") == level, F.col("n_positive")))
        return F.coalesce(here, F.lit(0)).alias(name)

    return (
        long.withColumns({"level_a": side_a, "level_b": side_b})
        .groupBy("site", "label", "view", "stratum", "level_a", "level_b")
        .agg(side(F.col("level_a"), "n_a"), side(F.col("level_b"), "n_b"))
    )


def level_columns(contrasts: dict[str, tuple[str, str]]) -> tuple[Column, Column]:
    """The two compared levels as expressions over the ``stratum`` column."""
    first = second = F.lit(None).cast("string")
    for stratum, (a, b) in contrasts.items():
        first = F.when(F.col("stratum") == stratum, a).otherwise(first)
        second = F.when(F.col("stratum") == stratum, b).otherwise(second)
    return first, second


def thinnest_cells(counts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` cells whose smaller side is smallest (top-k, no full sort)."""
    return (
        counts.withColumn("smaller", F.least("n_a", "n_b"))
        .orderBy("smaller", "site", "label", "view", "stratum").limit(n)
        .select("site", "label", "view", "stratum", "level_a", "n_a", "level_b", "n_b", "smaller")
    )


def fold_balance(cohort: DataFrame, labels: list[str], age_bins: list[str], stratify_by: list[str]) -> DataFrame:
    """Composition per site and fold; ``*`` marks the variables the folds control."""

    def named(name: str, source: str | None = None) -> str:
        return name + ("*" if (source or name) in stratify_by else "")

    conditions = {
        named("AP", "view"): "view = 'AP'",
        named("female", "sex"): "sex = 'Female'",
        **{f"age {band}": f"age_bin = '{band}'" for band in age_bins},
        **{named(name): f"`{name}` = 1" for name in labels},
    }
    shares = [
        F.expr(f"round(avg(cast(coalesce({test}, false) as int)), 4) AS `{name}`") for name, test in conditions.items()
    ]
    return cohort.groupBy("site", "fold").agg(F.expr("count(1) AS n_patients"), *shares)


def cell_balance(cohort: DataFrame, labels: list[str], n_folds: int, strata: tuple[str, ...] = ("sex",)) -> DataFrame:
    """Positives per fold within each cell, with their range; thinnest cells first."""
    names = [s for s in strata if s in cohort.columns]
    cube = label_cube(cohort, ["site", "fold", "view", *names], labels)
    long = stack_strata(cube, names, ["site", "fold", "label", "view", "n_positive"]).where(
        "view is not null and level is not null"
    )
    folds = [str(k) for k in range(n_folds)]
    wide = long.groupBy("site", "label", "view", "stratum", "level").agg(
        *[F.expr(f"coalesce(sum(n_positive) FILTER (WHERE fold = {k}), 0) AS `{k}`") for k in folds]
    )
    cols = [F.col(f"`{k}`") for k in folds]
    total = sum(cols[1:], cols[0])
    spread = F.round(ratio(F.greatest(*cols) - F.least(*cols), total) * len(folds), 3)
    return (
        wide.where(total > 0)
        .withColumns({"min": F.least(*cols), "max": F.greatest(*cols), "spread": spread})
        .orderBy("min", "site", "label", "view", "stratum", "level")
    )

"""False-negative-rate gaps: raw, within view, standardised, and what they support.

One scan of the decisions yields a cube of counts whose size depends on the number of
sites, labels, views and groups only. Every estimate below is arithmetic on that cube.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.maths import ratio
from cohortgauge.operators.cells import level_columns, stack_strata

# Fixed values.
DEFAULT_REFERENCE = {"AP": 0.5, "PA": 0.5}
EQUIVALENCE_MARGIN = 0.02
MIN_POSITIVES = 10
MAX_DISTANCE = 0.30

CELL_KEYS = ["site", "label", "stratum", "level_a", "level_b"]
MEASURES = ["n", "n_positive", "n_missed", "n_flagged"]


class FairnessError(ValueError):
    """An estimate cannot be computed as specified."""


def outcome_cube(decisions: DataFrame, dims: list[str]) -> DataFrame:
    """Counts per site, label, view and ``dims``: rows, positives, missed, flagged.

    A missed positive has an explicit negative prediction; a missing prediction is
    not a miss. The groupBy folds map-side, so one dominant site costs no more.
    """
    sick = F.col("truth") == 1
    return decisions.groupBy("site", "label", "view", *dims).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sick).alias("n_positive"),
        F.count_if(sick & (F.col("predicted") == 0)).alias("n_missed"),
        F.count_if(F.col("predicted") == 1).alias("n_flagged"),
    )


def contrast_cells(cube: DataFrame, contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """The cube once per contrast, each cell marked as side ``a``, ``b`` or ``other``."""
    strata = [s for s in contrasts if s in cube.columns]
    if not strata:
        raise FairnessError(f"the cube lacks the stratum columns {sorted(contrasts)}")
    long = stack_strata(cube, strata, ["site", "label", "view", *MEASURES])
    a, b = level_columns(contrasts)
    sided = long.withColumns({"level_a": a, "level_b": b})
    side = (
        F.when(F.col("level") == F.col("level_a"), "a").when(F.col("level") == F.col("level_b"), "b").otherwise("other")
    )
    return sided.withColumn("side", side).groupBy(*CELL_KEYS, "view", "side").agg(
        *[F.sum(m).alias(m) for m in MEASURES]
    )


def _count(measure: str, condition: str) -> str:
    return f"coalesce(sum({measure}) FILTER (WHERE {condition}), 0)"


def _rate(condition: str) -> str:
    """False-negative rate of the cells under ``condition``; NULL without positives."""
    return f"try_divide(cast({_count('n_missed', condition)} as double), {_count('n_positive', condition)})"


def overall_rates(cube: DataFrame) -> DataFrame:
    """False-negative rate and flagged rate per site and label."""
    return cube.groupBy("site", "label").agg(
        F.sum("n_positive").alias("positives"),
        ratio(F.sum("n_missed"), F.sum("n_positive")).alias("fnr"),
        ratio(F.sum("n_flagged"), F.sum("n")).alias("flagged"),
    )


def _gap(cells: DataFrame, keys: list[str]) -> DataFrame:
    sides = [F.expr(f"{_rate(f"side = '{s}'")} AS rate_{s}") for s in "ab"]
    sizes = [F.expr(f"{_count('n_positive', f"side = '{s}'")} AS n_{s}") for s in "ab"]
    return cells.groupBy(*keys).agg(*sides, *sizes).selectExpr("*", "rate_b - rate_a AS gap")


def group_gap(cells: DataFrame) -> DataFrame:
    """Rate of side b minus side a, over all views."""
    return _gap(cells, CELL_KEYS)


def within_view_gaps(cells: DataFrame) -> DataFrame:
    """The same gap inside each recorded view."""
    return _gap(cells.where("view is not null"), [*CELL_KEYS, "view"])


def _standardised(side: str, reference: dict[str, float]) -> str:
    """Reference-weighted rate; NULL as soon as one referenced view has no positives."""
    return " + ".join(
        f"{float(weight)}D * {_rate(f"side = '{side}' AND view = '{view}'")}" for view, weight in reference.items()
    )


def standardise_rate(cells: DataFrame, reference: dict[str, float] | None = None) -> DataFrame:
    """Rate of each side under the reference mixture of views."""
    mix = reference or DEFAULT_REFERENCE
    return cells.groupBy(*CELL_KEYS).agg(*[F.expr(f"{_standardised(s, mix)} AS std_rate_{s}") for s in "ab"])


def standardised_gap(cells: DataFrame, reference: dict[str, float] | None = None) -> DataFrame:
    rates = standardise_rate(cells, reference)
    return rates.withColumn("gap_standardised", F.col("std_rate_b") - F.col("std_rate_a"))


def paired_gaps(cells: DataFrame, keys: list[str], reference: dict[str, float]) -> DataFrame:
    """Raw and standardised gap of every set of cells, ``raw`` and ``std``, from one aggregate."""
    raw = f"{_rate("side = 'b'")} - {_rate("side = 'a'")} AS raw"
    std = f"({_standardised('b', reference)}) - ({_standardised('a', reference)}) AS std"
    return cells.groupBy(*keys).agg(F.expr(raw), F.expr(std))


def positivity_detail(cells: DataFrame, reference: dict[str, float] | None = None, min_positives: int = MIN_POSITIVES,
                      max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Each side's observed share of every reference view, and whether it is usable.

    Views without a row still appear: the reference, not the data, lists them.
    """
    mix = reference or DEFAULT_REFERENCE
    slots = [(k, side, i, view) for k, side in enumerate("ab") for i, view in enumerate(mix)]
    sides = cells.groupBy(*CELL_KEYS).agg(
        *[
            F.expr(f"{_count('n_positive', f"side = '{s}' AND view = '{v}'")} AS _{s}_{i}") for _, s, i, v in slots
        ],
        *[F.expr(f"{_count('n_positive', f"side = '{s}'")} AS _{s}") for s in "ab"],
    )
    packed = ", ".join(
        f"named_struct('pos', {k * len(mix) + i}, 'level', level_{s}, 'view', '{v}', 'n_positive', _{s}_{i}, "
        f"'_total', _{s}, 'reference_weight', {float(mix[v])}D)"
        for k, s, i, v in slots
    )
    stacked = sides.selectExpr(*CELL_KEYS, f"inline(array({packed}))").selectExpr(
        "*", "try_divide(cast(n_positive as double), _total) AS _share"
    )
    return stacked.selectExpr("*", "abs(_share - reference_weight) AS _distance").selectExpr(
        *CELL_KEYS, "pos", "level", "view", "n_positive", "round(_share, 4) AS observed_share", "reference_weight",
        "round(_distance, 4) AS reweight_distance",
        f"""CASE WHEN n_positive < {min_positives} THEN concat(level, '/', view, ': ', n_positive, ' positives')
            WHEN _distance > {float(max_distance)}D THEN concat(level, '/', view, ': observed ',
                 format_string('%.2f', round(_share, 2)), ' reweighted to ',
                 format_string('%.2f', round(reference_weight, 2))) END AS problem""",
    )


def positivity_report(detail: DataFrame) -> DataFrame:
    """One verdict per analysis: ``positivity_ok`` and the problems in order."""
    listed = F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("pos", "problem"))))
    return detail.groupBy(*CELL_KEYS).agg(
        (F.count("problem") == 0).alias("positivity_ok"),
        F.array_join(F.transform(listed, lambda p: p["problem"]), "; ").alias("positivity_note"),
    )


# --------------------------------------------------------------------- verdicts


def significant(low: Column, high: Column) -> Column:
    """The interval excludes zero; without an interval, no."""
    return F.coalesce((low > 0) | (high < 0), F.lit(False))


def verdict(low: Column, high: Column, margin) -> Column:
    """Outcome an interval on the gap difference supports."""
    limit = margin if isinstance(margin, Column) else F.lit(float(margin))
    return (
        F.when(low.isNull(), "not estimated")
        .when(low > 0, "attenuation")
        .when(high < 0, "masking")
        .when((low >= -limit) & (high <= limit), "independence")
        .otherwise("inconclusive")
    )


def verdict_sensitivity(estimates: DataFrame, margins: list[float]) -> DataFrame:
    """The verdict under each margin, and whether it moves."""
    low, high = F.col("delta_ci_low"), F.col("delta_ci_high")
    named = {f"margin={m}": verdict(low, high, m) for m in margins}
    return estimates.select(
        "site", "label", "stratum", *[c.alias(n) for n, c in named.items()],
        (F.size(F.array_distinct(F.array(*named.values()))) == 1).alias("stable"),
    )


def replication(estimates: DataFrame) -> DataFrame:
    """Agreement across sites for each label and contrast. A group holds one row per site."""
    return estimates.groupBy("label", "stratum").agg(
        (F.count_distinct("verdict") == 1).alias("same_verdict"),
        (F.count_distinct(F.sign("delta")) == 1).alias("same_direction"),
        F.array_join(F.array_sort(F.collect_set("verdict")), ", ").alias("verdicts"),
    )


def replication_pivot(estimates: DataFrame, sites: list[str]) -> DataFrame:
    """Difference and verdict side by side, one column pair per site."""
    return estimates.groupBy("label", "stratum").pivot("site", sites).agg(
        F.first("delta").alias("delta"), F.first("verdict").alias("verdict")
    )

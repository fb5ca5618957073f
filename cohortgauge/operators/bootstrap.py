"""Patient bootstrap on cell counts.

Drawing n patients with replacement and recounting is a multinomial draw over the
cells (side x view x missed), so a replicate costs a few numbers whatever n is. The
multinomial is a chain of binomial draws keyed by seed, analysis and replicate: column
expressions, with replicates as rows dealt over all tasks. A replicate is a set of cells
like the observed one, and the estimators of the gaps are applied to it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.draws import binomial_sql, normal_sql, unit_sql
from cohortgauge.operators.fairness import (
    CELL_KEYS,
    DEFAULT_REFERENCE,
    EQUIVALENCE_MARGIN,
    group_gap,
    paired_gaps,
    positivity_detail,
    positivity_report,
    significant,
    standardised_gap,
    verdict,
    within_view_gaps,
)

#: Fewer usable replicates than this give no interval.
MIN_USABLE = 100
BOTH = "both"
GROUP = [*CELL_KEYS, "scope"]


def _shares(cells: DataFrame) -> DataFrame:
    """One row per analysis and scope: its cells in a fixed order with the shares the chain draws by.

    ``share`` is the cell's part of what the cells before it leave, ``missed`` its own rate. The
    array is bounded by three sides times the views.
    """
    scopes = F.when(F.col("view").isNull(), F.array(F.lit(BOTH))).otherwise(F.array(F.lit(BOTH), F.col("view")))
    staged = cells.where("n_positive > 0").select(
        *CELL_KEYS, F.explode(scopes).alias("scope"),
        F.struct("side", F.coalesce("view", F.lit("")).alias("view"), "n_positive", "n_missed").alias("cell"),
    )
    packed = staged.groupBy(*GROUP).agg(F.array_sort(F.collect_list("cell")).alias("cells"), F.sum("cell.n_positive").alias("total"))
    before = "aggregate(slice(cells, 1, i), 0L, (t, x) -> t + x.n_positive)"
    return packed.selectExpr(
        *GROUP, "total",
        f"""transform(cells, (c, i) -> named_struct('side', c.side, 'view', c.view, 'share', cast(c.n_positive as double) / (total - {before}),
            'missed', cast(c.n_missed as double) / c.n_positive)) AS cells""",
    )


def replicate_cells(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The cells of every replicate: ``side, view, n_positive, n_missed`` per analysis, scope and replicate."""
    spark = cells.sparkSession
    spread = _shares(cells).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # A few short rows make all the work: a number of partitions that adaptive execution leaves alone.
    dealt = spread.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *GROUP, "replicate")
    key = ", ".join(["'" + str(seed) + "'", *GROUP, "cast(replicate as string)", "cast(i as string)"])
    digests = f"transform(cells, (c, i) -> md5(concat_ws(':', {key})))"
    u, v = unit_sql("h", 0), unit_sql("h", 2)
    drawn_by = f"named_struct('u', {u}, 'z', {normal_sql(u, unit_sql('h', 1))}, 'v', {v}, 'y', {normal_sql(v, unit_sql('h', 3))})"
    keyed = dealt.withColumn("draws", F.expr(f"transform({digests}, h -> {drawn_by})"))
    first = binomial_sql("(s.rest - s.last)", "cells[i].share", "draws[i].u", "draws[i].z")
    chain = f"""aggregate(sequence(0, size(cells) - 1), named_struct('rest', total, 'last', 0L, 'drawn', cast(array() as array<bigint>)),
        (s, i) -> named_struct('rest', s.rest - s.last, 'last', {first}, 'drawn', IF(i = 0, s.drawn, concat(s.drawn, array(s.last)))))"""
    drawn = keyed.withColumn("chain", F.expr(chain)).withColumn("drawn", F.expr("concat(chain.drawn, array(chain.last))"))
    return drawn.selectExpr(
        *GROUP, "replicate",
        f"""inline(transform(cells, (c, i) -> named_struct('side', c.side, 'view', c.view, 'n_positive', drawn[i],
            'n_missed', {binomial_sql("drawn[i]", "c.missed", "draws[i].v", "draws[i].y")})))""",
    )


OUT = [
    "ci_low", "ci_high", "usable", "raw_ci_low", "raw_ci_high", "std_ci_low", "std_ci_high", "delta_ci_low",
    "delta_ci_high", "usable_replicates",
]


def bootstrap(cells: DataFrame, *, reference: dict[str, float] | None = None, replicates: int = 2000, ci: float = 0.95,
              seed: int = 42) -> DataFrame:
    """Intervals per analysis and scope (``both`` views, and each view alone).

    ``ci_low/high`` is the gap's own interval. For ``both`` the paired intervals on
    the raw gap, the standardised gap and their difference come from the replicates
    in which both gaps exist; the others are counted out.
    """
    gaps = paired_gaps(replicate_cells(cells, replicates, seed), [*GROUP, "replicate"], reference or DEFAULT_REFERENCE)
    both = (F.col("scope") == BOTH) & F.col("raw").isNotNull() & F.col("std").isNotNull()
    ends = F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2))
    measures = {
        "": F.col("raw"), "raw_": F.when(both, F.col("raw")), "std_": F.when(both, F.col("std")), "delta_": F.when(both, F.col("raw") - F.col("std")),
    }
    folded = gaps.groupBy(*GROUP).agg(
        F.count("raw").alias("usable"), F.count_if(both).alias("_paired"), *(F.percentile(c, ends).alias(f"_{n}") for n, c in measures.items())
    )
    enough = lambda n, count: F.when(F.col(count) >= MIN_USABLE, F.col(n))
    intervals = {}
    for name in measures:
        count = "_paired" if name else "usable"
        intervals[f"{name}ci_low"], intervals[f"{name}ci_high"] = (enough(f"_{name}", count)[i] for i in (0, 1))
    paired = F.when(F.col("scope") == BOTH, F.col("_paired"))
    return folded.withColumns({**intervals, "usable_replicates": paired}).select(*GROUP, *OUT)


def bootstrap_gaps(cells: DataFrame, draws: DataFrame) -> DataFrame:
    """Gap, interval and significance over both views and within each."""
    estimates = group_gap(cells).withColumn("view", F.lit(BOTH)).unionByName(within_view_gaps(cells))
    intervals = draws.select(*CELL_KEYS, F.col("scope").alias("view"), "ci_low", "ci_high")
    return estimates.join(intervals, [*CELL_KEYS, "view"], "left").withColumn(
        "significant", significant(F.col("ci_low"), F.col("ci_high"))
    )


def delta_gaps(cells: DataFrame, draws: DataFrame, *, reference: dict[str, float] | None = None,
               margin: float = EQUIVALENCE_MARGIN, replicates: int = 2000, min_positives: int = 10,
               max_distance: float = 0.30) -> DataFrame:
    """Raw and standardised gap, their difference with intervals, verdict and positivity."""
    raw = group_gap(cells).select(*CELL_KEYS, "n_a", "n_b", F.col("gap").alias("gap_raw"))
    std = standardised_gap(cells, reference).select(*CELL_KEYS, "gap_standardised")
    detail = positivity_detail(cells, reference, min_positives, max_distance)
    paired = draws.where(F.col("scope") == BOTH).drop("scope", "ci_low", "ci_high", "usable")
    joined = raw.join(std, CELL_KEYS).join(paired, CELL_KEYS, "left").join(positivity_report(detail), CELL_KEYS)
    return joined.withColumns(
        {
            "delta": F.col("gap_raw") - F.col("gap_standardised"),
            "verdict": verdict(F.col("delta_ci_low"), F.col("delta_ci_high"), margin),
            "equivalence_margin": F.lit(float(margin)),
            "usable_replicates": F.coalesce("usable_replicates", F.lit(0)),
            "attempted_replicates": F.lit(replicates),
        }
    )

"""Corrections over a family of p-values.

A family has one row per fitted model, so its window is as small as the study design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ranked(df: DataFrame, family: list[str], p: str, ties: list[str]):
    order = W.partitionBy(*family).orderBy(p, *ties) if family else W.orderBy(p, *ties)
    whole = W.partitionBy(*family) if family else W.partitionBy(F.lit(1))
    return df.where(F.col(p).isNotNull()).withColumns(
        {"_rank": F.row_number().over(order), "_m": F.count(F.lit(1)).over(whole)}
    )


def holm(df: DataFrame, family: list[str], p: str = "p_value", ties: list[str] | None = None,
         alpha: float = 0.05) -> DataFrame:
    """Holm: family-wise error control for confirmatory tests."""
    stepped = (F.col("_m") - F.col("_rank") + 1) * F.col(p)
    running = W.partitionBy(*family).orderBy("_rank").rowsBetween(W.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.max(stepped).over(running))
    return (
        _ranked(df, family, p, ties or []).withColumn("p_adjusted", adjusted)
        .withColumn("reject", F.col("p_adjusted") < alpha).drop("_rank", "_m")
    )


def benjamini_hochberg(df: DataFrame, family: list[str] | None = None, p: str = "p_value",
                       ties: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: false-discovery control for exploratory tests."""
    family = family or []
    stepped = F.col("_m") / F.col("_rank") * F.col(p)
    running = W.partitionBy(*family).orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(stepped).over(running))
    return (
        _ranked(df, family, p, ties or []).withColumn("p_adjusted", adjusted)
        .withColumn("reject", F.col("p_adjusted") < alpha).drop("_rank", "_m")
    )

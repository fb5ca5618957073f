"""Numeric expressions kept inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are moved this far from 0 and 1 before the logit.
LOGIT_EPS = 1e-6


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def logit(probability, eps: float = LOGIT_EPS) -> Column:
    p = F.least(F.greatest(_col(probability), F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def log1p_exp(z) -> Column:
    """``ln(1 + e^z)`` without overflow."""
    z = _col(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that answers NULL for an empty denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def share(condition: Column) -> Column:
    """Share of rows where ``condition`` holds; a missing value counts as not holding."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def _erf_series(x: Column) -> Column:
    """erf for 0 <= x < 3: a series of positive terms, so nothing cancels."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * 2.0 * x * x / (2.0 * n + 1.0)).alias("term"),
            (acc["total"] + acc["term"] * 2.0 * x * x / (2.0 * n + 1.0)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * step


def _erfc_fraction(x: Column) -> Column:
    """erfc for x >= 3 by its continued fraction, evaluated from the inside out."""
    tail = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, k: x + (k / 2.0) / acc
    )
    return F.exp(-x * x) / (F.lit(math.sqrt(math.pi)) * tail)


def _erfc(x: Column) -> Column:
    """erfc for x >= 0."""
    return F.when(x < 3.0, F.lit(1.0) - _erf_series(x)).when(x >= 3.0, _erfc_fraction(x))


def normal_cdf(z) -> Column:
    z = _col(z)
    upper = F.lit(0.5) * _erfc(F.abs(z) / math.sqrt(2.0))
    return F.when(z >= 0, F.lit(1.0) - upper).when(z < 0, upper)


def two_sided_p(z) -> Column:
    return _erfc(F.abs(_col(z)) / math.sqrt(2.0))

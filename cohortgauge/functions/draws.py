"""Keyed random draws as SQL text, so that they run inside generated code and repeat anywhere."""

from __future__ import annotations

#: Below this variance a binomial draw adds up the distribution, above it expands the quantile.
EXACT_VARIANCE = 9
#: Terms are added up to the mean, so many standard deviations and so many more. The tail beyond
#: is below 1e-10, and uniforms of 32 bits do not reach it.
EXACT_DEVIATIONS, EXACT_MORE = 7, 8


def unit_sql(digest: str, number: int) -> str:
    """Uniform inside (0, 1) from the ``number``-th eight hex digits of an md5."""
    return f"((cast(conv(substr({digest}, {8 * number + 1}, 8), 16, 10) as bigint) + 0.5D) / 4294967296D)"


def normal_sql(first: str, second: str) -> str:
    """Standard normal from two uniforms (Box and Muller)."""
    return f"(sqrt(-2D * ln({first})) * cos(2D * pi() * {second}))"


def _summed_sql(n: str, p: str, u: str) -> str:
    """How many values have a distribution function of ``u`` or less; ``p`` is one half at most."""
    odds = f"({p} / (1D - {p}))"
    step = f"named_struct('f', sum_.f * ({n} - j_) / (j_ + 1) * {odds}, 'below', sum_.below + sum_.f, 'k', sum_.k + IF(sum_.below + sum_.f <= {u}, 1L, 0L))"
    start = f"named_struct('f', pow(1D - {p}, {n}), 'below', 0D, 'k', 0L)"
    terms = f"cast({n} * {p} + {EXACT_DEVIATIONS} * sqrt({n} * {p} * (1D - {p})) + {EXACT_MORE} as bigint)"
    return f"aggregate(sequence(0L, least({n} - 1, {terms})), {start}, (sum_, j_) -> {step}).k"


def binomial_sql(n: str, p: str, u: str, z: str) -> str:
    """A binomial draw of ``n`` (bigint) trials: the quantile at ``u``, or at the normal ``z``.

    A small variance sums the distribution exactly. A large one takes the quantile's expansion
    with its skewness, whose error is far below one count in a standard deviation.
    """
    variance = f"({n} * {p} * (1D - {p}))"
    expanded = f"floor({n} * {p} + sqrt({variance}) * {z} + (1D - 2D * {p}) * ({z} * {z} - 1D) / 6D + 0.5D)"
    return f"""CASE WHEN {n} = 0 OR {p} <= 0D THEN 0L WHEN {p} >= 1D THEN {n}
      WHEN {variance} >= {EXACT_VARIANCE} THEN least({n}, greatest(0L, cast({expanded} as bigint)))
      WHEN {p} <= 0.5D THEN {_summed_sql(n, p, u)} ELSE {n} - {_summed_sql(n, f"(1D - {p})", u)} END"""

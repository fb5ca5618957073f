"""Identifier and keyed-randomness expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a missing value inside a composed stratum key.
MISSING = "∅"


def canonical_image_key(name, depth: int = 1, pattern: str | None = None) -> Column:
    """One comparable form for an image named by file, path or bare identifier.

    Without ``pattern``: the last ``depth`` path parts, extension removed, lowercase.
    With ``pattern``: its capture groups joined by ``_``, lowercase, and NULL where
    the pattern does not match.
    """
    if depth < 1:
        raise ValueError(f"image key depth must be at least 1, got {depth}")
    path = F.replace(F.col(name) if isinstance(name, str) else name, F.lit("\\"), F.lit("/"))
    if pattern is None:
        tail = F.substring_index(path, "/", -depth)
        return F.lower(F.regexp_replace(tail, r"\.[A-Za-z0-9]+$", ""))
    groups = re.compile(pattern).groups
    if groups == 0:
        raise ValueError(f"image key pattern {pattern!r} has no capture groups")
    parts = [F.regexp_extract(path, pattern, i + 1) for i in range(groups)]
    # regexp_extract answers '' for "no match", so the match is tested separately.
    return F.when(path.rlike(pattern), F.lower(F.concat_ws("_", *parts)))


def hash_hex(seed, *parts) -> Column:
    """md5 over ``seed:part:part``; the order key behind every keyed draw.

    It depends on the row's own identity only, so the draw is the same however the
    rows are partitioned or retried.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first.cast("string"), *[c.cast("string") for c in cols]))


def hex_to_long(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def hash_unit_sql(*parts: str) -> str:
    """Uniform on [0, 1) keyed by ``parts`` (SQL expressions), as SQL text.

    Wide frames use text forms: one parsed expression per label instead of dozens of
    calls from Python into the JVM.
    """
    joined = ", ".join(f"cast({p} as string)" for p in parts)
    return f"(cast(conv(substr(md5(concat_ws(':', {joined})), 1, 8), 16, 10) as bigint) / 4294967296D)"


def hash_unit(seed, *parts) -> Column:
    """Uniform on [0, 1) keyed by the arguments."""
    return hex_to_long(F.substring(hash_hex(seed, *parts), 1, 8)) / F.lit(4294967296.0)


def stratum_key(*cols: str) -> Column:
    """A non-null string naming a stratum; missing members form their own stratum."""
    if not cols:
        return F.lit("all")
    parts = ", ".join(f"coalesce(cast({c} as string), '{MISSING}')" for c in cols)
    return F.expr(f"concat_ws('|', {parts})")

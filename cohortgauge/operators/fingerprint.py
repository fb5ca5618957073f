"""Order-free digests of identifier sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.keys import hex_to_long

#: 32 hex digits of each identifier's sha256 enter the sums, as four words.
WORDS = 4


def fingerprint(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """16 hex digits naming the multiset of identifiers, whatever its order.

    Hashing a sorted list would need all identifiers in one place. Sums of hash words
    need none: they fold map-side, and the digest covers the sums and the count.
    """
    digest = F.sha2(F.col(column).cast("string"), 256)
    words = [hex_to_long(F.substring(digest, 8 * i + 1, 8)).alias(f"_w{i}") for i in range(WORDS)]
    keys = keys or []
    sums = df.select(*keys, *words).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.col(f"_w{i}").cast("decimal(20,0)")), F.lit(0)).alias(f"_s{i}") for i in range(WORDS)],
    )
    text = F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(WORDS)])
    return sums.select(*keys, "n", F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))

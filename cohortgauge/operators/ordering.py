"""Ranks and running totals that never put one group into one task.

``row_number() over (partition by g order by k)`` sends all of ``g`` to a single
task. The helpers here cut each group into ordered chunks, rank inside a chunk, and
add the number of rows in the chunks before it. The result is the same number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgauge.session import materialise

#: Leading hex digits of an md5 order key that name its chunk: 4,096 even chunks.
CHUNK_DIGITS = 3
#: Buckets of scores in a group.
BUCKETS = 4096


def hash_rank(df: DataFrame, keys: list[str], order: Column, tie: str, name: str = "rank",
              carry: DataFrame | None = None) -> DataFrame:
    """1-based rank by an md5 order key within ``keys``.

    md5 values are uniform, so the leading digits split even one dominant group into
    equal chunks. The chunk totals are at most 4,096 rows per group. ``carry`` is a
    per-group table whose columns ride along on those totals, without a join of its own.
    """
    chunked = df.withColumn("_order", order).withColumn(
        "_chunk", F.substring("_order", 1, CHUNK_DIGITS)
    )
    totals = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    if carry is not None:
        offsets = offsets.join(carry, keys)
    inside = W.partitionBy(*keys, "_chunk").orderBy("_order", tie)
    return (
        chunked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_order", "_chunk", "_inside", "_before")
    )


def hash_select(df: DataFrame, keys: list[str], order: Column, tie: str, take: DataFrame, wanted: str, name: str) -> DataFrame:
    """Add ``name``: whether a row is among the first ``wanted`` of its group by an md5 order key.

    ``take`` holds ``wanted`` per group. Chunk totals name the one chunk per group in which the
    selection ends; only its rows, some 1 in 4,096, are ranked, for the last key selected. All
    others are told apart by comparing with that key, so nothing else is sorted. Rows of equal
    ``tie`` fall on the same side; a group without an entry in ``take`` selects nothing.
    """
    keyed = df.withColumn("_order", order)
    chunk = F.substring("_order", 1, CHUNK_DIGITS)
    totals = keyed.groupBy(*keys, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    ends = (
        totals.withColumn("_upto", F.sum("_n").over(upto)).join(take.select(*keys, F.col(wanted).alias("_wanted")), keys)
        .where("_wanted > 0 AND _wanted > _upto - _n AND _wanted <= _upto")
        .select(*keys, "_chunk", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    inside = keyed.select(*keys, "_order", tie, chunk.alias("_chunk")).join(ends, [*keys, "_chunk"])
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_order", tie))
    last = inside.withColumn("_rank", rank).where("_rank = _need").select(*keys, F.struct("_order", F.col(tie).alias("_tie")).alias("_last"))
    whole = take.select(*keys, (F.col(wanted) > 0).alias("_some")).join(last, keys, "left")
    # A group asked for all its rows, or more, has no last key: it selects everything.
    chosen = F.when(~F.coalesce("_some", F.lit(False)), False).when(F.col("_last").isNull(), True)
    chosen = chosen.otherwise(F.struct("_order", F.col(tie).alias("_tie")) <= F.col("_last"))
    return keyed.join(whole, keys, "left").withColumn(name, chosen).drop("_order", "_some", "_last")


def range_chunks(df: DataFrame, keys: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """Add ``_chunk``, increasing with ``order`` within ``keys``.

    Range partitioning samples the data for its bounds, so chunks are even for any
    distribution. The chunk number depends on that sample and is therefore written
    once to reliable storage; no later retry can renumber it.
    """
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in (*keys, *order)]
    return materialise(
        df.repartitionByRange(pieces, *by).withColumn("_chunk", F.spark_partition_id())
    )


def ordered_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """0-based rank over the whole table by arbitrary sort columns."""
    chunked = range_chunks(df, [], order)
    totals = chunked.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the table, never per row.
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_chunk").orderBy(*order)
    return (
        chunked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, "_chunk")
        .withColumn(name, F.col("_before") + F.col("_inside") - 1)
        .drop("_chunk", "_inside", "_before")
    )


def score_bucket(score: Column) -> Column:
    """A bucket number that rises with the score, of ``BUCKETS``, the same for any data.

    Between 0 and 1 the log odds are cut, so that probabilities crowding at either end still
    spread; scores outside share the outer quarters. NaN comes last, as in sorting. Never null,
    and said so: joins on the bucket then need no null filter, which would spell the score out
    again below one side and keep both sides from sharing their exchange.
    """
    squeeze = lambda x: x / (1.0 + F.abs(x))
    inside = squeeze(F.ln(score / (1.0 - score)))
    unit = (
        F.when(score <= 0, 0.25 * (1.0 + squeeze(score))).when(score < 1, 0.5 + 0.25 * inside)
        .when(score >= 1, 0.75 + 0.25 * squeeze(score - 1.0))
    )
    return F.coalesce(F.when(F.isnan(score), F.lit(BUCKETS)).otherwise(F.floor(unit * BUCKETS).cast("int")), F.lit(BUCKETS))


def score_curve(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth",
                sides: dict[str, Column] | None = None) -> DataFrame:
    """Class counts at and above every distinct score.

    One row per ``keys`` and score: ``n_pos``/``n_neg`` at the score, ``cum_pos``/
    ``cum_neg`` at or above it, ``all_pos``/``all_neg`` for the group. Tied rows are folded
    together before anything is sorted, so a value held by a third of all rows costs one
    row. Buckets with fixed edges cut each group into ordered pieces; their counts are at most
    ``BUCKETS`` + 1 rows a group, and nothing is sampled, stored or run before the result is.

    ``sides`` maps suffixes to conditions: the six counts then exist once for each, over the rows
    where it holds. Overlapping selections share the rows of the curve instead of having a curve each.
    """
    sides = {"": F.lit(True)} if sides is None else sides
    classes = [(f"{kind}{s}", F.count_if((F.col(truth) == value) & holds)) for s, holds in sides.items() for kind, value in (("pos", 1), ("neg", 0))]
    names = [name for name, _ in classes]
    folded = (
        df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, score_bucket(F.col(score)).alias("_bucket"), F.col(score).alias("score"))
        .agg(*[count.alias(f"n_{name}") for name, count in classes])
    )
    group = W.partitionBy(*keys)
    above = group.orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = folded.groupBy(*keys, "_bucket").agg(*[F.sum(f"n_{n}").alias(f"_{n}") for n in names]).select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_{n}_above") for n in names],
        *[F.sum(f"_{n}").over(group).alias(f"all_{n}") for n in names],
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    return (
        folded.select("*", *[F.sum(f"n_{n}").over(inside).alias(f"_{n}_inside") for n in names])
        .join(offsets, [*keys, "_bucket"])
        .select(
            *keys, "score", *[f"n_{n}" for n in names],
            *[(F.col(f"_{n}_inside") + F.col(f"_{n}_above")).alias(f"cum_{n}") for n in names], *[f"all_{n}" for n in names],
        )
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


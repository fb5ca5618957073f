"""Sharding by a keyed permutation of global row numbers; DataFrame functions only.

Rows get gapless numbers in a fixed order. A Feistel network over a grid of about N cells
permutes the numbers; a number that lands beyond N walks on through the network until it
falls inside (cycle walking), which keeps it a permutation of exactly 0 to N-1. Shard and
slot are the remainder and the quotient of the permuted number, so both can be computed
from a row number alone, and shard sizes differ by at most one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgauge.llm.tables import stored

SHARDS = 16
ROUNDS = 6
SEED = "shuffle-1"


def row_numbers(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a column ``row``: gapless from 0, ascending by ``order`` (nulls first).

    The rows are cut into ranges; a stored copy pins which row fell into which range before
    the ranges are counted. Equal rows are interchangeable and may be cut apart, so a value
    that a third of the rows share does not end up in one range.
    """
    cut = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie")
    pinned = stored(cut.withColumn("range", F.spark_partition_id()), "ranges")
    # One row per range: their number is that of the shuffle partitions, whatever the input.
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = pinned.groupBy("range").count().select(
        "range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order, "tie"))
    numbered = pinned.withColumn("inside", inside).join(starts, "range")
    return numbered.withColumn("row", F.col("before") + F.col("inside") - 1).drop("range", "inside", "before", "tie")


def _digest(seed: str, turn: int, half: Column, modulus: int) -> Column:
    """A keyed pseudo-random number below ``modulus``."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{turn}"), half.cast("string"))), 1, 15)
    return F.conv(hexed, 16, 10).cast("long") % F.lit(modulus)


def _network(number: Column, wide: int, high: int, seed: str, rounds: int) -> Column:
    """One pass over a grid of ``wide`` x ``high`` cells: a bijection of 0 to wide*high-1.

    The halves travel in a struct through ``transform`` so that each round is written once.
    """
    step = lambda turn: lambda s: (
        F.struct(((s["l"] + _digest(seed, turn, s["r"], wide)) % F.lit(wide)).alias("l"), s["r"].alias("r"))
        if turn % 2 == 0
        else F.struct(s["l"].alias("l"), ((s["r"] + _digest(seed, turn, s["l"], high)) % F.lit(high)).alias("r"))
    )
    state = F.array(F.struct((number % F.lit(wide)).alias("l"), F.floor(number / F.lit(wide)).cast("long").alias("r")))
    for turn in range(rounds):
        state = F.transform(state, step(turn))
    return F.element_at(F.transform(state, lambda s: s["r"] * F.lit(wide) + s["l"]), 1)


def permuted(number: Column, count: int, seed: str = SEED, rounds: int = ROUNDS) -> Column:
    """Where ``number`` of 0 to count-1 goes under the keyed permutation.

    The grid has fewer than sqrt(count)+1 cells too many, and no walk meets one of them
    twice; so that many further passes always end inside. Only the few numbers that start
    on such a cell walk at all.
    """
    wide = max(1, math.isqrt(max(count - 1, 0)) + 1)
    high = max(1, -(-count // wide))
    excess = wide * high - count
    first = _network(number, wide, high, seed, rounds)
    if not excess:
        return first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(excess)), F.struct(number.alias("from"), first.alias("to")).getField("to"),
        lambda at, _: F.when(at < F.lit(count), at).otherwise(_network(at, wide, high, seed, rounds)),
    )
    return F.when(first < F.lit(count), first).otherwise(walk)


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, row, place, shard, slot``.

    Rows are numbered by id, size and checksum. A null id comes first; a null text counts as
    an empty one. Repeated rows get numbers of their own. Fewer rows than shards leave
    shards empty; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError(f"shards must be at least 1, got {shards}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    numbered = stored(row_numbers(narrow, "doc_id", "size", "text_crc32"), "row-numbers")
    count = numbered.count()
    place = numbered.withColumn("place", permuted(F.col("row"), count, seed))
    return place.withColumn("shard", (F.col("place") % F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("place") / F.lit(shards)).cast("long")
    )

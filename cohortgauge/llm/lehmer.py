"""What each filter of a chain removes, in every order of the chain.

A row is described by its *mask*: which of the filters it fails. In a given order it is
removed by the first filter it fails. The orders of n filters, sorted as words, are numbered
by their Lehmer rank, and all orders that begin with the same k letters have neighbouring
ranks, an interval of (n - k)! numbers. So the orders in which a mask is removed at step k by
a certain letter are whole intervals: one for each beginning whose last letter the mask fails
and whose other letters it passes.

Rows are counted by part and mask before anything is multiplied. A count is added where an
interval begins and taken away where it ends, and a running sum over the ranks gives the
counts of all orders together. No row is ever judged order by order.

Defined results: a null text is empty; a null part is the empty string; a null id is smaller
and larger than nothing, so its row never fails as a copy and takes no other row's place; of
rows that share one id and one text, all pass or all fail; labels with one id count as 1 where
any of them is 1; rows without a label count as neither good nor toxic. No rows give no rows.
Other columns are not read. A long text is read piece by piece: its different words are held,
not the text again.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.tables import slices, stored

#: The filters, in the order of their bits.
LETTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
#: Bytes of one text that are split into words at a time.
PIECE = 1 << 22

_CAPITALS = bytes(range(65, 91))
_NO_CAPITAL = bytes(sorted(set(range(256)) - set(_CAPITALS)))
_FURTHER = bytes(range(0x80, 0xC0))
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def lehmer_rank(order: str, letters: str = LETTERS) -> int:
    """The place of ``order`` among all permutations of ``letters`` in lexicographic order."""
    left, rank = sorted(letters), 0
    for letter in order:
        at = left.index(letter)
        rank += at * factorial(len(left) - 1)
        left.pop(at)
    return rank


def removal_intervals(letters: str = LETTERS) -> list[tuple[int, int, int, int]]:
    """``mask, step, first rank, rank after the last`` for every mask and every step that removes it."""
    found = []
    for mask in range(1, 1 << len(letters)):
        passes = [x for i, x in enumerate(letters) if not mask >> i & 1]
        fails = [x for i, x in enumerate(letters) if mask >> i & 1]
        for k in range(len(passes) + 1):
            width = factorial(len(letters) - k - 1)
            for before in permutations(passes, k):
                for last in fails:
                    rest = "".join(sorted(set(letters) - set(before) - {last}))
                    first = lehmer_rank("".join(before) + last + rest, letters)
                    found.append((mask, k + 1, first, first + width))
    return found


def _distinct_words(text: bytes) -> tuple[int, int]:
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def own_mask(text: bytes) -> int:
    """Bits of the filters that the text alone decides (A, B, C, D)."""
    words, distinct = _distinct_words(text)
    capitals = len(text.translate(None, _NO_CAPITAL))
    points = len(text.translate(None, _FURTHER))
    symbols = len(text) != len(text.translate(None, SYMBOLS))
    return (words < FEWEST_WORDS) | (100 * distinct < LEAST_DISTINCT * words) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | symbols << 3


def text_masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id, part, mask, name``: the bits of the text alone, and a 128-bit name of the text."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text")
    )

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "part": batch.column("part"), "mask": pa.array([own_mask(t) for t in texts], pa.int32()),
            "name": pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
        })

    schema = T.StructType([rows.schema["id"], T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("name", T.BinaryType())])
    return rows.mapInArrow(slices(1 << 20, "text", work), schema)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: rows by part and by the filters they fail.

    A copy fails E unless it has the smallest id of its text. That is one minimum per text,
    aggregated before the shuffle, and no join back to the copies: those with the smallest
    id are taken from the count of all rows that would fail.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    once = text_masks(docs, id_col, text_col, part_col).groupBy("id", "name", "mask", "part").agg(F.count("*").alias("n"))
    one = F.lit(1 << LETTERS.index("E"))
    rows = stored(once.join(marks, "id", "left").select(
        "id", "name", "part", "mask", "n", *(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0).cast("long")).alias(c) for c in ("good", "toxic"))
    ), "masks")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    known = rows.where(F.col("id").isNotNull())
    copies = known.groupBy("part", (F.col("mask").bitwiseOR(one)).alias("mask")).agg(*sums)
    # Rows of one id and one text: a list no longer than there are parts.
    same = known.groupBy("id", "name").agg(F.collect_list(F.struct("part", "mask", "n", "good", "toxic")).alias("rows"))
    first = same.groupBy("name").agg(F.min(F.struct("id", "rows")).alias("least")).select(F.inline("least.rows"))
    firsts = first.groupBy("part", "mask").agg(*sums)
    back = firsts.select("part", F.col("mask").bitwiseOR(one).alias("mask"), *((-F.col(c)).alias(c) for c in ("n", "good", "toxic")))
    unknown = rows.where(F.col("id").isNull()).groupBy("part", "mask").agg(*sums)
    return copies.unionByName(back).unionByName(firsts).unionByName(unknown).groupBy("part", "mask").agg(*sums)


def _bit(mask: Column, number: int) -> Column:
    return F.shiftright(mask, number).bitwiseAND(F.lit(1)) == 1


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every order and step of every part, from ``part, mask, n, good, toxic``."""
    from pyspark.sql import Window

    spark = counts.sparkSession
    n, orders = len(letters), ["".join(p) for p in permutations(letters)]
    values = ("n", "good", "toxic")
    counts = stored(counts, "mask-counts")
    # Its size depends on the number of filters only.
    spans = spark.createDataFrame(removal_intervals(letters), "mask int, step int, first int, after int")
    ends = counts.join(F.broadcast(spans), "mask").select(
        "part", "step", F.inline(F.array(
            F.struct(F.col("first").alias("rank"), *values), F.struct(F.col("after").alias("rank"), *((-F.col(c)).alias(c) for c in values))
        ))
    )
    changes = ends.groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in values))
    # Letters that fail, alone and at all; one row a part.
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*(F.coalesce(F.sum(F.when(_bit(F.col("mask"), i), F.col("n"))), F.lit(0)) for i in range(n))).alias("fails"),
        F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == 1 << i, F.col("n"))), F.lit(0)) for i in range(n))).alias("alone"),
    )
    # Every rank and step of every part: rows by rule, as many as the result has.
    ranked = totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
    stepped = ranked.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    named = stepped.withColumn("filter_order", F.get(F.array(*map(F.lit, orders)), "rank"))
    bit = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    grid = named.withColumn("bit", bit).join(changes, ["part", "step", "rank"], "left")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = grid.select(
        "part", "filter_order", "step", "bit", "total", F.get("fails", "bit").alias("fails"), F.get("alone", "bit").alias("unique_fails"),
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("removed"), F.coalesce(F.sum("good").over(along), F.lit(0)).alias("good_lost"),
        F.coalesce(F.sum("toxic").over(along), F.lit(0)).alias("toxic_lost"),
    )
    within = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return removed.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(within)).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"),
    )

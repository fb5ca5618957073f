"""SimHash near-duplicates found with BK-trees.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its
shingles. Two fingerprints that differ in at most 3 bits link their texts.

All texts of one fingerprint are one node. Cut into five blocks, two linked fingerprints agree
in at least two, so a fingerprint goes to ten shards, each named by two blocks and their bits;
every link lies inside a shard. A shard builds a BK-tree, whose children are keyed by their
Hamming distance to the parent, and each member follows the edges within the radius. A shard
with more members than a tree may hold is dealt into finer ones first: of the bits not yet
fixed, cut in four, one part is equal. The bits run out before the members do, so a tree is
bounded whatever the corpus. Trees stay in the tasks of their shard; they are not sent to all
executors, because together they grow with the corpus.

A shard returns each member's smallest local partner, never pairs; joining those into classes
is left to a min-label contraction over the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.tables import discard, slices, stored, task_count

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Bits of the five blocks, from the lowest.
BLOCKS = (13, 13, 13, 13, 12)
#: Members of a tree.
TREE = 4096


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of lower-cased texts; zero for a text without words."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()
        if len(words) <= width:
            found = [digest(b" ".join(words), SEED)] if words else []
        elif width == 3:
            found = [digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:], strict=False)]
        else:
            found = [digest(b" ".join(words[i:i + width]), SEED) for i in range(len(words) - width + 1)]
        hashes += found
        counts.append(len(found))
    ones = np.zeros((len(texts), 64), np.int64)
    bits = np.array(hashes, np.uint64)
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts)
    starts = (ends - counts)[full]
    for low in range(0, 64, 8):  # eight bits of all hashes at a time
        part = ((bits >> np.uint64(low)) & np.uint64(255)).astype(np.uint8)
        spread = np.unpackbits(part[:, None], axis=1, bitorder="little")
        if len(full):
            ones[full, low:low + 8] = np.add.reduceat(spread, starts, axis=0, dtype=np.int64)
    major = (2 * ones > np.array(counts)[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8").reshape(-1)


class BKTree:
    """64-bit values; a child hangs on its Hamming distance to the parent, an equal value on 0."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all values at most ``radius`` bits away."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                open_nodes += [c for d, c in children.items() if distance - radius <= d <= distance + radius]
            else:
                open_nodes += [children[d] for d in range(max(0, distance - radius), distance + radius + 1) if d in children]
        return found


def local_roots(values: list[int], radius: int) -> dict[int, int]:
    """The smallest value of each value's class inside one shard, for values that have a partner."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):  # ascending, so the smaller place is the smaller value
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.insert(value)
    return {values[i]: values[t] for i in range(len(values)) if (t := top(i)) != i}


def _bits(mask: int) -> list[int]:
    return [i for i in range(64) if mask >> i & 1]


def _first_masks(radius: int) -> list[int]:
    edges = np.cumsum((0, *BLOCKS))
    blocks = [sum(1 << i for i in range(edges[k], edges[k + 1])) for k in range(5)]
    return [sum(c) for c in combinations(blocks, 5 - radius)]


def _finer(mask: int, radius: int) -> list[int]:
    free = _bits(~mask & (1 << 64) - 1)
    parts = np.array_split(np.array(free), radius + 1)
    return [mask | sum(1 << int(i) for i in part) for part in parts if len(part)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _dealt(rows: DataFrame, masks: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(masks), "mask").select(
        "value", F.explode("finer").alias("mask")
    ).withColumn("bits", F.col("value").bitwiseAND(F.col("mask")))


def shard_links(nodes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """``value, root`` for distinct ``value`` longs: a smaller value of the same class, from each shard.

    Parts of bits are equal for certain only while there are more of them than the radius, so a
    tree holds 2**radius members at least.
    """
    spark = nodes.sparkSession
    masks = {0: _first_masks(radius)}  # by the bits fixed so far, as the long that holds them
    dealt = nodes.select("value", F.lit(0).cast("long").alias("mask"))
    links = []
    while True:
        table = spark.createDataFrame([(m, [_signed(f) for f in fine]) for m, fine in masks.items()], "mask long, finer array<long>")
        rows = _dealt(dealt, table)
        sizes = rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shards = stored(rows.join(sizes, ["mask", "bits"]).select("value", "mask", "bits", (F.col("n") > max(tree, 1 << radius)).alias("large")), "shards")
        small = shards.where("not large").drop("large")
        grouped = small.repartition(task_count(spark), "mask", "bits").sortWithinPartitions("mask", "bits", "value")
        links.append(grouped.mapInArrow(_shard_mapper(radius), "value long, root long"))
        over = [r[0] for r in shards.where("large").select("mask").distinct().collect()]  # one per mask at most
        if not over:
            break
        masks = {m: _finer(m & (1 << 64) - 1, radius) for m in over}
        dealt = shards.where("large").select("value", "mask")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found


def _shard_mapper(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def made(values: list[int]) -> Iterator[pa.RecordBatch]:
            if len(values) > 1:
                found = local_roots(sorted(v & (1 << 64) - 1 for v in values), radius)
                if found:
                    signed = [[_signed(x) for x in side] for side in (found.keys(), found.values())]
                    yield pa.RecordBatch.from_pydict({"value": pa.array(signed[0], pa.int64()), "root": pa.array(signed[1], pa.int64())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("mask", "bits", "value")]
            for mask, bits, value in zip(*columns, strict=True):
                if (mask, bits) != key:
                    yield from made(members)
                    key, members = (mask, bits), []
                members.append(value)
        yield from made(members)

    return run


def classes(links: DataFrame, left: str = "value", right: str = "root", bounds: Sequence[DataFrame] = ()) -> DataFrame:
    """``node, label``: the smallest node of each connected class, for nodes with a link.

    Every round each node takes the smallest label around it and then the label of that
    label, so chains halve. Labels are stored each round; minima are aggregated before the
    shuffle, and a join splits the rows of a node that many others name. ``bounds`` are stored
    tables that the links are no larger than.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", *bounds)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels", both)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("next"))
        after = stored(lower.join(jump, F.col("label") == F.col("at")).select("node", "was", F.col("next").alias("label")), "labels", both)
        discard(labels)
        labels = after.drop("was")
        if after.where("label <> was").isEmpty():
            discard(both)
            return labels


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``id, value``: the fingerprint of every text as a signed long; zero for null and empty texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "value": pa.array(fingerprints(texts, width).view(np.int64))})

    return rows.mapInArrow(slices(1 << 19, "text", work), T.StructType([rows.schema["id"], T.StructField("value", T.LongType())]))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, value, fingerprint, component_id`` for every row.

    ``component_id`` is the smallest id of the row's class. Texts without words have the
    fingerprint zero and are linked like any other. Null ids are rows like any other but never
    the smallest unless a class has no other. An empty table gives an empty result.
    """
    rows = stored(fingerprint_rows(docs, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("value").agg(F.min("id").alias("least"))
    labels = classes(shard_links(nodes, radius))
    linked = nodes.join(labels, F.col("value") == F.col("node")).groupBy("label").agg(F.min("least").alias("smallest"))
    joined = labels.join(linked, "label").select("node", "smallest")
    per_value = nodes.join(joined, F.col("value") == F.col("node"), "left").select(
        F.col("value").alias("of"), F.coalesce("smallest", "least").alias("component_id")
    )
    # Stored, so that the join can split the rows of one fingerprint between tasks.
    per_value = stored(per_value, "components")
    return rows.join(per_value, F.col("value") == F.col("of")).select(
        "id", "value", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id"
    )

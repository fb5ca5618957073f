"""SimHash near-dedup of texts: fingerprints and BK-trees find partners, shared shingles confirm them.

Used where texts count as near copies from a similarity of their word shingles on, not from
equal fingerprint bits on. Texts at a Jaccard similarity of 0.8 differ in some 10 of 64 bits,
too many for blocks of equal bits to find them. So shards are named by the smallest of the
shingles' digests under several keys, which two such texts share with that probability for each
key, and by a size class, since similar texts have similar numbers of shingles. In a shard a
BK-tree gives the partners within a wide radius; the similarity is then computed from the whole
sets of shingles.

Keys and radius can miss a partner, so an exact turn follows for pairs of different classes. A
text has a partner in another class only if at least that share of its shingles occurs in other
classes. Names are counted for that, first those of a slice, then all of the texts still open.
Two partners share one of their rarest names: of n, the n - 0.8 n rarest and one more. These
names are the shards of the last turn, in which all pairs of different classes are compared.

Texts of equal words are one node before anything else. Nodes that share no shard with another
are never sent with their text. A shard whose shingles exceed what a task should hold is cut
into blocks, and every pair of blocks is compared, so no partner is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.recompression import joined_words, span_names, word_names
from cohortgauge.llm.simhash import BKTree, classes
from cohortgauge.llm.tables import discard, packed, slices, stored, task_count, unpacked

WIDTH, SIMILARITY = 5, 0.8
#: Differing bits up to which a partner's similarity is computed before the exact turn; 0.8 gives about 10, with deviation 3.
REACH = 22
#: Keys of shards. A pair at the least similarity misses all of them once in 600 times, and is left to the exact turn.
KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: Shingles of one block of a shard.
BLOCK = 2_000_000
#: Bits of a set's bitmap.
BITMAP = 4096
BASE = 0xD1342543DE82EF95
#: Shards of the first key are compared first; those of the others only where they join classes.
TURNS = ("first", "rest")
#: One of so many names is counted first; most texts have no partner by these alone.
SLICE = 3


def shingle_names(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Names of all shingles of lower-cased texts side by side, and how many each text has.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    words, bounds = joined_words([t.lower() for t in texts])
    lengths = np.diff(bounds)
    count = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    text = np.repeat(np.arange(len(texts)), count)
    start = bounds[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return span_names(word_names(words), start, np.minimum(start + width, bounds[text + 1]), BASE), count


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats: each text's names once, in ascending order."""
    names, count = shingle_names(texts, width)
    text = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((names, text))
    names, text = names[order], text[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    return names[new], np.bincount(text[new], minlength=len(texts))


def _sketch(texts: list[bytes], width: int, similarity: float) -> tuple[np.ndarray, np.ndarray, list[tuple[list[int], list[int]]]]:
    """Fingerprint, number of different shingles, and shard names of the first and the other keys of every text."""
    names, count = shingle_sets(texts, width)
    full = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[full]
    ones = np.zeros((len(texts), 64), np.int64)
    least = np.zeros((len(texts), len(KEYS)), np.uint64)
    if len(full):
        for low in range(0, 64, 8):
            part = ((names >> np.uint64(low)) & np.uint64(255)).astype(np.uint8)
            ones[full, low:low + 8] = np.add.reduceat(np.unpackbits(part[:, None], axis=1, bitorder="little"), start, axis=0, dtype=np.int64)
        for k, key in enumerate(KEYS):
            mixed = (names ^ (names >> np.uint64(29))) * np.uint64(key)
            least[full, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), start)
    value = np.packbits((2 * ones > count[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<i8").reshape(-1)
    # Size classes double. A text near the lower rim of its class also visits the one below.
    size = np.log2(np.maximum(count, 1))
    below = size % 1 < -np.log2(similarity)
    shards = []
    for row, c, b, n in zip(least, np.floor(size).astype(int).tolist(), below.tolist(), count.tolist(), strict=True):
        named = [[xxhash.xxh3_64_intdigest(b"%d,%d,%d" % (k, v, s)) for s in ((c, c - 1) if b else (c,))] if n else [] for k, v in enumerate(row.tolist())]
        signed = [[x - (1 << 64) if x >> 63 else x for x in names] for names in named]
        shards.append((signed[0], [x for names in signed[1:] for x in names]))
    return value, count, shards


def _same(texts: list[bytes]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts], pa.binary())


def _sketch_rows(width: int, similarity: float):
    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        value, count, shards = _sketch(texts, width, similarity)
        return pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "mark": batch.column("mark"), "same": _same(texts), "value": pa.array(value),
            "shingles": pa.array(count, pa.int64()), **{t: pa.array([s[k] for s in shards], pa.list_(pa.int64())) for k, t in enumerate(TURNS)},
        })

    return slices(1 << 18, "text", work)


def _set_rows(width: int, part: int):
    """``same, shingles, names``: of the different names those that ``part`` divides."""

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        names, count = shingle_sets(texts, width)
        taken = names % np.uint64(part) == 0
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), count)[taken], minlength=len(texts)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(names[taken].view(np.int64)))
        return pa.RecordBatch.from_pydict({"same": _same(texts), "shingles": pa.array(count, pa.int64()), "names": lists})

    return slices(1 << 18, "text", work)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= similarity * (len(a) + len(b) - common)


def _bits(names: np.ndarray) -> np.ndarray:
    held = np.zeros(BITMAP, bool)
    held[(names & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(held)


def bitmap(names: np.ndarray) -> int:
    """A bit for each name; a bit that another set lacks is a name that it lacks."""
    return int.from_bytes(_bits(names).tobytes(), "big")


def shard_classes(members: list[tuple[bytes, int, np.ndarray]], similarity: float) -> dict[bytes, bytes]:
    """The smallest node of each node's class inside a shard, for nodes that have a partner."""
    members = sorted(members, key=lambda m: m[0])
    tree, root = BKTree(), list(range(len(members)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    maps = [bitmap(m[2]) for m in members]
    for i, (_, value, shingles) in enumerate(members):
        own, spare = maps[i], (1 - similarity) * len(shingles) + 1e-6
        for j in tree.within(value, REACH):
            # Similar sets lack at most this share of each other: most others end here.
            if (own & ~maps[j]).bit_count() > spare:
                continue
            a, b = top(i), top(j)
            if a != b and similar(shingles, members[j][2], similarity):
                root[max(a, b)] = min(a, b)
        tree.insert(value)
    return {members[i][0]: members[t][0] for i in range(len(members)) if (t := top(i)) != i}


def pair_links(members: list[tuple[bytes, bytes, np.ndarray]], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links of nodes that join the labels of ``node, label, shingles``, after comparing all pairs of different classes."""
    _, group = np.unique([m[1] for m in members], return_inverse=True)
    sizes = np.array([len(m[2]) for m in members])
    maps = np.stack([_bits(m[2]).view(np.uint64) for m in members])
    links = []
    for i, (node, _, shingles) in enumerate(members):
        least, most = similarity * sizes[i] - 1e-6, sizes[i] / similarity + 1e-6
        near = np.flatnonzero((group[:i] != group[i]) & (sizes[:i] >= least) & (sizes[:i] <= most))
        near = near[np.bitwise_count(maps[i] & ~maps[near]).sum(1) <= (1 - similarity) * sizes[i] + 1e-6]
        for j in near.tolist():
            if group[j] != group[i] and similar(shingles, members[j][2], similarity):
                group[group == group[j]] = group[i]
                links.append((node, members[j][0]))
    return links


def _class_rows(width: int, similarity: float, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def made() -> Iterator[pa.RecordBatch]:
            if exact:
                found = pair_links([(node, label, names) for node, label, _, names in members], similarity) if members else []
            else:
                found = list(shard_classes([(node, value, names) for node, _, value, names in members], similarity).items()) if len(members) > 1 else []
            if found:
                sides = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in sides], ["value", "root"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("shard", "left", "right")), strict=True)
            nodes, labels, values = (batch.column(c).to_pylist() for c in ("same", "label", "value"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for own, node, label, value, text in zip(keys, nodes, labels, values, texts, strict=True):
                if own != key:
                    yield from made()
                    key, members = own, []
                members.append((node, label, value & (1 << 64) - 1, np.unique(shingle_names([text], width)[0])))
        yield from made()

    return run


def _with_labels(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("same"))
    return nodes.join(labels, F.col("same") == F.col("node"), "left").withColumn("label", F.coalesce("label", "same")).drop("node")


def _key(identity: str, mark: str):
    """One column for an id that may be null and a mark: joins on it are partitioned like what follows them."""
    return F.xxhash64(identity, mark)


def _only(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """One row of each ``id, mark`` that ``wanted`` lists as ``its, own``.

    The rows are shuffled once: what is wanted decides before repeats are dropped, and both go
    by ``key``.
    """
    equal = (F.col("key") == F.col("its_key")) & F.col("id").eqNullSafe(F.col("its")) & (F.col("mark") == F.col("own"))
    listed = wanted.withColumn("its_key", _key("its", "own")).hint("shuffle_hash")
    return rows.join(listed, equal, how).dropDuplicates(["key", "id", "mark"])


def _joined(rows: DataFrame, nodes: DataFrame, turn: str, width: int, similarity: float, labels: DataFrame | None) -> DataFrame:
    """The labels after one turn. What the turn stored is deleted with the labels before it."""
    links, used = _partners(rows, nodes, turn, width, similarity, labels)
    after = classes(links, bounds=[*used, *([labels] if labels is not None else [])])
    discard(*used, *([labels] if labels is not None else []))
    return after


def _partners(
    rows: DataFrame, nodes: DataFrame, turn: str, width: int, similarity: float, labels: DataFrame | None
) -> tuple[DataFrame, list[DataFrame]]:
    """``value, root``: links inside the shards of one turn that hold nodes of several classes, and those known.

    Beside them the stored tables that they are read from.

    Most groups of near copies share the shards of every key. Once they are one class, their
    other shards can join nothing and their texts are not sent again. Of shards with the same
    nodes one is enough.
    """
    exact = turn not in TURNS
    placed = nodes.select("same", "head.id", "head.mark", "value", "shingles", "label", F.explode(turn).alias("shard"))
    # In the exact turn, bitmaps of all members are held besides.
    weight = F.col("shingles") + F.lit(BITMAP // 64 if exact else 0)
    held = [F.bit_xor(F.xxhash64("same", F.lit(k))).alias(f"held{k}") for k in range(2)]
    several = placed.groupBy("shard").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum(weight).alias("all"), F.count(F.lit(1)).alias("n"), *held)
    several = several.where("low <> high").groupBy("held0", "held1", "n").agg(F.min("shard").alias("shard"), F.first("all").alias("all"))
    several = stored(several.select("shard", F.ceil(F.col("all") / F.lit(BLOCK)).cast("int").alias("blocks")), "shards", nodes)
    member = placed.join(several, "shard").groupBy("id", "mark", "same", "value", "label").agg(F.collect_set(F.struct("shard", "blocks")).alias("in_shards"))
    member = stored(member.withColumnsRenamed({"id": "its", "mark": "own"}), "members", nodes, several)
    with_text = _only(rows, member, "inner").select("same", "value", "label", "text", F.explode("in_shards").alias("of"))
    block = F.pmod(F.xxhash64("same"), F.col("of.blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("of.blocks") - 1))
    paired = with_text.select("same", "value", "label", "text", F.col("of.shard").alias("shard"), block.alias("block"), other.alias("other")).select(
        "same", "value", "label", "text", "shard", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    )
    dealt = paired.repartition(task_count(rows.sparkSession), "shard", "left", "right")
    links = dealt.sortWithinPartitions("shard", "left", "right").mapInArrow(_class_rows(width, similarity, exact), "value binary, root binary")
    if labels is not None:
        links = links.unionByName(labels.select(F.col("node").alias("value"), F.col("label").alias("root")))
    return links, [several, member]


def _shared(sets: DataFrame) -> DataFrame:
    """``name, often``: the names that nodes of several classes have, and how many nodes."""
    each = sets.select("class", F.explode("names").alias("name"))
    counted = each.groupBy("name").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("often"))
    return stored(counted.where("low <> high").select("name", "often"), "shared", sets)


def _open(rows: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """The nodes that may have a partner in another class, with the shards of the exact turn in ``exact``."""
    kind, spare = "same binary, shingles long, names array<long>", F.floor((1 - similarity) * F.col("shingles") + F.lit(1e-6))
    labelled = nodes.select("same", F.xxhash64("label").alias("class"))
    sets = rows.mapInArrow(_set_rows(width, SLICE), kind).dropDuplicates(["same"])
    sets = stored(sets.join(labelled, "same").where("shingles > 0"), "slices")
    shared = _shared(sets)
    met = sets.select("same", F.explode("names").alias("name")).join(shared, "name").groupBy("same").agg(F.count(F.lit(1)).alias("met"))
    left = sets.join(met, "same", "left").where(F.size("names") - F.coalesce("met", F.lit(0)) <= spare).select("same")
    left = stored(left.join(nodes, "same"), "open", sets, nodes)
    discard(sets, shared)
    # The same with all names.
    heads = left.select(F.col("head.id").alias("its"), F.col("head.mark").alias("own"))
    sets = _only(rows, heads, "left_semi").mapInArrow(_set_rows(width, 1), kind)
    sets = stored(sets.join(left.select("same", F.xxhash64("label").alias("class")), "same"), "sets")
    shared = _shared(sets)
    each = sets.select("same", "shingles", F.explode("names").alias("name")).join(shared, "name")
    common = each.groupBy("same", "shingles").agg(F.array_sort(F.collect_list(F.struct("often", "name"))).alias("common"))
    rarest = spare + 1 - (F.col("shingles") - F.size("common"))
    first = F.slice(F.col("common.name"), F.lit(1), rarest.cast("int")).alias("exact")
    found = stored(left.join(common.where(rarest > 0).select("same", first), "same"), "rarest", left, sets)
    discard(left, sets, shared)
    return found


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class of near copies, with all its columns.

    Two texts are near copies if their sets of ``width``-word shingles, A-Z lower-cased, have at
    least that Jaccard similarity; classes are connected. The row with the smallest id stays, a
    null id last, and one of several equal rows. Texts without words, null ones too, are one
    class. No rows give no rows. Columns may have any names and are returned unchanged.
    """
    marked = packed(docs, id=F.col(id_col), mark=F.xxhash64(text_col), text=F.col(text_col).cast("string"))
    marked = marked.withColumn("key", _key("id", "mark"))
    rows = marked.drop("row")
    kinds = [rows.schema["id"], T.StructField("mark", T.LongType())]
    made = [
        T.StructField("same", T.BinaryType()), T.StructField("value", T.LongType()), T.StructField("shingles", T.LongType()),
        *[T.StructField(t, T.ArrayType(T.LongType())) for t in TURNS],
    ]
    sketched = stored(rows.mapInArrow(_sketch_rows(width, similarity), T.StructType(kinds + made)), "sketches")
    head = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "mark")).alias("head")
    nodes = sketched.groupBy("same").agg(head, *[F.first(c).alias(c) for c in ("value", "shingles", *TURNS)])
    nodes = stored(nodes, "nodes", sketched)
    discard(sketched)
    labels = None
    for turn in TURNS:
        labels = _joined(rows, _with_labels(nodes, labels), turn, width, similarity, labels)
    open_nodes = _open(rows, _with_labels(nodes, labels), width, similarity)
    labels = _joined(rows, open_nodes, "exact", width, similarity, labels)
    classed = nodes.join(labels, F.col("same") == F.col("node"), "left").groupBy(F.coalesce("label", "same")).agg(F.min("head").alias("head"))
    kept = stored(classed.select(F.col("head.id").alias("its"), F.col("head.mark").alias("own")), "kept", nodes, labels)
    discard(open_nodes, labels, nodes)
    return unpacked(_only(marked.drop("text"), kept, "left_semi"), docs.columns)

"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

A passage of m characters that occurs in a text with at most k edits shares with it, of any
chosen u of its q-grams, at least u - k*q, on diagonals at most k apart (a diagonal is the
place in the text less the place in the passage). So shared q-grams are counted in diagonal
bands that overlap by k, bands that reach the bound are kept, and only those are aligned.

The passages are the query set. It is read in blocks of bounded size; each block's q-gram
index goes to all executors, and every text is searched against every block in one pass over
the table, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.recompression import span_names
from cohortgauge.llm.tables import portions

GRAM = 10
#: Edits per character of a passage that still count as the passage.
EDITS = 0.05
#: Places in the passages above which a q-gram is not chosen, where the bound allows that.
COMMON = 4
#: Characters of the passages in one block. Its index takes some 40 bytes a character.
BLOCK = 1 << 20
BASE = 0x9FB21C651E98DF25
FILTER_BITS = 22


def normalised(text: bytes) -> np.ndarray:
    """Code points in lower case, with white space drawn together."""
    return np.frombuffer(" ".join(text.decode().lower().split()).encode("utf-32-le"), np.uint32)


def gram_names(points: np.ndarray, size: int = GRAM) -> np.ndarray:
    at = np.arange(max(0, len(points) - size + 1))
    return span_names(points.astype(np.uint64) + np.uint64(1), at, at + size, BASE)


class PassageIndex:
    """The chosen q-grams of a block of passages, and the bound of each passage."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = GRAM, edits: float = EDITS):
        self.size = size
        self.items = [(i, normalised(t)) for i, t in items]
        self.items = [(i, p) for i, p in self.items if len(p) >= size]
        names = [gram_names(p, size) for _, p in self.items]
        everything = np.concatenate(names) if names else np.zeros(0, np.uint64)
        value, inverse, count = np.unique(everything, return_inverse=True, return_counts=True)
        rare = count[inverse] <= COMMON
        owner = np.repeat(np.arange(len(names)), [len(n) for n in names])
        lengths = np.array([len(p) for _, p in self.items], np.int64)
        self.budget = np.floor(edits * lengths).astype(np.int64)
        chosen = np.bincount(owner[rare], minlength=len(names)) - self.budget * size
        whole = lengths - size + 1 - self.budget * size
        # All q-grams where too few rare ones are left to tell anything.
        self.bound = np.maximum(1, np.where(2 * chosen >= whole, chosen, whole))
        use = rare | (2 * chosen < whole)[owner]
        place = np.concatenate([np.arange(len(n)) for n in names]) if names else np.zeros(0, np.int64)
        order = np.argsort(inverse[use], kind="stable")
        used, start = np.unique(inverse[use], return_index=False, return_counts=True)
        self.names, self.counts = value[used], start
        self.starts = np.concatenate([[0], np.cumsum(start)]).astype(np.int64)
        self.owner, self.place = owner[use][order], place[use][order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.names >> np.uint64(64 - FILTER_BITS)] = True

    def regions(self, names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, passage number and first diagonal of every band that reaches its bound.

        ``names`` are the q-grams of several texts side by side; ``bounds`` says where each
        text begins.
        """
        hit = np.flatnonzero(self.filter[names >> np.uint64(64 - FILTER_BITS)])
        none = np.zeros(0, np.int64)
        if not len(hit) or not len(self.names):
            return none, none, none
        found = np.searchsorted(self.names, names[hit])
        real = (found < len(self.names)) & (self.names[np.minimum(found, len(self.names) - 1)] == names[hit])
        hit, found = hit[real], found[real]
        many = self.counts[found]
        spread = np.repeat(np.arange(len(hit)), many)
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)
        entry = self.starts[found][spread] + inner
        text = np.searchsorted(bounds, hit, "right") - 1
        item = self.owner[entry]
        diagonal = (hit - bounds[text])[spread] - self.place[entry]
        step = self.budget[item] + 1
        band = diagonal // step
        twice = diagonal % step < self.budget[item]  # also in the overlap of the band before
        keys = [np.concatenate([x, x[twice]]) for x in (text[spread], item)]
        keys.append(np.concatenate([band, band[twice] - 1]))
        order = np.lexsort(keys[::-1])
        text, item, band = (k[order] for k in keys)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(order)))
        keep = head[count >= self.bound[item[head]]]
        return text[keep], item[keep], band[keep] * (self.budget[item[keep]] + 1)


def aligned(passage: np.ndarray, text: np.ndarray, diagonal: int, budget: int) -> tuple[int, int] | None:
    """Fewest edits of ``passage`` against a stretch of ``text`` near ``diagonal``, and where it ends.

    The alignment may use diagonals from ``diagonal - budget`` to ``diagonal + 2 * budget + 1``,
    which covers the band and the edits at its rims. None above the budget.
    """
    low, width, m = diagonal - budget, 3 * budget + 2, len(passage)
    # Cell c of row i stands for the text's first low + c + i characters.
    padded = np.full(width + m + 1, 0xFFFFFFFF, np.uint32)
    begin, end = max(0, low), min(len(text), low + width + m)
    if end <= begin:
        return None
    padded[begin - low:end - low] = text[begin:end]
    cells = np.arange(width)
    outside = 1 << 30
    row = np.where((low + cells >= 0) & (low + cells <= len(text)), 0, outside)
    for i in range(m):
        across = row + (padded[i:i + width] != passage[i])
        down = np.append(row[1:], outside) + 1
        best = np.minimum(across, down)
        row = np.minimum.accumulate(best - cells) + cells
        row[(low + cells + i + 1 < 0) | (low + cells + i + 1 > len(text))] = outside
        if row.min() > budget:
            return None
    at = int(row.argmin())
    return int(row[at]), low + at + m


def search(texts: list[bytes], index: PassageIndex) -> list[list[tuple[object, int, int]]]:
    """Per text the passages it holds: id, edits, and the end in the normalised text, best first end."""
    points = [normalised(t) for t in texts]
    grams = [gram_names(p, index.size) if len(p) >= index.size else np.zeros(0, np.uint64) for p in points]
    bounds = np.concatenate([[0], np.cumsum([len(g) for g in grams])])[:-1] if grams else np.zeros(0, np.int64)
    best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    everything = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    for text, item, diagonal in zip(*(x.tolist() for x in index.regions(everything, bounds)), strict=True):
        if best[text].get(item, (1,))[0] == 0:
            continue
        found = aligned(index.items[item][1], points[text], diagonal, int(index.budget[item]))
        if found and (item not in best[text] or found < best[text][item]):
            best[text][item] = found
    return [[(index.items[i][0], *found) for i, found in sorted(b.items())] for b in best]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        text = row["text"].encode()
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((row["item"], text))
        size += len(text)
    if block:
        yield block


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS,
    column: str = "leaks",
) -> DataFrame:
    """``docs`` with ``column``: an array of ``item, edits, stop`` for the passages that each text holds.

    ``stop`` is where the passage ends in the normalised text. A passage counts with up to
    ``edits`` times its characters inserted, deleted or replaced. A passage that occurs more than
    once in a text is listed once, with its fewest edits. Null and empty texts hold none, null
    and empty passages are in none. Passages shorter than a q-gram are found by grams of their own
    size, also inside words. A column of that name is replaced.
    """
    item_type = benchmark.schema[item_col].dataType
    leak = T.StructType([T.StructField("item", item_type), T.StructField("edits", T.IntegerType()), T.StructField("stop", T.LongType())])
    found = docs.withColumn(column, F.lit(None).cast(T.ArrayType(leak)))
    for block in _blocks(benchmark, item_col, item_text_col):
        indexes = docs.sparkSession.sparkContext.broadcast(_indexes(block, edits))
        found = found.mapInArrow(_mapper(indexes, text_col, column), found.schema)
    return found.withColumn(column, F.coalesce(column, F.array().cast(T.ArrayType(leak))))


def _indexes(block: list[tuple[object, bytes]], edits: float) -> list[PassageIndex]:
    """An index of the passages that hold a q-gram, and one for every smaller q that shorter ones need."""
    sizes: dict[int, list[tuple[object, bytes]]] = {}
    for item, text in block:
        m = len(normalised(text))
        # Of as many pieces as the budget and one more, one is met without edits.
        q = GRAM if m >= GRAM else m // (int(np.floor(edits * m)) + 1)
        if q:
            sizes.setdefault(q, []).append((item, text))
    return [PassageIndex(items, size, edits) for size, items in sorted(sizes.items(), reverse=True)]


def _mapper(indexes, text_col: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches, text_col, 1 << 18):
            at = part.schema.get_field_index(column)
            kind = part.schema.field(at).type
            names = [f.name for f in kind.value_type]
            before = part.column(at).to_pylist()
            leaks = [sum(found, []) for found in zip(*(search(texts, index) for index in indexes.value), strict=True)] or [[]] * len(texts)
            rows = [(old or []) + [dict(zip(names, x, strict=True)) for x in new] for old, new in zip(before, leaks, strict=True)]
            yield part.set_column(at, part.schema.field(at), pa.array(rows, kind))

    return run

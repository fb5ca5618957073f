"""Substring dedup by recompression: equal word sequences get equal grammar symbols.

Every word starts as a symbol, the 64-bit name of its bytes. A round replaces either the
runs of one symbol or pairs of neighbours. Which neighbours pair up depends on one bit of
each name, and the new name is a digest of the parts. A name is thus the same in every
task that meets the same parts: rounds name globally without a dictionary or a shuffle.

Inside a window of words, all but the outermost symbols of a round depend on the window
alone. What is left after cutting those is the window's *core*; the first symbol of the
last core that is not empty is its *anchor*. Equal windows have the same anchor at the
same place, whatever stands around them. So one row per anchor, not one per word, is
shuffled:

1. An anchor that occurs once settles its windows: none of them repeats.
2. Occurrences of an anchor that stand in the same words settle theirs: all repeat.
3. The windows of all other shared anchors are named in full and counted, together with
   one of each settled kind that has the same anchor.

Counts are aggregated before the shuffle, so a passage that a third of the documents hold
is one row on that side, and Spark can split the rows of the other side between tasks.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.tables import discard, packed, slices, stored, unpacked, unused

#: Words of a repeated window.
WINDOW = 35
#: Text bytes that are parsed together; numpy needs some 60 times as much memory.
PARSED_BYTES = 1 << 18
#: Runs are named in one round of so many, pairs in the others.
RUN_EVERY = 8
#: Windows are counted in so many passes, each over one slice of the window names.
PASSES = 4
#: A window whose anchor holds fewer words is named in full instead.
ANCHOR_WORDS = 3

MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(number: int) -> np.uint64:
    return np.uint64(number * int(MIX) % (1 << 64))


def _digest(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    return _mixed(_mixed(left + _salt(salt)) ^ (right * ODD + MIX))


def span_names(names: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """A name for the words from ``start`` to ``stop``, equal wherever the words are equal.

    Differences of one running sum weighted by powers of ``base``, divided by the power at
    the start (odd numbers have inverses modulo 2**64).
    """
    n = len(names)
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(names * up[:n], out=sums[1:])
    return _digest((sums[stop] - sums[start]) * down[start], (stop - start).astype(np.uint64), 1)


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def joined_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in a row, and where each text's words begin (and the last end)."""
    lists = [t.split() for t in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return [w for x in lists for w in x], bounds


def anchors(names: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor its name, the first word and the end of the words of all its windows, and a weight.

    The weight is one, or the number of windows where equal windows named in full stand
    side by side.
    """
    n = len(names)
    lengths = np.diff(bounds)
    ends = np.repeat(bounds[1:], lengths)
    where = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(where):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    sym, at = names, np.arange(n)
    opens = np.zeros(n + 1, bool)
    opens[bounds[:-1][lengths > 0]] = True
    opens[n] = True
    low, high, alive = where, where + window, np.arange(len(where))
    name, code, best = np.zeros(len(where), np.uint64), np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
    base, turn = 0, 0
    while len(alive):
        m = len(sym)
        words = np.diff(np.append(at, n))
        for end in (low, high - 1):
            more = words[end] > best[alive]
            done, here = alive[more], end[more]
            best[done], name[done], code[done] = words[here], sym[here], base + here
        if turn % RUN_EVERY == 0:
            # The runs at both ends of a core may go on outside: they are cut.
            head = np.ones(m + 1, bool)
            head[1:m] = (sym[1:] != sym[:-1]) | opens[1:m]
            place = np.cumsum(head[:m]) - 1
            heads = np.flatnonzero(head)
            run = np.diff(heads)
            low, high = place[low] + 1, place[high - 1]
            heads = heads[:-1]
            sym = np.where(run > 1, _digest(sym[heads], run.astype(np.uint64), 2 * turn + 2), sym[heads])
        else:
            # One bit of a name says left or right; a left followed by a right makes a pair.
            right = (_mixed(sym ^ _salt(turn)) >> np.uint64(63)).astype(bool)
            pair = np.zeros(m, bool)
            pair[:-1] = ~right[:-1] & right[1:] & ~opens[1:m]
            head = np.ones(m, bool)
            head[1:] = ~pair[:-1]
            place = np.cumsum(head) - 1
            heads = np.flatnonzero(head)
            # A right at the front or a left at the end may pair with what is outside: it is cut.
            first, last = low + right[low], high - ~right[high - 1]
            low, high = place[np.minimum(first, m - 1)], place[np.maximum(last - 1, 0)] + 1
            high = np.where(first < last, high, low)
            other = sym[np.minimum(heads + 1, m - 1)]
            sym = np.where(pair[heads], _digest(sym[heads], other, 2 * turn + 3), sym[heads])
        left = low < high
        alive, low, high = alive[left], low[left], high[left]
        base += m
        at, opens = at[heads], np.append(opens[heads], True)
        turn += 1
    full = best < ANCHOR_WORDS
    if full.any():
        weak = np.flatnonzero(full)
        name[weak] = span_names(names, where[weak], where[weak] + window, BASES[1])
        code[weak] = base + weak
        # Equal neighbours, as inside a long run of one word, become one row.
        same = np.flatnonzero((name[weak][1:] == name[weak][:-1]) & (np.diff(where[weak]) == 1)) + 1
        code[weak[same]] = 0
        code[weak] = np.maximum.accumulate(code[weak])
    edge = np.flatnonzero(np.diff(code, prepend=-1))
    last = np.append(edge[1:], len(where)) - 1
    order = np.argsort(code[edge], kind="stable")
    heads = np.flatnonzero(np.diff(code[edge][order], prepend=-1))
    tails = np.append(heads[1:], len(order)) - 1
    first, last = edge[order][heads], last[order][tails]
    weight = np.where(full[first], last - first + 1, 1)
    return name[first], where[first], where[last] + window, weight


def _identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, a digest that tells rows of one id apart, and the text."""
    return docs.select(
        F.col(id_col).alias("id"), F.hash(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text")
    )


def _located(batch: pa.RecordBatch, bounds: np.ndarray, start: np.ndarray, more: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows for places in the joined words: the text's id and mark, and word numbers inside the text."""
    row = np.searchsorted(bounds, start, "right") - 1
    columns = {k: batch.column(k).take(pa.array(row)) for k in ("id", "mark")}
    columns["start"] = pa.array((start - bounds[row]).astype(np.int32))
    if "stop" in more:
        more["stop"] = (more["stop"] - bounds[row]).astype(np.int32)
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in more.items()})


def _anchor_rows(window: int):
    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch | None:
        words, bounds = joined_words(texts)
        names = word_names(words)
        symbol, start, stop, weight = anchors(names, bounds, window)
        around = span_names(names, start, stop, BASES[0])
        more = {"stop": stop, "symbol": symbol.view(np.int64), "around": around.view(np.int64), "weight": weight}
        return _located(batch, bounds, start, more)

    return slices(PARSED_BYTES, "text", work)


def _window_rows(window: int):
    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch | None:
        words, bounds = joined_words(texts)
        chosen = np.zeros(len(words) + 1, np.int64)
        for row, spans in enumerate(batch.column("spans")):
            starts, stops = (x + bounds[row] for x in _pairs(spans))
            np.add.at(chosen, starts, 1)
            np.add.at(chosen, stops - window + 1, -1)
        start = np.flatnonzero(np.cumsum(chosen[:-1]))
        names = word_names(words)
        first = span_names(names, start, start + window, BASES[0])
        check = span_names(_mixed(names), start, start + window, BASES[1]) >> np.uint64(32)
        return _located(batch, bounds, start, {"name": first.view(np.int64), "check": check.astype(np.uint32).view(np.int32)})

    return slices(PARSED_BYTES, "text", work)


def _pairs(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    values = spans.values
    if values is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return values.field("start").to_numpy().astype(np.int64), values.field("stop").to_numpy().astype(np.int64)


def _with_spans(identity: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Texts with the spans of their own row; the spans are the hashed side, texts are not sorted."""
    by_row = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    by_row = by_row.select(F.col("id").alias("its"), F.col("mark").alias("own"), "spans").hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("its")) & F.col("mark").eqNullSafe(F.col("own"))
    return identity.join(by_row, same, how).drop("its", "own")


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word spans of every text that are made of windows occurring more than once anywhere.

    Returns ``id, mark, start, stop``: words ``start`` to ``stop - 1`` of the text, counted
    from 0, and ``mark``, a digest that tells rows with one id but other texts apart. Spans
    of one text may overlap. A null or empty text, or one of fewer words than a window, has
    none. Repeated rows are repeats of each other. Words are what stands between ASCII
    white space; other columns are not read.
    """
    identity = _identity(docs, id_col, text_col)
    kind = identity.schema["id"].dataType
    place = [
        T.StructField("id", kind), T.StructField("mark", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
    ]
    anchor = [T.StructField(n, T.LongType()) for n in ("symbol", "around", "weight")]
    found = stored(identity.mapInArrow(_anchor_rows(window), T.StructType([*place, *anchor])), "anchors")
    # Aggregates are stored before they are joined: Spark splits a large key only where both
    # sides of the join come straight from a shuffle.
    twice = stored(found.groupBy("symbol").agg(F.sum("weight").alias("total")).where("total > 1"), "shared-symbols")
    shared = stored(found.join(twice, "symbol"), "shared-anchors")
    discard(found, twice)
    where = F.struct("id", "mark", "start")
    alike = shared.groupBy("symbol", "around").agg(
        F.sum("weight").alias("n"), F.first("total").alias("of"), F.min(where).alias("head")
    ).where("n > 1").select("symbol", "around", F.when(F.col("n") < F.col("of"), F.col("head")).alias("head"), F.lit(True).alias("settled"))
    alike = stored(alike, "settled")
    spans = shared.join(alike, ["symbol", "around"], "left").select(
        "id", "mark", "start", "stop", F.coalesce("settled", F.lit(False)).alias("settled"),
        (F.col("settled").isNull() | F.col("head").eqNullSafe(where)).alias("named"),
    )
    spans = stored(spans, "anchor-spans")
    discard(shared, alike)
    windows = _with_spans(identity, spans.where("named"), "inner").mapInArrow(
        _window_rows(window), T.StructType([*place[:3], T.StructField("name", T.LongType()), T.StructField("check", T.IntegerType())])
    )
    windows = stored(windows, "windows")
    parts = [spans.where("settled").drop("settled", "named")]
    for turn in range(PASSES):
        part = windows.where(F.pmod("name", F.lit(PASSES)) == turn)
        again = part.groupBy("name", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        again = stored(again, "repeated-windows")
        parts.append(stored(part.join(again, ["name", "check"]).select("id", "mark", "start", (F.col("start") + window).alias("stop")), "repeats"))
        discard(again)
    discard(windows)
    return reduce(DataFrame.unionByName, parts)


def _cut(texts: list[bytes], spans: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int], list[bytes], list[bytes]]:
    total, removed, joined, plain = [], [], [], []
    for text, (start, stop) in zip(texts, spans, strict=True):
        words = text.split()
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, start, 1)
        np.add.at(drop, stop, -1)
        keep = np.cumsum(drop[:-1]) == 0
        kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if len(start) else words
        total.append(len(words))
        removed.append(len(words) - len(kept))
        joined.append(b" ".join(kept))
        plain.append(joined[-1] if len(kept) < len(words) else text)
    return total, removed, joined, plain


def _cut_rows(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
    total, removed, joined, plain = _cut(texts, [_pairs(s) for s in batch.column("spans")])
    text = pa.array(plain, pa.binary()).cast(pa.string())
    null = batch.column("text").is_null()
    return pa.RecordBatch.from_pydict({
        "id": batch.column("id"), "mark": batch.column("mark"), "text": pc.if_else(null, pa.scalar(None, pa.string()), text),
        "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
    })


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the words of windows that start more than once anywhere in the table.

    Returns one row per input row: ``id``, ``mark`` and ``text`` (untouched where nothing is
    removed, else the kept words joined by one space; null stays null), ``n_words``,
    ``n_removed``, ``kept_sha256`` of the kept words joined by one space. Which words go is
    judged on the input. An empty table gives an empty result.
    """
    identity = _identity(docs, id_col, text_col)
    spans = repeated_spans(docs, window, id_col, text_col)
    fields = [
        T.StructField("id", identity.schema["id"].dataType), T.StructField("mark", T.IntegerType()),
        T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    ]
    return _with_spans(identity, spans, "left").mapInArrow(slices(4 * PARSED_BYTES, "text", _cut_rows), T.StructType(fields))


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the words of repeated windows taken out of the texts, all columns and rows kept.

    A text that loses words becomes its kept words joined by one space, and ``chars_col``, if
    there is one, its new length; other texts are unchanged. Null texts stay null, no rows give
    no rows, and columns may have any names.
    """
    names, spans_col = docs.columns, unused(docs, "_spans")
    rows = packed(docs, id=F.col(id_col), mark=F.hash(F.col(text_col)))
    spans = repeated_spans(docs, window, id_col, text_col).withColumnsRenamed({"id": "its", "mark": "own"})
    by_row = spans.groupBy("its", "own").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("its")) & F.col("mark").eqNullSafe(F.col("own"))
    joined = unpacked(rows.join(by_row, same, "left"), names, F.col("spans").alias(spans_col))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        _, removed, _, plain = _cut(texts, [_pairs(s) for s in batch.column(spans_col)])
        cut = pc.greater(pa.array(removed, pa.int64()), 0)
        at = batch.schema.get_field_index(text_col)
        made = pc.if_else(cut, pa.array(plain, pa.binary()).cast(pa.string()), batch.column(at))
        batch = batch.set_column(at, batch.schema.field(at), made)
        at = batch.schema.get_field_index(chars_col)
        if at >= 0:
            length = pc.utf8_length(made).cast(batch.schema.field(at).type)
            batch = batch.set_column(at, batch.schema.field(at), pc.if_else(cut, length, batch.column(at)))
        return batch.select(names)

    return joined.mapInArrow(slices(4 * PARSED_BYTES, text_col, work), docs.schema)

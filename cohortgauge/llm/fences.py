"""Quality rules whose limits come from the corpus: quantile sketches per language and source.

Each text's measures are computed once. Mergeable KLL sketches of the ratios are built per
language and source; those of one language merge into the language's, and all into one for
the table, without another look at the texts. A group's limits are its quartiles widened by
a multiple of their distance. Rows meet the limits of their group in a join, and the rules
filter on both sides of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.tables import slices, stored

#: Fixed base rules: fewest words, and the largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Items a sketch keeps; the rank error is below 0.1 %.
SKETCH = 4096
#: Groups with fewer rows use the limits of their language, languages those of the table.
LEAST_ROWS = 50
#: Quartile distances between a quartile and a limit.
REACH = 3.0
#: Ratio, the least distance of its quartiles that is assumed, and whether it has a lower limit too.
RATIOS = {
    "symbols": (0.02, False), "repeats": (0.15, False), "dup_lines": (0.15, False), "capitals": (0.03, False),
    "marks": (0.02, False), "length": (0.5, True),
}

SYMBOLS, SPACE = b"#*$%&|<>", b"\t\n\x0b\x0c\r "
NOT_POINTS = SPACE + bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]


def repeated_words(lists: list[list[bytes]]) -> list[int]:
    """Words of each text in 3-word windows that the text holds twice or more."""
    lengths = np.array([len(x) for x in lists], np.int64)
    total = int(lengths.sum())
    if total < 4:
        return [0] * len(lists)
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for x in lists for w in x), np.int64, total)
    doc = np.repeat(np.arange(len(lists)), lengths)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    pair = word[:-1] * len(numbers) + word[1:]
    if len(numbers) ** 3 >= 1 << 62:  # words, pairs and places are below 2**31 each
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[inside] * len(numbers) + word[inside + 2]
    order = np.lexsort((window, doc[inside]))
    same = (np.diff(window[order]) == 0) & (np.diff(doc[inside][order]) == 0)
    found = np.zeros(len(order), bool)
    found[1:] |= same
    found[:-1] |= same
    start = inside[order][found]
    covered = np.zeros(total, bool)
    for k in range(3):
        covered[start + k] = True
    return np.bincount(doc[covered], minlength=len(lists)).tolist()


def _repeated_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines), len(lines) - len(set(lines))


def _measure(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
    lists = [t.split() for t in texts]
    lines = [_repeated_lines(t) for t in texts]
    without = lambda t, chars: len(t) - len(t.translate(None, chars))
    values = {
        "n_words": [len(x) for x in lists], "word_chars": [len(t.translate(None, NOT_POINTS)) for t in texts],
        "n_symbols": [without(t, SYMBOLS) for t in texts], "n_dup_lines": [x[1] for x in lines],
        "n_repeat_words": repeated_words(lists), "n_lines": [x[0] for x in lines],
        "n_capitals": [without(t, CAPITALS) for t in texts], "n_marks": [without(t, b"!?") for t in texts],
    }
    columns = {k: batch.column(k) for k in ("id", "lang", "source")}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(values[k], pa.int64()) for k in COUNTS})


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id, lang, source`` and the counts of every text. A null text has no words."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    fields = [rows.schema["id"], rows.schema["lang"], rows.schema["source"], *[T.StructField(c, T.LongType()) for c in COUNTS]]
    return rows.mapInArrow(slices(1 << 18, "text", _measure), T.StructType(fields))


def _ratios() -> dict[str, Column]:
    per = lambda count, of: F.coalesce(F.try_divide(F.col(count).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    return {
        "symbols": per("n_symbols", "n_words"), "repeats": per("n_repeat_words", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
        "capitals": per("n_capitals", "word_chars"), "marks": per("n_marks", "n_words"), "length": per("word_chars", "n_words"),
    }


def limits(counted: DataFrame) -> DataFrame:
    """Per ``lang, source`` (null is a value) the lower and upper limit of every ratio.

    Only rows with a word count. The sketches are one row per group, whatever it holds.
    """
    rated = counted.where("n_words > 0").select("lang", "source", *[c.alias(k) for k, c in _ratios().items()])
    sketches = rated.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("rows"), *[F.kll_sketch_agg_double(k, F.lit(SKETCH)).alias(k) for k in RATIOS]
    )
    sketches = stored(sketches, "sketches")
    merged = lambda *keys: sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(k).alias(k) for k in RATIOS]
    )
    by_lang = merged("lang").select(F.col("lang").alias("of"), F.struct("rows", *RATIOS).alias("wider"))
    whole = merged().select(F.struct("rows", *RATIOS).alias("widest"))
    # The whole table's sketches are one row; languages are a handful of rows.
    found = sketches.join(by_lang, F.col("lang").eqNullSafe(F.col("of"))).join(F.broadcast(whole))
    enough = F.col("rows") >= LEAST_ROWS
    columns = []
    for name, (least, both) in RATIOS.items():
        sketch = F.when(enough, F.col(name)).when(F.col("wider.rows") >= LEAST_ROWS, F.col(f"wider.{name}")).otherwise(F.col(f"widest.{name}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        reach = REACH * F.greatest(high - low, F.lit(least))
        columns.append(((low - reach) if both else F.lit(float("-inf"))).alias(f"{name}_from"))
        columns.append((high + reach).alias(f"{name}_to"))
    return found.select("lang", "source", *columns)


def apply_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """Every row's counts, ``base_failed`` and ``kept``.

    A row fails the base rules with fewer than 50 words or with over half of its words in
    repeated windows. Else it is kept if all its ratios lie within the limits of its language
    and source. Nulls in those two form groups of their own; repeated rows are judged alike;
    an empty table gives an empty result.
    """
    counted = stored(measures(docs, **columns), "measures")
    bound = limits(counted).select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[f"{k}_{e}" for k in RATIOS for e in ("from", "to")])
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.lit(True)
    for name, ratio in _ratios().items():
        inside = inside & ratio.between(F.col(f"{name}_from"), F.col(f"{name}_to"))
    return counted.join(bound, same, "left").select(
        "id", "lang", "source", *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept")
    )

"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of a fixed number of words. Every passage is encoded: its words
and the three-byte pieces of its words, hashed, and counts of its bytes and words become a
vector, and one learned layer its representation h. That layer holds an embedding for every
place of the hash, and h starts from their sum over the passage. Gated attention, softmax over the passages of w . (tanh(V h) * sigmoid(U h)), weighs them; the
weighted sum is scored. Only documents have labels, so the weights learn which passages tell.

The model is fitted on the driver from a bounded sample of labelled documents, which are
encoded by tasks. Scoring is one pass over the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.recompression import span_names
from cohortgauge.llm.tables import discard, portions, slices, stored

#: Words of a passage.
PASSAGE = 50
#: Labelled documents the model is fitted on, at most: those with the smallest digest of their id.
SAMPLE = 4000
#: Passages of all sampled documents together, at most, unless the first document alone has more.
SENT = 8 * SAMPLE
HIDDEN, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 128, 0.01, 1e-4, 7
THRESHOLD = 0.3

#: Byte classes of the counts: capital, small letter, digit, listed symbols, bar, calls, other
#: punctuation, line feed, other white space, beginning of another letter, its further bytes.
CLASSES = 11
NAMES = [
    "capitals", "letters", "digits", "symbols", "bars", "calls", "points", "lines", "other", "length", "spread", "words",
    "distinct", "most", "stutter", "shouted", "ended", "few",
]
#: Places that words, and three-byte pieces of words, are hashed to.
WORDS, PIECES = 128, 128
WIDTH = len(NAMES) + WORDS + PIECES
#: The hashed parts have many more columns than the counts: so much smaller is each.
SHRINK = 10.0


def byte_classes() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[65:91], table[97:123], table[48:58] = 0, 1, 2
    table[[ord(c) for c in "#*$%&<>"]] = 3
    table[ord("|")] = 4
    table[[ord("!"), ord("?")]] = 5
    table[ord("\n")] = 7
    table[[9, 11, 12, 13, 32]] = 8
    table[0xC0:] = 9
    table[0x80:0xC0] = 10
    return table


def encode_passages(texts: list[bytes], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """A vector per passage, and how many passages each text has (one at least)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    kind = byte_classes()[data]
    blank = (kind == 7) | (kind == 8)
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    stops = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    owner = np.searchsorted(ends, starts, "right")
    words = np.bincount(owner, minlength=len(texts))
    count = np.maximum(1, -(-words // size))
    first = np.cumsum(count) - count
    rank = np.arange(len(starts)) - (np.cumsum(words) - words)[owner]
    passage = first[owner] + rank // size
    total = int(count.sum())
    # A passage begins with its first word, a text's first passage with the text.
    cuts = np.zeros(len(data), np.int64)
    cuts[np.concatenate([[0], ends[:-1]])] = 1
    cuts[starts[(rank > 0) & (rank % size == 0)]] = 1
    at = np.cumsum(cuts) - 1
    classes = np.bincount(at * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float64)
    size_of = (stops - starts).astype(np.float64)
    per = lambda values: np.bincount(passage, values, minlength=total)
    n = np.bincount(passage, minlength=total).astype(np.float64)
    safe = np.maximum(n, 1)
    mean = per(size_of) / safe
    spread = np.sqrt(np.maximum(per(size_of**2) / safe - mean**2, 0))
    name = _word_hash(data, starts, stops)
    order = np.lexsort((name, passage))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(name[order]) != 0) | (np.diff(passage[order]) != 0)
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(order)))
    distinct = np.bincount(passage[order][head], minlength=total)
    most = np.zeros(total)
    np.maximum.at(most, passage[order][head], times)
    again = np.zeros(len(starts), bool)
    again[1:] = (name[1:] == name[:-1]) & (passage[1:] == passage[:-1])
    shouted = (kind[stops - 1] == 5) if len(stops) else again
    ended = np.isin(kind[stops - 1], (3, 4)) if len(stops) else again
    letters = classes[:, 0] + classes[:, 1] + classes[:, 9]
    points = np.maximum(classes[:, :7].sum(1) + classes[:, 9], 1)
    vector = np.stack([
        classes[:, 0] / np.maximum(letters, 1), letters / points, classes[:, 2] / points, classes[:, 3] / safe, classes[:, 4] / safe,
        classes[:, 5] / safe, classes[:, 6] / points, classes[:, 7] / safe, classes[:, 9] / points, mean / 10, spread / 5, n / size,
        distinct / safe, most / safe, per(again) / safe, per(shouted) / safe, per(ended) / safe, np.repeat(words < size, count),
    ], axis=1)
    # Shares of the passage's words, and of their pieces, at every place of the hash.
    spoken = np.bincount(passage * WORDS + (name % np.uint64(WORDS)).astype(np.int64), minlength=total * WORDS).reshape(total, WORDS) / safe[:, None]
    inside = ~blank[:-2] & ~blank[1:-1] & ~blank[2:] if len(data) > 2 else np.zeros(0, bool)
    at_piece = np.flatnonzero(inside)
    low = _lower()[data].astype(np.uint64)
    piece = (low[at_piece] << np.uint64(16) | low[at_piece + 1] << np.uint64(8) | low[at_piece + 2]) * np.uint64(0x9E3779B97F4A7C15)
    place = at[at_piece] * PIECES + (piece >> np.uint64(57)).astype(np.int64)
    pieces = np.bincount(place, minlength=total * PIECES).reshape(total, PIECES).astype(np.float64)
    pieces /= np.maximum(pieces.sum(1, keepdims=True), 1)
    return np.concatenate([np.minimum(vector, 10), spoken, pieces], axis=1).astype(np.float32), count


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _word_hash(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return span_names(data.astype(np.uint64), starts, stops, 0x8CB92BA72F3D8DD7)


class GatedAttention:
    """The network; ``weights`` are plain arrays, so it travels with the function that scores."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @staticmethod
    def start(width: int, seed: int = SEED) -> dict[str, np.ndarray]:
        random = np.random.RandomState(seed)
        drawn = lambda a, b: random.randn(a, b) / np.sqrt(a)
        return {
            "W": drawn(width, HIDDEN), "b": np.zeros(HIDDEN), "V": drawn(HIDDEN, GATES), "U": drawn(HIDDEN, GATES),
            "w": drawn(GATES, 1), "c": drawn(HIDDEN, 1), "d": np.zeros(1), "mean": np.zeros(width), "scale": np.ones(width),
        }

    def forward(self, vectors: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of bags whose passages lie side by side, and what the gradient needs."""
        p = self.weights
        x = (vectors - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"] + p["b"])
        gate, sigmoid = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = ((gate * sigmoid) @ p["w"])[:, 0]
        start = np.cumsum(count) - count
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), count))
        a = e / np.repeat(np.add.reduceat(e, start), count)
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        score = 1 / (1 + np.exp(-(z @ p["c"])[:, 0] - p["d"]))
        return score, {"x": x, "h": h, "gate": gate, "sigmoid": sigmoid, "a": a, "z": z, "start": start}

    def gradient(self, vectors: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        score, s = self.forward(vectors, count)
        error = (score - label) / len(label)
        dz = error[:, None] * p["c"].T
        spread = np.repeat(dz, count, axis=0)
        da = (spread * s["h"]).sum(1)
        de = s["a"] * (da - np.repeat(np.add.reduceat(s["a"] * da, s["start"]), count))
        dg = de[:, None] * p["w"].T
        dv, du = dg * s["sigmoid"] * (1 - s["gate"]**2), dg * s["gate"] * s["sigmoid"] * (1 - s["sigmoid"])
        dh = s["a"][:, None] * spread + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - s["h"]**2)
        return {
            "W": s["x"].T @ dx, "b": dx.sum(0), "V": s["h"].T @ dv, "U": s["h"].T @ du,
            "w": (s["gate"] * s["sigmoid"]).T @ de[:, None], "c": s["z"].T @ error[:, None], "d": error.sum(keepdims=True),
        }

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> GatedAttention:
        """Adam on the log loss, in an order drawn from ``seed``: the same bags give the same weights."""
        model = cls(cls.start(bags[0].shape[1] if bags else WIDTH, seed))
        if not bags:
            return model
        everything = np.concatenate(bags).astype(np.float32)
        model.weights["mean"], model.weights["scale"] = everything.mean(0, dtype=np.float64), everything.std(0, dtype=np.float64) + 1e-3
        del everything
        model.weights["scale"][len(NAMES):] *= SHRINK
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        model.weights["d"] = np.array([np.log(share / (1 - share))])
        random = np.random.RandomState(seed)
        first = {k: np.zeros_like(v) for k, v in model.weights.items()}
        second = {k: np.zeros_like(v) for k, v in model.weights.items()}
        turn = 0
        for _ in range(epochs):
            order = random.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                chosen = order[at:at + BATCH]
                count = np.array([len(bags[i]) for i in chosen])
                slope = model.gradient(np.concatenate([bags[i] for i in chosen]).astype(np.float64), count, labels[chosen])
                turn += 1
                for k, g in slope.items():
                    g = g + DECAY * model.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    model.weights[k] = model.weights[k] - RATE * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
        return model


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether the checksum of the id as text is a multiple of ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(folds) == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> GatedAttention:
    """Fit on at most ``sample`` labelled documents that are not held out, each with all its passages.

    Where ids repeat or documents are long, rows are taken in the order of their digest, up to
    twice ``sample`` rows and ``SENT`` passages. Rows without id or label are left out, and rows of
    one id, label and text count once. Without any labelled document the model scores from its
    start weights.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in chosen], T.StructType([labels.schema["doc_id"], T.StructField("label", T.DoubleType())]))
    # At most ``sample`` rows of an id and a number.
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches, "text", 1 << 18):
            vectors, count = encode_passages(texts)
            at, rows = 0, []
            for n in count.tolist():
                rows.append(vectors[at:at + n].astype(np.float16).tobytes())
                at += n
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "bag": pa.array(rows, pa.binary())})

    schema = T.StructType([picked.schema["doc_id"], T.StructField("label", T.DoubleType()), T.StructField("bag", T.BinaryType())])
    bagged = stored(picked.mapInArrow(run, schema).dropDuplicates().withColumn("digest", F.xxhash64("doc_id", "label", "bag")), "bags")
    sizes = bagged.select("digest", F.length("bag").alias("size")).orderBy("digest").limit(2 * sample).collect()
    total = np.cumsum([r["size"] // (2 * WIDTH) for r in sizes])
    last = sizes[max(0, int(np.searchsorted(total, SENT, "right")) - 1)]["digest"] if sizes else 0
    rows = bagged.where(F.col("digest") <= F.lit(last)).orderBy("doc_id", "bag").collect()
    discard(bagged)
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH) for r in rows]
    return GatedAttention.fit(bags, np.array([r["label"] for r in rows]))


def score_rows(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every whole text; a null text is scored as an empty one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        score, _ = model.forward(*encode_passages(texts))
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(score, pa.float64())})

    return rows.mapInArrow(slices(1 << 18, "text", work), T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: GatedAttention, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns unchanged."""

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        score, _ = model.forward(*encode_passages(texts))
        return batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(slices(1 << 18, "text", work), docs.schema)

"""Toxic spans and document scores from a linear-chain conditional random field.

A text is cut into words and sentences; a sentence (at most ``CHAIN`` words of it) is a chain.
Every word has the tag 1 (toxic) or 0. Its features are its name, beginnings and endings of
it, its neighbours and its shape, hashed to one table of weights; a 2 x 2 table scores tags of
neighbours. Forward-backward gives each word's marginal. Runs of words with a marginal of one
half or more are the offending spans; the largest marginal and the sum of all marginals give
the document's score through a logistic curve.

Labelled words teach the field (``ChainField.fit``). Where only documents have labels,
``label_words`` marks the words of toxic documents: those with a feature that stands in toxic
documents far more often than in clean ones, counted in different documents and in different
surroundings, so that copies of one document prove nothing.

The field is fitted on the driver on a bounded sample of labelled documents (``PER_CLASS``
and ``SENT_BYTES``). Scoring is one pass over the whole texts.

Defined results: a null text is scored as an empty one, and an empty text as one whose words
are all harmless; equal texts have equal scores; rows without id or label are not learnt
from; one id with several labels counts as their mean, toxic from one half; no labelled rows
of either class leave all scores at the share of toxic labels (0.5 without any); no rows give
no rows; other columns are not read. A text beyond ``PIECE`` bytes is read in pieces that end
at a blank, or where none follows within 64 KiB, at a character. Capitals are lower-cased in
ASCII and Latin-1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.tables import discard, portions, raw_bytes, slices, stored

#: Labelled documents of each class the field is fitted on, at most: smallest digests of their ids.
PER_CLASS = 2500
#: Bytes of their texts together, at most, unless the first document alone has more.
SENT_BYTES = 12 << 20
#: Words of a chain, at most.
CHAIN = 48
PIECE = 1 << 20
THRESHOLD = 0.5
#: Weights are hashed to so many places.
TABLE = 1 << 20
EPOCHS, BATCH_WORDS, RATE, DECAY, SEED = 5, 1 << 15, 0.3, 1e-6, 11
#: A feature marks words where it is so many times as frequent in toxic documents, with this log-likelihood ratio.
MARK_RATIO, MARK_GAIN = 5.0, 22.0
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7), (3, 4)
#: Columns of the features: bias, name, beginnings, endings, word before, word after, shape.
WIDTH = 5 + len(BEGINNINGS) + len(ENDINGS)
#: The columns that can mark a word: its name and its beginnings.
MARKING = range(1, 2 + len(BEGINNINGS))
BIAS, NONE = 0, 1

_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def cut(text: bytes, size: int | None = None, reach: int = 1 << 16) -> list[bytes]:
    """The text in pieces of about ``size`` bytes (``PIECE``); joined they are the text."""
    size = size or PIECE
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            seen = text[end:end + reach]
            step = next((i for i, c in enumerate(seen) if c in b" \t\n\r\x0b\x0c"), None)
            if step is None:
                while end < len(text) and 0x80 <= text[end] < 0xC0:
                    end += 1
            else:
                end += step
        out.append(text[at:end])
        at = end
    return out


class Words:
    """The words of some texts: where they are, which chain they belong to, their features."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        small = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        small = small + np.where(latin, 32, 0).astype(np.uint8)
        inside = ((small >= 97) & (small <= 122)) | ((data >= 48) & (data <= 57)) | (data == 39) | (data >= 0x80)
        before = np.append(False, inside[:-1])
        start = np.flatnonzero(inside & ~before)
        stop = np.flatnonzero(~inside & before)
        self.start, self.stop, self.n = start, stop, len(start)
        self.owner = np.searchsorted(ends, start, "right")
        first_char = (data & 0xC0) != 0x80
        self.char_at = np.cumsum(first_char) - first_char  # characters before each byte
        self.text_start = np.append(0, ends[:-1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        # A chain ends with its sentence, its text, or after CHAIN words.
        stops = np.cumsum(np.isin(data, (10, 33, 46, 63)))
        fresh = np.ones(self.n, bool)
        if self.n:
            fresh[1:] = (stops[start[1:]] != stops[start[:-1]]) | (self.owner[1:] != self.owner[:-1])
        head = np.flatnonzero(fresh)
        since = np.arange(self.n) - np.repeat(head, np.diff(np.append(head, self.n)))
        fresh |= since % CHAIN == 0
        self.fresh = fresh
        self.head = np.flatnonzero(fresh)
        self.length = np.diff(np.append(self.head, self.n))
        # Names of any span from one running sum.
        wide = small.astype(np.uint64)
        down = _powers(_INVERSE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(wide * _powers(_BASE, len(data))[:-1], out=sums[1:])
        name = lambda a, b: (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        chars = np.flatnonzero(first_char)
        begin = self.char_at[start]
        size = self.char_at[stop] - begin
        table = np.empty((self.n, WIDTH), np.int32)
        place = lambda x, column: (_mix(x, column + 1) % np.uint64(TABLE - 2)).astype(np.int32) + 2
        table[:, 0] = BIAS
        self.name = name(start, stop)
        table[:, 1] = place(self.name, 1)
        column = 2
        for k in BEGINNINGS:
            to = chars[np.minimum(begin + k, len(chars) - 1)]
            table[:, column] = np.where(size > k, place(name(start, np.minimum(to, stop)), column), NONE)
            column += 1
        for k in ENDINGS:
            since_end = chars[np.maximum(begin + size - k, 0)]
            table[:, column] = np.where(size > k, place(name(np.maximum(since_end, start), stop), column), NONE)
            column += 1
        left, right = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        if self.n:
            left[1:], right[:-1] = self.name[:-1], self.name[1:]
        last = np.append(fresh[1:], True)[:self.n]
        left[fresh] = right[last] = 0
        self.around = _mix(left, 77) ^ _mix(right, 78)
        table[:, column] = np.where(fresh, NONE, place(left, column))
        table[:, column + 1] = np.where(last, NONE, place(right, column + 1))
        upper = (data[start] >= 65) & (data[start] <= 90) if self.n else np.zeros(0, bool)
        table[:, column + 2] = place((np.minimum(size, 15) * 4 + upper * 2 + fresh).astype(np.uint64), column + 2)
        self.features = table

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """First character and character after the last, from the beginning of the word's text."""
        base = self.char_at[self.text_start[self.owner]] if self.n else 0
        return self.char_at[self.start] - base, self.char_at[self.stop] - base


def _chains(head: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """For every place in a chain, the words that stand there; longest chains first."""
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    return [head[:n] + t for t, n in enumerate(active)]


def _forward_backward(scores: np.ndarray, pairs: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log ratios of tag 1 to tag 0: from the words up to each (its own score included), and from those after it."""
    rho, beta = np.empty(len(scores)), np.zeros(len(scores))
    for t, at in enumerate(places):
        if t == 0:
            rho[at] = scores[at]
            continue
        r = rho[at - 1]
        rho[at] = scores[at] + np.logaddexp(pairs[0, 1], pairs[1, 1] + r) - np.logaddexp(pairs[0, 0], pairs[1, 0] + r)
    for t in range(len(places) - 1, 0, -1):
        at = places[t]
        s = scores[at] + beta[at]
        beta[at - 1] = np.logaddexp(pairs[1, 0], pairs[1, 1] + s) - np.logaddexp(pairs[0, 0], pairs[0, 1] + s)
    return rho, beta, 1 / (1 + np.exp(-np.clip(rho + beta, -40, 40)))


class ChainField:
    """Weights of features and of neighbouring tags, and the curve from marginals to a score."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, curve: np.ndarray):
        self.weights, self.pairs, self.curve = weights, pairs, curve

    def marginals(self, words: Words) -> np.ndarray:
        scores = self.weights[words.features].sum(1, dtype=np.float64)
        return _forward_backward(scores, self.pairs, _chains(words.head, words.length))[2]

    @classmethod
    def fit(cls, features: np.ndarray, head: np.ndarray, length: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ChainField:
        """AdaGrad on the log-likelihood of labelled words; the same words give the same weights.

        The curve is left flat; ``fit_curve`` sets it from documents.
        """
        weights, pairs = np.zeros(TABLE), np.zeros((2, 2))
        squares, pair_squares = np.full(TABLE, 1e-2), np.full((2, 2), 1e-2)
        weights[BIAS] = -4.0
        random = np.random.RandomState(seed)
        for _ in range(epochs):
            order = random.permutation(len(head))
            block = np.cumsum(length[order]) // BATCH_WORDS
            for chosen in np.split(order, np.flatnonzero(np.diff(block)) + 1) if len(order) else []:
                size = length[chosen]
                starts = np.cumsum(size) - size
                at = np.repeat(head[chosen] - starts, size) + np.arange(size.sum())
                part, tag = features[at], tags[at].astype(np.float64)
                scores = weights[part].sum(1)
                places = _chains(starts, size)
                rho, beta, p = _forward_backward(scores, pairs, places)
                error = p - tag
                touched, back = np.unique(part, return_inverse=True)
                slope = np.bincount(back.reshape(-1), np.repeat(error, WIDTH), minlength=len(touched)) + DECAY * weights[touched]
                slope[touched == NONE] = 0
                squares[touched] += slope**2
                weights[touched] -= RATE * slope / np.sqrt(squares[touched])
                follows = np.concatenate(places[1:]) if len(places) > 1 else np.zeros(0, np.int64)
                if len(follows):
                    r, s = rho[follows - 1], scores[follows] + beta[follows]
                    joint = np.stack([pairs[0, 0] + 0 * r, pairs[0, 1] + s, pairs[1, 0] + r, pairs[1, 1] + r + s])
                    joint = np.exp(joint - joint.max(0))
                    joint /= joint.sum(0)
                    seen = np.bincount((2 * tag[follows - 1] + tag[follows]).astype(np.int64), minlength=4)
                    tilt = (joint.sum(1) - seen).reshape(2, 2)
                    pair_squares += tilt**2
                    pairs = pairs - RATE * tilt / np.sqrt(pair_squares)
        return cls(weights.astype(np.float32), pairs, np.array([0.0, 0.0, 0.0]))

    def fit_curve(self, most: np.ndarray, total: np.ndarray, label: np.ndarray) -> None:
        """Logistic curve over the two aggregates, by Newton's steps with a small ridge."""
        x = self._aggregates(most, total)
        w = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            ridge = np.array([1e-3, 1.0, 1.0])
            slope = x.T @ (p - label) + ridge * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = w

    @staticmethod
    def _aggregates(most: np.ndarray, total: np.ndarray) -> np.ndarray:
        m = np.clip(most, 1e-6, 1 - 1e-6)
        return np.stack([np.ones(len(m)), np.log(m / (1 - m)) / 4, np.log(total + 1e-2) / 4], axis=1)

    def scores(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._aggregates(most, total) @ self.curve, -40, 40)))


def label_words(features: np.ndarray, owner: np.ndarray, around: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Marks for the words of toxic documents that have a telling feature.

    ``owner`` is the document of each word and ``toxic`` the label of each document. A
    feature's count is the smaller of its documents and its surroundings.
    """
    mine = toxic[owner]
    share = max(float(toxic.mean()), 1e-9)
    marked = np.zeros(len(features), bool)

    def counts(places: np.ndarray, other: np.ndarray) -> np.ndarray:
        key = np.unique(places.astype(np.uint64) << np.uint64(40) | (other & np.uint64((1 << 40) - 1)))
        return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=TABLE).astype(np.float64)

    for column in MARKING:
        places = features[:, column]
        t = np.minimum(counts(places[mine], owner[mine].astype(np.uint64)), counts(places[mine], around[mine]))
        c = counts(places[~mine], owner[~mine].astype(np.uint64))
        n = t + c
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 2 * (np.where(t > 0, t * np.log(t / (n * share)), 0) + np.where(c > 0, c * np.log(c / (n * (1 - share))), 0))
        ratio = (t / share) / ((c + 0.5) / (1 - share))
        telling = (gain >= MARK_GAIN) & (ratio >= MARK_RATIO)
        telling[[BIAS, NONE]] = False
        marked |= telling[places]
    return marked & mine


def fit_texts(texts: list[bytes], toxic: np.ndarray) -> ChainField:
    """A field from texts with one label each: mark words, fit the chain, then the curve."""
    share = float(toxic.mean()) if len(toxic) else 0.5
    if not len(toxic) or share in (0.0, 1.0):
        odds = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
        return ChainField(np.zeros(TABLE, np.float32), np.zeros((2, 2)), np.array([odds, 0.0, 0.0]))
    pieces, whose = [], []
    for i, text in enumerate(texts):
        for piece in cut(text):
            pieces.append(piece)
            whose.append(i)
    whose = np.array(whose)
    parts, owners, heads, lengths, arounds, n, begin = [], [], [], [], [], 0, 0
    while begin < len(pieces):
        end, size = begin, 0
        while end < len(pieces) and (end == begin or size + len(pieces[end]) <= PIECE):
            size += len(pieces[end])
            end += 1
        words = Words(pieces[begin:end])
        parts.append(words.features)
        owners.append(whose[begin + words.owner])
        heads.append(words.head + n)
        lengths.append(words.length)
        arounds.append(words.around)
        n, begin = n + words.n, end
    features, owner, head, length = np.concatenate(parts), np.concatenate(owners), np.concatenate(heads), np.concatenate(lengths)
    del parts
    marked = label_words(features, owner, np.concatenate(arounds), toxic)
    # Toxic documents in which nothing is marked say nothing about words.
    silent = toxic & (np.bincount(owner, marked, minlength=len(texts)) == 0)
    use = ~silent[owner[head]] if n else np.zeros(0, bool)
    field = ChainField.fit(features, head[use], length[use], marked)
    scores = np.concatenate([field.weights[part].sum(1, dtype=np.float64) for part in np.array_split(features, len(features) // BATCH_WORDS + 1)])
    p = _forward_backward(scores, field.pairs, _chains(head, length))[2]
    most, total = np.zeros(len(texts)), np.bincount(owner, p, minlength=len(texts))
    np.maximum.at(most, owner, p)
    field.fit_curve(most[~silent], total[~silent], toxic[~silent].astype(np.float64))
    return field


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether the checksum of the id as text is a multiple of ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(folds) == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, sent_bytes: int = SENT_BYTES) -> ChainField:
    """Fit on at most ``per_class`` labelled documents of each class that are not held out, whole texts.

    Equal texts with equal labels count once. Texts are taken in the order of their digest until
    ``sent_bytes`` is reached.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    marked = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).alias("label"))
    ordered = lambda which: marked.where(F.col("label") == which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = [(r["doc_id"], r["label"]) for which in (True, False) for r in ordered(which).collect()]
    ids = spark.createDataFrame(chosen, T.StructType([labels.schema["doc_id"], T.StructField("label", T.BooleanType())]))
    # At most ``2 * per_class`` rows of an id and a flag.
    picked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    picked = stored(picked.select("label", "text").dropDuplicates().withColumn("digest", F.xxhash64("text", "label")), "labelled")
    sizes = picked.select("digest", F.octet_length("text").alias("size")).orderBy("digest").limit(2 * per_class).collect()
    total = np.cumsum([r["size"] for r in sizes])
    last = sizes[max(0, int(np.searchsorted(total, sent_bytes, "right")) - 1)]["digest"] if sizes else 0
    rows = picked.where(F.col("digest") <= F.lit(last)).orderBy("digest", "label", "text").collect()
    discard(picked)
    return fit_texts([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], bool))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def _spans(begin: np.ndarray, end: np.ndarray, joined: np.ndarray) -> list[dict[str, int]]:
    """Words that are side by side in a chain are one span."""
    out: list[dict[str, int]] = []
    for a, b, more in zip(begin.tolist(), end.tolist(), joined.tolist(), strict=True):
        if more and out:
            out[-1]["stop"] = b
        else:
            out.append({"start": a, "stop": b})
    return out


def tag_texts(field: ChainField, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
    """The score of each text and its offending spans in characters."""
    most, total = np.zeros(len(texts)), np.zeros(len(texts))
    spans: list[list[dict[str, int]]] = [[] for _ in texts]

    def group() -> Iterator[list[tuple[int, bytes, int]]]:
        held: list[tuple[int, bytes, int]] = []
        size = 0
        for i, text in enumerate(texts):
            shift = 0
            for piece in cut(text):
                if held and size + len(piece) > PIECE:
                    yield held
                    held, size = [], 0
                held.append((i, piece, shift))
                size += len(piece)
                if len(text) > PIECE:
                    shift += len(piece.decode())
        if held:
            yield held

    for held in group():
        words = Words([piece for _, piece, _ in held])
        if not words.n:
            continue
        p = field.marginals(words)
        whose = np.array([i for i, _, _ in held])[words.owner]
        np.maximum.at(most, whose, p)
        np.add.at(total, whose, p)
        bad = np.flatnonzero(p >= 0.5)
        if not len(bad):
            continue
        begin, end = words.offsets()
        shift = np.array([s for _, _, s in held])[words.owner[bad]]
        joined = np.append(False, np.diff(bad) == 1) & ~words.fresh[bad]
        cuts = np.flatnonzero(np.append(True, np.diff(whose[bad]) != 0))
        for a, b in zip(cuts, np.append(cuts[1:], len(bad)), strict=True):
            spans[whose[bad[a]]] += _spans(begin[bad[a:b]] + shift[a:b], end[bad[a:b]] + shift[a:b], joined[a:b])
    return field.scores(most, total), spans


def score_rows(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, spans`` of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        score, spans = tag_texts(field, texts)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(score, pa.float64()), "spans": pa.array(spans, kind)})

    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    return rows.mapInArrow(slices(1 << 18, "text", work), schema)


def drop_toxic(docs: DataFrame, field: ChainField, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in portions(batches, "text", 1 << 18):
            score, _ = tag_texts(field, [t or b"" for t in raw_bytes(part.column("text"))])
            yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)

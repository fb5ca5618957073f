"""Byte-pair encoding with a queue of merge ranks over a linked list of symbols, and decoding.

A piece of text is a list of symbols linked both ways. A heap holds the merges that its
neighbours allow, lowest rank first, leftmost first among equals. Taking one joins two
links; entries that named either of them stay in the heap and are skipped when they come
up, because the symbols they expect are no longer there. Decoding joins the vocabulary's
strings.

The normaliser, the splitting pattern and the vocabulary are read from a tokenizer file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.tables import per_worker, portions

#: Pieces and words that a worker keeps; a full cache is emptied. A lost piece costs a merge, a
#: lost word only its splitting.
PIECES, WORDS = 500_000, 300_000
#: Bytes of the longest word that is cached.
LONGEST = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class MergeQueue:
    """An encoder and decoder for one tokenizer file of the kinds named below; others raise."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        unused = [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)]
        if model["type"] != "BPE" or unused or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError(f"this tokenizer file needs more than byte-level BPE without decoder: {unused or model['type']}")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocab
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.joined = [ids[a + b] for a, b in merges]
        letters = byte_letters()
        self.single = [ids[x] for x in letters]
        self.final = [ids[x + self.suffix] for x in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with stripping or normalisation are not covered")
        self.lead = os.path.commonprefix(list(self.special))
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.strings = {i: s for s, i in (ids | self.special).items()}
        self.steps = self._normaliser(spec["normalizer"])
        self.split = self._splitter(spec["pre_tokenizer"])

    @staticmethod
    def _normaliser(spec: dict) -> list:
        made = []
        for part in spec["normalizers"]:
            if part["type"] == "NFC":
                made.append(lambda s: s if s.isascii() else unicodedata.normalize("NFC", s))
            elif part["type"] == "Replace" and part["pattern"] == {"Regex": r"\s+"}:
                made.append(lambda s, r=regex.compile(r"\s+"), c=part["content"]: r.sub(c, s))
            elif part["type"] == "Lowercase":
                # Letter by letter: the form of a letter does not depend on its neighbours.
                made.append(lambda s: s.lower() if s.isascii() else "".join(c.lower() for c in s))
            else:
                raise ValueError(f"normaliser not covered: {part}")
        return made

    @staticmethod
    def _splitter(spec: dict) -> regex.Pattern:
        split, level = spec["pretokenizers"]
        wanted = {"behavior": "Removed", "invert": True}, {"add_prefix_space": False, "use_regex": False}
        if any(split[k] != v for k, v in wanted[0].items()) or any(level[k] != v for k, v in wanted[1].items()):
            raise ValueError(f"splitting not covered: {spec}")
        return regex.compile(split["pattern"]["Regex"])

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        raw = piece.encode()
        ids = [self.single[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        n = len(ids)
        rank_of = self.ranks.get
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []  # rank and place in one number, so that it sorts by rank, then by place
        for i in range(n - 1):
            rank = rank_of(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = ahead[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: one of the two is gone or has changed
            joined = ids[i] = self.joined[rank]
            ids[j] = -1
            after, before = ahead[j], behind[i]
            ahead[i] = after
            if after < n:
                behind[after] = i
                rank = rank_of(joined << 32 | ids[after])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | i)
            if before >= 0:
                rank = rank_of(ids[before] << 32 | joined)
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | before)
        return tuple([i for i in ids if i >= 0])

    def split_up(self, text: str) -> list[str]:
        """The normalised pieces of a text without special tokens."""
        if text.isascii() and text.isalpha():  # nothing to normalise or split
            return [text.lower()]
        for step in self.steps:
            text = step(text)
        return self.split.findall(text)

    def _plain(self, text: str) -> list[int]:
        return [i for piece in self.split_up(text) for i in self.merge(piece)]

    def encode(self, text: str) -> list[int]:
        """The ids of a text; strings of special tokens become their ids."""
        if self.lead not in text:
            return self._plain(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += self._plain(text[at:found.start()])
            out.append(self.special[found.group()])
            at = found.end()
        out += self._plain(text[at:])
        return out

    def decode(self, ids) -> str:
        """The vocabulary's strings side by side, with the space that joins them without a decoder."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


Written = tuple[int, str, str, bytes]


class WordCache:
    """Ids of a text put together from its words, and those of a word from its pieces.

    No piece spans ASCII white space and no normalising step looks across it, so a text's ids
    are those of its words in a row. Special tokens hold no white space. What is kept of a
    word or piece is the number of its ids, the decimal ids, the decoded string and the ids as
    little-endian 32-bit integers.
    """

    def __init__(self, queue: MergeQueue):
        self.queue = queue
        self.words: dict[bytes, Written] = {}
        self.pieces: dict[str, Written] = {}
        self.decimal = {i: str(i) for i in queue.strings}

    def _written(self, ids) -> Written:
        strings, decimal = self.queue.strings, self.decimal
        packed = struct.pack(f"<{len(ids)}i", *ids)
        return len(ids), " ".join([decimal[i] for i in ids]), " ".join([strings[i] for i in ids]), packed

    def _piece(self, piece: str) -> Written:
        made = self.pieces.get(piece)
        if made is None:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            made = self.pieces[piece] = self._written(self.queue.merge(piece))
        return made

    def _word(self, word: bytes) -> Written:
        text = word.decode()
        if self.queue.lead in text:
            made = self._written(self.queue.encode(text))
        else:
            parts = [self._piece(p) for p in self.queue.split_up(text)]
            made = parts[0] if len(parts) == 1 else _side_by_side(parts)
        if len(word) <= LONGEST:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = made
        return made

    def encode(self, text: bytes) -> Written:
        """Number of ids, the decimal ids joined by one space, the decoded text, and the packed ids."""
        known = self.words.get
        return _side_by_side([known(w) or self._word(w) for w in text.split()])


def _side_by_side(parts: list[Written]) -> Written:
    parts = [p for p in parts if p[0]]
    return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]), b"".join([p[3] for p in parts])


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: ``id, n_tokens, ids_sha256, decoded_sha256``, with ``ids=True`` also ``ids`` and ``decoded``.

    ``tokenizer`` is the path of a tokenizer file; the driver reads it and sends its text, of a
    fixed few megabytes, to every executor. Null and empty texts have no ids and decode to
    an empty text. Digests are of the decimal ids joined by one space and of the decoded text.
    Repeated rows and null ids stay as they are; other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [
        T.StructField("id", rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_worker(("merge queue", hash(definition.value)), lambda: WordCache(MergeQueue(definition.value)))
        for batch, texts in portions(batches, "text", 1 << 20):
            made = [cache.encode(t) for t in texts]
            columns = {
                "id": batch.column("id"), "n_tokens": pa.array([m[0] for m in made], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(m[1].encode()).hexdigest() for m in made], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(m[2].encode()).hexdigest() for m in made], pa.string()),
            }
            if ids:
                ends = np.cumsum([0] + [m[0] for m in made]).astype(np.int32)
                packed = pa.array(np.frombuffer(b"".join([m[3] for m in made]), "<i4"))
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), packed)
                columns["decoded"] = pa.array([m[2] for m in made], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, T.StructType(fields))

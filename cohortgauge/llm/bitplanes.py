"""Token ids in files of compressed bit planes.

A file holds the ids of consecutive documents, end ids included, in blocks of a fixed number
of ids. A block is transposed: plane k holds bit (or byte) k of all its ids, and each plane
is compressed by itself with zstandard. High planes are all zero and take no bytes. An index
at the end of the file names every chunk, the plane of a block, and every document:

    magic | chunks | chunk index | document lengths | footer

The footer has the number of blocks, ids and documents and the sizes of the two indexes, so a
reader can fetch any block by ranges.
"""

from __future__ import annotations

import array
import itertools
import json
import re
import struct
import sys
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.llm.mergequeue import byte_letters
from cohortgauge.llm.tables import new_path, per_worker, portions, stored

MAGIC = b"IDPLANE1"
FOOTER = "<QQQQQBI8s"
#: Ids of a block, and the compression level of its planes.
BLOCK, LEVEL = 1 << 16, 3
#: Words after which a worker forgets those whose ids it keeps, pieces it keeps, and text bytes encoded together.
CACHED, PIECES, PORTION = 500_000, 1_000_000, 1 << 20


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of a block of 32-bit ids, lowest first; an empty string for a plane of zeros."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if unit == "byte":
        return [p.tobytes() if p.any() else b"" for p in raw]
    planes = []
    for part in raw:
        if not part.any():
            planes += [b""] * 8
            continue
        for bit in range(8):
            plane = (part >> bit) & 1
            planes.append(np.packbits(plane).tobytes() if plane.any() else b"")
    return planes


def from_planes(planes: list[bytes], count: int, unit: str) -> np.ndarray:
    raw = np.zeros((4, count), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        if unit == "byte":
            raw[k] = np.frombuffer(plane, np.uint8)
        else:
            raw[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count) << (k % 8)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file, as documents are added in order."""

    def __init__(self, out, unit: str, block: int = BLOCK):
        self.out, self.unit, self.block = out, unit, block
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.held, self.sizes, self.lengths, self.ids = [], 0, [], [], 0
        out.write(MAGIC)

    def add(self, ids: np.ndarray, lengths: list[int]) -> None:
        """The ids of several documents in a row, and how many each has."""
        self.lengths += lengths
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            joined = np.concatenate(self.waiting)
            full = len(joined) // self.block * self.block
            for at in range(0, full, self.block):
                self._put(joined[at:at + self.block])
            self.waiting, self.held = [joined[full:]], len(joined) - full

    def _put(self, ids: np.ndarray) -> None:
        for plane in to_planes(ids, self.unit):
            chunk = self.packer.compress(plane) if plane else b""
            self.out.write(chunk)
            self.sizes.append(len(chunk))
        self.ids += len(ids)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        chunks = self.packer.compress(np.asarray(self.sizes, "<u4").tobytes())
        lengths = self.packer.compress(np.asarray(self.lengths, "<u8").tobytes())
        self.out.write(chunks)
        self.out.write(lengths)
        planes = 4 if self.unit == "byte" else 32
        blocks = len(self.sizes) // planes
        self.out.write(struct.pack(FOOTER, blocks, self.ids, len(self.lengths), len(chunks), len(lengths), planes, self.block, MAGIC))


class PlaneReader:
    """Reads a file by ranges: the footer, the indexes, then the blocks asked for."""

    def __init__(self, file):
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        size = file.size()
        if size < struct.calcsize(FOOTER):
            raise ValueError("not an id plane file: too short")
        blocks, self.ids, documents, a, b, self.planes, self.block, magic = struct.unpack(FOOTER, self._range(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not an id plane file: wrong magic")
        tail = self._range(size - struct.calcsize(FOOTER) - a - b, a + b)
        sizes = np.frombuffer(self.unpacker.decompress(tail[:a], max_output_size=4 * blocks * self.planes or 1), "<u4").astype(np.int64)
        self.sizes = sizes.reshape(blocks, self.planes)
        self.starts = len(MAGIC) + np.concatenate([[0], np.cumsum(sizes)])
        self.lengths = np.frombuffer(self.unpacker.decompress(tail[a:], max_output_size=8 * documents or 1), "<u8").astype(np.int64)
        self.unit = "byte" if self.planes == 4 else "bit"

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(size))

    def read_block(self, number: int) -> np.ndarray:
        first = number * self.planes
        data = self._range(self.starts[first], self.starts[first + self.planes] - self.starts[first])
        count = min(self.block, self.ids - number * self.block)
        width = count if self.unit == "byte" else (count + 7) // 8
        planes, at = [], 0
        for size in self.sizes[number].tolist():
            planes.append(self.unpacker.decompress(data[at:at + size], max_output_size=width) if size else b"")
            at += size
        return from_planes(planes, count, self.unit)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn, holding a block at a time beside the document."""
        held, number = np.zeros(0, "<u4"), 0
        for length in self.lengths.tolist():
            parts = [held]
            have = len(held)
            while have < length:
                parts.append(self.read_block(number))
                have += len(parts[-1])
                number += 1
            joined = np.concatenate(parts) if len(parts) > 1 else held
            yield joined[:length]
            held = joined[length:]


def _simple_classes(without: str = "") -> tuple[str, str, str]:
    """Letters, digits and other signs below U+0250, as the insides of character classes.

    Signs of ``without`` are left out. These are plain signs: composing leaves them alone. White space, controls and capitals whose
    lower case is two signs or lies beyond are not among them.
    """
    kinds: dict[str, list[str]] = {"L": [], "N": [], "": []}
    for sign in map(chr, range(0x21, 0x250)):
        kind = unicodedata.category(sign)
        if sign not in without and kind[0] not in "CZ" and len(sign.lower()) == 1 and sign.lower() < "\u0250":
            kinds[kind[0] if kind[0] in "LN" else ""].append(sign)
    letters, digits, others = ("".join(map(re.escape, signs)) for signs in kinds.values())
    return letters, digits, others


class WordIds:
    """Ids of texts from the tokenizer, with the ids of words and of their pieces kept between texts.

    Holds for tokenizers whose splitting never spans ASCII white space and that drop it. A word
    of plain signs is lower-cased and cut into pieces here, where the file says ``SIMPLE``, and
    the library's model gives the ids of a piece; all other words, and those that could hold a
    special token, are encoded whole. Pieces recur far more than words do. The ids of all known
    words lie in one array, from which a text's ids are gathered.
    """

    #: The normalising steps and the splitting pattern for which pieces are cut here.
    STEPS = ("NFC", "Replace", "Lowercase")
    SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spec = json.loads(definition)
        letters, digits, others = _simple_classes()
        lead = "".join({t["content"][:1] for t in spec["added_tokens"]})
        self.simple = re.compile(rf"[{''.join(_simple_classes(lead))}]+" if self._cuts(spec) else r"(?!)").fullmatch
        self.cut = re.compile(rf" |'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^ {letters}{digits}]+")
        self.letters = byte_letters()
        # Packed ids: bytes are no containers, so the garbage collector does not walk through them.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._empty()

    def _cuts(self, spec: dict) -> bool:
        """Whether the file is of the kind whose pieces can be cut here."""
        steps = (spec["normalizer"] or {}).get("normalizers") or []
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers") or []
        if [s["type"] for s in steps] != list(self.STEPS) or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
            return False
        split, level = parts
        return (
            split["pattern"] == {"Regex": self.SIMPLE} and split["behavior"] == "Removed" and split["invert"]
            and not level["add_prefix_space"] and not level["use_regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )

    def _empty(self) -> None:
        # Numbers in the order of looking up: a new word gets the next one without being asked for first.
        self.numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _piece(self, piece: str) -> bytes:
        """Ids of a lower-cased piece. Pieces unused for half of ``PIECES`` new ones are forgotten."""
        found = self.old.get(piece)
        if found is None:
            # Printable ASCII stands for itself among the letters of bytes.
            spelt = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = [t.id for t in self.model.tokenize(spelt)]
            found = array.array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)
        if len(self.young) >= PIECES // 2:
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found

    def _cut_up(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of plain signs."""
        out, ids = [], b""
        for piece in self.cut.findall(" ".join(words).lower() + " "):
            if piece == " ":
                out.append(ids)
                ids = b""
            else:
                ids += self.young.get(piece) or self._piece(piece)
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Ids of the words numbered last, in the order of their numbers."""
        texts = b"\n".join(words).decode().split("\n")
        simple = list(map(self.simple, texts))
        found = self._cut_up([t for t, m in zip(texts, simple, strict=True) if m])
        odd = [t for t, m in zip(texts, simple, strict=True) if not m]
        if odd:
            encoded = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            cut, whole = iter(found), (np.asarray(f.ids, "<u4").tobytes() for f in encoded)
            found = [next(cut) if m else next(whole) for m in simple]
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        self.starts = np.concatenate([self.starts, ends])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        lists = [t.split() for t in texts]
        words = list(itertools.chain.from_iterable(lists))
        if len(self.numbers) > CACHED:
            self._empty()
        known = len(self.numbers)
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > known:
            fresh = list(itertools.islice(reversed(self.numbers), len(self.numbers) - known))
            try:
                self._learn(fresh[::-1])
            except BaseException:
                self._empty()  # a numbered word without ids must not outlive the failure
                raise
        begin = self.starts[number]
        size = self.starts[number + 1] - begin
        ends = np.cumsum(size)
        place = np.repeat(begin - (ends - size), size)
        place += np.arange(len(place))
        bounds = np.cumsum([0] + [len(x) for x in lists])
        total = np.append(0, ends)[bounds]
        return self.ids[place], np.diff(total)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_ids(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, unit: str = "bit", block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every text and write the files; one row per file: ``part, path, first_row, n_docs, n_ids, ids``.

    Texts are cut into ranges by id (nulls first, ties by text) and each range is written in
    order as one file of ``folder``, which executors and driver must share (by default one
    in ``spark.checkpoint.dir``). A lost task writes its file again under a new name; the
    returned rows, which are stored, name the files that count. Null and empty texts are
    documents of the end id alone. ``ids`` has the id column of the file's documents.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ranges = rows.repartitionByRange("id", tie).sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        words = per_worker(("word ids", hash(definition.value)), lambda: WordIds(definition.value))
        store, root = _filesystem(folder)
        writer, ids, part = None, [], None
        for batch, texts in portions(batches, "text", PORTION):
            if writer is None:
                part = batch.column("part")[0].as_py()
                store.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                out = store.open_output_stream(f"{root}/{name}")
                writer = PlaneWriter(out, unit, block)
            found, counts = words.encode(texts)
            writer.add(np.insert(found, np.cumsum(counts), end_id), (counts + 1).tolist())
            ids.append(batch.column("id"))
        if writer is not None:
            writer.close()
            out.close()
            column = pa.chunked_array(ids).combine_chunks()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": pa.array([f"{folder}/{name}"]), "n_docs": pa.array([len(column)], pa.int64()),
                "n_ids": pa.array([writer.ids], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column),
            })

    fields = [
        T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
    ]
    return stored(ranges.mapInArrow(run, T.StructType(fields)), "id-files")


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read the files that ``write_ids`` names: ``id, start, n_tokens, ids_crc32`` per document, in any order.

    ``start`` counts the ids of all documents before it. With ``with_ids=True`` also ``ids``.
    """
    # One row per file: as many as the writing job had partitions.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("before"))
    # Short rows that stand for whole files: with a stated number they are not merged by their own bytes.
    # By path, as the join may have dealt them by part already: Spark drops a second dealing by the same key.
    placed = files.join(starts, "part").select("part", "path", "before", "ids").repartition(max(1, files.count()), "path")
    kind = files.schema["ids"].dataType.elementType
    fields = [
        T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before, ids in zip(*(batch.column(c) for c in ("path", "before", "ids")), strict=True):
                store, name = _filesystem(path.as_py())
                with store.open_input_file(name) as file:
                    reader = PlaneReader(file)
                    at, sums, docs = before.as_py(), [], []
                    for doc in reader.documents():
                        sums.append(zlib.crc32(doc.tobytes()))
                        if with_ids:
                            docs.append(doc.astype(np.int64))
                lengths = reader.lengths
                columns = {
                    "id": ids.values, "start": pa.array(at + np.concatenate([[0], np.cumsum(lengths)[:-1]]), pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(docs, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return placed.mapInArrow(run, T.StructType(fields))

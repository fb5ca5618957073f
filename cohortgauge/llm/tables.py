"""Intermediate tables in the folder all executors share, and small Arrow helpers."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of stored tables for one task and file of a table made of them, and files a core that are written all the same.
FILE_BYTES, FILES_A_CORE = 4 << 20, 3
#: Frees the shuffle files of a finished job, so that a chain of jobs holds one job's files at a time.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    folder = "file://" + tempfile.mkdtemp(prefix="cohortgauge-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def file_count(*tables: DataFrame) -> int:
    """Files for a table that is no larger than the stored ``tables`` it is made of."""
    spark, size = tables[0].sparkSession, 0
    for parent in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(FILES_A_CORE * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))


def stored(df: DataFrame, name: str, *bounds: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and continue from its rows.

    The table cuts the lineage: a lost executor costs a reread, and what was decided
    before the write cannot come out differently afterwards. ``bounds`` names stored tables that
    ``df`` is made of and no larger than: then it has as many files as their bytes ask for, at most,
    and not one for every shuffle partition. A file costs its executor several processes on a local disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if bounds:
        df = df.coalesce(file_count(*bounds))
    with _setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        folder = shared_folder(spark)
        parents = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for parent in parents:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            root = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(root.toUri().getPath() + "/"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with as many underscores as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside ``columns``, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The columns that ``packed`` put away, in their order, and ``more``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in names], *more)


def task_count(spark: SparkSession) -> int:
    """Partitions for rows that cost more than their bytes say: a stated number is not merged by bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``budget`` bytes; a longer text stands alone."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > budget:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def portions(batches: Iterator[pa.RecordBatch], text: str, budget: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``budget`` text bytes, and those texts (null: empty)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for begin, end in pieces(sizes, budget):
            part = batch.slice(begin, end - begin)
            yield part, [t or b"" for t in raw_bytes(part.column(text))]
        pa.default_memory_pool().release_unused()


def slices(budget: int, text: str, work: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch | None]):
    """An Arrow mapper that hands ``work`` portions of about ``budget`` text bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches, text, budget):
            made = work(part, texts)
            if made is not None and made.num_rows:
                yield made

    return run


def per_worker(key, make: Callable[[], object]) -> object:
    """What ``make`` returns, once for each Python worker process and not once for each task.

    Functions are shipped by value and forget their module's variables with the task, so the
    object is kept under a module name of its own.
    """
    kept = sys.modules.setdefault("_cohortgauge_worker", types.ModuleType("_cohortgauge_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]

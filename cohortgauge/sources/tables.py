"""File scans with the schema stated, never inferred, and sinks for reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(RuntimeError):
    """A source file is missing or does not have the expected shape."""


def _loaded(read, path) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise SourceError(f"there is no file {path}, which this site is read from") from error
        raise


def read_csv(spark: SparkSession, *paths, multiline: bool = False) -> DataFrame:
    """Union of CSV files with a header; every column arrives as a string.

    Loaders cast the columns they use with ``try_cast``. ``multiline`` is needed only
    where quoted text contains line breaks, because such files cannot be split.
    """
    frames = []
    for path in paths:
        reader = (
            spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        )
        frames.append(_loaded(lambda r=reader, p=path: r.csv(str(p)), path))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def scan_union(*frames: DataFrame) -> DataFrame:
    """Rows of several record files as one; a column absent from one file is missing there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def record_report(lines: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Per ``keys``: lines, blank lines, lines that hold no JSON object, and up to three of those.

    The examples are the smallest, the largest and the one of the smallest digest, so that the
    aggregate stays as small as three lines whatever breaks. Missing lines count as blank.
    """
    line = F.col(column)
    blank = F.coalesce(F.trim(line) == "", F.lit(True))
    bad = F.when(~blank & F.json_object_keys(line).isNull(), line)
    return lines.select(*keys, blank.alias("_blank"), bad.alias("_bad")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("_blank").alias("n_blank"), F.count("_bad").alias("n_broken"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(F.min("_bad"), F.max("_bad"), F.min_by("_bad", F.md5("_bad")))))).alias("examples"),
    )


def field_report(lines: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Per ``keys`` and top-level JSON key: the lines that hold it. Broken lines hold none."""
    named = lines.select(*keys, F.explode(F.array_distinct(F.json_object_keys(column))).alias("field"))
    return named.groupBy(*keys, "field").agg(F.count(F.lit(1)).alias("n_lines"))


def read_label_jsonl(spark: SparkSession, path, labels: list[str], key: str = "path_to_image",
                     site: str = "") -> DataFrame:
    """One JSON object per line: the image path and one nullable value per label.

    A broken line raises, with their number and examples; blank lines are passed over.
    """
    lines = _loaded(lambda: spark.read.text(str(path)), path)
    name = Path(path).name
    report = record_report(lines, []).first()
    if report["n_broken"]:
        shown = [e[:80] for e in report["examples"]]
        raise SourceError(f"{site}: {report['n_broken']:,} of {report['n_lines']:,} lines of {name} hold no record, such as {shown}")
    # One row as wide as the configuration; the keys of the file are never gathered.
    held = F.json_object_keys("value")
    found = lines.agg(*[F.coalesce(F.bool_or(F.array_contains(held, n)), F.lit(False)).alias(n) for n in (key, *labels)]).first().asDict()
    if not found[key]:
        raise SourceError(f"{site}: label file {name} has no {key!r} key")
    require_labels([n for n in labels if found[n]], labels, site)
    schema = T.StructType(
        [T.StructField(key, T.StringType()), *[T.StructField(name, T.DoubleType()) for name in labels]]
    )
    return spark.read.schema(schema).json(str(path))


def require_columns(columns, needed, site: str, what: str) -> None:
    absent = [c for c in needed if c not in columns]
    if absent:
        raise SourceError(f"{site}: {what} has no column {absent}; it has {sorted(columns)}")


def require_labels(columns, labels: list[str], site: str) -> None:
    """Every configured observation must be there; the schema is never narrowed silently."""
    absent = [name for name in labels if name not in columns]
    if absent:
        raise SourceError(f"{site}: no values for the labels {absent} of its observation schema")


def require_unique(df: DataFrame, keys: list[str], site: str, what: str) -> None:
    """The right side of a many-to-one join may hold each key once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise SourceError(f"{site}: {what} holds key {tuple(repeated[0][k] for k in keys)} more than once")


def read_manifest(spark: SparkSession, path) -> DataFrame:
    """Held image names, one per line."""
    from cohortgauge.operators.cohort import manifest_lines

    return manifest_lines(_loaded(lambda: spark.read.text(str(path)), path))


def write_parquet(df: DataFrame, path, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(str(path))


def write_csv(df: DataFrame, path) -> None:
    """Reports only: tables whose size follows the configuration, not the data."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(str(path))


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system behind ``path``, and the path as it knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document, on whatever storage the path names."""
    fs, target = filesystem(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def markdown_table(df: DataFrame, columns: list[str] | None = None, digits: int = 4, page: int = 500, stored_as: str = "") -> str:
    """A result table as markdown; one of more than ``page`` rows is named instead of shown."""
    shown = [c for c in (columns or df.columns) if c in df.columns]
    rows = df.select(*[F.col(f"`{c}`") for c in shown]).limit(page + 1).collect() if shown else []
    if not rows:
        return "_(none)_"
    if len(rows) > page:
        return f"{df.count():,} rows, stored as `{stored_as or 'a table of its own'}`"

    def text(value):
        return str(round(value, digits)) if isinstance(value, float) else str(value)

    lines = ["| " + " | ".join(shown) + " |", "|" + "|".join(["---"] * len(shown)) + "|"]
    lines += ["| " + " | ".join(text(v) for v in row) + " |" for row in rows]
    return "\n".join(lines)


def counted(df: DataFrame, column: str, examples: int = 3) -> tuple[int, list[str]]:
    """How many rows there are, and the first few values of a column: what a message needs of them."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.min_by(column, F.xxhash64(column)).alias("one")).first()
    return row["n"], sorted({str(v) for v in (row["low"], row["one"], row["high"]) if v is not None})[:examples]

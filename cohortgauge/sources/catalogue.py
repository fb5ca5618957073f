"""Artifacts of a study: named by what they were made from, published whole or not at all.

A *place* is one artifact under one stage hash. Each write goes to a new version below it, and
an empty file named after the version publishes it once the data are complete:

    root/section/artifact-site=X-<hash>.parquet/<version>/...        the data
    root/section/artifact-site=X-<hash>.parquet/_published/<version> says that they count

Creating an empty file is one step on every storage, so a reader sees the version before or the
new one; a write that was killed leaves data no reader is led to. Nothing is renamed or replaced.
The schema is kept beside the data, so opening a table starts no job.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortgauge.sources.tables import SourceError, filesystem, write_csv, write_parquet, write_text

PUBLISHED, SCHEMA = "_published", "_schema"


class Catalogue:
    """The artifacts below one folder or URI that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def place(self, section: str, artifact: str, stamp: str, kind: str = "parquet", **facets) -> str:
        """Where an artifact lives. Facets (site, arm, inputs, ...) tell variants apart; one of None says nothing."""
        told = [f"{name}={value}" for name, value in sorted(facets.items()) if value is not None]
        return f"{self.root}/{section}/{'-'.join([artifact, *told, stamp])}.{kind}"

    def _names(self, folder: str) -> list[str]:
        fs, target = filesystem(self.spark, folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def versions(self, place: str) -> list[str]:
        """Published versions, oldest first."""
        return self._names(f"{place}/{PUBLISHED}")

    def current(self, place: str) -> str | None:
        """The newest published version's path, or None."""
        found = self.versions(place)
        return f"{place}/{found[-1]}" if found else None

    def publish(self, place: str, write: Callable[[str], None]) -> str:
        """Let ``write`` fill a new version, then publish it; an error or a kill publishes nothing.

        Versions sort by the time they were begun; of two at once, both are whole and one counts.
        """
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        path = f"{place}/{version}"
        write(path)
        fs, mark = filesystem(self.spark, f"{place}/{PUBLISHED}/{version}")
        fs.createNewFile(mark)
        return path

    def put(self, df: DataFrame, place: str, partition_by: list[str] | None = None) -> DataFrame:
        """Publish a table and return it as stored. The place's kind decides the format; CSV is for small reports."""
        def write(path: str) -> None:
            if place.endswith(".csv"):
                write_csv(df, path)
            else:
                write_parquet(df, path, partition_by)
                write_text(self.spark, f"{path}{SCHEMA}", df.schema.json())

        self.publish(place, write)
        return self.read(place)

    def put_text(self, text: str, place: str) -> str:
        return self.publish(place, lambda path: write_text(self.spark, path, text))

    def _text(self, path: str) -> str:
        fs, target = filesystem(self.spark, path)
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def get_text(self, place: str) -> str:
        return self._text(self._published(place))

    def _published(self, place: str) -> str:
        path = self.current(place)
        if path is None:
            raise SourceError(f"nothing is published at {place}")
        return path

    def read(self, place: str) -> DataFrame:
        """The published table. CSV columns come back as strings."""
        path = self._published(place)
        if place.endswith(".csv"):
            return self.spark.read.option("header", True).csv(path)
        schema = T.StructType.fromJson(json.loads(self._text(path + SCHEMA)))
        return self.spark.read.schema(schema).parquet(path)

    # ---- stages
    def _stage(self, name: str, stamp: str) -> str:
        return f"{self.root}/_stages/{name}-{stamp}"

    def finish(self, name: str, stamp: str) -> None:
        """Record that every artifact of a stage is published."""
        fs, target = filesystem(self.spark, self._stage(name, stamp))
        fs.createNewFile(target)

    def finished(self, name: str, stamp: str) -> bool:
        fs, target = filesystem(self.spark, self._stage(name, stamp))
        return fs.exists(target)

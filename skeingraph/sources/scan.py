"""Source files of a repository as a DataFrame, by a Python data source.

Spark's own file index drops names that begin with `_` or `.` and empty files, and rounds times, so
the listing is our own: partitions are the top-level entries of the tree, walked on the executors.
Contents are read where they are needed, after filters.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skeingraph.runtime import map_columns, ship
from skeingraph.sources.languages import SKIPPED, language_of

SCHEMA = "file_path string, size bigint, mtime_ns bigint"


class Entry(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


def walk(root: str, name: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime_ns) of the source files at or below a top-level entry. Links to folders
    aren't followed; links to files count if they stay inside the root."""
    real = os.path.realpath(root)
    pending = [name]
    while pending:
        rel = pending.pop()
        if rel.rsplit("/", 1)[-1] in SKIPPED:
            continue
        full = os.path.join(root, rel)
        if os.path.isdir(full):
            if not os.path.islink(full):
                try:
                    pending.extend(f"{rel}/{x}" for x in os.listdir(full))
                except OSError:
                    pass
            continue
        if language_of(rel) is None or not os.path.isfile(full):
            continue
        target = os.path.realpath(full)
        if target.startswith(real.rstrip(os.sep) + os.sep):
            stat = os.stat(full)
            yield rel, stat.st_size, stat.st_mtime_ns


class RepoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.listdir(self.root))
        n = min(len(names), 64) or 1
        return [Entry(names[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in partition.names:
            yield from walk(self.root, name)


class RepoSource(DataSource):
    """spark.read.format("source_files").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RepoReader(self.options)


def files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, size, mtime_ns) of all source files below root."""
    ship(spark)
    spark.dataSource.register(RepoSource)
    return spark.read.format("source_files").load(root)


def with_content(rows: DataFrame, root: str) -> DataFrame:
    """Adds content (bytes; null if the file has gone) to rows with file_path."""
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    at = rows.columns.index("file_path")

    def read(path: str) -> bytes | None:
        try:
            with open(os.path.join(root, path), "rb") as f:
                return f.read()
        except OSError:
            return None

    def run(*columns):
        return *columns, [read(p) for p in columns[at]]

    return map_columns(rows, schema, lambda: run, rows=32)

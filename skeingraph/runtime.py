"""What every operator needs from the session: shipping this package to executors,
a shared folder for intermediate tables, and a column-wise wrapper of mapInArrow."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no spark.checkpoint.dir and runs on one host (tests, notebooks).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/skeingraph"

#: Steps in which at_ranks counts.
BINS = 4096
#: Removes the shuffle files of a query when it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, over Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_skeingraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._skeingraph_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, our own
    if all run on this host, and an error on a cluster, whose hosts would not see each other's files."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return context.getCheckpointDir()


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """A folder that has been written goes when the driver's JVM ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def stored(df: DataFrame, compact: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and any executor can reread it.
    compact: written smaller, and the shuffle files that made it go at once."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"t-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP)
    try:
        if compact:
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        df.write.parquet(path, compression="zstd" if compact else None)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What a task has freed goes back to the system, as Python workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_columns(df: DataFrame, schema: T.StructType, start: Callable[[], Callable], rows: int = 256) -> DataFrame:
    """mapInArrow in slices of `rows` rows: start() is called once per task and returns a
    function from the input columns (lists) to the output columns (lists, any length)."""
    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        f = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                out = f(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)
        f = batch = part = out = None
        give_back()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable], rows: int = 256) -> DataFrame:
    """The rows of df, with all its columns, for which the function that start() returns says
    True; it gets the named columns as lists. Column names that clash elsewhere don't matter here."""
    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                yield part.filter(pa.array(f(*(part.column(c).to_pylist() for c in columns)), pa.bool_()))
        f = batch = part = None
        give_back()

    return df.mapInArrow(run, df.schema)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that the scan reads no others."""
    return df.select(*(df[n] for n in names))


def at_ranks(values: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values that stand at these ranks (from 0) of a sorted column of numbers, exactly: counts in
    equal steps between the least and the greatest value tell in which step a rank lies, and that step is
    counted again until it holds one value. The driver gets a row for each of `BINS` steps at a time."""
    out = []
    for rank in ranks:
        low, high = values.agg(F.min(column), F.max(column)).first()
        part = values
        while low < high:
            step = F.least(F.floor((F.col(column) - low) / (high - low) * BINS), F.lit(BINS - 1))
            found = part.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
            for r in sorted(found, key=lambda r: r["step"]):
                if rank < r["n"]:
                    break
                rank -= r["n"]
            low, high = r["low"], r["high"]
            part = part.where(F.col(column).between(low, high))
        out.append(low)
    return out


def quantile(values: DataFrame, column: str, share: float) -> float:
    """The quantile of a column of numbers, between two ranks in proportion; 0 if there is no row."""
    values = stored(values.select(column))
    n = values.count()
    if not n:
        return 0.0
    at = (n - 1) * share
    low, high = at_ranks(values, column, [int(at), min(int(at) + 1, n - 1)])
    return float(low + (high - low) * (at - int(at)))

"""Helpers shared by the training-data operators: shared storage, Arrow row mapping, hashing samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that share a fixed sample are picked by this many hash slots.
SLOTS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see. Only an unset setting is filled in, and only where driver and
    executors are one machine (tests)."""
    base = spark.conf.get(CHECKPOINT, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"on a cluster {CHECKPOINT} must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(CHECKPOINT, base)
    return base.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark/{kind}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return path


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut lineage with a table in the shared folder; it outlives any executor. The shuffle files of the plan that
    wrote it are of no further use and go at once."""
    spark = df.sparkSession
    path = scratch(spark, kind)
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Remove a table of written() that nothing will read again."""
    path = None if df is None else df.__dict__.get("_scratch")
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(path: str):
    """(pyarrow filesystem, path in it) for a local path or any URI pyarrow can open."""
    from pyarrow import fs

    if "://" in path or urlparse(path).scheme in ("file", "hdfs", "s3", "gs"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


Columns = dict[str, list]


def arrow_rows(df: DataFrame, fn: Callable[[Iterator[Columns]], Iterable[Columns]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow for functions over columns of Python values.

    fn takes an iterator of batches and yields batches, each a dict of equally long lists. Give it only the
    columns it reads: all of them become Python values.
    """
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[Columns]:
            for b in batches:
                yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for cols in fn(read()):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def filtered(df: DataFrame, fn: Callable[[list], list[bool]], col: str) -> DataFrame:
    """The rows whose value of col fn keeps; the other columns stay in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(fn(b.column(b.schema.get_field_index(col)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def per_row(fn: Callable[..., tuple], names: list[str], keep: list[str]) -> Callable:
    """Lift fn(value of the last column) -> tuple of the named results to batches; keep passes through."""

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            last = list(b)[-1]
            rows = [fn(v) for v in b[last]]
            yield {k: b[k] for k in keep} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return run


def fold(col: str, n: int):
    """crc32 of a column as text, modulo n; null for null."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def slot(*cols):
    """A stable slot in [0, SLOTS) for a row."""
    return F.pmod(F.xxhash64(*cols), F.lit(SLOTS))

"""Append-only time-series tables: control plane on the driver, data plane in DataFrames."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import shutil
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import (
    AlreadyExistsError, AmbiguousCommitError, ConflictError, CoverageOverlapError, EmptySourceError, MissingCoverageError, OptimizeError, RollbackError, SchemaMismatchError,
    SegmentError, StorageError, TidemarkError,
)
from .functions.buckets import micros, ordinal
from .model import FORMAT_VERSION, IndexSpec, OptimizeReport, SegmentMeta, TableState
from .operators import coverage as C
from .sources import schema as S
from .sources.log import COVERAGE, DATA, Log, local_root

log = logging.getLogger("tidemark")
#: Input bytes of one segment of a DataFrame, about; Arrow sources make one segment.
SEGMENT_BYTES = 256 << 20
#: Bytes and rows of Arrow batches that are held before they are written as a row group.
HELD_BYTES, HELD_ROWS = 64 << 20, 1 << 20
#: Coverage sidecars since the last snapshot at which an append writes a new one.
COMPACT = 16
#: Sidecars of overlapping segments up to which an append reads these instead of the whole coverage.
FEW = 64


class Undo:
    """Removals to be done if the block fails; what can't be removed is told with the first error."""

    def __init__(self) -> None:
        self.steps: list[tuple[Callable, tuple]] = []

    def add(self, fn: Callable, *args: Any) -> None:
        self.steps.append((fn, args))

    def file(self, path: Path) -> None:
        self.add(lambda: path.unlink(missing_ok=True))

    def tree(self, path: Path) -> None:
        self.add(lambda: shutil.rmtree(path) if path.exists() else None)

    def done(self) -> None:
        self.steps.clear()

    def __enter__(self) -> Undo:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        failures = []
        for fn, args in reversed(self.steps):
            try:
                fn(*args)
            except OSError as e:
                failures.append(e)
        if failures and error is not None:
            raise RollbackError(error, failures) from error


class ArrowSource:
    """Arrow batches of one schema, taken one at a time."""

    def __init__(self, schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> None:
        self.schema, self.batches = schema, batches

    @classmethod
    def of(cls, source: Any) -> ArrowSource:
        if isinstance(source, pa.RecordBatch):
            return cls(source.schema, [source])
        if isinstance(source, (list, tuple)):
            if not source:
                raise EmptySourceError("the source holds no batch")
            return cls(source[0].schema, source)
        if isinstance(source, pa.Table):
            return cls(source.schema, source.to_batches())
        if not isinstance(source, pa.RecordBatchReader):
            if not hasattr(source, "__arrow_c_stream__"):
                raise TypeError(f"{type(source).__name__} is neither a DataFrame nor Arrow data")
            source = pa.RecordBatchReader.from_stream(source)
        return cls(source.schema, source)

    def write(self, path: Path, casts: list[tuple[str, str | None]], rows_per_group: int | None) -> int:
        """Write a Parquet file in the planned order and types; at most one row group and one batch are held."""
        target, rows, held, size, names = S.arrow_schema(self.schema, casts), 0, [], 0, [n for n, _ in casts]
        with pq.ParquetWriter(path, target) as out:

            def flush() -> None:
                if held:
                    out.write_table(pa.Table.from_batches(held, schema=target), row_group_size=rows_per_group)
                    held.clear()

            for b in self.batches:
                if not b.schema.equals(self.schema):
                    raise SchemaMismatchError("batches differ in schema")
                if not b.num_rows:
                    continue
                part = pa.Table.from_batches([b]).select(names).cast(target)
                held += part.to_batches()
                rows, size = rows + b.num_rows, size + part.nbytes
                if size >= HELD_BYTES or sum(h.num_rows for h in held) >= (rows_per_group or HELD_ROWS):
                    flush()
                    size = 0
            flush()
        return rows


class TimeSeriesTable:
    """A handle: log, state as of a version, and index specification."""

    def __init__(self, spark: SparkSession, root: Path, state: TableState) -> None:
        self.spark, self._root, self.state, self._log = spark, root, state, Log(root)

    # lifecycle
    @classmethod
    def create(cls, spark: SparkSession, location: str | os.PathLike, spec: IndexSpec, schema: pa.Schema | T.StructType | None = None) -> TimeSeriesTable:
        root = local_root(location)
        fields = None if schema is None else S.from_arrow(schema) if isinstance(schema, pa.Schema) else S.from_spark(schema)
        if fields is not None:
            S.check_index(spec, fields)
        created = datetime.now(timezone.utc).isoformat()
        try:
            Log(root).commit(0, [cls._definition(spec, fields, created)])
        except ConflictError as e:
            raise AlreadyExistsError(f"there is a table at {root}") from e
        (root / DATA).mkdir(exist_ok=True)
        return cls.open(spark, location)

    @classmethod
    def open(cls, spark: SparkSession, location: str | os.PathLike) -> TimeSeriesTable:
        root = local_root(location)
        if not root.is_dir():
            raise StorageError(f"no table at {root}")
        return cls(spark, root, Log(root).replay())

    @staticmethod
    def _definition(spec: IndexSpec, fields: list[dict] | None, created: str) -> dict:
        return {"table": {"format": FORMAT_VERSION, "kind": "time_series", "index": spec.to_json(), "schema": fields, "created_at": created}}

    def refresh(self) -> bool:
        """Whether a newer version was loaded."""
        if self._log.version() == self.state.version:
            return False
        self.state = self._log.replay(since=self.state)
        return True

    root = property(lambda self: str(self._root))
    version = property(lambda self: self.state.version)
    index_spec = property(lambda self: self.state.spec)
    schema = property(lambda self: self.state.schema)

    def current_version(self) -> int:
        return self._log.version()

    def load_latest_state(self) -> TableState:
        return self._log.replay()

    # reading
    def paths(self, segments: Iterable[SegmentMeta]) -> list[str]:
        return [str(self._root / s.path) for s in segments]

    def spark_schema(self) -> T.StructType:
        """Spark's types of the columns, told from the log alone."""
        if self.state.schema is None:
            raise TidemarkError("the table has no schema before its first append")
        return S.spark_schema(self.state.schema)

    def zone(self) -> str:
        return S.zone_of(self.state.schema, self.state.spec)

    def read(self, segments: list[SegmentMeta] | None = None) -> DataFrame:
        """Rows of the given segments, else of all live ones. No other file is touched, and no footer on the driver."""
        kept, schema = self.state.ordered() if segments is None else segments, self.spark_schema()
        if not kept:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self.paths(kept))

    def candidates(self, start: Any, end: Any, identity: tuple | None = None) -> list[SegmentMeta]:
        """Segments that may hold rows of the half-open range, by (low, high, path)."""
        spec = self.state.spec
        spec.range_ordinals(start, end)
        s, e = spec.unit_value(start), spec.unit_value(end)
        return [x for x in self.state.ordered() if x.high >= s and x.low < e and (identity is None or x.layout != "single" or x.identity == identity)]

    def identity(self, entity: Any) -> tuple | None:
        """Ordered identity of named components, checked against the columns' types."""
        spec = self.state.spec
        types = {f["name"]: S.base_type(f["type"]) for f in self.state.schema or ()}
        return spec.identity(entity, types if all(c in types for c in spec.entities) else None)

    def _only(self, df: DataFrame, identity: tuple | None) -> DataFrame:
        for c, v in zip(self.state.spec.entities, identity or ()):
            df = df.where(F.col(f"`{c}`") == F.lit(v).cast(df.schema[c].dataType))
        return df

    def scan(self, start: Any, end: Any, entity: Any = None) -> DataFrame:
        """Rows with start <= index < end, lazily; rows without index value never match."""
        spec = self.state.spec
        identity = self.identity(entity) if entity is not None else None
        df = self.read(self.candidates(start, end, identity))
        unit = F.col(f"`{spec.column}`")
        if spec.kind == "timestamp":
            kind = df.schema[spec.column].dataType
            bound = lambda v: F.timestamp_micros(F.lit(spec.unit_value(v))).cast(kind)
        else:
            bound = lambda v: F.lit(str(v)).cast(df.schema[spec.column].dataType)
        return self._only(df.where((unit >= bound(start)) & (unit < bound(end))), identity)

    scan_range = scan

    # appending
    def append(self, source: Any, max_segments: int | None = None, rows_per_group: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Write the source as new segments and commit them; returns the version. Nothing stays on failure.

        A DataFrame is written by as many tasks as its size asks for, or at most max_segments; Arrow data is
        streamed into one segment. batch (stream, id) makes the append one that happens once: an id that the
        stream has committed already is left out.
        """
        if rows_per_group is not None and rows_per_group <= 0:
            raise ValueError("rows_per_group must be positive")
        if batch is not None and self.state.batches.get(batch[0], -1) >= batch[1]:
            return self.version
        if isinstance(source, DataFrame):
            fields = S.from_spark(source.schema)
            write = lambda casts, undo: self._write(source, casts, max_segments, rows_per_group, undo)
        else:
            arrow = ArrowSource.of(source)
            fields = S.from_arrow(arrow.schema)
            write = lambda casts, undo: self._stream(arrow, casts, rows_per_group, undo)
        return self._append(write, fields, batch)

    def append_parquet(self, path: str | os.PathLike, max_segments: int | None = None, rows_per_group: int | None = None) -> int:
        try:
            found = pq.read_schema(os.fspath(path)).remove_metadata()
        except (OSError, pa.ArrowInvalid) as e:
            raise StorageError(f"{path} can't be read as Parquet: {e}") from e
        df = self.spark.read.parquet(os.fspath(path))
        return self._append(lambda casts, undo: self._write(df, casts, max_segments, rows_per_group, undo), S.from_arrow(found), None)

    def _append(self, write: Callable, fields: list[dict], batch: tuple[str, int] | None) -> int:
        spec, stored, expected = self.state.spec, self.state.schema, self.state.version
        log.info("append to version %d", expected)
        actions: list[dict] = []
        if stored is None:
            S.check_index(spec, fields)
            widened = {"int8": "int32", "int16": "int32", "uint8": "uint64", "uint16": "uint64", "uint32": "uint64"}
            stored = [f | {"type": spec.kind if f["name"] == spec.column and spec.kind != "timestamp" else widened.get(f["type"], f["type"])} for f in fields]
            actions.append(self._definition(spec, stored, self.state.created_at))
        with Undo() as undo:
            files = write(S.plan(stored, fields), undo)
            segments = self._inspect(files, stored, undo)
            self._reject_overlap(segments)
            actions += [{"add": s.to_json()} for s in segments]
            if len(self.state.pending) + 1 >= COMPACT:
                fresh = self._sidecars([segments[0].coverage], stored)
                runs = fresh if not self.state.segments else C.merged(self._coverage().unionByName(fresh), list(spec.entities))
                actions.append({"coverage": {"path": self._keep(runs, undo)}})
            if batch is not None:
                actions.append({"batch": {"stream": batch[0], "id": batch[1]}})
            self._commit(expected, actions, undo)
        return self.state.version

    def _commit(self, expected: int, actions: list[dict], undo: Undo) -> None:
        try:
            self._log.commit(expected, actions)
        except AmbiguousCommitError:
            undo.done()  # the commit may stand, and then the files belong to it
            raise
        undo.done()
        self.state = self._log.replay(since=self.state)
        self._log.keep(self.state)

    def _stream(self, source: ArrowSource, casts: list[tuple[str, str | None]], rows_per_group: int | None, undo: Undo) -> list[str]:
        name = f"{DATA}/{uuid.uuid4().hex}.parquet"
        part = self._root / DATA / f".{uuid.uuid4().hex}"
        undo.file(part)
        rows = source.write(part, casts, rows_per_group)
        if not rows:
            raise EmptySourceError("the source holds no row")
        undo.file(self._root / name)
        os.replace(part, self._root / name)
        return [name]

    def _write(self, df: DataFrame, casts: list[tuple[str, str | None]], max_segments: int | None, rows_per_group: int | None, undo: Undo) -> list[str]:
        df = df.select(*(F.col(f"`{n}`").cast(S.spark_type(t)).alias(n) if t else F.col(f"`{n}`") for n, t in casts))
        staging = self._root / DATA / f".staging-{uuid.uuid4().hex}"
        undo.tree(staging)
        most = max_segments or -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SEGMENT_BYTES)
        # fewer tasks than the source has only where it is too small for them
        writer = (df.coalesce(max(1, most)) if most < 100_000 else df).write
        if rows_per_group:
            writer = writer.option("parquet.block.row.count.limit", rows_per_group)
        writer.parquet(str(staging))
        return self._placed(sorted(staging.glob("part-*.parquet")), staging, undo)

    def _placed(self, parts: list[Path], staging: Path, undo: Undo) -> list[str]:
        """Move written files to their names in the table."""
        files = []
        for part in parts:
            name = f"{DATA}/{uuid.uuid4().hex}.parquet"
            undo.file(self._root / name)
            os.replace(part, self._root / name)
            files.append(name)
        shutil.rmtree(staging, ignore_errors=True)
        return files

    def _unit(self) -> Column:
        spec = self.state.spec
        at = F.col(f"`{spec.column}`")
        return micros(at) if spec.kind == "timestamp" else at.cast("decimal(20,0)") if spec.kind == "uint64" else at.cast("bigint")

    def _inspect(self, files: list[str], stored: list[dict], undo: Undo) -> list[SegmentMeta]:
        """Metadata of written files. One pass over index and entity columns makes the coverage sidecar, which
        holds the runs of every file and identity with their rows and bounds; all else is told from it."""
        spec = self.state.spec
        if not files:
            raise EmptySourceError("the source holds no row")
        keys, own = list(spec.entities), ["file", *spec.entities]
        wanted = [f for f in stored if f["name"] in (*keys, spec.column)]
        data = self.spark.read.schema(S.spark_schema(wanted)).parquet(*(str(self._root / f) for f in files))
        cells = data.select(F.col("_metadata.file_name").alias("file"), *keys, ordinal(spec).alias("bucket"), self._unit().alias("unit"))
        cells = cells.groupBy(*own, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("low"), F.max("unit").alias("high"))
        runs = C.runs(cells, own, {"n": F.sum, "low": F.min, "high": F.max})
        sidecar = self._keep(runs, undo)
        held = self.spark.read.schema(runs.schema).parquet(str(self._root / sidecar))
        ents = F.struct(*keys) if keys else F.lit(None)
        blank = F.max(F.lit(False) if not keys else F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x))
        found = held.groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), blank.alias("blank"), F.max(F.col("first").isNull()).alias("loose"), F.min(ents).alias("least"), F.max(ents).alias("most")).collect()
        by_name = {r["file"]: r for r in found}
        out = []
        for f in files:
            r = by_name.get(Path(f).name)
            if r is None:  # an empty part of a larger append
                (self._root / f).unlink(missing_ok=True)
                continue
            if r["blank"]:
                raise SegmentError("entity values may not be null")
            if r["low"] is None:
                raise SegmentError("a segment needs at least one index value")
            layout, identity = "none", None
            if keys:
                least, most = tuple(r["least"]), tuple(r["most"])
                layout, identity = ("single", tuple(int(v) if not isinstance(v, str) else v for v in least)) if least == most else ("mixed", None)
            out.append(SegmentMeta(f, int(r["low"]), int(r["high"]), r["n"], (self._root / f).stat().st_size, layout, identity, sidecar))
        if not out:
            raise EmptySourceError("the source holds no row")
        if keys and any(r["loose"] for r in found):
            bare = held.groupBy(*keys).agg(F.max("first").alias("first")).where("first is null")
            if not bare.isEmpty():
                raise SegmentError("an entity has no index value")
        return out

    # coverage
    def _keep(self, runs: DataFrame, undo: Undo) -> str:
        """Write a sidecar of runs, named by its content; returns its path in the table."""
        part = self._root / COVERAGE / f".{uuid.uuid4().hex}"
        undo.tree(part)
        runs.write.parquet(str(part))
        name = f"{COVERAGE}/{self.content_id(part)}-{uuid.uuid4().hex[:8]}"
        undo.tree(self._root / name)
        os.replace(part, self._root / name)
        return name

    def content_id(self, sidecar: Path) -> str:
        """Hash of what a sidecar holds, under this index; the end of its name tells attempts apart."""
        h = hashlib.blake2b(b"tidemark-coverage\0" + json.dumps(self.state.spec.to_json(), sort_keys=True).encode(), digest_size=16)
        for f in sorted(sidecar.glob("*.parquet"), key=lambda p: p.name.split("-")[1]):
            with f.open("rb") as body:
                while block := body.read(1 << 20):
                    h.update(block)
        return h.hexdigest()

    def intact(self, sidecar: str) -> bool:
        """Whether a sidecar still holds what its name says."""
        return Path(sidecar).name.startswith(self.content_id(self._root / sidecar) + "-")

    def _readable(self, sidecar: str) -> bool:
        """Whether a sidecar is there and its footers hold the columns of runs."""
        parts = list((self._root / sidecar).glob("*.parquet"))
        try:
            return bool(parts) and all({*self.state.spec.entities, "first", "last"} <= set(pq.read_schema(p).names) for p in parts)
        except (OSError, pa.ArrowInvalid):
            return False

    def _sidecars(self, names: list[str], stored: list[dict] | None = None) -> DataFrame:
        """(entities..., first, last) of sidecars and snapshots."""
        spec, fields = self.state.spec, S.spark_schema(stored or self.state.schema)
        kind = T.DecimalType(20, 0) if spec.kind == "uint64" else T.LongType()
        schema = T.StructType([*(fields[k] for k in spec.entities), T.StructField("first", kind), T.StructField("last", kind)])
        return self.spark.read.schema(schema).parquet(*(str(self._root / n) for n in names)).where("first is not null")

    def _coverage(self) -> DataFrame | None:
        """Runs of the whole table: the last snapshot and the sidecars since. A lost snapshot is made up for by
        the live segments' sidecars, a lost sidecar by the segments it is of."""
        state = self.state
        if not state.segments:
            return None
        if bare := [s.path for s in state.segments.values() if s.coverage is None]:
            raise MissingCoverageError(f"segment {bare[0]} names no coverage")
        names = list(dict.fromkeys(([state.coverage] if state.coverage else []) + state.pending))
        lost = [n for n in names if not self._readable(n)]
        if state.coverage in lost:
            log.warning("coverage snapshot of version %d is unreadable; using the segments' sidecars", state.version)
            names = list(dict.fromkeys(s.coverage for s in state.ordered()))
            lost = [n for n in names if not self._readable(n)]
        parts = []
        if kept := [n for n in names if n not in lost]:
            parts.append(self._sidecars(kept))
        if lost:
            # a sidecar whose segments were rewritten since is made up for by the rewrites' sidecars
            log.warning("%d coverage sidecar(s) of version %d are unreadable; computing them from the segments", len(lost), state.version)
            again = [s for s in state.ordered() if s.coverage in lost] or ([] if set(kept) >= {s.coverage for s in state.segments.values()} else state.ordered())
            if again:
                parts.append(C.runs(C.coverage(self.read(again), state.spec), list(state.spec.entities)))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return found if len(names) == 1 and names == [state.coverage] else C.merged(found, list(state.spec.entities))

    def _reject_overlap(self, fresh: list[SegmentMeta]) -> None:
        """Fail if a live segment covers a bucket of the fresh ones. Segments are chosen by the log's bounds, so
        rows that come in order of their index are compared with nothing."""
        spec, keys = self.state.spec, list(self.state.spec.entities)
        low, high = (spec.ordinal(v) for v in (min(s.low for s in fresh), max(s.high for s in fresh)))
        identities = None if any(s.layout != "single" for s in fresh) else {s.identity for s in fresh}
        near = [s for s in self.state.ordered() if spec.ordinal(s.high) >= low and spec.ordinal(s.low) <= high and (identities is None or s.layout != "single" or s.identity in identities)]
        if not near:
            return
        names = list(dict.fromkeys(s.coverage for s in near))
        live = C.merged(self._sidecars(names), keys) if len(names) <= FEW and all(n and self._readable(n) for n in names) else self._coverage()
        new = C.merged(self._sidecars([fresh[0].coverage]), keys) if len(fresh) > 1 else self._sidecars([fresh[0].coverage])
        shared = C.overlapping_runs(new, live.where((F.col("last") >= low) & (F.col("first") <= high)), keys)
        r = shared.agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.min(F.struct(*keys, "first")).alias("x")).first()
        if r["n"]:
            at, place = r["x"], int(r["x"]["first"])
            start, end = spec.bucket_range(place)
            raise CoverageOverlapError(int(r["n"]), spec.bucket_id(place), spec.user_value(start), spec.user_value(end), tuple(at[k] for k in keys) or None, fresh[0].path)

    def split_late(self, rows: DataFrame) -> DataFrame:
        """rows with a flag __late: whether the table covers their identity and bucket already."""
        found = self._coverage()
        if found is None:
            return rows.withColumn("__late", F.lit(False))
        return C.split_covered(rows, found, list(self.state.spec.entities), ordinal(self.state.spec))

    def coverage_runs(self, entity: Any = None) -> DataFrame:
        """Runs of one identity, or of a table without entities. No data file is read."""
        identity = self.identity(entity)
        found = self._coverage()
        if found is None:
            return self.spark.createDataFrame([], "first bigint, last bigint")
        return self._only(found, identity).select("first", "last")

    def coverage_ratio(self, start: Any, end: Any, entity: Any = None) -> float:
        low, high = self.state.spec.range_ordinals(start, end)
        n = C.clip(self.coverage_runs(entity), [], low, high).agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
        return int(n) / (high - low + 1)

    def max_gap(self, start: Any, end: Any, entity: Any = None) -> int:
        low, high = self.state.spec.range_ordinals(start, end)
        return int(C.max_gap(self.coverage_runs(entity), [], low, high).first()[0])

    def missing_runs(self, start: Any, end: Any, entity: Any = None, longest: int | None = None) -> list[tuple[int, int]]:
        """Public bucket ids of uncovered stretches, in order."""
        spec = self.state.spec
        low, high = spec.range_ordinals(start, end)
        rows = C.missing_runs(self.coverage_runs(entity), [], low, high, longest).orderBy("first").collect()
        return [(spec.bucket_id(int(r["first"])), spec.bucket_id(int(r["last"]))) for r in rows]

    def last_fully_covered_window(self, end: Any, length: int, entity: Any = None) -> tuple[int, int] | None:
        """Public bucket ids of the last covered window of length buckets that ends before end."""
        spec = self.state.spec
        row = C.last_window(self.coverage_runs(entity), [], spec.last_ordinal(end), length).first()
        return None if row is None else (spec.bucket_id(int(row["first"])), spec.bucket_id(int(row["last"])))

    coverage_ratio_for_range = coverage_ratio_for_entity_range = coverage_ratio
    max_gap_len_for_range = max_gap_len_for_entity_range = max_gap
    last_fully_covered_window_for_entity = last_fully_covered_window

    # layout
    def optimize(self) -> OptimizeReport:
        """Rewrite every mixed segment into one file per identity, verify, and commit removes and adds at once.
        A task writes one identity of one segment, which is no more than a segment's size."""
        spec = self.state.spec
        if not spec.entities:
            raise OptimizeError("only tables with entity columns can be optimized")
        mixed = [s for s in self.state.ordered() if s.layout == "mixed"]
        single = sum(s.layout == "single" for s in self.state.segments.values())
        if not mixed:
            return OptimizeReport(self.version, single_before=single, single_after=single)
        keys = list(spec.entities)
        with Undo() as undo:
            staging = self._root / DATA / f".staging-{uuid.uuid4().hex}"
            undo.tree(staging)
            # one shuffle on source file and identity; partitionBy then opens one file per identity and source
            tagged = self.read(mixed).withColumns({"__src": F.col("_metadata.file_name"), "__id": F.sha2(F.to_json(F.struct(*keys)), 256)})
            tagged.repartition("__src", "__id").write.partitionBy("__src", "__id").parquet(str(staging))
            files = self._placed(sorted(staging.glob("__src=*/__id=*/part-*.parquet")), staging, undo)
            made = self._inspect(files, self.state.schema, undo)
            if any(s.layout != "single" for s in made) or sum(s.rows for s in made) != sum(s.rows for s in mixed):
                raise OptimizeError("the rewrite lost or mixed rows")
            whole = lambda segments: C.merged(self._sidecars(list(dict.fromkeys(s.coverage for s in segments))), keys)
            # a sidecar may be of more segments than the mixed ones, so the rewrite must be inside it
            before, after = C.runs(C.coverage(self.read(mixed), spec), keys), whole(made)
            if not before.exceptAll(after).isEmpty() or not after.exceptAll(before).isEmpty():
                raise OptimizeError("the rewrite changed the coverage")
            self._commit(self.version, [{"remove": {"path": s.path}} for s in mixed] + [{"add": s.to_json()} for s in made], undo)
        identities = len({s.identity for s in made})
        return OptimizeReport(self.version, len(mixed), len(made), sum(s.rows for s in made), sum(s.size for s in mixed), sum(s.size for s in made), identities, single, single + len(made))

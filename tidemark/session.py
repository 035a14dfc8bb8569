"""A catalog of named tables with SQL over them.

A query is planned over stand-ins of the managed tables, relations of their schema without files; from its
filters and the log follow the segments to read, and only their files are opened. The plans are made in a
clone of the Spark session, so the names that the caller sees always mean the whole tables. Commands are run
once, on the whole tables.
"""

from __future__ import annotations

import logging
import os
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.serializers import NoOpSerializer
from pyspark.sql import SparkSession
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.util import _local_iterator_from_socket

from .errors import SqlError, StorageError
from .functions import sqltext
from .model import SegmentMeta
from .plans import pruning
from .table import TimeSeriesTable

log = logging.getLogger("tidemark")

#: Months from the origin to the start of the bin, give or take bins: months ends are clamped from the origin's
#: day, so what whole months say may be one bin off.
STRIDE = "(CAST(extract(YEAR FROM stride) AS BIGINT) * 12 + CAST(extract(MONTH FROM stride) AS BIGINT))"
SPAN_MONTHS = "timestampdiff(MONTH, origin, ts)"
MONTH_STEP = f"(({SPAN_MONTHS} - pmod({SPAN_MONTHS}, {STRIDE})) + {{}} * {STRIDE})"

#: SQL functions that the dialect has and Spark lacks or reads otherwise.
FUNCTIONS = {
    "to_unixtime": "(ts TIMESTAMP) RETURNS BIGINT RETURN unix_micros(ts) div 1000000L",
    "to_timestamp_seconds": "(v BIGINT) RETURNS TIMESTAMP_NTZ RETURN CAST(timestamp_seconds(v) AS TIMESTAMP_NTZ)",
    "to_timestamp_millis": "(v BIGINT) RETURNS TIMESTAMP_NTZ RETURN CAST(timestamp_millis(v) AS TIMESTAMP_NTZ)",
    "to_timestamp_micros": "(v BIGINT) RETURNS TIMESTAMP_NTZ RETURN CAST(timestamp_micros(v) AS TIMESTAMP_NTZ)",
    "to_timestamp_nanos": "(v BIGINT) RETURNS TIMESTAMP_NTZ RETURN CAST(timestamp_micros((v - pmod(v, 1000L)) div 1000L) AS TIMESTAMP_NTZ)",
    "date_bin_months": "(stride INTERVAL YEAR TO MONTH, ts TIMESTAMP, origin TIMESTAMP DEFAULT TIMESTAMP '1970-01-01 00:00:00Z') RETURNS TIMESTAMP_NTZ RETURN CASE"
    + " ".join(
        f" WHEN timestamp_micros(unix_micros(origin)) + make_ym_interval(0, CAST({step} AS INT)) {test} ts THEN CAST(origin + make_ym_interval(0, CAST({step} AS INT)) AS TIMESTAMP_NTZ)"
        for step, test in ((MONTH_STEP.format(1), "<="), (MONTH_STEP.format(0), "<="))
    )
    + f" ELSE CAST(origin + make_ym_interval(0, CAST({MONTH_STEP.format(-1)} AS INT)) AS TIMESTAMP_NTZ) END",
    "date_bin": "(stride INTERVAL DAY TO SECOND, ts TIMESTAMP, origin TIMESTAMP DEFAULT TIMESTAMP '1970-01-01 00:00:00Z') RETURNS TIMESTAMP_NTZ RETURN "
    "CAST(timestamp_micros(unix_micros(ts) - pmod(unix_micros(ts) - unix_micros(origin), CAST(extract(DAY FROM stride) AS BIGINT) * 86400000000L + CAST(extract(HOUR FROM stride) AS BIGINT) * 3600000000L"
    " + CAST(extract(MINUTE FROM stride) AS BIGINT) * 60000000L + CAST(extract(SECOND FROM stride) * 1000000 AS BIGINT))) AS TIMESTAMP_NTZ)",
}


def install(spark: SparkSession) -> None:
    """Define FUNCTIONS in a session; they keep its time zone."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


class ResultReader:
    """Arrow record batches of a running query, in order, one partition at a time.

    Iterating gives batches; an error of the query surfaces where it is met. After the last batch, an error or
    close() the reader is at its end: next() raises StopIteration and, once closed, read_all() ArrowInvalid.
    close() cancels what is running, also from another thread; it can be called again.
    """

    def __init__(self, df: DataFrame) -> None:
        spark = df.sparkSession
        self.schema: pa.Schema = to_arrow_schema(df.schema)
        self._context, self._group = spark.sparkContext, f"tidemark-reader-{uuid.uuid4().hex}"
        self._df, self._batches, self._started, self._done, self.closed = df, None, False, False, False
        self._lock = threading.Lock()

    def _start(self) -> Iterator[bytes]:
        """Serialized batches. The jobs inherit the group of the thread that starts them."""
        context = self._context
        held = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
        context.setJobGroup(self._group, "tidemark reader", interruptOnCancel=True)
        try:
            rdd = self._df._jdf.toArrowBatchRdd()
            served = self._df.sparkSession._jvm.org.apache.spark.api.python.PythonRDD.toLocalIteratorAndServe(rdd, False)
        finally:
            for k, v in held.items():
                context.setLocalProperty(k, v)
        return _local_iterator_from_socket(served, NoOpSerializer())

    def __iter__(self) -> ResultReader:
        return self

    def __next__(self) -> pa.RecordBatch:
        if self.closed or self._done:
            raise StopIteration
        try:
            if self._batches is None:
                self._started = True
                self._batches = iter(self._start())
            while True:
                batch = pa.ipc.read_record_batch(pa.py_buffer(next(self._batches)), self.schema)
                if self.closed:
                    raise StopIteration
                if batch.num_rows:
                    return batch
        except StopIteration:
            self._end()
            raise
        except Exception as e:
            self._end()
            if self.closed:  # cancelled under way
                raise StopIteration from None
            raise SqlError(str(e)) from e

    read_next_batch = __next__

    def _end(self) -> None:
        self._done, self._batches = True, None

    def _open(self) -> None:
        if self.closed:
            raise pa.ArrowInvalid("the reader is closed")

    def reader(self) -> pa.RecordBatchReader:
        """The rest as pyarrow's reader."""
        self._open()
        return pa.RecordBatchReader.from_batches(self.schema, self)

    def read_all(self) -> pa.Table:
        """The rest as one table."""
        self._open()
        return pa.Table.from_batches(list(self), schema=self.schema)

    def __arrow_c_stream__(self, requested_schema: object = None) -> object:
        return self.reader().__arrow_c_stream__(requested_schema)

    def close(self) -> None:
        with self._lock:
            if self.closed:
                return
            self.closed = True
        if self._started:  # stages may run before there is a first batch
            self._context.cancelJobGroup(self._group)
        self._done = True

    def __enter__(self) -> ResultReader:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


class Session:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._lock = spark, threading.RLock()
        self._managed: dict[str, TimeSeriesTable] = {}
        self._stand_ins: dict[str, tuple[str, Any]] = {}  # by name: schema and Java frame
        self._plain: set[str] = set()
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        install(spark)

    def register_tstable(self, name: str, location: str | os.PathLike) -> TimeSeriesTable:
        """Name a managed table; a failure leaves an earlier one of that name in place."""
        with self._lock:
            table = TimeSeriesTable.open(self.spark, location)
            self._name(name)
            self._show(name, table)
            self._managed[name] = table
            self._plain.discard(name)
            return table

    def register_parquet(self, name: str, path: str | os.PathLike) -> None:
        """Name a Parquet file or directory."""
        with self._lock:
            p = Path(path)
            if p.is_dir() and not any(p.rglob("*.parquet")):
                raise StorageError(f"no Parquet file under {p}")
            self.spark.read.parquet(os.fspath(path)).createOrReplaceTempView(self._name(name))
            self._managed.pop(name, None)
            self._plain.add(name)

    @staticmethod
    def _name(name: str) -> str:
        if not name or not name.strip():
            raise ValueError("a table needs a name")
        return name

    def table(self, name: str) -> TimeSeriesTable:
        """The handle of a managed table."""
        return self._managed[name]

    def tables(self) -> list[str]:
        return sorted({*self._managed, *self._plain})

    def deregister(self, name: str) -> None:
        with self._lock:
            if not name or not name.strip():
                raise ValueError("a table needs a name")
            if name not in self._managed and name not in self._plain:
                raise KeyError(name)
            self.spark.catalog.dropTempView(name)
            self._managed.pop(name, None)
            self._plain.discard(name)

    def _show(self, name: str, table: TimeSeriesTable) -> None:
        """The caller's view of a managed table; a table without schema has no columns yet."""
        if table.state.schema is not None:
            table.read().createOrReplaceTempView(name)

    def _stand_in(self, name: str, table: TimeSeriesTable) -> Any:
        """A relation of the table's schema over no file, as a Java frame."""
        schema = table.spark_schema().json()
        if name not in self._stand_ins or self._stand_ins[name][0] != schema:
            java = self.spark._jsparkSession
            self._stand_ins[name] = schema, java.createDataFrame(self.spark.sparkContext._jsc.emptyRDD(), java.parseDataType(schema))
        return self._stand_ins[name][1]

    def _frame(self, session: SparkSession, plan: Any) -> DataFrame:
        return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)

    def _is_command(self, text: str) -> bool:
        jvm = self.spark._jvm
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        return jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command").isInstance(plan) or pruning.name_of(plan) == "InsertIntoStatement"

    def refresh(self) -> None:
        """Take the newest version of every managed table."""
        with self._lock:
            for name, table in self._managed.items():
                if table.refresh():
                    self._show(name, table)

    def plan(self, query: str, params: Any = None) -> tuple[DataFrame, dict[str, list[SegmentMeta]]]:
        """A query over the latest versions, and the segments that it reads of each managed table it names."""
        text, args = sqltext.prepared(query), sqltext.parameters(params)
        with self._lock:
            self.refresh()
            try:
                if explained := sqltext.explained(text):
                    mode, inner = explained
                    df, kept = self.plan(inner, params)
                    plan = self.spark._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
                    return self.spark.createDataFrame([(plan,)], "plan string"), kept
                managed = {n: t for n, t in self._managed.items() if t.state.schema is not None}
                if not managed or self._is_command(text):
                    return self.spark.sql(text, args=args or None), {n: t.state.ordered() for n, t in managed.items()}
                clone = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
                stand_ins = {n: self._stand_in(n, t) for n, t in managed.items()}
                for n, java in stand_ins.items():
                    self._frame(clone, java.queryExecution().logical()).createOrReplaceTempView(n)
                found = clone.sql(text, args=args or None)._jdf.queryExecution()
                kept, zones = {}, set()
                numbers = {n: java.queryExecution().logical().rdd().id() for n, java in stand_ins.items()}
                named = {n: bool(pruning.scans(found.analyzed(), number, False)[0]) for n, number in numbers.items()}
                zones = {t.zone() for n, t in managed.items() if named[n]}
                zone = zones.pop() if len(zones) == 1 else "UTC"
                if zone != clone.conf.get("spark.sql.session.timeZone"):
                    clone.conf.set("spark.sql.session.timeZone", zone)
                    install(clone)
                    found = clone.sql(text, args=args or None)._jdf.queryExecution()
                for n, t in managed.items():
                    segments = t.state.ordered()
                    try:
                        few = pruning.kept_segments(found.analyzed(), found.optimizedPlan(), numbers[n], t.index_spec, segments, zone)
                    except Py4JError as e:  # a plan that is not as expected
                        log.warning("the plan could not be read, all segments of %s stay: %s", n, e)
                        few = segments
                    if named[n]:
                        kept[n] = few
                    self._frame(clone, t.read(few)._jdf.queryExecution().logical()).createOrReplaceTempView(n)
                # the analyzed plan carries all that the clone's settings decide
                return self._frame(self.spark, clone.sql(text, args=args or None)._jdf.queryExecution().analyzed()), kept
            except PySparkException as e:
                raise SqlError(str(e)) from e

    def dataframe(self, query: str, params: Any = None) -> DataFrame:
        """Plan a query over the latest versions, with segments pruned by the log before any file is opened.

        Local days and hours are those of the zone of the managed tables that the query names, or UTC where
        they differ."""
        return self.plan(query, params)[0]

    def sql(self, query: str, params: Any = None) -> pa.Table:
        df = self.dataframe(query, params)
        try:
            return df.toArrow()
        except PySparkException as e:
            raise SqlError(str(e)) from e

    def sql_reader(self, query: str, params: Any = None) -> ResultReader:
        return ResultReader(self.dataframe(query, params))

    def explain(self, query: str, params: Any = None) -> str:
        df = self.dataframe(query, params)
        return self.spark._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")

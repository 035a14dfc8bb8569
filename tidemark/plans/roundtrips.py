"""Queries that write managed tables and read them again, beside SQL over the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CoverageOverlapError, StorageError
from ..model import IndexSpec
from ..session import Session
from ..table import TimeSeriesTable
from .catalog import own, table

HALF = "2024-01-15 00:00:00"
ROWS = "SELECT event_id, ts, user_id, event_type, value FROM events"


def new_root(spark: SparkSession) -> str:
    """A folder for one table, beside the session's checkpoints; removed when the driver ends. A machine's own
    folder is taken only where driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise StorageError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    base = base.removeprefix("file://") if base else tempfile.mkdtemp(prefix="tidemark-")
    root = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def two_appends(spark: SparkSession, sf_dir: str) -> TimeSeriesTable:
    """The events of both halves of the month, appended one after the other; each segment mixes entities."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    made = TimeSeriesTable.create(spark, new_root(spark), IndexSpec.timestamp("ts", "1h", ["event_type"]))
    half = F.lit(HALF).cast("timestamp_ntz")
    made.append(events.where(F.col("ts") < half))
    made.append(events.where(F.col("ts") >= half))
    return made


@own("append_roundtrip", ROWS)
def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_appends(spark, sf_dir).read()


@own("optimize_roundtrip", ROWS)
def _optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = two_appends(spark, sf_dir)
    made.optimize()
    return made.read()


@own("optimize_layout", f"SELECT event_type, count(*) AS row_count, epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events GROUP BY event_type, ts < TIMESTAMP '{HALF}'")
def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = two_appends(spark, sf_dir)
    made.optimize()
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    by_file = made.read().withColumn("file", F.col("_metadata.file_name")).groupBy("file")
    return by_file.agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("row_count"), F.min(us).alias("low"), F.max(us).alias("high")).drop("file")


@own("table_scan_range", f"{ROWS} WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-08' AND event_type = 'click'")
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = two_appends(spark, sf_dir)
    session = Session(spark.newSession())
    session.register_tstable("t", made.root)
    return session.dataframe("SELECT * FROM t WHERE ts >= TIMESTAMP_NTZ '2024-01-05 12:00:00' AND ts < TIMESTAMP_NTZ '2024-01-08' AND event_type = $kind", {"kind": "click"})


@own("table_coverage_runs", "WITH b AS (SELECT DISTINCT (epoch_us(ts) // 3600000000)::BIGINT AS bucket FROM events WHERE event_type = 'click'), g AS (SELECT bucket, bucket - row_number() OVER (ORDER BY bucket) AS k FROM b) SELECT min(bucket) AS first, max(bucket) AS last FROM g GROUP BY k")
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one entity from the table's own coverage snapshot; the data files aren't read."""
    return two_appends(spark, sf_dir).coverage_runs({"event_type": "click"})


@own("segment_bounds", f"SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high, count(*) AS row_count FROM events GROUP BY ts < TIMESTAMP '{HALF}'")
def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log says of the segments."""
    found = [(s.low, s.high, s.rows) for s in two_appends(spark, sf_dir).state.ordered()]
    return spark.createDataFrame(found, "low bigint, high bigint, row_count bigint")


FIRST, LAST = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 12, tzinfo=timezone.utc)
WHOLE = "WITH b AS (SELECT DISTINCT (epoch_us(ts) // 60000000)::BIGINT AS bucket FROM events)"
MINUTE_LOW, MINUTE_HIGH = IndexSpec.timestamp("ts", "1m").range_ordinals(FIRST, LAST)


def global_table(spark: SparkSession, sf_dir: str) -> TimeSeriesTable:
    """The events of every week as one append each, without entities; a bucket is a minute."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    made = TimeSeriesTable.create(spark, new_root(spark), IndexSpec.timestamp("ts", "1m"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    week = 7 * 86_400_000_000
    for k in range(low // week, high // week + 1):
        made.append(events.where((us >= k * week) & (us < (k + 1) * week)))
    return made


@own("table_coverage_global", f"""{WHOLE}, i AS (SELECT * FROM b WHERE bucket BETWEEN {MINUTE_LOW} AND {MINUTE_HIGH}),
 p AS (SELECT bucket FROM i UNION ALL VALUES ({MINUTE_LOW - 1}), ({MINUTE_HIGH + 1})),
 g AS (SELECT lead(bucket) OVER (ORDER BY bucket) - bucket - 1 AS gap FROM p),
 r AS (SELECT min(bucket) AS s, least(max(bucket), {MINUTE_HIGH}) AS e FROM (SELECT bucket, bucket - row_number() OVER (ORDER BY bucket) AS k FROM b) GROUP BY k)
SELECT (SELECT count(*) FROM i) / {float(MINUTE_HIGH - MINUTE_LOW + 1)} AS ratio, (SELECT max(gap) FROM g) AS gap,
 (SELECT max(e) FROM r WHERE s <= {MINUTE_HIGH} AND e - s + 1 >= 3) AS window_last""")
def _global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three coverage questions of a table without entities, told from its sidecars."""
    made = global_table(spark, sf_dir)
    window = made.last_fully_covered_window(LAST, 3)
    last = None if window is None else made.index_spec.ordinal_of(window[1])
    return spark.createDataFrame([(made.coverage_ratio(FIRST, LAST), made.max_gap(FIRST, LAST), last)], "ratio double, gap bigint, window_last bigint")


@own("table_range_scan", f"{ROWS} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_table(spark, sf_dir).scan_range(FIRST, LAST)


@own("append_overlap", "WITH b AS (SELECT DISTINCT (epoch_us(ts) // 3600000000)::BIGINT AS bucket, event_type FROM events WHERE event_type = 'click') SELECT count(*) AS overlap_count, min(bucket) AS bucket, min(event_type) AS event_type FROM b")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append is told that writes one entity's rows again; the table stays as it was."""
    made = two_appends(spark, sf_dir)
    version, again = made.version, made.read().where("event_type = 'click'")
    try:
        made.append(again)
    except CoverageOverlapError as e:
        assert made.load_latest_state().version == version
        return spark.createDataFrame([(e.overlap_count, made.index_spec.ordinal_of(e.bucket_id), e.entity[0])], "overlap_count bigint, bucket bigint, event_type string")
    raise AssertionError("the overlap was not found")


@own("append_overlap_global", "WITH b AS (SELECT DISTINCT (epoch_us(ts) // 60000000)::BIGINT AS bucket FROM events WHERE value > 100) SELECT count(*) AS overlap_count, min(bucket) AS bucket FROM b HAVING count(*) > 0")
def _overlap_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = global_table(spark, sf_dir)
    schema = "overlap_count bigint, bucket bigint"
    again = made.read().where("value > 100")
    if again.isEmpty():
        return spark.createDataFrame([], schema)
    try:
        made.append(again)
    except CoverageOverlapError as e:
        return spark.createDataFrame([(e.overlap_count, made.index_spec.ordinal_of(e.bucket_id))], schema)
    raise AssertionError("the overlap was not found")


@own("late_rows_set_aside", "WITH a AS (SELECT DISTINCT event_type, epoch_us(ts) // 3600000000 AS b FROM events WHERE event_id % 2 = 0) SELECT event_id FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.event_type = e.event_type AND a.b = epoch_us(e.ts) // 3600000000)")
def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the second half whose hour and type the first half doesn't cover."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    made = TimeSeriesTable.create(spark, new_root(spark), IndexSpec.timestamp("ts", "1h", ["event_type"]))
    made.append(events.where("event_id % 2 = 0"))
    return made.split_late(events.where("event_id % 2 = 1")).where("not __late").select("event_id")


#: By query: the condition in both dialects. Each runs in a session over a table of weekly segments.
PRUNED = {
    "compare": ("ts >= TIMESTAMP_NTZ '2024-01-12 06:00:00'", "ts >= TIMESTAMP '2024-01-12 06:00:00'"),
    "between": ("ts BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-05 03:00:00'", "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-05 03:00:00'"),
    "boolean": ("NOT (ts < TIMESTAMP_NTZ '2024-01-20 00:00:00') OR ts < TIMESTAMP_NTZ '2024-01-02 00:00:00'", "NOT (ts < TIMESTAMP '2024-01-20 00:00:00') OR ts < TIMESTAMP '2024-01-02 00:00:00'"),
    "interval": ("ts + INTERVAL 2 DAY < TIMESTAMP_NTZ '2024-01-05 00:00:00'", "ts + INTERVAL 2 DAY < TIMESTAMP '2024-01-05 00:00:00'"),
    "unixtime": ("to_unixtime(ts) < 1704326400", "epoch(ts) < 1704326400"),
    "to_date": ("to_date(ts) = DATE '2024-01-08'", "CAST(ts AS DATE) = DATE '2024-01-08'"),
    "date_trunc": ("date_trunc('hour', ts) = TIMESTAMP '2024-01-09 05:00:00'", "date_trunc('hour', ts) = TIMESTAMP '2024-01-09 05:00:00'"),
    "date_bin": ("date_bin(INTERVAL '15' MINUTE, ts) < TIMESTAMP_NTZ '2024-01-02 00:00:00'", "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') < TIMESTAMP '2024-01-02'"),
    "date_bin_month": ("date_bin(INTERVAL '1' MONTH, ts, TIMESTAMP '2023-12-15 00:00:00') = TIMESTAMP_NTZ '2023-12-15 00:00:00'", "ts >= TIMESTAMP '2023-12-15' AND ts < TIMESTAMP '2024-01-15'"),
}
#: Segments kept, at least one less than all, is part of what a query answers.
for _name, (_spark, _duck) in PRUNED.items():

    def _query(spark: SparkSession, sf_dir: str, where: str = _spark) -> DataFrame:
        made = global_table(spark, sf_dir)
        session = Session(spark.newSession())
        session.register_tstable("t", made.root)
        df, kept = session.plan(f"SELECT event_id, ts FROM t WHERE {where}")
        pruned = len(kept["t"]) < len(made.state.segments) or len(made.state.segments) == 1
        return df.withColumn("pruned", F.lit(pruned))

    own(f"segment_prune_{_name}", f"SELECT event_id, ts, true AS pruned FROM events WHERE {_duck}")(_query)

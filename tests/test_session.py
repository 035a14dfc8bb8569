import threading
import time
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.errors import SqlError, StorageError
from tidemark.functions import sqltext
from tidemark.model import IndexSpec
from tidemark.session import Session, install
from tidemark.streaming.ingest import append_stream
from tidemark.table import TimeSeriesTable

DAY0 = datetime(2024, 1, 7)


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    table = TimeSeriesTable.create(spark, base / "prices", IndexSpec.timestamp("ts", "1h", ["symbol"]))
    for day, symbol in ((0, "A"), (1, "A"), (2, "B")):
        ts = [DAY0 + timedelta(days=day, hours=h) for h in range(24)]
        table.append(pa.table({"ts": pa.array(ts, pa.timestamp("us")), "symbol": [symbol] * 24, "close": [float(h) for h in range(24)]}))
    pq.write_table(pa.table({"symbol": ["A", "B"], "exchange": ["X", "Y"]}), base / "symbols.parquet")
    s = Session(spark)
    s.register_tstable("prices", base / "prices")
    s.register_parquet("symbols", base / "symbols.parquet")
    return s


CASES = [
    ("ts >= TIMESTAMP_NTZ '2024-01-08 00:00:00'", [1, 2]),
    ("TIMESTAMP_NTZ '2024-01-08 00:00:00' > ts", [0]),
    ("ts BETWEEN TIMESTAMP_NTZ '2024-01-08 03:00:00' AND TIMESTAMP_NTZ '2024-01-08 04:00:00'", [1]),
    ("NOT (ts < TIMESTAMP_NTZ '2024-01-09 00:00:00')", [2]),
    ("ts = TIMESTAMP_NTZ '2024-01-09 05:00:00' OR ts < TIMESTAMP_NTZ '2024-01-07 05:00:00'", [0, 2]),
    ("ts IN (TIMESTAMP_NTZ '2024-01-07 05:00:00', TIMESTAMP_NTZ '2024-01-09 05:00:00')", [0, 2]),
    ("ts + INTERVAL 2 HOUR < TIMESTAMP_NTZ '2024-01-08 00:00:00'", [0]),
    ("ts + INTERVAL 1 MONTH < TIMESTAMP_NTZ '2024-02-08 00:00:00'", [0]),
    ("to_date(ts) = DATE '2024-01-08'", [1]),
    ("date_trunc('day', ts) = TIMESTAMP '2024-01-09 00:00:00'", [2]),
    ("date_trunc('hour', ts) <= TIMESTAMP '2024-01-07 03:00:00'", [0]),
    ("to_unixtime(ts) < 1704672000", [0]),
    ("date_bin(INTERVAL '15' MINUTE, ts) < TIMESTAMP_NTZ '2024-01-07 20:00:00'", [0]),
    ("date_bin(INTERVAL '1' DAY, ts, TIMESTAMP '2024-01-01 00:00:00') = TIMESTAMP_NTZ '2024-01-08 00:00:00'", [1]),
    ("date_bin(INTERVAL '1' MONTH, ts, TIMESTAMP '2023-12-09 00:00:00') = TIMESTAMP_NTZ '2024-01-09 00:00:00'", [2]),
    ("CASE WHEN ts < TIMESTAMP_NTZ '2024-01-09 00:00:00' THEN 1 ELSE 2 END = 2", [0, 1, 2]),
    ("symbol = 'B'", [2]),
    ("symbol = 'A' AND ts >= TIMESTAMP_NTZ '2024-01-08 00:00:00'", [1]),
    ("symbol = 'B' OR close > 3", [0, 1, 2]),
    ("close > 3 AND ts < TIMESTAMP_NTZ '2024-01-08 00:00:00'", [0]),
    ("date_part('minute', ts) = 0", [0, 1, 2]),
    ("ts < '2024-01-07T12:00:00'", [0]),
]


@pytest.mark.parametrize("where, days", CASES)
def test_pruning(session, where, days):
    full = session.spark.read.parquet(*session._managed["prices"].paths(session._managed["prices"].state.ordered()))
    full.createOrReplaceTempView("plain_prices")
    expect = session.spark.sql(sqltext.prepared(f"SELECT ts, symbol, close FROM plain_prices WHERE {where}")).count()
    df, kept = session.plan(f"SELECT ts, symbol, close FROM prices WHERE {where}")
    segments = session.table("prices").state.ordered()
    assert df.count() == expect
    assert [segments.index(s) for s in kept["prices"]] == days
    assert session.spark.sql("SELECT count(*) FROM prices").first()[0] == 72


def test_plans_that_hide_the_table(session):
    n = "SELECT count(*) AS n FROM prices"
    whole = lambda sql: session.sql(sql)["n"][0].as_py()
    df = session.dataframe("SELECT * FROM prices").cache()
    assert df.count() == 72 and whole(n) == 72
    df.unpersist()
    few = session.dataframe("SELECT * FROM prices WHERE symbol = 'B'").cache()
    assert few.count() == 24 and whole(n) == 72 and whole(f"{n} WHERE symbol = 'B'") == 24
    few.unpersist()
    for mode in ("", "EXTENDED", "FORMATTED"):
        plan = session.sql(f"EXPLAIN {mode} {n} WHERE symbol = 'B'")["plan"][0].as_py()
        assert "parquet" in plan.lower() and "ExistingRDD" not in plan
    assert whole(n) == 72
    session.sql("CREATE OR REPLACE TEMPORARY VIEW late AS SELECT * FROM prices WHERE ts >= TIMESTAMP_NTZ '2024-01-09 00:00:00'")
    assert len(session.plan("SELECT * FROM late")[1]["prices"]) == 1 and whole("SELECT count(*) AS n FROM late") == 24
    assert whole("WITH c AS (SELECT * FROM prices) SELECT count(*) AS n FROM c WHERE symbol = 'A'") == 48
    assert whole("WITH c AS (SELECT *, rand() AS r FROM prices) SELECT count(*) AS n FROM c x JOIN c y ON x.ts = y.ts WHERE x.symbol = 'A'") == 48
    assert whole(f"{n} WHERE ts > (SELECT max(ts) FROM prices WHERE symbol = 'A')") == 24
    assert whole(f"{n} WHERE false") == 0 and whole(f"{n} WHERE NOT (ts <=> TIMESTAMP_NTZ '2024-01-07 00:00:00')") == 71
    assert whole("SELECT count(*) AS n FROM (SELECT * FROM prices WHERE symbol = 'A' UNION ALL SELECT * FROM prices WHERE symbol = 'B')") == 72
    assert session.spark.sql(n).first()[0] == 72


def test_pruned_files_are_not_touched(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1h"))
    for day in range(3):
        table.append(pa.table({"ts": pa.array([DAY0 + timedelta(days=day)], pa.timestamp("us")), "v": [day]}))
    s = Session(spark)
    s.register_tstable("gappy", tmp_path / "t")
    (tmp_path / "t" / table.state.ordered()[0].path).unlink()
    assert s.sql("SELECT sum(v) AS v FROM gappy WHERE ts >= TIMESTAMP_NTZ '2024-01-08 00:00:00'")["v"][0].as_py() == 3
    with pytest.raises(SqlError):
        s.sql("SELECT sum(v) AS v FROM gappy")
    s.deregister("gappy")


ZONED = [
    ("date_trunc('day', ts) = TIMESTAMP '2024-03-10 05:00:00Z'", [1, 2, 3]),
    ("date_trunc('hour', ts) = TIMESTAMP '2024-03-10 06:00:00Z'", [2]),
    ("date_bin(INTERVAL '2' HOUR, ts) = TIMESTAMP_NTZ '2024-03-10 01:00:00'", [2, 3]),
    ("to_date(ts) = DATE '2024-03-10'", [1, 2, 3]),
    ("ts + INTERVAL '1' DAY = TIMESTAMP '2024-03-11 05:00:00Z'", [2]),
    ("(ts + INTERVAL '1' DAY) + INTERVAL '1' HOUR = TIMESTAMP '2024-03-10 07:30:00Z'", [5]),
    ("ts >= TIMESTAMP '2024-03-11 00:00:00Z'", [4]),
]


@pytest.fixture(scope="module")
def zoned(spark, tmp_path_factory):
    """Hours around a change to summer time in New York, one segment each."""
    root = tmp_path_factory.mktemp("zoned") / "t"
    table = TimeSeriesTable.create(spark, root, IndexSpec.timestamp("ts", "1m", timezone="America/New_York"))
    starts = ["2024-03-10T04:00", "2024-03-10T05:00", "2024-03-10T06:00", "2024-03-10T07:00", "2024-03-11T04:00"]
    spans = [(datetime.fromisoformat(s), datetime.fromisoformat(s) + timedelta(minutes=59, seconds=59)) for s in starts]
    spans.append((datetime(2024, 3, 9, 6, 30), datetime(2024, 3, 9, 6, 30, 1)))
    for span in spans:
        table.append(pa.table({"ts": pa.array(span, pa.timestamp("us", "America/New_York"))}))
    s = Session(spark)
    s.register_tstable("zoned", root)
    return s, [table.state.ordered().index(x) for x in sorted(table.state.ordered(), key=lambda x: [int(y[0].replace(tzinfo=timezone.utc).timestamp()) * 1_000_000 for y in spans].index(x.low))]


@pytest.mark.parametrize("where, expect", ZONED)
def test_zones(zoned, where, expect):
    session, order = zoned
    df, kept = session.plan(f"SELECT ts FROM zoned WHERE {where}")
    segments = session.table("zoned").state.ordered()
    got = {order.index(segments.index(s)) for s in kept["zoned"]}
    clock = session.spark.newSession()
    clock.conf.set("spark.sql.session.timeZone", "America/New_York")
    install(clock)  # the same statement over the plain files, in the table's zone
    clock.read.parquet(*session.table("zoned").paths(segments)).createOrReplaceTempView("zoned")
    want = sorted(r[0] for r in clock.sql(f"SELECT unix_micros(ts) FROM zoned WHERE {where}").collect())
    assert sorted(r[0] for r in df.selectExpr("unix_micros(ts)").collect()) == want
    assert got == set(expect)


def test_month_bins(session):
    sql = "SELECT date_bin(INTERVAL '1' MONTH, ts, TIMESTAMP '2023-10-31 00:00:00') AS b, count(*) AS n FROM {} GROUP BY 1"
    from datetime import datetime as D

    for day, want in ((D(2024, 2, 28), D(2024, 1, 31)), (D(2024, 2, 29), D(2024, 2, 29)), (D(2024, 3, 30), D(2024, 2, 29)), (D(2023, 9, 30), D(2023, 9, 30)), (D(2023, 9, 29), D(2023, 8, 31))):
        assert session.sql(sql.format(f"(SELECT TIMESTAMP_NTZ '{day}' AS ts) x"))["b"].to_pylist() == [want]
    assert session.sql("SELECT date_bin(INTERVAL '2' YEAR, ts) AS b FROM prices LIMIT 1")["b"].to_pylist() == [D(2024, 1, 1)]
    assert sqltext.month_strides("date_bin(INTERVAL '1' DAY, ts) -- date_bin(INTERVAL '1' MONTH") == "date_bin(INTERVAL '1' DAY, ts) -- date_bin(INTERVAL '1' MONTH"


def test_reader(session):
    whole = session.sql("SELECT id FROM range(50000) ORDER BY id")
    with session.sql_reader("SELECT id FROM range(50000) ORDER BY id") as r:
        assert r.read_all() == whole
    r = session.sql_reader("SELECT id FROM range(50000)")
    first = next(r)
    rest = r.read_all()
    assert first.num_rows and rest.num_rows and first.num_rows + rest.num_rows == 50000
    with pytest.raises(StopIteration):
        next(r)
    r.close()
    r.close()
    for take in (r.read_all, r.reader):
        with pytest.raises(pa.ArrowInvalid, match="closed"):
            take()
    early = session.sql_reader("SELECT 1 AS x")
    early.close()
    assert list(early) == []
    empty = session.sql_reader("SELECT 1L AS x WHERE false").read_all()
    assert empty.num_rows == 0 and empty.column_names == ["x"]
    assert pa.table(session.sql_reader("SELECT id FROM range(10)")).num_rows == 10
    broken = session.sql_reader("SELECT raise_error('boom') AS x FROM range(4)")
    with pytest.raises(SqlError, match="boom"):
        next(broken)
    with pytest.raises(StopIteration):
        next(broken)
    broken.close()
    with pytest.raises(TypeError, match="params"):
        session.sql_reader("SELECT 1", {1, 2})
    with pytest.raises(SqlError):
        session.sql_reader("SELECT * FROM no_such_table")


def test_close_ends_a_running_query(session):
    r = session.sql_reader("SELECT count(*) AS n FROM range(10000000) a JOIN range(10000000) b ON a.id + b.id > -1")
    got = []
    t = threading.Thread(target=lambda: got.append(next(r, "end")))
    t.start()
    time.sleep(1)
    r.close()
    t.join(30)
    assert got == ["end"]


def test_limit_parts_filter_from_scan(session):
    assert session.sql("SELECT count(*) AS n FROM (SELECT * FROM prices LIMIT 72) WHERE ts >= TIMESTAMP_NTZ '2024-01-09 00:00:00'")["n"][0].as_py() == 24


def test_join_params_reader(session):
    got = session.sql("SELECT p.symbol, s.exchange, count(*) AS n FROM prices p JOIN symbols s ON p.symbol = s.symbol WHERE p.close >= $1 GROUP BY p.symbol, s.exchange ORDER BY p.symbol", [22.0])
    assert got.to_pydict() == {"symbol": ["A", "B"], "exchange": ["X", "Y"], "n": [4, 2]}
    assert session.sql("SELECT $x AS v, '$x' AS lit", {"x": 3}).to_pydict() == {"v": [3], "lit": ["$x"]}
    with session.sql_reader("SELECT close FROM prices") as reader:
        assert sum(b.num_rows for b in reader) == 72
    assert session.sql("SELECT sum(a.close) AS s FROM prices a, prices b WHERE a.ts = b.ts AND a.ts < TIMESTAMP_NTZ '2024-01-08 00:00:00'")["s"][0].as_py() == sum(range(24))
    with pytest.raises(SqlError):
        session.sql("SELECT nope FROM prices")


def test_catalog(session, tmp_path):
    assert session.tables() == ["prices", "symbols"]
    with pytest.raises(KeyError):
        session.deregister("none")
    with pytest.raises(ValueError):
        session.deregister(" ")
    (tmp_path / "empty").mkdir()
    with pytest.raises(StorageError):
        session.register_parquet("x", tmp_path / "empty")


def test_sqltext():
    assert sqltext.named_parameters("SELECT $1, '$2', \"$3\" -- $4\n, $name") == "SELECT :p_1, '$2', \"$3\" -- $4\n, :p_name"
    assert sqltext.renamed("SELECT p.v, 'p' FROM p -- p", {"p": "prices"}) == "SELECT prices.v, 'p' FROM prices -- p"
    assert sqltext.explained("explain verbose select 1") == ("extended", "select 1") and sqltext.explained("select 1") is None
    assert sqltext.ended("select ';' ; -- x") and not sqltext.ended("select ';'")
    assert sqltext.unsigned_types("CAST(x AS BIGINT  UNSIGNED), CAST(y AS bigint)") == "CAST(x AS DECIMAL(20, 0)), CAST(y AS bigint)"


def drop(folder, name, hours, **more):
    ts = [DAY0 + timedelta(hours=h) for h in hours]
    pq.write_table(pa.table({"ts": pa.array(ts, pa.timestamp("us")), "v": list(hours)} | more), folder / name)


def test_stream(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1h"))
    (tmp_path / "in").mkdir()
    drop(tmp_path / "in", "a.parquet", [0])
    stream = lambda: spark.readStream.schema("ts timestamp_ntz, v bigint").parquet(str(tmp_path / "in"))
    append_stream(stream(), table, str(tmp_path / "cp")).awaitTermination(60)
    assert table.read().count() == 1 and list(table.state.batches.values()) == [0]
    # a crash between the append and the stream's own commit: the batch comes again and is left out
    (tmp_path / "cp" / "commits" / "0").unlink()
    (tmp_path / "cp" / "commits" / ".0.crc").unlink(missing_ok=True)
    append_stream(stream(), table, str(tmp_path / "cp")).awaitTermination(60)
    table.refresh()
    assert table.read().count() == 1 and table.version == 2
    drop(tmp_path / "in", "b.parquet", [0, 1])
    q = append_stream(stream(), table, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="overlap"):
        q.awaitTermination(60)


def test_late_rows_are_set_aside_one_by_one(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1h"))
    (tmp_path / "in").mkdir()
    drop(tmp_path / "in", "a.parquet", [5])
    stream = lambda: spark.readStream.schema("ts timestamp_ntz, v bigint").parquet(str(tmp_path / "in"))
    go = lambda: append_stream(stream(), table, str(tmp_path / "cp"), late="skip", aside=str(tmp_path / "late")).awaitTermination(60)
    go()
    drop(tmp_path / "in", "b.parquet", list(range(100)))
    go()
    table.refresh()
    assert sorted(r["v"] for r in table.read().collect()) == list(range(100))
    assert [r["v"] for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [5]
    with pytest.raises(ValueError):
        append_stream(stream(), table, str(tmp_path / "cp"), late="drop")

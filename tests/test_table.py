import os
import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest

from tidemark.errors import (
    AlreadyExistsError, AmbiguousCommitError, ConflictError, CoverageOverlapError, DuplicateEntityError, EmptySourceError, EmptyTableError, EntityError, EntityNotConfiguredError,
    EntityTypeError, LogCorruptError, MissingCoverageError, MissingEntityError, RollbackError, SchemaMismatchError, StorageError, TidemarkError, UnexpectedEntityError,
)
from tidemark.model import SIGN, IndexSpec, TimeBucket
from tidemark.table import TimeSeriesTable

T0 = datetime(1970, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return datetime(1970, 1, 1) + timedelta(seconds=seconds)


def rows(seconds, symbol="A"):
    return pa.table({"ts": pa.array([at(s) for s in seconds], pa.timestamp("us")), "symbol": [symbol] * len(seconds), "price": [1.0 * s for s in seconds]})


def test_bucket_grammar():
    assert TimeBucket.parse("15 mins").width_seconds == 900
    assert TimeBucket.parse("1d").width_seconds == 86400
    for bad in ("", "0s", "1w", "-1h"):
        with pytest.raises(TidemarkError):
            TimeBucket.parse(bad)


def test_bucket_arithmetic():
    spec = IndexSpec.integer("i", 10)
    assert [spec.ordinal(v) for v in (-11, -10, -1, 0, 9, 10)] == [-2, -1, -1, 0, 0, 1]
    assert spec.bucket_id(-1) == SIGN - 1
    assert spec.bucket_range(spec.ordinal(SIGN - 1))[1] == SIGN
    wide = IndexSpec.integer("i", (1 << 64) - 1, unsigned=True)
    assert wide.ordinal((1 << 64) - 1) == 1 and wide.bucket_id(1) == 1


def test_coverage_pipeline(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m"))
    for part in ([1, 61], [180], [240, 300], [480]):
        table.append(rows(part))
    assert table.version == 5
    again = TimeSeriesTable.open(spark, tmp_path / "t")
    end = lambda s: T0 + timedelta(seconds=s)
    assert again.coverage_ratio(T0, end(360)) == pytest.approx(5 / 6)
    assert again.max_gap(T0, end(360)) == 1
    ids = lambda a, b: (SIGN + a, SIGN + b)
    assert again.last_fully_covered_window(end(360), 2) == ids(4, 5)
    assert again.last_fully_covered_window(end(180), 2) == ids(0, 1)
    assert again.last_fully_covered_window(end(600), 2) == ids(4, 5)
    assert again.last_fully_covered_window(end(600), 3) == ids(3, 5)
    assert again.last_fully_covered_window(end(600), 4) is None
    assert again.missing_runs(T0, end(600)) == [ids(2, 2), ids(6, 7), ids(9, 9)]
    assert again.read().count() == 6
    assert [s.path for s in again.candidates(end(60), end(120))] == [again.state.ordered()[0].path]
    assert again.scan(end(61), end(240)).count() == 2
    # a lost sidecar is computed again from its segments
    assert all(again.intact(s.coverage) for s in again.state.ordered())
    for f in (tmp_path / "t" / again.state.ordered()[1].coverage).glob("*"):
        f.unlink()
    assert again.max_gap(T0, end(600)) == 2


def test_overlap_and_rollback(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m", ["symbol"]))
    table.append(rows([0, 60]))
    table.append(rows([0, 60], "B"))
    before = sorted(p.name for p in (tmp_path / "t").rglob("*") if p.is_file())
    with pytest.raises(CoverageOverlapError) as e:
        table.append(rows([30, 61, 120], "B"))
    assert e.value.overlap_count == 2 and e.value.entity == ("B",) and e.value.bucket_id == SIGN
    assert sorted(p.name for p in (tmp_path / "t").rglob("*") if p.is_file()) == before
    assert table.coverage_ratio(T0, T0 + timedelta(seconds=180), {"symbol": "B"}) == pytest.approx(2 / 3)
    assert table.coverage_ratio(T0, T0 + timedelta(seconds=180), {"symbol": "Z"}) == 0.0
    with pytest.raises(EntityError):
        table.coverage_ratio(T0, T0 + timedelta(seconds=180))
    other = TimeSeriesTable.open(spark, tmp_path / "t")
    other.append(rows([600], "C"))
    with pytest.raises(ConflictError):
        table.append(rows([700], "C"))
    assert table.refresh() and table.version == 4 and not table.refresh()


def test_snapshot_and_kept_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.table.COMPACT", 3)
    monkeypatch.setattr("tidemark.sources.log.EVERY", 2)
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m"))
    for k in range(5):
        table.append(rows([60 * k, 60 * k + 1]))
    assert table.state.coverage and len(table.state.pending) == 2
    kept = sorted(p.name for p in (tmp_path / "t" / "_coverage").iterdir())
    assert len(kept) == 6 and not any(n.startswith(".") for n in kept)  # one an append and one snapshot, no orphan
    again = TimeSeriesTable.open(spark, tmp_path / "t")
    assert again.state == table.state and again._log._kept(6).version == 6
    (tmp_path / "t" / "_log" / "0000000006.state.json").write_text("{")
    assert TimeSeriesTable.open(spark, tmp_path / "t").state == table.state
    end = T0 + timedelta(minutes=6)
    assert table.coverage_runs().count() == 1 and table.max_gap(T0, end) == 1
    for f in (tmp_path / "t" / table.state.coverage).glob("*"):
        f.unlink()
    assert table.coverage_runs().count() == 1 and table.max_gap(T0, end) == 1
    table.state.segments = {p: replace(s, coverage=None) for p, s in table.state.segments.items()}
    with pytest.raises(MissingCoverageError):
        table.max_gap(T0, end)


def test_overlap_of_runs(spark):
    from tidemark.operators import coverage as C

    r = random.Random(1)
    kind = "k string, first bigint, last bigint"

    def some(span):
        out, at = [], r.randint(-3 * span, 0)
        for _ in range(r.randint(0, 12)):
            at += r.randint(2, span)
            out.append(("a", at, at + r.randint(0, span)))
            at = out[-1][2]
        return out

    for span in (5, C.SPAN // 2):
        for _ in range(3):
            a, b = some(span), some(span)
            left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
            want = sum(max(0, min(x[2], y[2]) - max(x[1], y[1]) + 1) for x in a for y in b)
            assert (C.overlapping_runs(left, right, ["k"]).selectExpr("sum(last - first + 1)").first()[0] or 0) == want
            union, last = 0, None
            for _, s, e in sorted(a + b, key=lambda x: x[1]):
                union += max(0, e - max(s, last + 1 if last is not None else s) + 1)
                last = e if last is None else max(last, e)
            found = sorted((x["first"], x["last"]) for x in C.merged(left.union(right), ["k"]).collect())
            assert sum(e - s + 1 for s, e in found) == union and all(p[1] + 1 < q[0] for p, q in zip(found, found[1:]))
            low, high = -span, span
            marks = [low - 1] + [v for _, s, e in sorted(a, key=lambda x: x[1]) for v in (max(s, low), min(e, high)) if s <= high and e >= low] + [high + 1]
            gaps = [q - p - 1 for p, q in zip(marks[::2], marks[1::2])]
            got = C.max_gap(left, ["k"], low, high).collect()
            assert [g["max_gap"] for g in got] == ([max(gaps)] if a else []) and C.max_gap(left.drop("k"), [], low, high).first()[0] == max(gaps)


def test_identity_errors(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m", ["symbol"]))
    table.append(rows([0]))
    end = T0 + timedelta(minutes=1)
    for given, error in (({}, MissingEntityError), ({"symbol": None}, MissingEntityError), ({"symbol": "A", "x": 1}, UnexpectedEntityError), ([("symbol", "A"), ("symbol", "B")], DuplicateEntityError), ({"symbol": 5}, EntityTypeError)):
        with pytest.raises(error):
            table.coverage_ratio(T0, end, given)
    plain = TimeSeriesTable.create(spark, tmp_path / "p", IndexSpec.timestamp("ts", "1m"))
    with pytest.raises(EntityNotConfiguredError):
        plain.coverage_ratio(T0, end, {"symbol": "A"})
    with pytest.raises(AlreadyExistsError):
        TimeSeriesTable.create(spark, tmp_path / "p", IndexSpec.timestamp("ts", "1m"))


def test_arrow_sources(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m", ["symbol"]))
    taken = []

    def batches():
        for k in range(4):
            taken.append(k)
            yield pa.record_batch({"ts": pa.array([at(60 * k)], pa.timestamp("ms")), "symbol": pa.array(["A"]).dictionary_encode(), "tags": [[{"a b": k}]]})

    first = next(batches())
    table.append(pa.RecordBatchReader.from_batches(first.schema, batches()), rows_per_group=2)
    (segment,) = table.state.ordered()
    import pyarrow.parquet as pq

    meta = pq.read_metadata(tmp_path / "t" / segment.path)
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [2, 2] and segment.rows == 4
    assert sorted(r["tags"][0]["a b"] for r in table.read().collect()) == [0, 1, 2, 3]
    assert {f["name"]: f["type"] for f in table.schema}["symbol"] == "utf8"

    class Stream:
        def __arrow_c_stream__(self, requested_schema=None):
            return pa.Table.from_batches([first.set_column(0, "ts", pa.array([at(600)], pa.timestamp("ms")))]).__arrow_c_stream__(requested_schema)

    table.append(Stream())
    table.append([first.set_column(0, "ts", pa.array([at(1200)], pa.timestamp("ms")))])
    assert table.read().count() == 6
    before = sorted(p.name for p in (tmp_path / "t").rglob("*"))

    def broken():
        yield first.set_column(0, "ts", pa.array([at(3000)], pa.timestamp("ms")))
        raise OSError("the source broke")

    with pytest.raises(OSError, match="broke"):
        table.append(pa.RecordBatchReader.from_batches(first.schema, broken()))
    for empty in ([], first.slice(0, 0), pa.Table.from_batches([], first.schema)):
        with pytest.raises(EmptySourceError):
            table.append(empty)
    with pytest.raises(ValueError):
        table.append(first, rows_per_group=0)
    assert sorted(p.name for p in (tmp_path / "t").rglob("*")) == before


def test_frame_is_written_in_parallel(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m"))
    df = spark.range(0, 4000, 1, 4).selectExpr("timestamp_seconds(id) AS ts", "id AS v")
    table.append(df.repartition(3), max_segments=3)
    assert len(table.state.segments) == 3 and table.read().count() == 4000
    assert table.coverage_runs().count() == 1  # minutes that two segments share count once


def test_rollback_error(spark, tmp_path, monkeypatch):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m"))
    table.append(rows([0]))

    def stuck(path):
        raise OSError("stuck")

    monkeypatch.setattr("tidemark.table.shutil.rmtree", stuck)
    with pytest.raises(RollbackError) as e:
        table.append(rows([1]))
    assert isinstance(e.value.original, CoverageOverlapError) and e.value.failures


def test_ambiguous_commit(spark, tmp_path, monkeypatch):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m"))
    real = os.replace

    def lost(a, b):
        if str(b).endswith("CURRENT"):
            raise OSError("gone")
        return real(a, b)

    monkeypatch.setattr("tidemark.sources.log.os.replace", lost)
    with pytest.raises(AmbiguousCommitError):
        table.append(rows([0]))
    monkeypatch.undo()
    assert list((tmp_path / "t" / "data").glob("*.parquet"))  # the commit may stand, so its files do


def test_schema_rules(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.integer("i", 10))
    table.append(pa.table({"i": pa.array([1], pa.int64()), "x": pa.array([1.0], pa.float64())}))
    table.append(pa.table({"x": pa.array([2.5], pa.float32()), "i": pa.array([11], pa.int32())}))
    assert sorted(r["x"] for r in table.read().collect()) == [1.0, 2.5]
    for bad in ({"i": pa.array([50], pa.int64())}, {"i": pa.array([50], pa.int64()), "x": pa.array(["a"])}, {"i": pa.array([50], pa.int64()), "x": pa.array([1.0]), "y": [1]}, {"i": pa.array([], pa.int64()), "x": pa.array([], pa.float64())}):
        with pytest.raises(SchemaMismatchError):
            table.append(pa.table(bad))
    with pytest.raises(TypeError):
        table.append(42)


def test_unsigned_index(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.integer("i", 1, unsigned=True))
    for v in ([0], [(1 << 63) - 1], [1 << 63, (1 << 63) + 1]):
        table.append(pa.table({"i": pa.array(v, pa.uint64()), "tag": [str(x) for x in v]}))
    assert sorted(int(r["tag"]) for r in table.scan((1 << 63) - 1, (1 << 63) + 1).collect()) == [(1 << 63) - 1, 1 << 63]


def test_optimize(spark, tmp_path):
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m", ["symbol"]))
    table.append(pa.concat_tables([rows([0, 60], "A"), rows([0], "B")]))
    table.append(rows([600], "C"))
    before = sorted(map(tuple, table.read().collect()))
    report = table.optimize()
    assert (report.sources, report.outputs, report.rows, report.identities) == (1, 2, 3, 2)
    assert sorted(map(tuple, table.read().collect())) == before
    assert {s.layout for s in table.state.segments.values()} == {"single"}
    assert table.optimize().sources == 0
    assert [s.identity for s in table.candidates(T0, T0 + timedelta(hours=1), ("B",))] == [("B",)]


def test_log_corruption(spark, tmp_path):
    with pytest.raises(StorageError):
        TimeSeriesTable.open(spark, tmp_path / "none")
    (tmp_path / "e").mkdir()
    with pytest.raises(EmptyTableError):
        TimeSeriesTable.open(spark, tmp_path / "e")
    table = TimeSeriesTable.create(spark, tmp_path / "t", IndexSpec.timestamp("ts", "1m"))
    table.append(rows([0]))
    commit = tmp_path / "t" / "_log" / "0000000002.json"
    good = commit.read_text()
    for bad in ("{", good.replace('"base": 1', '"base": 0'), good.replace('"add"', '"put"'), good.replace("data/", "../data/")):
        commit.write_text(bad)
        with pytest.raises(LogCorruptError):
            TimeSeriesTable.open(spark, tmp_path / "t")
    for bad in ("", "s3://x/y"):
        with pytest.raises(StorageError):
            TimeSeriesTable.open(spark, bad)

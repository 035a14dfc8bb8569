"""Every catalog query answers as its SQL twin does on DuckDB."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

from tidemark.plans import catalog, roundtrips  # noqa: F401 - the latter adds to the catalog

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in catalog.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(v):
    """A value that is equal in both engines up to number types and the sixth digit of floats."""
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6g}" if abs(v) < 100_000 else str(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in sorted(names)] for r in df.collect()) == want

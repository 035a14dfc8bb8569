"""Bucket arithmetic and time bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import SIGN, IndexSpec

#: Microseconds of the fixed strides.
MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros(ts: Column) -> Column:
    """Microseconds since 1970. A timestamp without zone is read in the session's zone, which is UTC here."""
    return F.unix_micros(ts.cast("timestamp"))


def floor_div(value: Column, width: int) -> Column:
    """Quotient rounded down, of a bigint by a positive constant; no step can overflow."""
    if width >= SIGN:  # wider than any bigint: only the sign is left
        return F.when(value < 0, F.lit(-1)).when(value >= 0, F.lit(0)).cast("bigint")
    w = F.lit(width).cast("bigint")
    return F.call_function("div", value, w) - F.when(value % w < 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def ordinal(spec: IndexSpec, value: Column | None = None) -> Column:
    """Bucket ordinal of the index column: bigint, or decimal(20,0) for an unsigned index."""
    value = F.col(spec.column) if value is None else value
    if spec.kind == "timestamp":
        return floor_div(micros(value), spec.width)
    if spec.kind == "int64":
        return floor_div(value.cast("bigint"), spec.width)
    wide, w = value.cast("decimal(20,0)"), F.lit(spec.width).cast("decimal(20,0)")
    return ((wide - wide % w) / w).cast("decimal(20,0)")


def date_bin(stride_micros: int, ts: Column, origin_micros: int = 0) -> Column:
    """Start of the fixed-stride bin of ts, counted from origin, as a timestamp without zone."""
    shifted = micros(ts) - F.lit(origin_micros)
    return F.timestamp_micros(floor_div(shifted, stride_micros) * F.lit(stride_micros) + F.lit(origin_micros)).cast("timestamp_ntz")


def date_bin_months(months: int, ts: Column, origin: Column) -> Column:
    """Start of the whole-month bin of ts counted from origin; month ends are clamped from the origin's day."""
    ts, origin = ts.cast("timestamp_ntz"), origin.cast("timestamp_ntz")
    span = (F.year(ts) - F.year(origin)) * 12 + F.month(ts) - F.month(origin)
    steps = floor_div(span.cast("bigint"), months).cast("int")
    at = lambda n: origin + F.make_ym_interval(F.lit(0), n * months)
    return F.when(at(steps) > ts, at(steps - 1)).otherwise(at(steps))


def to_unixtime(ts: Column) -> Column:
    """Whole seconds since 1970, rounded towards zero."""
    return F.call_function("div", micros(ts), F.lit(1_000_000).cast("bigint"))

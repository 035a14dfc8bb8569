"""Coverage algebra on DataFrames.

A coverage is a DataFrame of (entity columns..., bucket) with distinct rows, bucket being a signed ordinal.
Its compact form is runs: (entity columns..., first, last) of maximal stretches. All answers per entity are
window or group plans over one shuffle on the entity columns; answers about a range take it as inclusive
ordinals. Windows partitioned by nothing are avoided: a coverage without entities is dealt by stretches of
SPAN ordinals, runs are found inside each, and only the runs at their borders are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import ordinal
from ..model import IndexSpec

#: Ordinals in a stretch.
SHIFT = 20
SPAN = 1 << SHIFT


def stretch(at: Column, kind: T.DataType) -> Column:
    """Stretch of an ordinal. A bigint is shifted: dividing it would go through a double."""
    return F.shiftright(at, SHIFT) if isinstance(kind, T.LongType) else F.floor(at / F.lit(SPAN)).cast("bigint")


def coverage(df: DataFrame, spec: IndexSpec, keys: list[str] | None = None) -> DataFrame:
    """Distinct (entities..., bucket) of the rows with an index value."""
    keys = list(spec.entities) if keys is None else keys
    return df.where(F.col(spec.column).isNotNull()).select(*keys, ordinal(spec).alias("bucket")).distinct()


def runs(cov: DataFrame, keys: list[str], carry: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """(keys..., first, last): maximal stretches of consecutive buckets. carry: further columns and how they are
    put together, by an associative aggregate; rows without bucket make one run without ends."""
    carry = carry or {}
    b = F.col("bucket")
    part = stretch(b, cov.schema["bucket"].dataType)
    w = Window.partitionBy(*keys, "__part").orderBy("bucket")
    put = lambda: [fn(c).alias(c) for c, fn in carry.items()]
    out = [*keys, "first", "last", *carry]
    inside = cov.withColumn("__part", part).withColumn("__island", b - F.row_number().over(w))
    pieces = inside.groupBy(*keys, "__part", "__island").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), *put()).select(*out)
    # stretches that touch a border may go on beyond it; the others are runs already
    edge = F.coalesce((F.pmod(F.col("first"), F.lit(SPAN)) == 0) | (F.pmod(F.col("last"), F.lit(SPAN)) == SPAN - 1), F.lit(False))
    over = border_window(keys)
    starts = pieces.where(edge).withColumn("__new", F.when(F.lag("last").over(over) == F.col("first") - 1, 0).otherwise(1))
    joined = starts.withColumn("__run", F.sum("__new").over(over)).groupBy(*keys, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), *put()).select(*out)
    return pieces.where(~edge).unionByName(joined)


def border_window(keys: list[str]) -> WindowSpec:
    """Runs in order. Without keys it is one task, whose input is runs that touch a border only."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("first")


def cut(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., __part, first, last): runs cut at multiples of SPAN. A run has at most as many buckets as the
    table has rows, so it is cut into few pieces."""
    kind = found.schema["first"].dataType
    at = F.explode(F.sequence(stretch(F.col("first"), kind), stretch(F.col("last"), kind))).alias("__part")
    start = F.col("__part").cast(kind) * F.lit(SPAN).cast(kind)
    low, high = F.greatest(F.col("first"), start.cast(kind)), F.least(F.col("last"), (start + F.lit(SPAN - 1)).cast(kind))
    return found.select(*keys, "first", "last", at).select(*keys, "__part", low.alias("first"), high.alias("last"))


def reached(keys: list[str]) -> Column:
    """Furthest end of the pieces that start before, in this piece's stretch."""
    w = Window.partitionBy(*keys, "__part").orderBy("first", "last")
    return F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))


def merged(found: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of runs that may touch or overlap, without unfolding them into buckets: inside stretches of
    SPAN ordinals, then at their borders, as in runs()."""
    w = Window.partitionBy(*keys, "__part").orderBy("first", "last")
    flagged = cut(found, keys).withColumn("__new", F.when(reached(keys) >= F.col("first") - 1, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = flagged.groupBy(*keys, "__part", "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(*keys, "first", "last")
    edge = (F.pmod(F.col("first"), F.lit(SPAN)) == 0) | (F.pmod(F.col("last"), F.lit(SPAN)) == SPAN - 1)
    over = border_window(keys)
    starts = pieces.where(edge).withColumn("__new", F.when(F.lag("last").over(over) == F.col("first") - 1, 0).otherwise(1))
    joined = starts.withColumn("__run", F.sum("__new").over(over)).groupBy(*keys, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(*keys, "first", "last")
    return pieces.where(~edge).unionByName(joined)


def split_covered(rows: DataFrame, found: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """rows with a flag __late: whether their (identity, bucket) lies in one of the runs found. The runs meet the
    distinct buckets only, at most SPAN of them in a task; rows without bucket are not late."""
    at = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    tagged = rows.withColumn("__bucket", bucket)
    cells = tagged.where("__bucket is not null").select(*at, F.col("__bucket").alias("first"), F.lit(None).cast(found.schema["last"].dataType).alias("last")).distinct()
    parted = cells.withColumn("__part", stretch(F.col("first"), cells.schema["first"].dataType)).select(*names, "__part", "first", "last", F.lit(1).alias("__cell"))
    held = cut(found.select(*at, "first", "last"), names).withColumn("__cell", F.lit(0))
    # a run goes before the bucket it starts at, so a bucket sees all runs that start at or before it
    w = Window.partitionBy(*names, "__part").orderBy("first", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    late = parted.unionByName(held).withColumn("__reached", F.max("last").over(w)).where((F.col("__cell") == 1) & (F.col("__reached") >= F.col("first")))
    late = late.select(*names, F.col("first").alias("__b"), F.lit(True).alias("__hit"))
    on = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return tagged.join(late, on, "left").select(*rows.columns, F.coalesce("__hit", F.lit(False)).alias("__late"))


def clip(found: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Runs inside [low, high]."""
    inside = found.where((F.col("last") >= low) & (F.col("first") <= high))
    return inside.select(*keys, F.greatest("first", F.lit(low).cast("bigint")).alias("first"), F.least("last", F.lit(high).cast("bigint")).alias("last"))


def ratio(cov: DataFrame, keys: list[str], low: int, high: int, entities: DataFrame | None = None) -> DataFrame:
    """(keys..., covered, total, ratio) over [low, high]; 1.0 if the range is empty. entities: identities to answer even if absent."""
    total = max(0, high - low + 1)
    found = cov.where(F.col("bucket").between(low, high)).groupBy(*keys).agg(F.count(F.lit(1)).alias("covered"))
    if entities is not None:
        found = entities.join(found, keys, "left").select(*keys, F.coalesce("covered", F.lit(0)).alias("covered"))
    share = F.lit(1.0) if total == 0 else F.col("covered") / F.lit(float(total))
    return found.select(*keys, "covered", F.lit(total).cast("bigint").alias("total"), share.alias("ratio"))


def missing_runs(found: DataFrame, keys: list[str], low: int, high: int, longest: int | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(keys..., first, last) of uncovered stretches of [low, high], cut to at most longest buckets (0: none)."""
    if high < low or longest == 0:
        return found.select(*keys, "first", "last").limit(0)
    if entities is None:
        entities = found.select(*keys).distinct() if keys else found.sparkSession.range(1).select()
    ends = entities.select(*keys, F.explode(F.array(F.struct(F.lit(low - 1).cast("bigint").alias("first"), F.lit(low - 1).cast("bigint").alias("last")), F.struct(F.lit(high + 1).cast("bigint").alias("first"), F.lit(high + 1).cast("bigint").alias("last")))).alias("r")).select(*keys, "r.*")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    marks = clip(found, keys, low, high).unionByName(ends)
    gaps = marks.select(*keys, (F.col("last") + 1).alias("s"), (F.lead("first").over(w.orderBy("first")) - 1).alias("e")).where("e is not null and s <= e")
    if longest is None:
        return gaps.select(*keys, F.col("s").alias("first"), F.col("e").alias("last"))
    cut = gaps.select(*keys, "e", F.explode(F.sequence("s", "e", F.lit(longest).cast("bigint"))).alias("first"))
    return cut.select(*keys, "first", F.least("e", F.col("first") + longest - 1).alias("last"))


def max_gap(found: DataFrame, keys: list[str], low: int, high: int, entities: DataFrame | None = None) -> DataFrame:
    """(keys..., max_gap): buckets in the longest uncovered stretch, 0 if none. One window over the runs: every
    identity's runs outside the range stay in as marks, so an identity needs no run inside to be answered."""
    if high < low:
        ids = found.select(*keys).distinct() if keys else found.sparkSession.range(1).select()
        return (ids if entities is None else entities).select(*keys, F.lit(0).cast("bigint").alias("max_gap"))
    kind = found.schema["first"].dataType
    whole = F.lit(high - low + 1).cast("bigint")
    edge = lambda v: F.lit(v).cast(kind)
    inside = found.where((F.col("last") >= low) & (F.col("first") <= high)) if not keys else found
    marks = inside.select(*keys, F.least(F.greatest("first", edge(low)), edge(high + 1)).alias("first"), F.greatest(F.least("last", edge(high)), edge(low - 1)).alias("last"))
    gap = F.col("first") - F.max("last").over(border_window(keys).rowsBetween(Window.unboundedPreceding, -1)) - 1
    steps = marks.select(*keys, F.coalesce(gap, F.col("first") - edge(low)).alias("before"), "last")
    gaps = steps.groupBy(*keys).agg(F.greatest(F.max("before"), edge(high) - F.max("last")).cast("bigint").alias("max_gap"))
    if not keys:
        return gaps.select(F.coalesce("max_gap", whole).alias("max_gap"))
    if entities is None:
        return gaps
    return entities.join(gaps, keys, "left").select(*keys, F.coalesce("max_gap", whole).alias("max_gap"))


def last_window(found: DataFrame, keys: list[str], last: int, length: int) -> DataFrame:
    """(keys..., first, last) of the last covered window of length buckets that ends at or before last."""
    if length <= 0:
        return found.select(*keys, "first", "last").limit(0)
    cut = found.where(F.col("first") <= last).select(*keys, "first", F.least("last", F.lit(last).cast("bigint")).alias("last")).where(F.col("last") - F.col("first") + 1 >= length)
    best = cut.groupBy(*keys).agg(F.max("last").alias("last")).where("last is not null")
    return best.select(*keys, (F.col("last") - length + 1).alias("first"), "last")


def last_run(found: DataFrame, keys: list[str], low: int, high: int, least: int) -> DataFrame:
    """(keys..., first, last) of the last run inside [low, high] of at least least buckets; none for 0."""
    if least <= 0:
        return found.select(*keys, "first", "last").limit(0)
    cut = clip(found, keys, low, high).where(F.col("last") - F.col("first") + 1 >= least)
    return cut.groupBy(*keys).agg(F.max_by("first", "last").alias("first"), F.max("last").alias("last")).where("last is not null")


def union(*covs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, covs).distinct()


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, [*keys, "bucket"], "left_semi")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(count, keys..., bucket): how many (identity, bucket) both cover, and the first in identity order."""
    both = intersect(a, b, keys)
    first: Column = F.min(F.struct(*keys, "bucket")).alias("first")
    return both.agg(F.count(F.lit(1)).alias("overlap_count"), first).select("overlap_count", *(F.col(f"first.{k}").alias(k) for k in keys), F.col("first.bucket").alias("bucket"))


def from_runs(found: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage of runs, for algebra that needs single buckets."""
    return found.select(*keys, F.explode(F.sequence("first", "last")).alias("bucket"))


def overlapping_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches that runs a and b share, each side's runs being disjoint. One window over both: what starts
    before and reaches into a run is the other side's, so nothing is unfolded and no pair is formed."""
    both = cut(a.select(*keys, "first", "last"), keys).unionByName(cut(b.select(*keys, "first", "last"), keys))
    return both.withColumn("__reached", reached(keys)).where("__reached >= first").select(*keys, "first", F.least("last", "__reached").alias("last"))

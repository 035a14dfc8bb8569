"""Index specification, buckets and segment metadata: plain values on the driver."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta, timezone
from typing import Any

from .errors import DuplicateEntityError, EntityNotConfiguredError, EntityTypeError, MissingEntityError, RangeError, TidemarkError, UnexpectedEntityError

FORMAT_VERSION = 2
U64 = 1 << 64
SIGN = 1 << 63
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
#: Accepted unit names.
UNIT_NAMES = {
    "s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s",
    "m": "m", "min": "m", "mins": "m", "minute": "m", "minutes": "m",
    "h": "h", "hr": "h", "hrs": "h", "hour": "h", "hours": "h",
    "d": "d", "day": "d", "days": "d",
}
ENTITY_TYPES = ("utf8", "int32", "int64", "uint64")


@dataclass(frozen=True)
class TimeBucket:
    count: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> TimeBucket:
        m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
        if not m or m[2].lower() not in UNIT_NAMES or not 0 < int(m[1]) < 1 << 32:
            raise TidemarkError(f"not a bucket: {text!r}; write a positive number and a unit, as in 15m or 1h")
        return cls(int(m[1]), UNIT_NAMES[m[2].lower()])

    @property
    def width_seconds(self) -> int:
        return self.count * UNITS[self.unit]

    def __str__(self) -> str:
        return f"{self.count}{self.unit}"


@dataclass(frozen=True)
class IndexSpec:
    """One ordered index column, its buckets, and the entity columns in identity order.

    kind is timestamp, int64 or uint64; width counts microseconds for timestamps.
    """

    column: str
    kind: str
    width: int
    entities: tuple[str, ...] = ()
    timezone: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("timestamp", "int64", "uint64"):
            raise TidemarkError(f"unknown index kind {self.kind!r}")
        if not self.column or any(not e for e in self.entities):
            raise TidemarkError("column names may not be empty")
        if len(set(self.entities)) < len(self.entities) or self.column in self.entities:
            raise TidemarkError("entity columns must be distinct and differ from the index column")
        if not 0 < self.width < U64:
            raise TidemarkError("the bucket width must be positive")

    @classmethod
    def timestamp(cls, column: str, bucket: str | TimeBucket, entities: tuple[str, ...] | list[str] = (), timezone: str | None = None) -> IndexSpec:
        b = TimeBucket.parse(bucket) if isinstance(bucket, str) else bucket
        return cls(column, "timestamp", b.width_seconds * 1_000_000, tuple(entities), timezone)

    @classmethod
    def integer(cls, column: str, width: int, entities: tuple[str, ...] | list[str] = (), unsigned: bool = False) -> IndexSpec:
        return cls(column, "uint64" if unsigned else "int64", width, tuple(entities))

    # values are microseconds since 1970 for timestamps, else the integers themselves
    def unit_value(self, value: Any) -> int:
        if self.kind == "timestamp":
            if not isinstance(value, datetime):
                raise RangeError(f"{value!r} is not a timestamp")
            aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
            return (aware - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        if isinstance(value, bool) or not isinstance(value, int):
            raise RangeError(f"{value!r} is not an integer")
        low, high = (0, U64) if self.kind == "uint64" else (-SIGN, SIGN)
        if not low <= value < high:
            raise RangeError(f"{value} is outside {self.kind}")
        return value

    def user_value(self, unit: int) -> Any:
        if self.kind == "timestamp":
            return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=unit)
        return unit

    def ordinal(self, unit: int) -> int:
        return unit // self.width

    def bucket_id(self, ordinal: int) -> int:
        """Public unsigned id: signed ordinals have their sign bit flipped."""
        return ordinal if self.kind == "uint64" else ordinal + SIGN

    def ordinal_of(self, bucket_id: int) -> int:
        return bucket_id if self.kind == "uint64" else bucket_id - SIGN

    def bucket_range(self, ordinal: int) -> tuple[int, int]:
        """[start, end) in units, clipped to the domain; at its top the end is one past the largest value."""
        low, high = (0, U64) if self.kind == "uint64" else (-SIGN, SIGN)
        return max(low, ordinal * self.width), min(high, (ordinal + 1) * self.width)

    def range_ordinals(self, start: Any, end: Any) -> tuple[int, int]:
        """First and last bucket of the half-open [start, end)."""
        s, e = self.unit_value(start), self.unit_value(end)
        if s >= e:
            raise RangeError(f"start {start!r} is not before end {end!r}")
        return self.ordinal(s), self.ordinal(e - 1)

    def last_ordinal(self, end: Any) -> int:
        return self.ordinal(self.unit_value(end) - 1)

    def identity(self, entity: Any, types: dict[str, str] | None = None) -> tuple | None:
        """Ordered identity of named components: a mapping, or (name, value) pairs. types: logical types of the columns."""
        pairs = list(entity.items()) if isinstance(entity, dict) else list(entity or ())
        names = [n for n, _ in pairs]
        if not self.entities:
            if pairs:
                raise EntityNotConfiguredError("the table has no entity columns")
            return None
        if repeated := sorted({n for n in names if names.count(n) > 1}):
            raise DuplicateEntityError(f"repeated entity component(s): {', '.join(repeated)}")
        given = dict(pairs)
        if missing := [c for c in self.entities if given.get(c) is None]:
            raise MissingEntityError(f"missing entity component(s): {', '.join(missing)}")
        if extra := sorted(set(given) - set(self.entities)):
            raise UnexpectedEntityError(f"unexpected entity component(s): {', '.join(extra)}")
        for c in self.entities if types else ():
            v, kind = given[c], types[c]
            low, high = {"int32": (-(1 << 31), 1 << 31), "int64": (-SIGN, SIGN), "utf8": (0, 0)}.get(kind, (0, U64))
            if not isinstance(v, str) if kind == "utf8" else isinstance(v, bool) or not isinstance(v, int) or not low <= v < high:
                raise EntityTypeError(f"entity component {c} is {kind}, not {v!r}")
        return tuple(given[c] for c in self.entities)

    def to_json(self) -> dict:
        return asdict(self) | {"entities": list(self.entities)}

    @classmethod
    def from_json(cls, d: dict) -> IndexSpec:
        return cls(d["column"], d["kind"], d["width"], tuple(d["entities"]), d.get("timezone"))


@dataclass(frozen=True)
class SegmentMeta:
    """One Parquet file. low and high are inclusive bounds in units; layout is none, single or mixed; coverage
    is the sidecar that holds the file's runs of covered buckets."""

    path: str
    low: int
    high: int
    rows: int
    size: int
    layout: str = "none"
    identity: tuple | None = None
    coverage: str | None = None

    @property
    def order(self) -> tuple:
        return self.low, self.high, self.path

    def to_json(self) -> dict:
        return asdict(self) | {"identity": None if self.identity is None else list(self.identity)}

    @classmethod
    def from_json(cls, d: dict) -> SegmentMeta:
        return cls(**d | {"identity": None if d.get("identity") is None else tuple(d["identity"])})


@dataclass
class TableState:
    """The fold of the log up to version. coverage is the last snapshot of all runs, pending the sidecars
    written since, batches the last stream batch of each stream that appends."""

    version: int = 0
    spec: IndexSpec | None = None
    schema: list[dict] | None = None
    created_at: str = ""
    segments: dict[str, SegmentMeta] = field(default_factory=dict)
    coverage: str | None = None
    pending: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)

    def ordered(self) -> list[SegmentMeta]:
        return sorted(self.segments.values(), key=lambda s: s.order)

    def copy(self) -> TableState:
        return replace(self, segments=dict(self.segments), pending=list(self.pending), batches=dict(self.batches))

    def to_json(self) -> dict:
        return {
            "format": FORMAT_VERSION, "version": self.version, "index": self.spec.to_json(), "schema": self.schema, "created_at": self.created_at,
            "segments": [s.to_json() for s in self.segments.values()], "coverage": self.coverage, "pending": self.pending, "batches": self.batches,
        }

    @classmethod
    def from_json(cls, d: dict) -> TableState:
        segments = {s.path: s for s in map(SegmentMeta.from_json, d["segments"])}
        return cls(d["version"], IndexSpec.from_json(d["index"]), d["schema"], d["created_at"], segments, d["coverage"], list(d["pending"]), dict(d["batches"]))


@dataclass(frozen=True)
class OptimizeReport:
    version: int
    sources: int = 0
    outputs: int = 0
    rows: int = 0
    source_bytes: int = 0
    output_bytes: int = 0
    identities: int = 0
    single_before: int = 0
    single_after: int = 0

"""Logical schemas: what a table's columns are, adopted once and then fixed but for lossless widening."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import types as T

from ..errors import IndexColumnError, SchemaMismatchError
from ..model import IndexSpec

#: Incoming type to the stored types it may widen to.
WIDENINGS = {
    "int8": ("int32", "int64"), "int16": ("int32", "int64"), "int32": ("int64",),
    "uint8": ("uint64",), "uint16": ("uint64",), "uint32": ("uint64",), "float32": ("float64",),
}
SIMPLE = {
    "bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(),
    "binary": T.BinaryType(), "utf8": T.StringType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(),
}
ARROW = {
    "bool": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "uint8": pa.uint8(), "uint16": pa.uint16(), "uint32": pa.uint32(),
    "uint64": pa.uint64(), "float32": pa.float32(), "float64": pa.float64(), "binary": pa.binary(), "utf8": pa.string(),
}


def type_name(t: pa.DataType) -> str:
    """Logical name of an Arrow type; raises for types that tables don't store."""
    if pa.types.is_dictionary(t):  # stored as its values
        return type_name(t.value_type)
    for name, arrow in ARROW.items():
        if t == arrow:
            return name
    if pa.types.is_timestamp(t) and t.unit in ("ms", "us"):
        return f"timestamp[{t.tz or ''}]"
    if pa.types.is_decimal(t) and t.precision <= 38:
        return f"decimal({t.precision},{t.scale})"
    if pa.types.is_fixed_size_binary(t):
        return f"binary({t.byte_width})"
    if pa.types.is_struct(t):
        names = [f.name for f in t]
        if not names or len(set(names)) < len(names) or any(not n.strip() for n in names):
            raise SchemaMismatchError(f"struct fields must be named, once each: {t}")
        quoted = lambda n: n if re.fullmatch(r"[A-Za-z_]\w*", n, re.A) else json.dumps(n)
        return "struct<" + ",".join(f"{quoted(f.name)}:{type_name(f.type)}{'' if f.nullable else '!'}" for f in t) + ">"
    if pa.types.is_list(t):
        return f"list<{type_name(t.value_type)}>"
    if pa.types.is_map(t):
        return f"map<{type_name(t.key_type)},{type_name(t.item_type)}>"
    raise SchemaMismatchError(f"type {t} can't be stored")


def from_arrow(schema: pa.Schema) -> list[dict]:
    if len(set(schema.names)) < len(schema.names):
        raise SchemaMismatchError("column names must be distinct")
    return [{"name": f.name, "type": type_name(f.type), "nullable": f.nullable} for f in schema]


def from_spark(schema: T.StructType) -> list[dict]:
    """Logical schema of a DataFrame; timestamps with zone carry UTC."""

    def arrow(t: T.DataType) -> pa.DataType:
        if isinstance(t, T.StructType):
            return pa.struct([pa.field(f.name, arrow(f.dataType), f.nullable) for f in t])
        if isinstance(t, T.ArrayType):
            return pa.list_(arrow(t.elementType))
        if isinstance(t, T.MapType):
            return pa.map_(arrow(t.keyType), arrow(t.valueType))
        if isinstance(t, T.TimestampNTZType):
            return pa.timestamp("us")
        if isinstance(t, T.TimestampType):
            return pa.timestamp("us", "UTC")
        if isinstance(t, T.DecimalType):
            return pa.decimal128(t.precision, t.scale)
        for name, spark in SIMPLE.items():
            if spark == t and name in ("bool", "int8", "int16", "int32", "int64", "float32", "float64", "binary", "utf8"):
                return ARROW[name]
        raise SchemaMismatchError(f"type {t.simpleString()} can't be stored")

    return [{"name": f.name, "type": type_name(arrow(f.dataType)), "nullable": f.nullable} for f in schema]


TYPE = re.compile(r'\s*(?:(timestamp\[[^\]]*\]|decimal\([^)]*\)|binary\(\d+\)|[A-Za-z_]\w*)|("(?:[^"\\]|\\.)*")|([<>:,!]))', re.A)


def spark_type(name: str) -> T.DataType:
    """Spark type of a logical name."""
    parts = [m.groups() for m in TYPE.finditer(name)]
    at = 0

    def take(sign: str | None = None) -> str:
        nonlocal at
        if at == len(parts) or sign and parts[at][2] != sign:
            raise SchemaMismatchError(f"{name} is not a type")
        word, quoted, mark = parts[at]
        at += 1
        return json.loads(quoted) if quoted else word or mark

    def follows(sign: str) -> bool:
        nonlocal at
        if at < len(parts) and parts[at][2] == sign:
            at += 1
            return True
        return False

    def one() -> T.DataType:
        word = take()
        if word == "struct" and follows("<"):
            fields = []
            while not fields or follows(","):
                label = take()
                take(":")
                kind = one()
                fields.append(T.StructField(label, kind, not follows("!")))
            take(">")
            return T.StructType(fields)
        if word in ("list", "map") and follows("<"):
            kinds = [one()]
            while follows(","):
                kinds.append(one())
            take(">")
            return T.ArrayType(*kinds) if word == "list" else T.MapType(*kinds)
        if word in SIMPLE:
            return SIMPLE[word]
        if word.startswith("timestamp["):
            return T.TimestampNTZType() if word == "timestamp[]" else T.TimestampType()
        if word.startswith("decimal("):
            return T.DecimalType(*map(int, word[8:-1].split(",")))
        if word.startswith("binary("):
            return T.BinaryType()
        raise SchemaMismatchError(f"{name} is not a type")

    found = one()
    if at < len(parts):
        raise SchemaMismatchError(f"{name} is not a type")
    return found


def spark_schema(fields: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(f["name"], spark_type(f["type"]), True) for f in fields])


def arrow_schema(schema: pa.Schema, casts: list[tuple[str, str | None]]) -> pa.Schema:
    """Arrow schema of a segment: the planned casts, dictionaries decoded, microseconds, unsigned 64-bit as decimal."""

    def stored(t: pa.DataType) -> pa.DataType:
        if pa.types.is_dictionary(t):
            return stored(t.value_type)
        if pa.types.is_timestamp(t):
            return pa.timestamp("us", t.tz)
        return pa.decimal128(20, 0) if t == pa.uint64() else t

    return pa.schema([pa.field(n, stored(ARROW[to] if to else schema.field(n).type)) for n, to in casts])


def zone_of(fields: list[dict] | None, spec: IndexSpec) -> str:
    """Zone in which the index's local days and hours are told: the column's own, else the declared one. A column
    without zone is told in UTC whatever is declared, as its buckets are."""
    found = next((f["type"] for f in fields or () if f["name"] == spec.column), "")
    if not found.startswith("timestamp[") or found == "timestamp[]":
        return "UTC"
    own = found[10:-1]
    return spec.timezone or own if own.upper() in ("UTC", "ETC/UTC", "Z", "+00:00") else own


def base_type(name: str) -> str:
    """Types that differ only in how a table stores them: an unsigned 64-bit column is a decimal in Spark."""
    return "uint64" if name == "decimal(20,0)" else "timestamp[z]" if name.startswith("timestamp[") and name != "timestamp[]" else name


def plan(stored: list[dict], incoming: list[dict]) -> list[tuple[str, str | None]]:
    """(column, type to cast to or None) in stored order; raises if the schemas don't fit."""
    given = {f["name"]: f for f in incoming}
    names = [f["name"] for f in stored]
    if missing := [n for n in names if n not in given]:
        raise SchemaMismatchError(f"missing column(s): {', '.join(missing)}")
    if extra := [n for n in given if n not in names]:
        raise SchemaMismatchError(f"unexpected column(s): {', '.join(extra)}")
    out = []
    for f in stored:
        g = given[f["name"]]
        if g["nullable"] and not f["nullable"]:
            raise SchemaMismatchError(f"column {f['name']} may not be null")
        if base_type(g["type"]) == base_type(f["type"]):
            out.append((f["name"], None))
        elif f["type"] in WIDENINGS.get(g["type"], ()):
            out.append((f["name"], f["type"]))
        else:
            raise SchemaMismatchError(f"column {f['name']} is {g['type']}, not {f['type']}")
    return out


def check_index(spec: IndexSpec, fields: list[dict]) -> None:
    """The index and entity columns must exist with fitting types."""
    types = {f["name"]: f["type"] for f in fields}
    if spec.column not in types:
        raise IndexColumnError(f"index column {spec.column} is missing")
    found = types[spec.column]
    fits = found.startswith("timestamp[") if spec.kind == "timestamp" else found == spec.kind or spec.kind == "uint64" and found in ("decimal(20,0)", "uint8", "uint16", "uint32") or spec.kind == "int64" and found in ("int8", "int16", "int32")
    if not fits:
        raise IndexColumnError(f"index column {spec.column} is {found}, not {spec.kind}")
    for e in spec.entities:
        if types.get(e) not in ("utf8", "int32", "int64", "uint64", "decimal(20,0)"):
            raise IndexColumnError(f"entity column {e} is {types.get(e, 'missing')}")

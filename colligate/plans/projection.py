"""Format plans: whether a record can be carried by a format, decided on the driver; and renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .schema import Contract, SchemaError, TypeRef

CONTAINERS = ("list", "set", "map", "group", "array")
#: Formats that can tell NULL from absent.
KEEPS_NULL = ("json", "yaml", "binary")


def admit(contract: Contract, type_name: str, format: str, typed: bool = True) -> None:
    """Raises where the format can't carry the record. typed: the flat route; else nested fields are flattened."""
    if format not in ("json", "yaml", "csv", "xml", "binary"):
        raise SchemaError(f"no format is named {format}")
    for f in contract.record(type_name).fields:
        nested = f.type.name in CONTAINERS or f.type.name in contract.records
        kind = contract.records[f.type.name].kind if f.type.name in contract.records else ""
        if f.nullable and format not in KEEPS_NULL:
            raise SchemaError(f"{type_name}.{f.name}: {format} can't carry NULL")
        if f.type.name == "varint" and format != "binary":
            raise SchemaError(f"{type_name}.{f.name}: {format} has no varint")
        if typed and format == "csv" and nested:
            raise SchemaError(f"{type_name}.{f.name}: a CSV row is flat")
        if typed and format == "xml" and (f.type.name in CONTAINERS or kind in ("union", "group")):
            raise SchemaError(f"{type_name}.{f.name}: XML has no {f.type.name}")


def canonical(df: DataFrame, contract: Contract, type_name: str) -> DataFrame:
    """A table with external or alias names to canonical names; absent fields are NULL."""
    columns = []
    for f in contract.record(type_name).fields:
        found = [F.col(f"`{n}`") for n in f.inputs if n in df.columns]
        columns.append((F.coalesce(*found) if found else F.lit(None)).cast(contract.spark_type(f.type)).alias(f.name))
    return df.select(*columns)


def renamed(df: DataFrame, contract: Contract, type_name: str) -> DataFrame:
    """A table with canonical names to external names."""
    return df.select(*[F.col(f.name).alias(f.external) for f in contract.record(type_name).fields])


def values(x: Column) -> Column:
    """The range of a list or set: position and value rows come from posexplode of it."""
    return F.transform(x, lambda v, i: F.struct(i.alias("position"), v.alias("value")))


def fields(contract: Contract, type_name: str, record: Column) -> Column:
    """The range of a record: name and text of each field, in declared order."""
    rows = [F.struct(F.lit(f.name).alias("name"), F.to_json(F.struct(record[f.name].alias("v"))).alias("value")) for f in contract.record(type_name).fields]
    return F.array(*rows)


def entries(x: Column) -> Column:
    """The range of a map, in insertion order."""
    return F.map_entries(x)


def same_value(contract: Contract, ref: TypeRef, a: Column, b: Column) -> Column:
    """Deep equality: sets and maps in any order, NULL equal to NULL."""
    return ordered(contract, ref, a).eqNullSafe(ordered(contract, ref, b))


def value_hash(contract: Contract, ref: TypeRef, x: Column) -> Column:
    return F.xxhash64(F.to_json(F.struct(ordered(contract, ref, x).alias("v"))))


def ordered(contract: Contract, ref: TypeRef, x: Column) -> Column:
    if ref.name == "map":
        return F.array_sort(F.map_entries(x))
    if ref.name == "set":
        return F.array_sort(x)
    if ref.name in contract.records:
        return F.when(x.isNotNull(), F.struct(*[ordered(contract, f.type, x[f.name]).alias(f.name) for f in contract.record(ref.name).fields]))
    return x


def has_any_bits(x: Column, mask: int) -> Column:
    return x.cast("long").bitwiseAND(F.lit(mask)) != 0


def has_all_bits(x: Column, mask: int) -> Column:
    return x.cast("long").bitwiseAND(F.lit(mask)) == mask

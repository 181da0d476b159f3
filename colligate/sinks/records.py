"""Sinks: typed records to JSON, YAML, XML and CSV text, under the names that the contract has for output."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.temporal import format_duration, format_rfc822
from ..plans.schema import SPARK, Contract, SchemaError, TypeRef


def external(contract: Contract, ref: TypeRef, x: Column, text_temporals: bool = True) -> Column:
    """The value under external names, through lists, maps and unions; enums by name, temporals as text."""
    if ref.name in contract.enums:
        e = contract.enums[ref.name]
        if e.flags:
            names = F.array(*[F.when(x.cast("long").bitwiseAND(F.lit(v)) == v, F.lit(n)) for n, v in e.items if v])
            return F.when(x.isNotNull(), F.array_join(F.filter(names, lambda n: n.isNotNull()), "|"))
        found = F.lit(None).cast("string")
        for n, v in reversed(e.items):
            found = F.when(x == v, F.lit(n)).otherwise(found)
        return F.coalesce(found, x.cast("string"))
    if ref.name == "datetime":
        return format_rfc822(x)
    if ref.name == "duration":
        return format_duration(x)
    if ref.name == "bytes":
        return F.base64(x)
    if ref.name == "money":
        return F.when(x.isNotNull(), F.struct(plain_decimal(x["amount"]).alias("amount"), x["currency"].alias("currency")))
    if ref.name in SPARK:
        return x
    if ref.name in ("list", "set", "group", "array"):
        return F.transform(x, lambda y: external(contract, ref.args[0], y))
    if ref.name == "map":
        return F.transform_values(x, lambda k, y: external(contract, ref.args[1], y))
    fields = [external(contract, f.type, x[f.name]).alias(f.external) for f in contract.record(ref.name).fields]
    return F.when(x.isNotNull(), F.struct(*fields))


def plain_decimal(x: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def to_json(contract: Contract, type_name: str, record: Column, nulls: bool = False) -> Column:
    """nulls: whether NULL is written (as null) rather than left out."""
    return F.to_json(external(contract, TypeRef(type_name), record), {"ignoreNullFields": str(not nulls).lower()})


@F.pandas_udf(T.StringType())
def json_to_yaml(texts: pd.Series) -> pd.Series:
    import json

    import yaml

    return texts.map(lambda t: None if t is None else yaml.safe_dump(json.loads(t), sort_keys=False, allow_unicode=True))


def to_yaml(contract: Contract, type_name: str, record: Column, nulls: bool = False) -> Column:
    return json_to_yaml(to_json(contract, type_name, record, nulls)).alias("yaml")


_XML_NAME = re.compile(r"[A-Za-z_][\w.-]*")


def to_xml(contract: Contract, type_name: str, record: Column) -> Column:
    """Lists are repeated elements. Names that are no XML names are rejected on the driver."""
    stack, seen = [type_name], set()
    while stack:
        for f in contract.record(stack.pop()).fields:
            if not _XML_NAME.fullmatch(f.external):
                raise SchemaError(f"{f.external} is no XML name")
            for n in (f.type.name, *(a.name for a in f.type.args)):
                if n in contract.records and n not in seen:
                    seen.add(n)
                    stack.append(n)
    return F.to_xml(external(contract, TypeRef(type_name), record), {"rowTag": type_name, "declaration": ""})


def flattened(contract: Contract, type_name: str, record: Column, lengths: dict[str, int] | None = None, keys: dict[str, list[str]] | None = None) -> list[Column]:
    """Columns a.b, a[0], a.key of a record, as a CSV has them. The lengths of lists and the keys of maps,
    by path, are the caller's, see csv_shape; empty ones are rejected, as a CSV can't tell them from absent."""
    out: list[Column] = []

    def visit(ref: TypeRef, x: Column, path: str) -> None:
        if ref.name in ("list", "set", "group", "array"):
            n = ref.size if ref.name == "array" else (lengths or {}).get(path, 0)
            if not n:
                raise SchemaError(f"{path} is an empty container")
            for i in range(n):
                visit(ref.args[0], F.get(x, i), f"{path}[{i}]")
        elif ref.name == "map":
            if not (keys or {}).get(path):
                raise SchemaError(f"{path} is an empty container")
            for k in keys[path]:
                visit(ref.args[1], F.try_element_at(x, F.lit(k)), f"{path}.{k}")
        elif ref.name == "money":
            out.append(F.concat_ws(" ", plain_decimal(x["amount"]), x["currency"]).alias(path))
        elif ref.name in SPARK or ref.name in contract.enums:
            value = external(contract, ref, x)
            out.append((plain_decimal(value) if ref.name == "decimal" else value.cast("string")).alias(path))
        else:
            for f in contract.record(ref.name).fields:
                visit(f.type, x[f.name], f"{path}.{f.external}" if path else f.external)

    visit(TypeRef(type_name), record, "")
    return out


def csv_shape(df: DataFrame, contract: Contract, type_name: str, record: str = "record") -> tuple[dict[str, int], dict[str, list[str]]]:
    """The greatest length of each list and the keys of each map of a table, found in one pass."""
    lists, maps = {}, {}

    def visit(ref: TypeRef, x: Column, path: str) -> None:
        if ref.name in ("list", "set", "group"):
            lists[path] = F.max(F.size(x))
        elif ref.name == "map":
            maps[path] = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(x)))))
        elif ref.name in contract.records:
            for f in contract.record(ref.name).fields:
                visit(f.type, x[f.name], f"{path}.{f.external}" if path else f.external)

    visit(TypeRef(type_name), F.col(record), "")
    if not lists and not maps:
        return {}, {}
    names = [*lists, *maps]
    row = df.agg(*[(lists | maps)[n].alias(str(i)) for i, n in enumerate(names)]).first()
    return {n: max(0, row[i] or 0) for i, n in enumerate(names) if n in lists}, {n: list(row[i] or []) for i, n in enumerate(names) if n in maps}


def to_csv(columns: list[Column]) -> Column:
    """One CSV line: fields are quoted that have a blank at an end, a comma, a quote or a line break."""
    quoted = [F.when(c.rlike(r'^[ \t]|[ \t]$|[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in columns]
    return F.concat_ws(",", *quoted)


def write_csv(df: DataFrame, path: str, contract: Contract, type_name: str, record: str = "record") -> None:
    columns = flattened(contract, type_name, F.col(record), *csv_shape(df, contract, type_name, record))
    df.select(*columns).write.option("escape", '"').csv(path, header=True)

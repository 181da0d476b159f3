"""Validation plans: the rules of a contract as one violations column, by path, through nested values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.formats import matches_format
from .schema import Contract, Field, Rule, SchemaError, TypeRef

VIOLATIONS = "array<struct<path:string,rule:string>>"
DEEPEST = 32


def _broken(rule: Rule, ref: TypeRef, x: Column) -> Column:
    if rule.kind == "min":
        return x < F.lit(str(rule.value)).cast("decimal(38,18)") if isinstance(rule.value, int) else x < rule.value
    if rule.kind == "max":
        return x > F.lit(str(rule.value)).cast("decimal(38,18)") if isinstance(rule.value, int) else x > rule.value
    if rule.kind == "size":
        size = F.octet_length(x) if ref.name in ("string", "bytes") else F.size(x)
        broken = F.lit(False)
        if rule.low is not None:
            broken = broken | (size < rule.low)
        if rule.high is not None:
            broken = broken | (size > rule.high)
        return broken
    return ~x.rlike(rule.value)


def _checked(rule: Rule, f: Field) -> None:
    kind = f.type.name
    if rule.kind in ("min", "max"):
        if kind in ("string", "bytes", "bool", "list", "set", "map") or isinstance(rule.value, float) and not math.isfinite(rule.value):
            raise SchemaError(f"{f.name}: {rule.kind} does not fit {f.type}")
    elif rule.kind == "size" and kind not in ("string", "bytes", "list", "set", "map", "group", "array"):
        raise SchemaError(f"{f.name}: size does not fit {f.type}")
    elif rule.kind == "pattern" and kind != "string":
        raise SchemaError(f"{f.name}: pattern does not fit {f.type}")


def violations(contract: Contract, type_name: str, record: Column) -> Column:
    """An array of (path, rule). NULL values break no rule."""

    def _each(inner: str, container: str, value: Column, at: Column, depth: int) -> Column:
        none = F.array().cast(VIOLATIONS)

        def one(y: Column, where: Column) -> Column:
            return F.flatten(F.array(none, *[F.coalesce(c, none) for c in visit(inner, y, where, depth + 1)]))

        if container == "map":
            return F.transform(F.map_entries(value), lambda e: one(e["value"], F.concat(at, F.lit("."), e["key"], F.lit("."))))
        return F.transform(value, lambda y, i: one(y, F.concat(at, F.lit("["), i.cast("string"), F.lit("]."))))

    def visit(name: str, x: Column, path: Column, depth: int) -> list[Column]:
        if depth > DEEPEST:
            raise SchemaError(f"{name} is nested more than {DEEPEST} deep")
        out = []
        for f in contract.record(name).fields:
            value, at = x[f.name], F.concat(path, F.lit(f.name))
            for rule in f.rules:
                _checked(rule, f)
                out.append(_when(_broken(rule, f.type, value), at, rule.kind))
            if f.format:
                out.append(_when(~matches_format(value, f.format), at, f"format {f.format}"))
            if f.type.name in contract.records:
                out += [F.when(value.isNotNull(), c) for c in visit(f.type.name, value, F.concat(at, F.lit(".")), depth + 1)]
            elif f.type.args and f.type.args[-1].name in contract.records:
                out.append(F.flatten(_each(f.type.args[-1].name, f.type.name, value, at, depth)))
        return out

    found = visit(type_name, record, F.lit(""), 1)
    none = F.array().cast(VIOLATIONS)
    return F.flatten(F.array(*[F.coalesce(c, none) for c in found])) if found else none


def _when(broken: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"))).cast(VIOLATIONS)).otherwise(F.array().cast(VIOLATIONS))


def validate(df: DataFrame, contract: Contract, type_name: str, record: str = "record") -> DataFrame:
    """Adds violations and is_valid."""
    out = df.withColumn("violations", violations(contract, type_name, F.col(record)))
    return out.withColumn("is_valid", F.size("violations") == 0)

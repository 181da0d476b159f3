"""Binding: raw records to typed columns, by a contract, as one projection that Catalyst sees whole.

Two forms of raw record are bound: a VARIANT (JSON, YAML), in which absent and null differ, and a tree of
string columns (CSV, XML), in which an absent value is NULL. Both give the typed struct and the errors, an
array of (path, message). Rules on absence: a default where there is one, else an error unless optional;
an explicit null is an error unless nullable, and never takes the default.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.formats import matches_format
from ..functions.temporal import parse_date, parse_datetime, parse_duration, parse_time
from .schema import INTEGERS, SPARK, Contract, Field, Record, TypeRef

ERRORS = "array<struct<path:string,message:string>>"
#: So many columns in all levels of a binding go into one generated method.
FUSED = 24


Use = Callable[[Column], Column]


def once(x: Column, use: Use) -> Column:
    """use(x), in which x is evaluated once however often it stands there: neither projections that are merged nor
    filters that are pushed down repeat it. There can be no Python function in it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


@dataclass
class Bound:
    """value: NULL where it does not bind; good: whether it does; errors: of nested records."""

    value: Column
    good: Column
    errors: Column | None = None


def _none(kind: T.DataType) -> Column:
    return F.lit(None).cast(kind)


def bind_scalar(name: str, text: Column, size: int | None = None) -> Bound:
    """A scalar from its text; exact: what would be rounded or cut does not bind."""
    t = F.trim(text)
    if name == "string":
        return Bound(text, F.lit(True))
    if name == "bool":
        value = F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)
        # numbers are true unless they are zero
        value = F.coalesce(value, F.when(t.rlike(r"^[-+]?\d+(\.\d*)?([eE][-+]?\d+)?$"), t.try_cast("double") != 0))
    elif name in INTEGERS or name == "varint":
        low, high = INTEGERS.get(name, INTEGERS["int64"])
        wide = F.when(t.rlike(r"^[-+]?\d{1,30}(\.0*)?$"), F.substring_index(t, ".", 1).try_cast("decimal(38,0)"))
        value = F.when((wide >= F.lit(str(low)).cast("decimal(38,0)")) & (wide <= F.lit(str(high)).cast("decimal(38,0)")), wide).try_cast(SPARK[name].simpleString())
    elif name in ("float", "double"):
        value = F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$|^[-+]?(inf|infinity|nan)$"), t.try_cast(SPARK[name].simpleString()))
    elif name == "bytes":
        value = F.try_to_binary(text, F.lit("base64"))
        if size is not None:
            value = F.when(F.octet_length(value) == size, value)
    elif name == "uuid":
        value = F.when(t.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.lower(t))
    elif name == "datetime":
        value = parse_datetime(text)
    elif name == "date":
        value = parse_date(t)
    elif name == "time":
        value = parse_time(t)
    elif name == "duration":
        value = parse_duration(text)
    elif name == "decimal":
        value = F.when(t.rlike(r"^[-+]?(\d{1,20}(\.\d{0,18}0*)?|\.\d{1,18}0*)$"), t.try_cast("decimal(38,18)"))
    elif name == "bigint":
        digits = F.regexp_replace(t, r"^([-+]?)0+(?=\d)", "$1")
        value = F.when(t.rlike(r"^[-+]?\d+$"), F.when(digits.isin("-0", "+0"), "0").otherwise(F.regexp_replace(digits, r"^\+", "")))
    elif name == "money":
        amount, currency = F.regexp_extract(t, r"^([-+]?\d{1,20}(?:\.\d{1,18})?) ?([A-Z]{3})$", 1), F.regexp_extract(t, r"^([-+]?\d{1,20}(?:\.\d{1,18})?) ?([A-Z]{3})$", 2)
        value = F.when(currency != "", F.struct(amount.try_cast("decimal(38,18)").alias("amount"), currency.alias("currency")))
    else:
        raise ValueError(name)
    return Bound(value, value.isNotNull())


def bind_enum(c: Contract, name: str, text: Column) -> Bound:
    """By name or number; flags by names joined with space, tab, bar, comma or plus."""
    e = c.enums[name]
    kind = SPARK[e.storage].simpleString()
    table = F.create_map(*[F.lit(x) for n, v in e.items for x in (n, str(v))]) if e.items else F.create_map().cast("map<string,string>")
    low, high = INTEGERS[e.storage]
    known = F.lit("|".join(str(v) for _, v in e.items))
    one = lambda t: F.coalesce(F.try_element_at(table, t), F.when(F.array_contains(F.split(known, r"\|"), t), t)).try_cast("decimal(20,0)")
    if not e.flags:
        value = one(F.trim(text)).try_cast(kind)
        return Bound(value, value.isNotNull())
    parts = F.filter(F.split(text, r"[ \t|,+]+"), lambda p: p != "")
    number = lambda p: F.coalesce(F.try_element_at(table, p).try_cast("long"), F.when(p.rlike(r"^\d+$"), p.try_cast("long")))
    values = F.transform(parts, number)
    value = F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    value = F.when(F.size(parts) == 0, F.lit(0).cast("long")).otherwise(value)
    return Bound(F.when((value >= low) & (value <= min(high, (1 << 63) - 1)), value).try_cast(kind), F.coalesce((value >= low) & (value <= min(high, (1 << 63) - 1)), F.lit(False)))


def _joined(errors: list[Column]) -> Column:
    found = [e for e in errors if e is not None]
    return F.flatten(F.array(*found)) if found else F.array().cast(ERRORS)


def _error(path: str, message: str) -> Column:
    return F.array(F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))).cast(ERRORS)


def _default(c: Contract, f: Field) -> Column:
    """A default as the field's type; true and false on an integer field are 1 and 0."""
    value: Any = f.default
    if f.type.name in c.enums:
        return bind_enum(c, f.type.name, F.lit(str(value))).value
    if isinstance(value, bool):
        value = ("true" if value else "false") if f.type.name in ("bool", "string") else str(int(value))
    return bind_scalar(f.type.name, F.lit(str(value)), f.type.size).value if f.type.name in SPARK else _none(c.spark_type(f.type))


class VariantBinder:
    """Binds VARIANT columns. Each value of a record is looked up and bound once, and its parts from it."""

    def __init__(self, contract: Contract, exact_tokens: bool = False, reject_unknown: bool = False):
        self.c, self.exact, self.reject_unknown, self.hold = contract, exact_tokens, reject_unknown, once

    def bound(self, df: DataFrame, item: str, name: str, value: str = "record", errors: str = "errors") -> DataFrame:
        """df without the VARIANT column item and with its value (good only without errors) and errors. What several
        expressions need is a column of a projection of its own, by levels; inside of lists and maps there are none."""
        levels: dict[int, dict[str, Column]] = {}

        def put(level: int, x: Column) -> Column:
            held = levels.setdefault(level, {})
            held[column := f"cg_{level}_{len(held)}"] = x
            return F.col(column)

        out, wrong, last = self._levels(put, 0, name, F.col(f"`{item}`"), "")
        out, wrong = put(last, out), put(last, wrong)
        if sum(map(len, levels.values())) > FUSED:
            # with a lambda function in it, a projection is compiled by itself, in methods small enough to be compiled to machine code
            there = F.col(f"`{item}`").isNotNull()
            for n in range(last + 1):
                there = put(n, F.exists(F.array(there), lambda y: y))
            wrong = F.when(there, wrong).otherwise(_error(name, "is no object"))
        for n in sorted(levels):
            df = df.withColumns(levels[n])
        # made by a generator, as no filter is pushed below one with all that it needs copied into it
        df = df.withColumn("cg_bound", F.explode(F.array(F.struct(out.alias("value"), wrong.alias("errors")))))
        df = df.withColumns({value: F.col("cg_bound.value"), errors: F.col("cg_bound.errors")})
        return df.drop("cg_bound", item, *[c for held in levels.values() for c in held])

    def _levels(self, put: Callable[[int, Column], Column], level: int, name: str, x: Column, path: str) -> tuple[Column, Column, int]:
        """Value and errors of a record and the first level that may use them."""
        r, none, values, errors, raws, last = self.c.record(name), F.array().cast(ERRORS), [], [], [], level + 1
        held = put(level, F.try_variant_get(x, "$", "map<string,variant>")) if self.reject_unknown else None
        is_object = put(level, F.try_variant_get(x, "$", "struct<cg: variant>").isNotNull())
        for f in r.fields:
            at, of = (f"{path}.{f.name}" if path else f.name), level + 1
            raw = put(level, F.coalesce(*[F.try_variant_get(x, f"$[{json.dumps(n)}]", "variant") for n in f.inputs]))
            if f.type.name in self.c.records:
                value, wrong, of = self._levels(put, of, f.type.name, raw, at)
                wrong, value = put(of, wrong), put(of, value)
                b, of = F.struct(value.alias("value"), wrong.alias("errors")), of + 1
            elif (f.type.name in SPARK or f.type.name in self.c.enums) and f.type.name != "money":
                kind = put(of, F.schema_of_variant(raw))
                b, of = put(of + 2, self._scalar(f.type, raw, kind, lambda y, use, n=of + 1: use(put(n, y)))), of + 3
            else:
                b, of = put(of, self.bind(f.type, raw, at)), of + 1
            shown = self._shown(r.kind, f, raw, b, at)
            values.append(shown["value"].alias(f.name))
            errors.append(shown["errors"])
            raws.append(raw)
            last = max(last, of)
        return F.struct(*values), self._checked(r, path or name, is_object, held, raws, errors), last

    def bind(self, ref: TypeRef, x: Column, path: str) -> Column:
        """The value, NULL where it does not bind."""
        c = self.c
        if ref.name == "money":
            parts = F.concat_ws(" ", F.try_variant_get(x, "$.amount", "string"), F.try_variant_get(x, "$.currency", "string"))
            text = F.when(F.schema_of_variant(x).startswith("OBJECT"), parts).otherwise(F.try_variant_get(x, "$", "string"))
            return self.hold(text, lambda t: bind_scalar("money", t).value)
        if ref.name in SPARK or ref.name in c.enums:
            return self.hold(F.schema_of_variant(x), lambda kind: self._scalar(ref, x, kind, self.hold))
        if ref.name in ("list", "set", "group", "array"):
            items = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y: self.bind(ref.args[0], y, path + "[]"))

            def whole(found: Column) -> Column:
                good = ~F.exists(found, lambda y: y.isNull())
                if ref.name == "array":
                    good = good & (F.size(found) == ref.size)
                return F.when(good, F.array_distinct(found) if ref.name == "set" else found)

            return self.hold(items, whole)
        if ref.name == "map":
            items = F.transform_values(F.try_variant_get(x, "$", "map<string,variant>"), lambda k, y: self.bind(ref.args[1], y, path + "{}"))
            return self.hold(items, lambda found: F.when(~F.exists(F.map_values(found), lambda y: y.isNull()), found))
        return self.hold(self.record(ref.name, x, path), lambda b: self._good(ref, b))

    def _scalar(self, ref: TypeRef, x: Column, kind: Column, hold: Callable[[Column, Use], Column]) -> Column:
        """kind: the type that x has as a VARIANT."""
        plain = ~F.left(kind, F.lit(5)).isin("ARRAY", "OBJEC", "VOID")
        if self.exact and ref.name in SPARK:
            wanted = "^BOOLEAN" if ref.name == "bool" else "^(BIGINT|DECIMAL|DOUBLE)" if ref.name in INTEGERS or ref.name in ("float", "double") else "^STRING"
            plain = plain & kind.rlike(wanted)
        read = F.try_variant_get(x, "$", "string")
        if ref.name in self.c.enums:
            return hold(F.when(plain, read), lambda t: bind_enum(self.c, ref.name, t).value)
        if ref.name not in INTEGERS or ref.name == "uint64":
            return hold(F.when(plain, read), lambda t: bind_scalar(ref.name, t, ref.size).value)
        # whole numbers need no text
        low, high = INTEGERS[ref.name]
        whole, to = F.when(kind == "BIGINT", F.try_variant_get(x, "$", "bigint")), SPARK[ref.name].simpleString()
        of_text = lambda w: hold(F.when(plain & (kind != "BIGINT"), read), lambda t: F.coalesce(F.when((w >= low) & (w <= high), w).try_cast(to), F.when(t.isNotNull(), bind_scalar(ref.name, t).value)))
        return hold(whole, of_text)

    def _good(self, ref: TypeRef, b: Column) -> Column:
        return F.when(F.size(b["errors"]) == 0, b["value"]).cast(self.c.spark_type(ref))

    def _shown(self, kind: str, f: Field, x: Column, b: Column, at: str) -> Column:
        """A struct of value and errors. x: what was read; b: what it binds to, of records with their errors."""
        none, empty, nested = F.array().cast(ERRORS), _none(self.c.spark_type(f.type)), f.type.name in self.c.records
        default = _default(self.c, f) if f.has_default else empty
        wrong = b["errors"] if nested else _error(at, f"is no {f.type}" + (f" of format {f.format}" if f.format else ""))
        missing = none if f.optional or f.has_default else _error(at, "is missing")
        nulled = none if f.nullable else _error(at, "is null")
        value, good = (self._good(f.type, b), F.size(b["errors"]) == 0) if nested else (b, b.isNotNull())
        if kind == "union":
            missing, nulled, wrong = none, _error(at, "does not bind"), _error(at, "does not bind")
        if f.format:
            good = good & F.coalesce(matches_format(value, f.format), F.lit(False))
        absent, null = x.isNull(), F.is_variant_null(x)
        errors = F.when(absent, missing).when(null, nulled).when(good, none).otherwise(wrong)
        return F.struct(F.when(absent, default).when(null, empty).otherwise(value).alias("value"), errors.alias("errors"))

    def _checked(self, r: Record, at: str, is_object: Column, held: Column | None, raws: list[Column], errors: list[Column]) -> Column:
        none = F.array().cast(ERRORS)
        if r.kind == "union":
            known = sum((raw.isNotNull().cast("int") for raw in raws), F.lit(0))
            errors = [*errors, F.when(known != 1, _error(at, "needs exactly one variant")).otherwise(none)]
        if self.reject_unknown:
            extra = F.array_except(F.map_keys(held), F.array(*[F.lit(n) for f in r.fields for n in f.inputs]).cast("array<string>"))
            errors = [*errors, F.when(F.size(extra) > 0, _error(at, "has unknown fields")).otherwise(none)]
        return F.when(is_object, _joined(errors)).otherwise(_error(at, "is no object"))

    def record(self, name: str, x: Column, path: str = "") -> Column:
        """A struct of value and errors, inside of lists and maps."""
        r = self.c.record(name)

        def field(f: Field, raw: Column) -> Column:
            at = f"{path}.{f.name}" if path else f.name
            bound = lambda y: self.record(f.type.name, y, at) if f.type.name in self.c.records else self.bind(f.type, y, at)
            return self.hold(raw, lambda y: self.hold(bound(y), lambda b: self._shown(r.kind, f, y, b, at)))

        def read(held: Column) -> Column:
            raws = [F.coalesce(*[F.try_element_at(held, F.lit(n)) for n in f.inputs]) for f in r.fields]
            fields = [field(f, raw).alias(f"f{i}") for i, (f, raw) in enumerate(zip(r.fields, raws, strict=True))]
            return self.hold(F.struct(*fields), lambda found: joined(held, raws, found))

        def joined(held: Column, raws: list[Column], found: Column) -> Column:
            checked = self._checked(r, path or name, held.isNotNull(), held, raws, [found[f"f{i}"]["errors"] for i in range(len(raws))])
            return F.struct(F.struct(*[found[f"f{i}"]["value"].alias(f.name) for i, f in enumerate(r.fields)]).alias("value"), checked.alias("errors"))

        return self.hold(F.try_variant_get(x, "$", "map<string,variant>"), read)


class TextBinder:
    """Binds trees of string columns; a node is a dict of nodes, a list of nodes, or a column."""

    def __init__(self, contract: Contract):
        self.c = contract

    def leaf(self, ref: TypeRef, text: Column) -> Bound:
        return bind_enum(self.c, ref.name, text) if ref.name in self.c.enums else bind_scalar(ref.name, text, ref.size)

    def bind(self, ref: TypeRef, x: Column) -> Bound:
        """x: a string, an array of strings or structs, a map or a struct of them, shaped by text_type."""
        c = self.c
        if ref.name in SPARK or ref.name in c.enums:
            return self.leaf(ref, x)
        if ref.name in ("list", "set", "group", "array"):
            value = F.transform(x, lambda y: self.bind(ref.args[0], y).value)
            good = F.forall(x, lambda y: self.bind(ref.args[0], y).good)
            if ref.name == "set":
                value = F.array_distinct(value)
            if ref.name == "array":
                good = good & (F.size(x) == ref.size)
            return Bound(value, F.coalesce(good, F.lit(False)))
        if ref.name == "map":
            value = F.transform_values(x, lambda k, y: self.bind(ref.args[1], y).value)
            return Bound(value, F.coalesce(F.forall(F.map_values(x), lambda y: self.bind(ref.args[1], y).good), F.lit(False)))
        b = self.record(ref.name, {f.name: x.getField(f.name) for f in c.record(ref.name).fields})
        return Bound(F.when(x.isNotNull(), b.value), F.size(b.errors) == 0, b.errors)

    def record(self, name: str, raw: dict[str, Column], path: str = "") -> Bound:
        r, values, errors = self.c.record(name), [], []
        none = F.array().cast(ERRORS)
        for f in r.fields:
            at = f"{path}.{f.name}" if path else f.name
            x = raw[f.name]
            b = self.bind(f.type, x)
            good = b.good if not f.format else b.good & F.coalesce(matches_format(b.value, f.format), F.lit(False))
            default = _default(self.c, f) if f.has_default else _none(self.c.spark_type(f.type))
            values.append(F.when(x.isNull(), default).otherwise(b.value).cast(self.c.spark_type(f.type)).alias(f.name))
            missing = none if f.optional or f.nullable or f.has_default or r.kind == "union" else _error(at, "is missing")
            wrong = b.errors if b.errors is not None else _error(at, f"is no {f.type}")
            errors.append(F.when(x.isNull(), missing).when(good, none).otherwise(wrong))
        if r.kind == "union":
            known = sum(F.when(raw[f.name].isNotNull(), 1).otherwise(0) for f in r.fields)
            errors.append(F.when(known != 1, _error(path or name, "needs exactly one variant")).otherwise(none))
        checked = _joined(errors)
        return Bound(F.struct(*values), F.size(checked) == 0, checked)


def admitted(df: DataFrame, mode: str, record: str = "record", errors: str = "errors") -> DataFrame:
    """failfast: the first bad row fails the job; drop: bad rows go; quarantine: they stay, with errors."""
    if mode == "quarantine":
        return df.withColumn(record, F.when(F.size(errors) == 0, F.col(record)))
    if mode == "drop":
        return df.where(F.size(errors) == 0).drop(errors)
    if mode != "failfast":
        raise ValueError(mode)
    first = F.concat(F.col(errors)[0]["path"], F.lit(" "), F.col(errors)[0]["message"])
    return df.withColumn(record, F.when(F.size(errors) == 0, F.col(record)).otherwise(F.raise_error(first).cast(df.schema[record].dataType))).drop(errors)

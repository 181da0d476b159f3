"""Expression templates as one column, where every name has a type; else by value in a pandas UDF."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import strings, values
from ..operators import arrays
from .templates import Environment, Parser

MISSING = T.NullType()


class NotTyped(ValueError):
    """A construct that has no column form; the message names it."""


@dataclass
class Typed:
    """A column with its type; safe: it is markup already."""

    x: Column
    kind: T.DataType
    safe: bool = False


def _text(v: Typed) -> Column:
    if isinstance(v.kind, T.ArrayType | T.MapType | T.StructType):
        raise NotTyped("the text of a collection")
    return F.lit("") if isinstance(v.kind, T.NullType) else values.text(v.x, v.kind)


class Compiler:
    def __init__(self, row: Column, kind: T.StructType, autoescape: bool = False):
        self.scope: dict[str, Typed] = {f.name: Typed(row[f.name], f.dataType) for f in kind.fields}
        self.autoescape = autoescape

    def body(self, nodes: list, scope: dict[str, Typed]) -> Column:
        parts = []
        scope = dict(scope)
        for n in nodes:
            if n[0] == "text":
                parts.append(F.lit(n[1]))
            elif n[0] == "out":
                v = self.eval(n[1], scope)
                parts.append(strings.escape(_text(v)) if self.autoescape and not v.safe else _text(v))
            elif n[0] == "if":
                out = self.body(n[2], scope)
                for c, inner in reversed(n[1]):
                    out = F.when(self.true(self.eval(c, scope)), self.body(inner, scope)).otherwise(out)
                parts.append(out)
            elif n[0] == "set" and isinstance(n[1], str):
                scope[n[1]] = self.eval(n[2], scope)
            elif n[0] == "with":
                inner = scope | {name: self.eval(e, scope) for name, e in n[1]}
                parts.append(self.body(n[2], inner))
            elif n[0] == "for" and isinstance(n[1], str) and not n[4]:
                parts.append(self.loop(n, scope))
            else:
                raise NotTyped(n[0])
        return F.concat(*parts) if parts else F.lit("")

    def loop(self, n: tuple, scope: dict[str, Typed]) -> Column:
        xs = self.eval(n[2], scope)
        if not isinstance(xs.kind, T.ArrayType):
            raise NotTyped("a loop over what is no list")
        items, element = F.coalesce(xs.x, F.array().cast(xs.kind)), xs.kind.elementType
        if n[3] is not None:
            items = F.filter(items, lambda x: self.true(self.eval(n[3], scope | {n[1]: Typed(x, element)})))

        def each(x: Column, i: Column) -> Column:
            length = F.size(items)
            loop = {"index": i + 1, "index0": i, "revindex": length - i, "revindex0": length - i - 1, "first": i == 0, "last": i == length - 1, "length": length}
            kinds = {k: T.BooleanType() if k in ("first", "last") else T.IntegerType() for k in loop}
            struct = Typed(F.struct(*[c.alias(k) for k, c in loop.items()]), T.StructType([T.StructField(k, kinds[k]) for k in loop]))
            return self.body(n[5], scope | {n[1]: Typed(x, element), "loop": struct})

        return F.when(F.size(items) > 0, F.array_join(F.transform(items, each), "")).otherwise(self.body(n[6], scope))

    def true(self, v: Typed) -> Column:
        return F.lit(False) if isinstance(v.kind, T.NullType) else values.truthy(v.x, v.kind)

    def eval(self, e: Any, scope: dict[str, Typed]) -> Typed:
        handler = getattr(self, f"on_{e[0]}", None)
        if handler is None:
            raise NotTyped(e[0])
        return handler(e, scope)

    def on_lit(self, e: tuple, scope: dict) -> Typed:
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): MISSING}
        return Typed(F.lit(e[1]), kinds[type(e[1])])

    def on_name(self, e: tuple, scope: dict) -> Typed:
        return scope.get(e[1], Typed(F.lit(None), MISSING))

    def on_undefined(self, e: tuple, scope: dict) -> Typed:
        return Typed(F.lit(None), MISSING)

    def on_attr(self, e: tuple, scope: dict) -> Typed:
        v = self.eval(e[1], scope)
        if isinstance(v.kind, T.StructType):
            return Typed(v.x[e[2]], v.kind[e[2]].dataType) if e[2] in v.kind.names else Typed(F.lit(None), MISSING)
        if isinstance(v.kind, T.MapType):
            return Typed(F.try_element_at(v.x, F.lit(e[2])), v.kind.valueType)
        raise NotTyped(f"the attribute {e[2]}")

    def on_item(self, e: tuple, scope: dict) -> Typed:
        v = self.eval(e[1], scope)
        if e[2][0] == "slice":
            parts = [p[1] if p is not None and p[0] == "lit" else None if p is None else NotTyped for p in e[2][1]]
            if NotTyped in parts:
                raise NotTyped("a slice by columns")
            return Typed(arrays.sliced(v.x, v.kind, parts[0], parts[1], 1 if parts[2] is None else parts[2]), v.kind)
        if e[2][0] != "lit":
            raise NotTyped("an index by column")
        if isinstance(e[2][1], str):
            return self.on_attr(("attr", e[1], e[2][1]), scope)
        kind = v.kind.elementType if isinstance(v.kind, T.ArrayType) else T.StringType()
        return Typed(arrays.item(v.x, e[2][1], v.kind), kind)

    def on_if(self, e: tuple, scope: dict) -> Typed:
        c, a, b = (self.eval(x, scope) for x in e[1:])
        return Typed(F.when(self.true(c), a.x).otherwise(b.x), b.kind if isinstance(a.kind, T.NullType) else a.kind, a.safe and b.safe)

    def on_and(self, e: tuple, scope: dict) -> Typed:
        a, b = self.eval(e[1], scope), self.eval(e[2], scope)
        return Typed(F.when(self.true(a), b.x).otherwise(a.x), b.kind)

    def on_or(self, e: tuple, scope: dict) -> Typed:
        a, b = self.eval(e[1], scope), self.eval(e[2], scope)
        return Typed(F.when(self.true(a), a.x).otherwise(b.x), b.kind if isinstance(a.kind, T.NullType) else a.kind)

    def on_not(self, e: tuple, scope: dict) -> Typed:
        return Typed(~self.true(self.eval(e[1], scope)), T.BooleanType())

    def on_cmp(self, e: tuple, scope: dict) -> Typed:
        left, out = self.eval(e[1], scope), F.lit(True)
        for op, x in e[2]:
            right = self.eval(x, scope)
            floats = isinstance(left.kind, T.FractionalType) or isinstance(right.kind, T.FractionalType)
            a, b = (v.x.cast("double") if floats else v.x for v in (left, right))
            if op in ("in", "notin"):
                found = values.contains(right.x, left.x, right.kind)
            elif op in ("==", "!="):
                found = values.equal(a, b, floats)
            else:
                low, high = (a, b) if op[0] == "<" else (b, a)
                found = values.less(low, high, floats) | (values.equal(a, b, floats) if op.endswith("=") else F.lit(False))
            out, left = out & (~found if op in ("!=", "notin") else found), right
        return Typed(out, T.BooleanType())

    def on_sign(self, e: tuple, scope: dict) -> Typed:
        v = self.eval(e[2], scope)
        return Typed(-v.x if e[1] == "-" else v.x, v.kind)

    def on_bin(self, e: tuple, scope: dict) -> Typed:
        op, a, b = e[1], self.eval(e[2], scope), self.eval(e[3], scope)
        if op == "~":
            return Typed(F.concat(_text(a), _text(b)), T.StringType())
        if not all(isinstance(v.kind, T.NumericType) for v in (a, b)):
            if op == "+" and all(isinstance(v.kind, T.StringType | T.ArrayType) for v in (a, b)):
                return Typed(F.concat(a.x, b.x), a.kind)
            raise NotTyped(op)
        floats = any(isinstance(v.kind, T.FractionalType) for v in (a, b))
        kind: T.DataType = T.DoubleType() if floats or op == "/" else T.LongType()
        x, y = (v.x.cast("double" if isinstance(kind, T.DoubleType) else "long") for v in (a, b))
        if op == "//":
            return Typed(F.floor(x / y).cast("double") if floats else values.floor_div(x, y), kind)
        found = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: values.floor_mod(x, y), "**": lambda: values.power(x, y, not floats)}
        return Typed(found[op](), kind)

    def on_test(self, e: tuple, scope: dict) -> Typed:
        v = self.eval(e[1], scope)
        if isinstance(v.kind, T.NullType):
            found = F.lit(e[2] in ("undefined", "none"))
        else:
            found = values.test(e[2], v.x, v.kind, *[self.eval(a[2], scope).x for a in e[3]])
        return Typed(~found if e[4] else found, T.BooleanType())

    def on_filter(self, e: tuple, scope: dict) -> Typed:
        v, name = self.eval(e[1], scope), e[2]
        args, named = [], {}
        for kind, key, x in e[3]:
            if kind not in ("pos", "key") or x[0] != "lit":
                raise NotTyped(f"{name} with computed arguments")
            if kind == "pos":
                args.append(x[1])
            else:
                named[key] = x[1]
        if name in ("default", "d"):
            other = args[0] if args else named.get("default_value", "")
            if isinstance(v.kind, T.NullType):
                return self.on_lit(("lit", other), scope)
            absent = ~self.true(v) if (args[1:] and args[1]) or named.get("boolean") else v.x.isNull()
            return Typed(F.when(absent, F.lit(other)).otherwise(v.x), v.kind)
        if name in ("escape", "e"):
            return Typed(v.x if v.safe else strings.escape(_text(v)), T.StringType(), True)
        if name == "safe":
            return Typed(v.x, v.kind, True)
        texts = ("upper", "lower", "capitalize", "title", "trim", "center", "indent", "truncate", "replace", "striptags", "urlencode", "wordwrap")
        if name in texts:
            return Typed(getattr(strings, name)(_text(v), *args, **named), T.StringType())
        if name == "wordcount":
            return Typed(strings.wordcount(_text(v)).cast("long"), T.LongType())
        if name in ("length", "count"):
            return Typed(arrays.length(v.x, v.kind), T.IntegerType())
        if name == "string":
            return Typed(_text(v), T.StringType())
        if name == "filesizeformat":
            return Typed(strings.filesizeformat(v.x, *args, **named), T.StringType())
        if name == "abs":
            return Typed(F.abs(v.x), v.kind)
        if name == "round":
            return Typed(values.rounded(v.x.cast("double"), *args, **named), T.DoubleType())
        if name == "int":
            return Typed(values.to_int(v.x, *args, **named), T.LongType())
        if name == "float":
            return Typed(values.to_float(v.x, *args, **named), T.DoubleType())
        if name == "reverse" and isinstance(v.kind, T.StringType | T.ArrayType):
            return Typed(F.reverse(v.x), v.kind)
        if isinstance(v.kind, T.ArrayType):
            element = v.kind.elementType
            if name in ("first", "last"):
                return Typed(getattr(arrays, name)(v.x), element)
            if name in ("min", "max"):
                return Typed((arrays.smallest if name == "min" else arrays.largest)(v.x, element, **named), element)
            if name == "sort":
                return Typed(arrays.sort(v.x, element, *args, **named), v.kind)
            if name == "unique":
                return Typed(arrays.unique(v.x, element, *args, **named), v.kind)
            if name == "sum" and isinstance(element, T.NumericType):
                return Typed(arrays.total(v.x, element, *[a for a in args[1:]]), T.DoubleType() if isinstance(element, T.FloatType | T.DoubleType) else T.LongType())
            if name == "join" and "attribute" not in named and len(args) < 2:
                joined = F.transform(v.x, lambda x: _text(Typed(x, element)))
                return Typed(F.array_join(joined, args[0] if args else named.get("d", "")), T.StringType())
        raise NotTyped(f"the filter {name} on {v.kind.simpleString()}")


def compile_column(template: str, row: Column, kind: T.StructType, environment: Environment | None = None) -> Column:
    env = environment or Environment()
    compiler = Compiler(row, kind, env.options.autoescape)
    return compiler.body(Parser(template, env.options).parse(), compiler.scope)


def render_rows(df: DataFrame, template: str, name: str = "rendered", environment: Environment | None = None, by_value: bool = False) -> DataFrame:
    """A column of the template's text for each row; with a warning, in Python where it has no column form."""
    env = environment or Environment()
    if not by_value:
        try:
            return df.withColumn(name, compile_column(template, F.struct(*df.columns), df.schema, env))
        except NotTyped as why:
            warnings.warn(f"the template is rendered row by row in Python: {why} has no column form", stacklevel=2)
    templates, options = env.templates, env.options
    filters, tests, extra, messages = env.filters, env.tests, env.globals, env.messages

    @F.pandas_udf(T.StringType())
    def by_json(rows: pd.Series) -> pd.Series:
        compiled = Environment(templates, options, filters, tests, extra, messages).from_string(template)
        return rows.map(lambda r: compiled.render(json.loads(r)))

    return df.withColumn(name, by_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))

"""The logic-less template dialect: tags to a tree on the driver, then to a column or to text.

compile_column makes one string expression over a row's struct where every name has a type; render works
on plain values and is what the pandas UDF of render_rows runs for everything else.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.strings import escape
from ..functions.values import truthy

DEEPEST = 128


class MustacheError(ValueError):
    """A template that has no valid reading."""


@dataclass
class Node:
    """kind: text, value, raw, section, inverted, partial; name is dotted; inner: nodes of a section."""

    kind: str
    name: str = ""
    inner: list[Node] = field(default_factory=list)
    source: str = ""
    indent: str = ""
    delimiters: tuple[str, str] = ("{{", "}}")


def parse(template: str, delimiters: tuple[str, str] = ("{{", "}}")) -> list[Node]:
    """Standalone sections, comments, partials and delimiter changes take their line with them."""
    root: list[Node] = []
    stack: list[tuple[str, list[Node], int, Node]] = []
    here, at, (left, right) = root, 0, delimiters
    while True:
        begin = template.find(left, at)
        if begin < 0:
            here.append(Node("text", template[at:]))
            break
        inside = begin + len(left)
        sigil = template[inside : inside + 1]
        close = "}" + right if sigil == "{" else "=" + right if sigil == "=" else right
        end = template.find(close, inside + (1 if sigil in "{=" else 0))
        if end < 0:
            raise MustacheError(f"an unclosed tag at {begin}")
        tag, after = template[inside:end], end + len(close)
        kind = sigil if sigil in ("#", "^", "/", ">", "!", "&", "{", "=") else ""
        name = tag[1 if kind else 0 :].strip()
        line = template.rfind("\n", 0, begin) + 1
        tail = re.match(r"[ \t]*(\r?\n|\Z)", template[after:])
        alone = kind in ("#", "^", "/", ">", "!", "=") and tail is not None and not template[line:begin].strip(" \t") and line >= at
        indent = template[line:begin] if alone else ""
        here.append(Node("text", template[at : line if alone else begin]))
        body_end, at = (line if alone else begin), after + (tail.end() if alone and tail else 0)
        if kind in ("#", "^"):
            node = Node("section" if kind == "#" else "inverted", name, delimiters=(left, right))
            here.append(node)
            stack.append((name, here, at, node))
            here = node.inner
        elif kind == "/":
            if not stack or stack[-1][0] != name:
                raise MustacheError(f"{name} closes no section")
            _, outer, start, node = stack.pop()
            node.source, here = template[start:body_end], outer
        elif kind == ">":
            here.append(Node("partial", name, indent=indent))
        elif kind == "=":
            parts = name.split()
            if len(parts) != 2:
                raise MustacheError("wrong delimiters")
            left, right = parts
        elif kind in ("&", "{"):
            here.append(Node("raw", name))
        elif kind == "":
            here.append(Node("value", name))
    if stack:
        raise MustacheError(f"{stack[-1][0]} is not closed")
    return [n for n in root]


# --- rendering of plain values ---------------------------------------------------------------------

_MISSING = object()


def _lookup(name: str, stack: list) -> object:
    if name == ".":
        return stack[-1]
    first, *rest = name.split(".")
    value: object = _MISSING
    for frame in reversed(stack):
        if isinstance(frame, dict) and first in frame:
            value = frame[first]
            break
    for part in rest:
        value = value[part] if isinstance(value, dict) and part in value else _MISSING
    return value


def _text(value: object) -> str:
    if value is _MISSING or value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value) if isinstance(value, dict | list) else str(value)


def render(nodes: list[Node], data: object, partials: dict[str, str] | None = None, depth: int = 0) -> str:
    return _render(nodes, [data], partials or {}, depth)


def _render(nodes: list[Node], stack: list, partials: dict[str, str], depth: int) -> str:
    if depth > DEEPEST:
        raise MustacheError(f"expanded more than {DEEPEST} deep")
    out = []
    for n in nodes:
        if n.kind == "text":
            out.append(n.name)
        elif n.kind == "partial":
            name = _text(_lookup(n.name[1:].strip(), stack)) if n.name.startswith("*") else n.name
            source = partials.get(name, "")
            if n.indent:
                source = re.sub(r"(?m)^(?=.)", n.indent, source) if source else source
                source = re.sub(r"(?m)^(?=\n)", n.indent, source)
            out.append(_render(parse(source), stack, partials, depth + 1))
        else:
            value = _lookup(n.name, stack)
            if callable(value):
                if n.kind == "section":
                    out.append(_render(parse(_text(value(n.source)), n.delimiters), stack, partials, depth + 1))
                    continue
                value = _render(parse(_text(value())), stack, partials, depth + 1) if n.kind != "inverted" else True
            # a number of zero is true; false, null, the empty text and the empty list aren't
            true = value is not _MISSING and value is not None and value is not False and value != [] and not (isinstance(value, str) and value == "" and n.kind in ("section", "inverted"))
            if n.kind == "value":
                out.append(html.escape(_text(value)).replace("&#x27;", "'"))
            elif n.kind == "raw":
                out.append(_text(value))
            elif n.kind == "inverted":
                out.append("" if true else _render(n.inner, stack, partials, depth + 1))
            elif true:
                for item in value if isinstance(value, list) else [value]:
                    out.append(_render(n.inner, [*stack, item], partials, depth + 1))
    return "".join(out)


# --- columns ---------------------------------------------------------------------------------------


class NotTyped(ValueError):
    """A template that needs rendering by value, as a name in it has no type."""


def compile_column(template: str, row: Column, kind: T.StructType, partials: dict[str, str] | None = None) -> Column:
    """A template over a struct column, as one expression of concat, when and transform."""
    return _column(parse(template), [(row, kind)], partials or {}, 0)


def _typed(name: str, stack: list[tuple[Column, T.DataType]]) -> tuple[Column, T.DataType] | None:
    if name == ".":
        return stack[-1]
    first, *rest = name.split(".")
    for x, kind in reversed(stack):
        if isinstance(kind, T.StructType) and first in kind.names:
            found: tuple[Column, T.DataType] | None = (x[first], kind[first].dataType)
            for part in rest:
                inner = found[1]
                if not isinstance(inner, T.StructType) or part not in inner.names:
                    return None
                found = (found[0][part], inner[part].dataType)
            return found
        if isinstance(kind, T.MapType):
            raise NotTyped(name)
    return None


def _as_text(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.to_json(x), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))


def _column(nodes: list[Node], stack: list[tuple[Column, T.DataType]], partials: dict[str, str], depth: int) -> Column:
    if depth > DEEPEST:
        raise MustacheError(f"expanded more than {DEEPEST} deep")
    parts: list[Column] = []
    for n in nodes:
        if n.kind == "text":
            parts.append(F.lit(n.name))
            continue
        if n.kind == "partial":
            source = re.sub(r"(?m)^(?=.)", n.indent, partials.get(n.name, ""))
            parts.append(_column(parse(source), stack, partials, depth + 1))
            continue
        found = _typed(n.name, stack)
        if n.kind in ("value", "raw"):
            if found is not None:
                text = _as_text(*found)
                parts.append(escape(text) if n.kind == "value" else text)
            continue
        if found is None:
            if n.kind == "inverted":
                parts.append(_column(n.inner, stack, partials, depth + 1))
            continue
        x, kind = found
        true = x.isNotNull() if isinstance(kind, T.NumericType | T.StructType) else truthy(x, kind)
        if n.kind == "inverted":
            parts.append(F.when(true, F.lit("")).otherwise(_column(n.inner, stack, partials, depth + 1)))
        elif isinstance(kind, T.ArrayType):
            each = _each(n.inner, stack, kind.elementType, partials, depth)
            parts.append(F.coalesce(F.array_join(F.transform(x, each), ""), F.lit("")))
        else:
            parts.append(F.when(true, _column(n.inner, [*stack, (x, kind)], partials, depth + 1)).otherwise(F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _each(inner: list[Node], stack: list, kind: T.DataType, partials: dict[str, str], depth: int) -> Callable[[Column], Column]:
    return lambda item: _column(inner, [*stack, (item, kind)], partials, depth + 1)


def render_rows(df: DataFrame, template: str, name: str = "rendered", partials: dict[str, str] | None = None, by_value: bool = False) -> DataFrame:
    """A column of the template's text for each row; by a column expression unless that needs values."""
    if not by_value:
        try:
            return df.withColumn(name, compile_column(template, F.struct(*df.columns), df.schema, partials))
        except NotTyped:
            pass
    nodes = parse(template)

    @F.pandas_udf(T.StringType())
    def by_json(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: render(nodes, json.loads(r), partials))

    return df.withColumn(name, by_json(F.to_json(F.struct(*df.columns))))

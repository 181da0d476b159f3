"""Path queries and row filters, compiled on the driver to columns.

A path selects values of a VARIANT: children, indexes, unions, slices, wildcards, descendants by predicate.
A row filter compares named columns with literals. Both share one grammar of conditions. Syntax errors and
expressions over the size limit raise before any job runs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .binding import once


class QueryError(ValueError):
    """A path or filter that can't be compiled; .place is the character where it went wrong."""

    def __init__(self, message: str, place: int = 0):
        super().__init__(f"{message} at character {place + 1}")
        self.place = place


class QueryLimit(QueryError):
    """A query with more steps or operands than allowed."""


@dataclass(frozen=True)
class Limits:
    max_steps: int = 1024
    max_operands: int = 1024
    max_regexes: int = 64


_TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<op>==|!=|>=|<=|=~|&&|\|\||[<>!()\[\],.@$*?:])|(?P<name>[A-Za-z_][\w-]*))""")


class _Cursor:
    def __init__(self, text: str, limits: Limits):
        self.text, self.limits, self.tokens, at = text, limits, [], 0
        end = len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError("unexpected character", at)
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.i = self.operands = self.regexes = self.steps = 0

    def look(self, ahead: int = 0) -> str:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)][1]

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def take(self, text: str) -> bool:
        if self.look() == text and self.kind in ("op", "name"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.error(f"expected {text}")

    def error(self, message: str) -> QueryError:
        return QueryError(message, self.tokens[self.i][2])

    def count(self, what: str) -> None:
        setattr(self, what, getattr(self, what) + 1)
        if getattr(self, what) > getattr(self.limits, f"max_{what}"):
            raise QueryLimit(f"more than {getattr(self.limits, f'max_{what}')} {what}", self.tokens[self.i][2])


def unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


Operand = tuple[str, object]  # ("literal", value) or ("value", typed getter)


def _condition(c: _Cursor, operand: Callable[[_Cursor], Operand]) -> Column:
    left = _all_of(c, operand)
    while c.take("||") or c.take("or"):
        left = left | _all_of(c, operand)
    return left


def _all_of(c: _Cursor, operand: Callable[[_Cursor], Operand]) -> Column:
    left = _one(c, operand)
    while c.take("&&") or c.take("and"):
        left = left & _one(c, operand)
    return left


def _one(c: _Cursor, operand: Callable[[_Cursor], Operand]) -> Column:
    c.count("steps")
    if c.take("!") or c.take("not"):
        return ~_one(c, operand)
    if c.take("("):
        inner = _condition(c, operand)
        c.need(")")
        return inner
    left = operand(c)
    op = c.look()
    if op not in ("==", "!=", ">=", "<=", "<", ">", "=~"):
        if left[0] == "literal":
            raise c.error("expected a comparison")
        return left[1]("exists")
    c.next()
    right = operand(c)
    if op == "=~":
        c.count("regexes")
        if right[0] != "literal" or not isinstance(right[1], str):
            raise c.error("a pattern must be quoted")
        return F.coalesce(left[1]("string").rlike(right[1]), F.lit(False))
    kind = next((_kind(x[1]) for x in (left, right) if x[0] == "literal"), "string")
    a, b = (F.lit(x[1]) if x[0] == "literal" else x[1](kind) for x in (left, right))
    if right == ("literal", None) or left == ("literal", None):
        same = (left if right == ("literal", None) else right)[1]("null")
        return same if op == "==" else ~same
    found = {"==": a == b, "!=": a != b, ">=": a >= b, "<=": a <= b, "<": a < b, ">": a > b}[op]
    return F.coalesce(found, F.lit(op == "!="))


def _kind(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, int | float) else "string"


def _literal(c: _Cursor) -> Operand | None:
    c.count("operands")
    if c.kind == "string":
        return "literal", unquoted(c.next())
    if c.kind == "number":
        text = c.next()
        return "literal", float(text) if re.search("[.eE]", text) else int(text)
    if c.kind == "name" and c.look() in ("true", "false", "null"):
        return "literal", {"true": True, "false": False, "null": None}[c.next()]
    return None


# --- row filters ----------------------------------------------------------------------------------


def row_filter(text: str, columns: list[str], limits: Limits = Limits()) -> Column:
    """A condition over named columns, as in side == "Sell" && id >= 3."""
    c = _Cursor(text, limits)

    def operand(c: _Cursor) -> Operand:
        if (found := _literal(c)) is not None:
            return found
        if c.kind != "name":
            raise c.error("expected a column or a literal")
        name = c.next()
        while c.look() == "." or (c.look() == "[" and f"{name}[{c.look(1)}]" in columns):
            name += c.next() + c.next() + (c.next() if c.look() == "]" else "")
        if name not in columns:
            raise QueryError(f"no column is named {name}", c.tokens[c.i - 1][2])
        column = F.col(f"`{name}`")
        views = {"exists": column.isNotNull(), "null": column.isNull()}
        return "value", lambda kind: views[kind] if kind in views else column.try_cast(kind)

    found = _condition(c, operand)
    if c.kind != "end":
        raise c.error("unexpected text")
    return found


# --- paths ----------------------------------------------------------------------------------------

Select = Callable[[Column], Column]


def _child(name: str) -> Select:
    path = f"$[{json.dumps(name)}]"
    return lambda xs: F.filter(F.transform(xs, lambda x: F.try_variant_get(x, path, "variant")), lambda x: x.isNotNull())


def _at(index: int) -> Select:
    if index >= 0:
        return lambda xs: F.filter(F.transform(xs, lambda x: F.try_variant_get(x, f"$[{index}]", "variant")), lambda x: x.isNotNull())
    return lambda xs: F.filter(F.transform(xs, lambda x: F.try_element_at(F.try_variant_get(x, "$", "array<variant>"), F.lit(index))), lambda x: x.isNotNull())


def _every(xs: Column) -> Column:
    none = F.array().cast("array<variant>")
    inner = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), none)
    return F.flatten(F.transform(xs, inner))


def _variant_operand(item: Column) -> Callable[[_Cursor], Operand]:
    def operand(c: _Cursor) -> Operand:
        if (found := _literal(c)) is not None:
            return found
        c.need("@")
        path = "$"
        while c.look() in (".", "["):
            if c.take("."):
                path += f"[{json.dumps(c.next())}]"
            else:
                c.need("[")
                path += f"[{json.dumps(unquoted(c.next()))}]" if c.kind == "string" else f"[{int(c.next())}]"
                c.need("]")
        value = F.try_variant_get(item, path, "variant")
        views = {"exists": value.isNotNull(), "null": F.coalesce(F.is_variant_null(value), F.lit(False))}
        return "value", lambda kind: views[kind] if kind in views else F.try_variant_get(item, path, kind)

    return operand


def compile_path(text: str, limits: Limits = Limits()) -> Select:
    """A function from a VARIANT column to the array of all values that the path selects in it."""
    c, steps = _Cursor(text, limits), []
    c.need("$")
    while c.kind != "end":
        c.count("steps")
        if c.take("."):
            if c.take("*"):
                steps.append(_every)
            elif c.kind == "name":
                steps.append(_child(c.next()))
            else:
                raise c.error("expected a name")
            continue
        c.need("[")
        if c.take("*"):
            steps.append(_every)
        elif c.kind == "string":
            steps.append(_child(unquoted(c.next())))
        elif c.kind == "number" or c.look() == ":":
            steps.append(_indexes(c))
        elif c.look() in ("?", "@", "("):
            c.take("?")
            begin = c.i
            _condition(c, _variant_operand(F.lit(None).cast("variant")))
            spent, end = (c.steps, c.operands, c.regexes), c.i
            steps.append(_filtered(c, begin))
            c.i, (c.steps, c.operands, c.regexes) = end, spent
        else:
            raise c.error("expected an index, a name or a condition")
        c.need("]")
    return lambda x: _folded(steps, F.array(x))


def _folded(steps: list[Select], xs: Column) -> Column:
    for step in steps:
        xs = step(xs)
    return xs


def _indexes(c: _Cursor) -> Select:
    numbers: list[int | None] = []
    ranged = False
    while c.look() != "]":
        if c.take(":"):
            ranged = True
            if not numbers:
                numbers.append(None)
            numbers.append(int(c.next()) if c.kind == "number" else None)
        elif c.kind == "number":
            numbers.append(int(c.next()))
            c.take(",")
        else:
            raise c.error("expected an index")
    if ranged:
        a, b = numbers[0] or 0, numbers[1]
        items = lambda x: F.try_variant_get(x, "$", "array<variant>")
        if a < 0 or b is not None and b < 0:
            raise c.error("a range can't be negative")
        return lambda xs: F.flatten(F.transform(xs, lambda x: F.filter(items(x), lambda y, i: (i >= a) & (F.lit(True) if b is None else i < b))))
    picks = [_at(n) for n in numbers]
    return picks[0] if len(picks) == 1 else lambda xs: once(xs, lambda held: F.concat(*[p(held) for p in picks]))


def _filtered(c: _Cursor, begin: int) -> Select:
    def keep(x: Column) -> Column:
        again = _Cursor(c.text, c.limits)
        again.i = begin
        return _condition(again, _variant_operand(x))

    return lambda xs: F.filter(_every(xs), keep)

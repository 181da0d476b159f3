"""The same collection operators on array, map and string columns, as higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from ..functions.values import folded

Key = Callable[[Column], Column]


def _compared(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def sort(xs: Column, element: T.DataType, reverse: bool = False, case_sensitive: bool = False, key: Key | None = None) -> Column:
    """Stable, also in reverse."""
    key = key or (lambda x: folded(x, element, case_sensitive))
    rows = F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    order = lambda a, b: F.when(_compared(a["k"], b["k"]) != 0, _compared(a["k"], b["k"]) * (-1 if reverse else 1)).otherwise(_compared(a["i"], b["i"]))
    return F.transform(F.array_sort(rows, order), lambda r: r["x"])


def dictsort(m: Column, key_type: T.DataType, value_type: T.DataType, by: str = "key", reverse: bool = False, case_sensitive: bool = False) -> Column:
    """Pairs of a map by key or value."""
    kind = key_type if by == "key" else value_type
    entry = T.StructType([T.StructField("key", key_type), T.StructField("value", value_type)])
    return sort(F.map_entries(m), entry, reverse, case_sensitive, lambda e: folded(e[by], kind, case_sensitive))


def unique(xs: Column, element: T.DataType, case_sensitive: bool = False, key: Key | None = None) -> Column:
    """The first item of each key, in order."""
    key = key or (lambda x: folded(x, element, case_sensitive))
    keys = F.transform(xs, key)
    return F.filter(xs, lambda x, i: F.array_position(keys, key(x)) == (i + 1).cast("long"))


def groupby(xs: Column, key: Key, kind: T.DataType, case_sensitive: bool = False) -> Column:
    """Pairs (grouper, list) in the order of keys."""
    fold = lambda x: folded(key(x), kind, case_sensitive)
    keys = F.array_sort(F.array_distinct(F.transform(xs, fold)))
    group = lambda k: F.filter(xs, lambda x: fold(x).eqNullSafe(k))
    return F.transform(keys, lambda k: F.struct(key(F.element_at(group(k), 1)).alias("grouper"), group(k).alias("list")))


def total(xs: Column, kind: T.DataType, start: object = 0, key: Key | None = None) -> Column:
    """Integers are checked; floating point sums carry the lost part along."""
    key = key or (lambda x: x)
    if isinstance(kind, T.FloatType | T.DoubleType):
        zero = F.struct(F.lit(float(start)).alias("s"), F.lit(0.0).alias("c"))  # type: ignore[arg-type]

        def add(a: Column, x: Column) -> Column:
            v = key(x).cast("double")
            t = a["s"] + v
            lost = F.when(F.abs(a["s"]) >= F.abs(v), (a["s"] - t) + v).otherwise((v - t) + a["s"])
            return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

        return F.aggregate(xs, zero, add, lambda a: a["s"] + a["c"])
    return F.aggregate(xs, F.lit(start).cast("long"), lambda a, x: a + key(x).cast("long"))


def _extreme(xs: Column, element: T.DataType, case_sensitive: bool, key: Key | None, reverse: bool) -> Column:
    return F.try_element_at(sort(xs, element, reverse, case_sensitive, key), F.lit(1))


def smallest(xs: Column, element: T.DataType, case_sensitive: bool = False, key: Key | None = None) -> Column:
    """The item with the least key, the first of equal ones; NULL for an empty list."""
    return _extreme(xs, element, case_sensitive, key, False)


def largest(xs: Column, element: T.DataType, case_sensitive: bool = False, key: Key | None = None) -> Column:
    return _extreme(xs, element, case_sensitive, key, True)


def length(x: Column, kind: T.DataType) -> Column:
    return F.char_length(x) if isinstance(kind, T.StringType) else F.size(x)


def first(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def mapped(xs: Column, f: Key, default: object = None) -> Column:
    return F.transform(xs, lambda x: F.coalesce(f(x), F.lit(default)) if default is not None else f(x))


def select(xs: Column, condition: Key) -> Column:
    return F.filter(xs, lambda x: F.coalesce(condition(x), F.lit(False)))


def reject(xs: Column, condition: Key) -> Column:
    return F.filter(xs, lambda x: ~F.coalesce(condition(x), F.lit(False)))


def batch(xs: Column, linecount: int, fill_with: Column | None = None) -> Column:
    n = F.ceil(F.size(xs) / linecount).cast("int")
    rows = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(xs, i * linecount + 1, F.lit(linecount)))
    if fill_with is None:
        return rows
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(fill_with, F.lit(linecount) - F.size(r))))


def slices(xs: Column, count: int, fill_with: Column | None = None) -> Column:
    """count lists, longer ones first; with a filler every list past the longer ones gets one."""
    per, more = F.floor(F.size(xs) / count).cast("int"), (F.size(xs) % count).cast("int")

    def part(i: Column) -> Column:
        found = F.slice(xs, i * per + F.least(i, more) + 1, per + F.when(i < more, 1).otherwise(0))
        return found if fill_with is None else F.when(i >= more, F.concat(found, F.array(fill_with))).otherwise(found)

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), part)


def joined(xs: Column, separator: str = "", key: Key | None = None) -> Column:
    """NULL items are empty."""
    return F.array_join(F.transform(xs, lambda x: (key(x) if key else x).cast("string")), separator, "")


def reverse(x: Column) -> Column:
    return F.reverse(x)


def listed(x: Column, kind: T.DataType) -> Column:
    """The characters of a text, the keys of a map, the items of a list."""
    if isinstance(kind, T.StringType):
        return F.filter(F.split(x, ""), lambda c: c != "")
    return F.map_keys(x) if isinstance(kind, T.MapType) else x


def items(m: Column) -> Column:
    return F.map_entries(m)


def item(x: Column, index: int, kind: T.DataType) -> Column:
    """From the end where negative; NULL outside."""
    at = index + 1 if index >= 0 else index
    if isinstance(kind, T.StringType):
        return F.when(F.char_length(x) >= (at if index >= 0 else -index), F.substring(x, at, 1))
    return F.try_element_at(x, F.lit(at))


def sliced(x: Column, kind: T.DataType, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """start:stop:step, negative ones included, of a list or a text."""
    if step == 0:
        raise ValueError("the step of a slice can't be zero")
    if isinstance(kind, T.StringType):
        return F.array_join(sliced(listed(x, kind), T.ArrayType(T.StringType()), start, stop, step), "")
    n = F.size(x)

    def clip(v: int, low: int | Column, high: Column) -> Column:
        at = F.lit(v) if v >= 0 else n + v
        return F.greatest(F.lit(low) if isinstance(low, int) else low, F.least(at, high))

    if step > 0:
        a = clip(start, 0, n) if start is not None else F.lit(0)
        b = clip(stop, 0, n) if stop is not None else n
        return F.filter(x, lambda _, i: (i >= a) & (i < b) & ((i - a) % step == 0))
    a = clip(start, -1, n - 1) if start is not None else n - 1
    b = clip(stop, -1, n - 1) if stop is not None else F.lit(-1)
    return F.reverse(F.filter(x, lambda _, i: (i <= a) & (i > b) & ((a - i) % (-step) == 0)))


def shuffled_item(xs: Column, seed: int | None = None) -> Column:
    """One item at random; NULL for an empty list."""
    return F.try_element_at(F.shuffle(xs, seed), F.lit(1)) if seed is not None else F.try_element_at(F.shuffle(xs), F.lit(1))


def numbers(start: int, stop: int | None = None, step: int = 1) -> Column:
    """range(start, stop, step); stop is not in it."""
    r = range(start) if stop is None else range(start, stop, step)
    return F.sequence(F.lit(r[0]), F.lit(r[-1]), F.lit(step)) if len(r) else F.array().cast("array<int>")

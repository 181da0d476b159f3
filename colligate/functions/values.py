"""The value rules that collections and templates share: truth, keys, text, floor arithmetic, tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def truthy(x: Column, kind: T.DataType) -> Column:
    """False for NULL, false, zero, and what is empty."""
    if isinstance(kind, T.BooleanType):
        found = x
    elif isinstance(kind, T.NumericType):
        found = x != 0
    elif isinstance(kind, T.StringType):
        found = x != ""
    elif isinstance(kind, T.ArrayType | T.MapType):
        found = F.size(x) > 0
    else:
        found = x.isNotNull()
    return F.coalesce(found, F.lit(False))


def folded(x: Column, kind: T.DataType, case_sensitive: bool) -> Column:
    return F.lower(x) if isinstance(kind, T.StringType) and not case_sensitive else x


def text(x: Column, kind: T.DataType, undefined: str = "") -> Column:
    """Text as templates write it: True, None, shortest float."""
    if isinstance(kind, T.BooleanType):
        found = F.when(x, "True").otherwise("False")
    elif isinstance(kind, T.FloatType | T.DoubleType):
        found = float_text(x)
    else:
        found = x.cast("string")
    return F.coalesce(F.when(x.isNotNull(), found), F.lit(undefined))


def float_text(x: Column) -> Column:
    """Positional from 1e-4 up to 1e16, exponents as 1e+16 and 1e-05 beyond; nan, inf."""
    raw = x.cast("double").cast("string")
    digits, power = F.regexp_extract(raw, r"^(-?[0-9.]+)E(-?\d+)$", 1), F.regexp_extract(raw, r"^(-?[0-9.]+)E(-?\d+)$", 2).try_cast("int")
    bare = F.regexp_replace(digits, r"\.0$", "")
    exponent = F.concat(bare, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.regexp_replace(F.regexp_replace(x.cast("double").cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    long = F.abs(x)
    return (
        F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
        .when(raw.contains("E") & (long < 1e16) & (long >= 1e-4), plain)
        .when(raw.contains("E"), exponent).otherwise(raw)
    )


def floor_div(a: Column, b: Column) -> Column:
    """Rounds down, whatever the signs; dividing by zero raises."""
    return F.floor(a.cast("decimal(38,0)") / b.cast("decimal(20,0)")).cast("long")


def floor_mod(a: Column, b: Column) -> Column:
    """Has the sign of the divisor."""
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def power(a: Column, b: Column, whole: bool = True) -> Column:
    """whole: both are integers, and a result that fits stays one; a result out of range raises."""
    return F.pow(a, b).cast("decimal(38,0)").cast("long") if whole else F.pow(a, b)


@F.pandas_udf(T.DoubleType())
def _round_half_even(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def rounded(x: Column, precision: int = 0, method: str = "common") -> Column:
    """common: ties to even, on the binary value; ceil and floor at the precision."""
    if method == "common":
        return F.bround(x, precision) if precision <= 0 else _round_half_even(x.cast("double"), F.lit(precision))
    scale = float(10**precision) if precision >= 0 else 1 / float(10**-precision)
    return {"ceil": F.ceil, "floor": F.floor}[method](x * scale) / scale


def to_int(x: Column, default: int = 0, base: int = 10) -> Column:
    """Digits with an optional sign and, for base 16, 8 and 2, prefix; decimal text is cut; else the default."""
    t = F.trim(x.cast("string"))
    if base == 10:
        plain = F.when(t.rlike(r"^[-+]?\d+(_\d+)*$"), F.replace(t, F.lit("_"), F.lit("")).try_cast("long"))
        cut = F.when(t.rlike(r"^[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?$|^[-+]?\d+[eE][-+]?\d+$"), t.try_cast("double").try_cast("long"))
        return F.coalesce(plain, cut, F.lit(default))
    prefix = {16: "0[xX]", 8: "0[oO]", 2: "0[bB]"}[base]
    digits = F.regexp_extract(t, rf"^([-+]?)(?:{prefix})?([0-9A-Za-z]+)$", 2)
    letters = {16: "^[0-9A-Fa-f]+$", 8: "^[0-7]+$", 2: "^[01]+$"}[base]
    value = F.when(digits.rlike(letters), F.conv(digits, base, 10).try_cast("long"))
    return F.coalesce(F.when(t.startswith("-"), -value).otherwise(value), F.lit(default))


def to_float(x: Column, default: float = 0.0) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    good = t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?$|^[-+]?(inf|infinity|nan)$")
    return F.coalesce(F.when(good, t.try_cast("double")), F.lit(default))


# --- tests ----------------------------------------------------------------------------------------


def odd(x: Column) -> Column:
    return F.coalesce(floor_mod(x, F.lit(2)) == 1, F.lit(False))


def even(x: Column) -> Column:
    return F.coalesce(floor_mod(x, F.lit(2)) == 0, F.lit(False))


def divisible_by(x: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.coalesce(x % n == 0, F.lit(False))


def equal(a: Column, b: Column, floats: bool = False) -> Column:
    """NULL is equal to NULL; not a number is equal to nothing."""
    same = a.eqNullSafe(b)
    return same & ~F.isnan(a) & ~F.isnan(b) if floats else same


def less(a: Column, b: Column, floats: bool = False) -> Column:
    found = F.coalesce(a < b, F.lit(False))
    return found & ~F.isnan(a) & ~F.isnan(b) if floats else found


def contains(container: Column, item: Column, kind: T.DataType) -> Column:
    """item in container: a part of a text, an element of a list, a key of a map."""
    if isinstance(kind, T.StringType):
        return container.contains(item)
    if isinstance(kind, T.MapType):
        return F.map_contains_key(container, item)
    return F.coalesce(F.exists(container, lambda x: x.eqNullSafe(item)), F.lit(False))


#: Tests by name on a column and its type; the type decides those about types.
def test(name: str, x: Column, kind: T.DataType, *args: Column) -> Column:
    number = isinstance(kind, T.NumericType)
    whole = isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType) or isinstance(kind, T.DecimalType) and kind.scale == 0
    static = {
        "boolean": isinstance(kind, T.BooleanType),
        "integer": whole,
        "float": number and not whole,
        "number": number or isinstance(kind, T.BooleanType),
        "string": isinstance(kind, T.StringType),
        "mapping": isinstance(kind, T.MapType | T.StructType),
        "sequence": isinstance(kind, T.ArrayType | T.StringType | T.MapType | T.StructType),
        "iterable": isinstance(kind, T.ArrayType | T.StringType | T.MapType | T.StructType),
        "callable": False,
    }
    if name in static:
        return x.isNotNull() & F.lit(static[name])
    floats = isinstance(kind, T.FloatType | T.DoubleType)
    if name in ("defined", "undefined", "none"):
        return x.isNotNull() if name == "defined" else x.isNull()
    if name in ("true", "false"):
        return F.coalesce(x == F.lit(name == "true"), F.lit(False)) if isinstance(kind, T.BooleanType) else F.lit(False)
    if name in ("odd", "even"):
        return odd(x) if name == "odd" else even(x)
    if name == "divisibleby":
        return divisible_by(x, args[0])
    if name == "sameas":
        return x.eqNullSafe(args[0])
    if name in ("lower", "upper"):
        return (x == getattr(F, name)(x)) & (F.upper(x) != F.lower(x))
    if name in ("eq", "equalto", "=="):
        return equal(x, args[0], floats)
    if name in ("ne", "!="):
        return ~equal(x, args[0], floats)
    if name in ("lt", "lessthan", "<"):
        return less(x, args[0], floats)
    if name in ("gt", "greaterthan", ">"):
        return less(args[0], x, floats)
    if name in ("le", "<="):
        return less(x, args[0], floats) | equal(x, args[0], floats)
    if name in ("ge", ">="):
        return less(args[0], x, floats) | equal(x, args[0], floats)
    if name == "in":
        return F.coalesce(F.exists(args[0], lambda y: y.eqNullSafe(x)), F.lit(False))
    raise ValueError(f"no test is named {name}")

"""Sources: raw JSON, YAML, CSV, XML and text tables to typed records of a contract.

Each source gives the table with a record struct added and, in mode quarantine, an errors array. In mode
failfast (the default, as a bad record fails the whole call) the first bad record fails the job; in mode
drop bad rows go. Selections: root (one record a row), all (an array of records), path and path_first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.binding import ERRORS, TextBinder, VariantBinder, admitted
from ..plans.schema import SPARK, Contract, TypeRef
from ..plans.selection import Limits, compile_path, row_filter


def from_variant(df: DataFrame, value: Column, contract: Contract, type_name: str, select: str = "root", path: str | None = None, mode: str = "failfast", exact: bool = False, reject_unknown: bool = False, limits: Limits = Limits()) -> DataFrame:
    df = df.withColumn("cg_value", value)
    if select == "all":
        items = F.coalesce(F.try_variant_get("cg_value", "$", "array<variant>"), F.array(F.lit(None).cast("variant")))
        df = df.select("*", F.posexplode(items).alias("ordinal", "cg_item"))
    elif select in ("path", "path_first"):
        found = compile_path(path or "$", limits)(F.col("cg_value"))
        found = F.slice(found, 1, 1) if select == "path_first" else found
        df = df.select("*", F.posexplode(found).alias("ordinal", "cg_item"))
    elif select == "root":
        df = df.withColumn("cg_item", F.col("cg_value"))
    else:
        raise ValueError(select)
    df = VariantBinder(contract, exact, reject_unknown).bound(df, "cg_item", type_name).drop("cg_value")
    return admitted(df, mode)


def read_json(df: DataFrame, column: str, contract: Contract, type_name: str, **options) -> DataFrame:
    """column: JSON text. Numbers keep all digits; of a key that repeats, text that doesn't parse is no record."""
    return from_variant(df, F.try_parse_json(F.col(column)), contract, type_name, **options)


@F.pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    import datetime
    import json

    import yaml

    class Loader(yaml.SafeLoader):
        """Plain scalars become null, booleans true/false and numbers; dates stay text."""

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def convert(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(yaml.load(text, Loader), default=lambda x: x.isoformat() if isinstance(x, datetime.date) else str(x))
        except (yaml.YAMLError, ValueError):
            return None

    return texts.map(convert)


def read_yaml(df: DataFrame, column: str, contract: Contract, type_name: str, **options) -> DataFrame:
    """column: YAML text of one document, bound as the JSON that it stands for."""
    return from_variant(df, F.try_parse_json(yaml_to_json(F.col(column))), contract, type_name, **options)


# --- CSV ------------------------------------------------------------------------------------------


def _sanitized(path: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", path).strip("_")


class CsvHeader:
    """Finds the columns of a nested field: a.b, a[0], a_b, with typed suffixes _n and _s."""

    def __init__(self, names: list[str]):
        self.names = names

    def column(self, paths: list[str]) -> Column | None:
        for p in paths:
            for n in (p, f"{p}_n", f"{p}_s", _sanitized(p), f"{_sanitized(p)}_n", f"{_sanitized(p)}_s"):
                if n in self.names:
                    c = F.col(f"`{n}`")
                    return F.when(c != "", c)
        return None

    def below(self, paths: list[str]) -> bool:
        return any(n.startswith((f"{p}.", f"{p}[", f"{_sanitized(p)}_")) for p in paths for n in self.names)

    def keys(self, paths: list[str]) -> list[str]:
        """The next part of each column below one of the paths, in header order."""
        out = []
        for n in self.names:
            for p in paths:
                if n.startswith(f"{p}."):
                    out.append(re.split(r"[.\[]", n[len(p) + 1 :])[0])
        return list(dict.fromkeys(out))

    def length(self, paths: list[str]) -> int:
        found = [int(m[1]) for p in paths for n in self.names if (m := re.match(re.escape(p) + r"\[(\d+)\]", n)) or (m := re.match(re.escape(_sanitized(p)) + r"_(\d+)(?:_|$)", n))]
        return max(found, default=-1) + 1


def unflattened(contract: Contract, ref: TypeRef, header: CsvHeader, paths: list[str]) -> Column | None:
    """The tree of strings of one field from the columns of a header; None where no column belongs to it."""
    if ref.name in SPARK or ref.name in contract.enums:
        if ref.name == "money" and header.below(paths):
            parts = [header.column([f"{p}.{n}" for p in paths]) for n in ("amount", "currency")]
            return F.concat_ws(" ", *parts) if all(p is not None for p in parts) else None
        return header.column(paths)
    if ref.name in ("list", "set", "group", "array"):
        items = [unflattened(contract, ref.args[0], header, [f"{p}[{i}]" for p in paths]) for i in range(header.length(paths))]
        items = [x for x in items if x is not None]
        return F.when(F.coalesce(*items).isNotNull(), F.filter(F.array(*items), lambda x: x.isNotNull())) if items else None
    if ref.name == "map":
        keys = header.keys(paths)
        values = [unflattened(contract, ref.args[1], header, [f"{p}.{k}" for p in paths]) for k in keys]
        pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in zip(keys, values, strict=True) if v is not None]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())) if pairs else None
    fields = []
    for f in contract.record(ref.name).fields:
        x = unflattened(contract, f.type, header, [f"{p}.{n}" for p in paths for n in f.inputs])
        fields.append((x if x is not None else F.lit(None).cast(text_type(contract, f.type))).alias(f.name))
    some = [f for f in fields]
    return F.when(F.coalesce(*[x.isNotNull().cast("int") for x in some]).isNotNull() & F.greatest(*[x.isNotNull() for x in some], F.lit(False)), F.struct(*fields)) if header.below(paths) else None


def text_type(contract: Contract, ref: TypeRef) -> T.DataType:
    """The type of a field's tree of strings."""
    if ref.name in SPARK or ref.name in contract.enums:
        return T.StringType()
    if ref.name in ("list", "set", "group", "array"):
        return T.ArrayType(text_type(contract, ref.args[0]))
    if ref.name == "map":
        return T.MapType(T.StringType(), text_type(contract, ref.args[1]))
    return T.StructType([T.StructField(f.name, text_type(contract, f.type)) for f in contract.record(ref.name).fields])


def bind_csv(df: DataFrame, contract: Contract, type_name: str, where: str | None = None, mode: str = "failfast") -> DataFrame:
    """df: a table of strings as a CSV reader gives it. The filter sees the raw fields, before binding."""
    if where:
        df = df.where(row_filter(where, df.columns))
    header = CsvHeader(df.columns)
    raw = {}
    for f in contract.record(type_name).fields:
        x = unflattened(contract, f.type, header, list(f.inputs))
        raw[f.name] = x if x is not None else F.lit(None).cast(text_type(contract, f.type))
    bound = TextBinder(contract).record(type_name, raw)
    return admitted(df.withColumns({"record": bound.value, "errors": bound.errors.cast(ERRORS)}), mode)


def read_csv(spark, path: str, contract: Contract, type_name: str, where: str | None = None, mode: str = "failfast", row: int | None = None, multi_line: bool = True) -> DataFrame:
    """Files with a header. multi_line: fields may hold line breaks; without it, files are split among tasks.
    row: the index of the only row to take of a single file, which is read as one."""
    if row is not None and not multi_line:
        raise ValueError("a row's index is known only where a file is read as one")
    df = spark.read.option("multiLine", multi_line).option("escape", '"').csv(path, header=True)
    if row is not None:
        df = df.withColumn("cg_row", F.monotonically_increasing_id()).where(F.col("cg_row") == row).drop("cg_row")
    return bind_csv(df, contract, type_name, where, mode).select("record", *(["errors"] if mode == "quarantine" else []))


# --- XML ------------------------------------------------------------------------------------------


def xml_type(contract: Contract, type_name: str) -> T.StructType:
    """What from_xml reads: every field as an element and as an attribute (with an underscore before)."""

    def node(ref: TypeRef) -> T.DataType:
        if ref.name in SPARK or ref.name in contract.enums:
            return T.StringType()
        if ref.name in ("list", "set", "group", "array"):
            return T.ArrayType(node(ref.args[0]))
        if ref.name == "map":
            return T.MapType(T.StringType(), node(ref.args[1]))
        return xml_type(contract, ref.name)

    fields = []
    for f in contract.record(type_name).fields:
        for n in f.inputs:
            fields.append(T.StructField(n, node(f.type)))
            if isinstance(node(f.type), T.StringType):
                fields.append(T.StructField(f"_{n}", T.StringType()))
    return T.StructType(fields)


def _xml_tree(contract: Contract, ref: TypeRef, x: Column) -> Column:
    if ref.name in SPARK or ref.name in contract.enums:
        return x
    if ref.name in ("list", "set", "group", "array"):
        return F.transform(x, lambda y: _xml_tree(contract, ref.args[0], y))
    if ref.name == "map":
        return F.transform_values(x, lambda k, y: _xml_tree(contract, ref.args[1], y))
    return F.when(x.isNotNull(), F.struct(*[c.alias(n) for n, c in _xml_fields(contract, ref.name, x).items()]))


def _xml_fields(contract: Contract, type_name: str, x: Column) -> dict[str, Column]:
    """A child element shadows the attribute of the same name."""
    out = {}
    for f in contract.record(type_name).fields:
        plain = f.type.name in SPARK or f.type.name in contract.enums
        found = [x.getField(n) for n in f.inputs] + ([x.getField(f"_{n}") for n in f.inputs] if plain else [])
        out[f.name] = _xml_tree(contract, f.type, F.coalesce(*found))
    return out


def bind_xml(df: DataFrame, column: str, contract: Contract, type_name: str, mode: str = "failfast") -> DataFrame:
    """column: XML text with one record as its root element."""
    parsed = F.from_xml(F.col(column), _ddl(xml_type(contract, type_name)), {"attributePrefix": "_", "mode": "PERMISSIVE"})
    df = df.withColumn("cg_xml", parsed)
    bound = TextBinder(contract).record(type_name, _xml_fields(contract, type_name, F.col("cg_xml")))
    return admitted(df.withColumns({"record": bound.value, "errors": bound.errors.cast(ERRORS)}).drop("cg_xml"), mode)


def read_xml(spark, path: str, contract: Contract, type_name: str, row_tag: str, mode: str = "failfast") -> DataFrame:
    """Every element of the name row_tag, as //row_tag selects them, split by Spark's reader."""
    df = spark.read.schema(xml_type(contract, type_name)).option("attributePrefix", "_").option("rowTag", row_tag).xml(path)
    df = df.select(F.struct(*df.columns).alias("cg_xml"))
    bound = TextBinder(contract).record(type_name, _xml_fields(contract, type_name, F.col("cg_xml")))
    return admitted(df.select(bound.value.alias("record"), bound.errors.cast(ERRORS).alias("errors")), mode)


def select_xml(df: DataFrame, column: str, xpath: str, contract: Contract, type_name: str, mode: str = "failfast") -> DataFrame:
    """XML text and an XPath: a row for each node that it selects, bound as a record."""

    @F.pandas_udf("array<string>")
    def nodes(texts: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        def pick(text: str | None) -> list[str]:
            if text is None:
                return []
            root = ET.fromstring(text)
            path = "." + xpath if xpath.startswith("//") else re.sub(rf"^/{root.tag}/?", "./", xpath) if xpath.startswith("/") else xpath
            return [ET.tostring(n, encoding="unicode") for n in (root.findall(path) if path not in ("./", "") else [root])]

        return texts.map(pick)

    return bind_xml(df.select("*", F.posexplode(nodes(F.col(column))).alias("ordinal", "cg_node")), "cg_node", contract, type_name, mode).drop("cg_node")


def _ddl(kind: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString() if not isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else _typed(f.dataType)}" for f in kind.fields)


def _typed(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"`{f.name}`: {_typed(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{_typed(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<string, {_typed(kind.valueType)}>"
    return kind.simpleString()


def parse(df: DataFrame, column: str, contract: Contract, type_name: str, format: str, **options) -> DataFrame:
    """One record a row, by the name of its format."""
    readers = {"json": read_json, "yaml": read_yaml, "xml": bind_xml}
    if format not in readers:
        raise ValueError(f"no format is named {format}")
    return readers[format](df, column, contract, type_name, **options)


def validated(df: DataFrame, column: str, contract: Contract, type_name: str, format: str = "json", **options) -> DataFrame:
    """Decode and discard: the table with is_valid and errors."""
    out = parse(df, column, contract, type_name, format, mode="quarantine", **options)
    return out.withColumn("is_valid", F.size("errors") == 0).drop("record")

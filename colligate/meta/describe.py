"""What a contract says of itself: reflection tables, DDL, JSON schema and OpenAPI, key checks, declarations."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.schema import INTEGERS, Contract, Field, Record, SchemaError

# --- reflection -----------------------------------------------------------------------------------


def fields(spark: SparkSession, c: Contract) -> DataFrame:
    rows = [
        (r.name, r.kind, i, f.name, str(f.type), f.external, list(f.inputs), f.optional, f.nullable, json.dumps(f.default) if f.has_default else None, f.format, [_rule(x) for x in f.rules])
        for r in c.records.values()
        for i, f in enumerate(r.fields)
    ]
    return spark.createDataFrame(rows, "type string, kind string, position int, field string, field_type string, name string, inputs array<string>, optional boolean, nullable boolean, default_value string, format string, rules array<string>")


def _rule(r: Any) -> str:
    return f"{r.kind}({r.value if r.value is not None else f'{r.low},{r.high}'})"


def enum_items(spark: SparkSession, c: Contract) -> DataFrame:
    rows = [(e.name, e.storage, e.flags, i, n, v) for e in c.enums.values() for i, (n, v) in enumerate(e.items)]
    return spark.createDataFrame(rows, "enum string, storage string, flags boolean, position int, item string, value long")


def attributes(spark: SparkSession, c: Contract) -> DataFrame:
    rows = [(r.name, None, n, list(v)) for r in c.records.values() for n, v in r.attributes]
    rows += [(r.name, f.name, n, list(v)) for r in c.records.values() for f in r.fields for n, v in f.attributes]
    return spark.createDataFrame(rows, "type string, field string, attribute string, arguments array<string>")


def methods(spark: SparkSession, c: Contract) -> DataFrame:
    rows = [(s.name, s.kind, m.name, m.request, m.response or None, list(m.throws)) for s in c.services.values() for m in s.methods]
    return spark.createDataFrame(rows, "service string, kind string, method string, request string, response string, throws array<string>")


# --- DDL ------------------------------------------------------------------------------------------

#: SQL types by dialect.
_SQL = {
    "sqlite": {"bool": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "bytes": "BLOB", "uuid": "TEXT", "uint64": "TEXT"} | {n: "INTEGER" for n in INTEGERS if n != "uint64"},
    "postgresql": {"bool": "boolean", "int8": "smallint", "int16": "smallint", "int32": "integer", "int64": "bigint", "uint8": "smallint", "uint16": "integer", "uint32": "bigint", "uint64": "numeric(20,0)", "float": "real", "double": "double precision", "string": "text", "bytes": "bytea", "uuid": "uuid"},
    "spark": {"bool": "BOOLEAN", "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "uint8": "SMALLINT", "uint16": "INT", "uint32": "BIGINT", "uint64": "DECIMAL(20,0)", "float": "FLOAT", "double": "DOUBLE", "string": "STRING", "bytes": "BINARY", "uuid": "STRING"},
}


def _quoted(name: str, dialect: str = "") -> str:
    if not name or "\0" in name:
        raise SchemaError("an identifier is empty or holds NUL")
    return f"`{name.replace('`', '``')}`" if dialect == "spark" else '"' + name.replace('"', '""') + '"'


def column(f: Field) -> str:
    return (f.attribute("db_column") or (f.name,))[0]


def _stored(c: Contract, r: Record) -> list[Field]:
    out = [f for f in r.fields if f.attribute("db_ignore") is None]
    for f in out:
        if f.type.name not in _SQL["spark"] and f.type.name not in c.enums:
            raise SchemaError(f"{r.name}.{f.name}: {f.type} has no SQL type")
    if not out or len({column(f) for f in out}) != len(out):
        raise SchemaError(f"{r.name}: columns are missing or repeat a name")
    return out


def primary_key(r: Record) -> list[Field]:
    keyed = sorted(((int(f.attribute("db_primary_key")[0]), f) for f in r.fields if f.attribute("db_primary_key")), key=lambda x: x[0])
    if [n for n, _ in keyed] != list(range(1, len(keyed) + 1)):
        raise SchemaError(f"{r.name}: the primary key's order has gaps or repeats")
    if any(f.optional for _, f in keyed):
        raise SchemaError(f"{r.name}: a primary key can't be optional")
    return [f for _, f in keyed]


def foreign_keys(c: Contract, r: Record) -> list[tuple[str, Record, list[Field], list[Field]]]:
    """name, target, own fields, their fields; the target's fields must be a key of it."""
    out = []
    for v in r.all("db_foreign_key"):
        name, target, pairs = v[0], c.record(v[1]), v[2:]
        if not pairs or len(pairs) % 2:
            raise SchemaError(f"{r.name}: the fields of {name} are pairs")
        own, theirs = [r.field(x) for x in pairs[::2]], [target.field(x) for x in pairs[1::2]]
        keys = [[f.name for f in primary_key(target)], *[[f.name] for f in target.fields if f.attribute("db_unique")], *[list(u[1:]) for u in target.all("db_unique_index")]]
        if [f.name for f in theirs] not in keys:
            raise SchemaError(f"{r.name}: {name} refers to no key of {target.name}")
        if [f.type for f in own] != [f.type for f in theirs]:
            raise SchemaError(f"{r.name}: the types of {name} differ")
        out.append((name, target, own, theirs))
    return out


def _literal(c: Contract, f: Field, dialect: str) -> str:
    v = f.default
    if f.type.name in c.enums:
        return str(c.enums[f.type.name].values.get(v, v))
    if isinstance(v, bool):
        return ("true" if v else "false") if dialect != "sqlite" and f.type.name == "bool" else str(int(v))
    if isinstance(v, str):
        body = v.replace("'", "''")
        return "E'" + body.replace("\\", "\\\\") + "'" if dialect == "postgresql" else f"'{body}'"
    return f"'{v}'" if f.type.name == "uint64" and dialect == "sqlite" else str(v)


def _range_check(c: Contract, f: Field, dialect: str) -> str | None:
    kind, name = f.type.name, _quoted(column(f), dialect)
    if kind == "bool" and dialect == "sqlite":
        return f"{name} IN (0, 1)"
    if kind in c.enums and not c.enums[kind].flags:
        return f"{name} IN ({', '.join(str(v) for _, v in c.enums[kind].items)})"
    if kind.startswith("uint"):
        low, high = INTEGERS[kind]
        if kind == "uint64" and dialect == "sqlite":
            return f"{name} NOT GLOB '*[^0-9]*' AND length({name}) > 0 AND length(CAST({name} AS BLOB)) = length({name}) AND ({name} = '0' OR {name} NOT LIKE '0%') AND (length({name}) < 20 OR (length({name}) = 20 AND {name} <= '{high}'))"
        return f"{name} BETWEEN {low} AND {high}"
    return None


def _fragment(sql: str) -> str:
    """A fragment of SQL that can't end its statement."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", "", sql)
    if re.search(r"[;\x00-\x1f]|--|/\*", bare) or "'" in bare or '"' in bare or bare.count("(") != bare.count(")"):
        raise SchemaError(f"unsafe SQL: {sql}")
    return sql


def ddl(c: Contract, dialect: str) -> str:
    """Tables, then indexes, then (PostgreSQL) foreign keys, then seed rows. Spark gets tables alone."""
    if dialect not in _SQL:
        raise SchemaError(f"no dialect is named {dialect}")
    tables, indexes, later, names = [], [], [], set()
    for r in c.records.values():
        if not r.all("db_table"):
            continue
        table = r.all("db_table")[0][0]
        if table in names:
            raise SchemaError(f"{table} is two tables")
        names.add(table)
        key, lines = primary_key(r), []
        for f in _stored(c, r):
            storage = c.enums[f.type.name].storage if f.type.name in c.enums else f.type.name
            parts = [_quoted(column(f), dialect), _SQL[dialect][storage]]
            identity = f.attribute("db_generated") is not None
            if identity and (len(key) != 1 or key[0] != f or f.type.name not in INTEGERS or f.has_default):
                raise SchemaError(f"{r.name}.{f.name} can't be generated")
            if identity and dialect == "sqlite":
                if f.type.name.startswith("u"):
                    raise SchemaError(f"{r.name}.{f.name}: SQLite generates signed integers")
                parts.append("PRIMARY KEY AUTOINCREMENT")
            elif identity and dialect == "postgresql":
                parts.append("GENERATED BY DEFAULT AS IDENTITY")
            if not f.optional:
                parts.append("NOT NULL")
            if f.has_default and dialect != "spark":
                parts.append(f"DEFAULT {_literal(c, f, dialect)}")
            if f.attribute("db_unique") and dialect != "spark":
                parts.append("UNIQUE")
            check = _range_check(c, f, dialect) if dialect != "spark" else None
            if check:
                parts.append(f"CHECK ({check})")
            lines.append(" ".join(parts))
        if dialect != "spark":
            if key and not (dialect == "sqlite" and key[0].attribute("db_generated")):
                lines.append(f"PRIMARY KEY ({', '.join(_quoted(column(f)) for f in key)})")
            for v in r.all("db_check"):
                if v[1] == dialect:
                    lines.append(f"CONSTRAINT {_quoted(v[0])} CHECK ({_fragment(v[2])})")
            for name, target, own, theirs in foreign_keys(c, r):
                deletes = [v[1] for v in r.all("db_foreign_key_on_delete") if v[0] == name]
                fk = f"CONSTRAINT {_quoted(name)} FOREIGN KEY ({', '.join(_quoted(column(f)) for f in own)}) REFERENCES {_quoted(target.all('db_table')[0][0])} ({', '.join(_quoted(column(f)) for f in theirs)})" + (f" ON DELETE {deletes[0]}" if deletes else "")
                if dialect == "sqlite":
                    lines.append(fk)
                else:
                    later.append(f"ALTER TABLE {_quoted(table)} ADD {fk};")
            for kind, attr in (("INDEX", "db_index"), ("UNIQUE INDEX", "db_unique_index")):
                for v in r.all(attr):
                    indexes.append(f"CREATE {kind} {_quoted(v[0])} ON {_quoted(table)} ({', '.join(_quoted(column(r.field(x))) for x in v[1:])});")
        tables.append(f"CREATE TABLE {_quoted(table, dialect)} (\n  " + ",\n  ".join(lines) + "\n)" + (" USING parquet" if dialect == "spark" else "") + ";")
    seeds = [v[1] for n, v in c.attributes if n == "db_init" and v[0] == dialect]
    for s in seeds:
        if not re.match(r"INSERT\b", s, re.I):
            raise SchemaError("a seed is an INSERT")
    return "\n".join([*tables, *indexes, *later, *(f"{_fragment(s)};" for s in seeds)]) + "\n"


# --- keys as queries --------------------------------------------------------------------------------


def key_duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their count; combined before the shuffle."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, own: list[str], theirs: list[str]) -> DataFrame:
    """Rows of the child whose key is not NULL and not in the parent."""
    keys = parent.select(*[F.col(t).alias(f"cg_{i}") for i, t in enumerate(theirs)])
    for o in own:
        child = child.where(F.col(o).isNotNull())
    return child.join(keys, [child[o] == keys[f"cg_{i}"] for i, o in enumerate(own)], "left_anti")


# --- JSON schema and OpenAPI -------------------------------------------------------------------------


def json_schema(c: Contract, f: Field) -> dict[str, Any]:
    def kind(ref: Any) -> dict[str, Any]:
        if ref.name in INTEGERS:
            low, high = INTEGERS[ref.name]
            return {"type": "integer", "minimum": low, "maximum": high}
        if ref.name in c.enums:
            return {"type": "string", "enum": [n for n, _ in c.enums[ref.name].items]}
        if ref.name in c.records:
            return {"$ref": f"#/components/schemas/{ref.name}"}
        if ref.name in ("list", "group", "array"):
            return {"type": "array", "items": kind(ref.args[0])} | ({"minItems": ref.size, "maxItems": ref.size} if ref.name == "array" else {})
        if ref.name == "set":
            return {"type": "array", "items": kind(ref.args[0]), "uniqueItems": True}
        if ref.name == "map":
            return {"type": "object", "additionalProperties": kind(ref.args[1])}
        plain = {"bool": {"type": "boolean"}, "float": {"type": "number"}, "double": {"type": "number"}, "bytes": {"type": "string", "format": "byte"}, "uuid": {"type": "string", "format": "uuid"}, "date": {"type": "string", "format": "date"}, "datetime": {"type": "string", "format": "date-time"}}
        return dict(plain.get(ref.name, {"type": "string"}))

    out = kind(f.type)
    for r in f.rules:
        if r.kind in ("min", "max"):
            out["minimum" if r.kind == "min" else "maximum"] = r.value
        elif r.kind == "pattern":
            out["pattern"] = r.value
        else:
            low, high = {"string": ("minLength", "maxLength"), "object": ("minProperties", "maxProperties")}.get(out.get("type", ""), ("minItems", "maxItems"))
            out |= ({low: r.low} if r.low is not None else {}) | ({high: r.high} if r.high is not None else {})
    if f.format:
        out["format"] = f.format
    if f.has_default:
        out["default"] = f.default
    if f.nullable:
        out = {"anyOf": [out, {"type": "null"}]} if "$ref" in out else out | {"type": [out["type"], "null"]}
    return out


def openapi(c: Contract, title: str | None = None) -> dict[str, Any]:
    """Services as paths, messages as components."""
    schemas = {}
    for r in c.records.values():
        required = [f.external for f in r.fields if not f.optional and not f.has_default and r.kind != "union"]
        body: dict[str, Any] = {"type": "object", "properties": {f.external: json_schema(c, f) for f in r.fields}}
        if r.kind == "union":
            body |= {"minProperties": 1, "maxProperties": 1}
        schemas[r.name] = body | ({"required": required} if required else {})
    paths = {}
    content = lambda n: {"content": {"application/json": {"schema": {"$ref": f"#/components/schemas/{n}"}}}}
    for s in c.services.values():
        for m in s.methods:
            answers: dict[str, Any] = {"200": {"description": m.response or "done"} | (content(m.response) if m.response else {})}
            for t in m.throws:
                answers["default" if "default" not in answers else t] = {"description": t} | content(t)
            paths[f"/{s.name}/{m.name}"] = {"post": {"operationId": f"{s.name}.{m.name}", "requestBody": {"required": True} | content(m.request), "responses": answers}}
    version = next((v[0] for n, v in c.attributes if n == "version"), "1")
    return {"openapi": "3.1.0", "info": {"title": title or c.name or "schema", "version": version}, "paths": paths, "components": {"schemas": schemas}}


# --- declarations ------------------------------------------------------------------------------------

#: Type names by language.
_NAMES = {
    "python": {"bool": "bool", "float": "float", "double": "float", "string": "str", "bytes": "bytes", "decimal": "Decimal", "list": "list[{0}]", "set": "list[{0}]", "map": "dict[str, {1}]", "integer": "int", "other": "str"},
    "typescript": {"bool": "boolean", "float": "number", "double": "number", "string": "string", "bytes": "Uint8Array", "decimal": "string", "list": "{0}[]", "set": "{0}[]", "map": "Record<string, {1}>", "integer": "number", "other": "string"},
    "go": {"bool": "bool", "float": "float32", "double": "float64", "string": "string", "bytes": "[]byte", "decimal": "string", "list": "[]{0}", "set": "[]{0}", "map": "map[string]{1}", "integer": "{name}", "other": "string"},
    "rust": {"bool": "bool", "float": "f32", "double": "f64", "string": "String", "bytes": "Vec<u8>", "decimal": "String", "list": "Vec<{0}>", "set": "Vec<{0}>", "map": "BTreeMap<String, {1}>", "integer": "{short}", "other": "String"},
}


def declarations(c: Contract, language: str) -> str:
    """Records and enums as type declarations of a language."""
    names = _NAMES[language]

    def kind(ref: Any) -> str:
        if ref.name in c.records or ref.name in c.enums:
            return ref.name
        key = "integer" if ref.name in INTEGERS or ref.name == "varint" else "list" if ref.name in ("group", "array") else ref.name
        args = [kind(a) for a in ref.args]
        return names.get(key, names["other"]).format(*args, name=ref.name, short=ref.name.replace("uint", "u").replace("int", "i"))

    out = []
    for e in c.enums.values():
        if language == "python":
            out.append(f"class {e.name}({'IntFlag' if e.flags else 'IntEnum'}):\n" + "".join(f"    {n} = {v}\n" for n, v in e.items))
        elif language == "typescript":
            out.append(f"export enum {e.name} {{ {', '.join(f'{n} = {v}' for n, v in e.items)} }}\n")
        elif language == "go":
            out.append(f"type {e.name} {e.storage}\n\nconst (\n" + "".join(f"\t{e.name}{n} {e.name} = {v}\n" for n, v in e.items) + ")\n")
        else:
            out.append(f"pub enum {e.name} {{ {', '.join(f'{n} = {v}' for n, v in e.items)} }}\n")
    for r in c.records.values():
        if language == "python":
            ordered = sorted(r.fields, key=lambda f: f.optional)
            out.append(f"@dataclass\nclass {r.name}:\n" + "".join(f"    {f.name}: {kind(f.type)}{' | None = None' if f.optional else ''}\n" for f in ordered))
        elif language == "typescript":
            out.append(f"export interface {r.name} {{ " + " ".join(f"{f.name}{'?' if f.optional else ''}: {kind(f.type)}{' | null' if f.nullable else ''};" for f in r.fields) + " }\n")
        elif language == "go":
            out.append(f"type {r.name} struct {{\n" + "".join(f"\t{f.name[:1].upper() + f.name[1:]} {'*' if f.optional else ''}{kind(f.type)}\n" for f in r.fields) + "}\n")
        else:
            out.append(f"pub struct {r.name} {{ " + ", ".join(f"pub {f.name}: {'Option<' + kind(f.type) + '>' if f.optional else kind(f.type)}" for f in r.fields) + " }\n")
    return "\n".join(out)

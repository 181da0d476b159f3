"""The schema language: text to a contract, and a contract's messages to Spark types.

Compiling happens on the driver. A contract is immutable; messages, composites and groups are records,
unions have one field for each variant, enums and flags are named numbers.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field as slot
from typing import Any

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema text that has no valid reading; the message gives line and column."""


#: Scalar names with their aliases.
SCALARS = {
    "bool": ("bool",),
    "int8": ("int8", "i8", "int8_t"),
    "int16": ("int16", "i16", "int16_t"),
    "int32": ("int32", "i32", "int32_t", "int"),
    "int64": ("int64", "i64", "int64_t"),
    "uint8": ("uint8", "u8", "uint8_t", "byte"),
    "uint16": ("uint16", "u16", "uint16_t"),
    "uint32": ("uint32", "u32", "uint32_t"),
    "uint64": ("uint64", "u64", "uint64_t"),
    "float": ("float", "f32"),
    "double": ("double", "f64"),
    "string": ("string",),
    "bytes": ("bytes",),
    "uuid": ("uuid",),
    "datetime": ("datetime",),
    "date": ("date",),
    "time": ("time",),
    "duration": ("duration",),
    "decimal": ("decimal",),
    "bigint": ("bigint",),
    "money": ("money",),
    "varint": ("varint",),
}
ALIASES = {alias: name for name, aliases in SCALARS.items() for alias in aliases}
INTEGERS = {f"{s}int{n}": (0 if s else -(1 << n - 1), (1 << n if s else 1 << n - 1) - 1) for s in ("", "u") for n in (8, 16, 32, 64)}
MONEY = T.StructType([T.StructField("amount", T.DecimalType(38, 18)), T.StructField("currency", T.StringType())])
#: A uint needs the next wider signed type; durations are milliseconds.
SPARK = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
    "uuid": T.StringType(),
    "datetime": T.TimestampType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "duration": T.LongType(),
    "decimal": T.DecimalType(38, 18),
    "bigint": T.StringType(),
    "money": MONEY,
    "varint": T.LongType(),
}
DEEPEST = 32


@dataclass(frozen=True)
class TypeRef:
    """name: a scalar, a declared type, list, set, map, group or array; args: element types; size: T[n], bytes(n)."""

    name: str
    args: tuple[TypeRef, ...] = ()
    size: int | None = None

    def __str__(self) -> str:
        if self.name == "array":
            return f"{self.args[0]}[{self.size}]"
        inner = f"<{','.join(map(str, self.args))}>" if self.args else ""
        return f"{self.name}{inner}" + (f"({self.size})" if self.size is not None else "")


@dataclass(frozen=True)
class Rule:
    """min, max: value; size: min and max; pattern: regular expression."""

    kind: str
    value: Any = None
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Field:
    name: str
    type: TypeRef
    optional: bool = False
    nullable: bool = False
    default: Any = None
    has_default: bool = False
    rules: tuple[Rule, ...] = ()
    attributes: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def attribute(self, name: str) -> tuple[str, ...] | None:
        return next((v for n, v in self.attributes if n == name), None)

    @property
    def external(self) -> str:
        """The name on output."""
        return (self.attribute("name") or (self.name,))[0]

    @property
    def inputs(self) -> tuple[str, ...]:
        """All names on input, the canonical one first."""
        aliases = tuple(a for n, v in self.attributes if n == "alias" for a in v)
        return tuple(dict.fromkeys((self.external, *aliases)))

    @property
    def format(self) -> str | None:
        return (self.attribute("format") or (None,))[0]


@dataclass(frozen=True)
class Enum:
    name: str
    storage: str
    items: tuple[tuple[str, int], ...]
    flags: bool = False

    @property
    def values(self) -> dict[str, int]:
        return dict(self.items)


@dataclass(frozen=True)
class Record:
    name: str
    kind: str
    fields: tuple[Field, ...]
    attributes: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def all(self, attribute: str) -> list[tuple[str, ...]]:
        return [v for n, v in self.attributes if n == attribute]


@dataclass(frozen=True)
class Method:
    name: str
    request: str
    response: str
    throws: tuple[str, ...] = ()


@dataclass(frozen=True)
class Service:
    name: str
    kind: str
    methods: tuple[Method, ...]
    attributes: tuple[tuple[str, tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class Contract:
    name: str | None
    attributes: tuple[tuple[str, tuple[str, ...]], ...]
    records: dict[str, Record] = slot(default_factory=dict)
    enums: dict[str, Enum] = slot(default_factory=dict)
    services: dict[str, Service] = slot(default_factory=dict)

    def record(self, name: str) -> Record:
        if name not in self.records:
            raise SchemaError(f"no record is named {name}")
        return self.records[name]

    # --- Spark ---

    def spark_type(self, ref: TypeRef) -> T.DataType:
        if ref.name in SPARK:
            return SPARK[ref.name]
        if ref.name in ("list", "set", "group", "array"):
            return T.ArrayType(self.spark_type(ref.args[0]))
        if ref.name == "map":
            return T.MapType(T.StringType(), self.spark_type(ref.args[1]))
        if ref.name in self.enums:
            return SPARK[self.enums[ref.name].storage]
        return self.struct(ref.name)

    def struct(self, name: str) -> T.StructType:
        """Field metadata carries names, rules, defaults and formats."""
        fields = []
        for f in self.record(name).fields:
            meta = {"type": str(f.type), "name": f.external, "inputs": list(f.inputs), "optional": f.optional, "nullable": f.nullable}
            if f.has_default:
                meta["default"] = json.dumps(f.default)
            if f.rules:
                meta["rules"] = [f"{r.kind} {r.value if r.value is not None else (r.low, r.high)}" for r in f.rules]
            if f.format:
                meta["format"] = f.format
            fields.append(T.StructField(f.name, self.spark_type(f.type), True, meta))
        return T.StructType(fields)

    def fingerprint(self, name: str) -> str:
        """Equal for equal shapes: sha256 of the record and all that it refers to, in canonical JSON."""
        seen: dict[str, Any] = {}

        def visit(ref: TypeRef) -> None:
            for a in ref.args:
                visit(a)
            if ref.name in self.enums:
                e = self.enums[ref.name]
                seen[e.name] = [e.storage, e.flags, list(e.items)]
            elif ref.name in self.records and ref.name not in seen:
                r = self.records[ref.name]
                seen[r.name] = [r.kind, [[f.name, str(f.type), f.optional, f.nullable, f.default, f.external, list(f.inputs)] for f in r.fields]]
                for f in r.fields:
                    visit(f.type)

        visit(TypeRef(self.record(name).name))
        return hashlib.sha256(json.dumps([name, seen], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# --- reading --------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|\#[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>[-+]?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?))"""
    r"""|(?P<arrow>->)|(?P<name>[A-Za-z_][\w.-]*)|(?P<mark>[{}\[\]()<>;:,=@])""",
    re.S | re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class _Token:
    kind: str
    text: str
    at: int


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, [], 0
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise self.error("unexpected character", at)
            if m.lastgroup != "skip":
                self.tokens.append(_Token(m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(_Token("end", "", len(text)))

    def error(self, what: str, at: int | None = None) -> SchemaError:
        at = self.tokens[self.i].at if at is None else at
        line = self.text.count("\n", 0, at) + 1
        return SchemaError(f"{what} at line {line}, column {at - self.text.rfind(chr(10), 0, at)}")

    @property
    def now(self) -> _Token:
        return self.tokens[self.i]

    def next(self) -> _Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def take(self, text: str) -> bool:
        if self.now.text == text and self.now.kind != "string":
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.error(f"expected {text!r}, found {self.now.text!r}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.error(f"expected a name, found {self.now.text!r}")
        return self.next().text

    def value(self) -> Any:
        """A literal: string, number, true, false, or the name of an enum item."""
        t = self.next()
        if t.kind == "string":
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), t.text[1:-1], flags=re.S)
        if t.kind == "number":
            return _number(t.text)
        if t.kind == "name":
            return {"true": True, "false": False}.get(t.text, t.text)
        raise self.error("expected a value", t.at)


def _number(text: str) -> int | float:
    if "x" in text.lower():
        return int(text, 16)
    return float(text) if re.search(r"[.eE]", text) else int(text)


class _Parser:
    def __init__(self, text: str):
        self.r = _Reader(text)
        self.contract_name: str | None = None
        self.contract_attributes: tuple = ()
        self.records: dict[str, Record] = {}
        self.enums: dict[str, Enum] = {}
        self.services: dict[str, Service] = {}

    def run(self) -> Contract:
        r = self.r
        while r.now.kind != "end":
            attributes = self.attributes()
            keyword = r.name()
            if keyword == "schema":
                self.contract_name = r.name()
                self.contract_attributes = attributes + self.attributes()
                r.take(";")
            elif keyword in ("enum", "flags"):
                self.enum(keyword == "flags")
            elif keyword in ("message", "composite", "group", "union"):
                self.record(keyword, attributes)
            elif keyword in ("service", "channel", "component"):
                self.service(keyword, attributes)
            else:
                r.i -= 1
                raise r.error(f"unknown declaration {keyword!r}")
        return _checked(Contract(self.contract_name, self.contract_attributes, self.records, self.enums, self.services))

    def new(self, name: str) -> str:
        if name in self.records or name in self.enums or name in self.services or name in ALIASES:
            raise self.r.error(f"{name} is declared twice")
        return name

    def attributes(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        r, out = self.r, []
        while r.take("["):
            while not r.take("]"):
                name, values = r.name(), []
                if r.take("("):
                    while not r.take(")"):
                        values.append(str(r.value()))
                        r.take(",")
                out.append((name, tuple(values)))
                r.take(",")
        return tuple(out)

    def enum(self, flags: bool) -> None:
        r = self.r
        name, storage, items = self.new(r.name()), "uint32" if flags else "int32", []
        if r.take("<"):
            storage = ALIASES.get(r.name(), "")
            r.need(">")
        if storage not in INTEGERS:
            raise r.error("an enum needs an integer type")
        low, high = INTEGERS[storage]
        r.need("{")
        while not r.take("}"):
            item = r.name()
            if r.take("="):
                value = r.value()
                if not isinstance(value, int) or isinstance(value, bool):
                    raise r.error(f"{item} needs an integer")
            else:
                value = (items[-1][1] * 2 if items else 1) if flags else (items[-1][1] + 1 if items else 0)
            if any(item == n or value == v for n, v in items):
                raise r.error(f"{item} repeats a name or value of {name}")
            if not low <= value <= high:
                raise r.error(f"{value} is no {storage}")
            items.append((item, value))
            r.take(";") or r.take(",")
        r.take(";")
        self.enums[name] = Enum(name, storage, tuple(items), flags)

    def type(self, depth: int = 0) -> TypeRef:
        r = self.r
        if depth > DEEPEST:
            raise r.error(f"types are nested more than {DEEPEST} deep")
        name = r.name()
        ref = TypeRef(ALIASES.get(name, name))
        if ref.name in ("list", "set", "map", "group") and r.take("<"):
            args = [self.type(depth + 1)]
            while r.take(","):
                args.append(self.type(depth + 1))
            r.need(">")
            if len(args) != (2 if ref.name == "map" else 1):
                raise r.error(f"{ref.name} has a wrong number of types")
            ref = TypeRef(ref.name, tuple(args))
        elif ref.name == "bytes" and r.take("("):
            ref = TypeRef("bytes", (), int(r.value()))
            r.need(")")
        while r.now.text == "[" and r.tokens[r.i + 1].kind == "number":
            r.next()
            ref = TypeRef("array", (ref,), int(r.value()))
            r.need("]")
        return ref

    def rules(self) -> list[Rule]:
        r, out = self.r, []
        while r.take("@"):
            kind = r.name()
            r.need("(")
            values, named = [], {}
            while not r.take(")"):
                if r.now.kind == "name" and r.tokens[r.i + 1].text == "=":
                    key = r.name()
                    r.need("=")
                    named[key] = r.value()
                else:
                    values.append(r.value())
                r.take(",")
            if kind in ("Min", "Max") and len(values) == 1 and isinstance(values[0], int | float):
                out.append(Rule(kind.lower(), values[0]))
            elif kind == "Size" and (values or named):
                low, high = named.get("min", values[0] if values else None), named.get("max", values[1] if len(values) > 1 else None)
                out.append(Rule("size", None, low, high))
            elif kind == "Pattern" and len(values) == 1 and isinstance(values[0], str):
                out.append(Rule("pattern", values[0]))
            else:
                raise r.error(f"wrong rule @{kind}")
        return out

    def field(self) -> Field:
        r = self.r
        attributes, rules = self.attributes(), self.rules()
        attributes += self.attributes()
        optional = nullable = False
        while r.now.text in ("optional", "nullable", "required") and r.tokens[r.i + 1].text != ";":
            word = r.name()
            optional, nullable = optional or word == "optional", nullable or word == "nullable"
            rules += self.rules()
            attributes += self.attributes()
        ref, name = self.type(), r.name()
        while r.now.text == "[" and r.tokens[r.i + 1].kind == "number":
            r.next()
            ref = TypeRef("array", (ref,), int(r.value()))
            r.need("]")
        attributes += self.attributes()
        default, has = None, False
        if r.take("=") or r.take("default"):
            default, has = r.value(), True
        attributes += self.attributes()
        r.need(";")
        return Field(name, ref, optional, nullable, default, has, tuple(rules), attributes)

    def record(self, kind: str, attributes: tuple) -> None:
        r = self.r
        name, fields = self.new(r.name()), []
        attributes += self.attributes()
        r.need("{")
        while not r.take("}"):
            f = self.field()
            if any(f.name == x.name for x in fields):
                raise r.error(f"{name}.{f.name} is declared twice")
            fields.append(f)
        r.take(";")
        self.records[name] = Record(name, kind, tuple(fields), attributes)

    def service(self, kind: str, attributes: tuple) -> None:
        r = self.r
        name, methods = self.new(r.name()), []
        r.need("{")
        while not r.take("}"):
            self.attributes()
            method = r.name()
            r.need(":")
            request = r.name()
            response, throws = "", []
            if r.take("->"):
                response = r.name()
            if r.take("throws"):
                throws.append(r.name())
                while r.take(","):
                    throws.append(r.name())
            r.need(";")
            methods.append(Method(method, request, response, tuple(throws)))
        r.take(";")
        self.services[name] = Service(name, kind, tuple(methods), attributes)


def _checked(c: Contract) -> Contract:
    """Types are known, names are unambiguous, records don't hold themselves, defaults fit their fields."""

    def known(ref: TypeRef, where: str) -> None:
        for a in ref.args:
            known(a, where)
        if ref.name not in SPARK and ref.name not in ("list", "set", "map", "group", "array") and ref.name not in c.records and ref.name not in c.enums:
            raise SchemaError(f"{where} has the unknown type {ref.name}")
        if ref.name == "map" and ref.args[0].name != "string":
            raise SchemaError(f"{where}: the keys of a map are strings")

    def holds(ref: TypeRef) -> list[str]:
        return [n for a in ref.args for n in holds(a)] + ([ref.name] if ref.name in c.records else [])

    for r in c.records.values():
        seen: dict[str, str] = {}
        for f in r.fields:
            known(f.type, f"{r.name}.{f.name}")
            for n in f.inputs:
                if seen.setdefault(n, f.name) != f.name:
                    raise SchemaError(f"{r.name}: the name {n} is ambiguous")
            if f.has_default and f.type.name in c.enums and isinstance(f.default, str):
                for part in re.split(r"[ \t|,+]+", f.default):
                    if part not in c.enums[f.type.name].values:
                        raise SchemaError(f"{r.name}.{f.name}: {part} is no {f.type.name}")
        stack, done = [n for f in r.fields for n in holds(f.type)], set()
        while stack:
            n = stack.pop()
            if n == r.name:
                raise SchemaError(f"{r.name} holds itself")
            if n not in done:
                done.add(n)
                stack += [x for f in c.records[n].fields for x in holds(f.type)]
    for s in c.services.values():
        for m in s.methods:
            for n in (m.request, m.response, *m.throws):
                if n and n not in c.records and s.kind == "service":
                    raise SchemaError(f"{s.name}.{m.name}: no message is named {n}")
    return c


def parse_schema(text: str) -> Contract:
    return _Parser(text).run()

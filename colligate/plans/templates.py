"""The expression template dialect: a lexer and parser on the driver, and an evaluator for values.

A parsed template is a tree of tuples. render_rows runs it for each row in a pandas UDF; compile_column (in
columns.py) turns the part of the dialect that has typed names into one column expression instead.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from .rendering import (
    FILTERS,
    TESTS,
    Cycler,
    Joiner,
    LoaderError,
    Namespace,
    Safe,
    TemplateError,
    TemplateSyntaxError,
    Undefined,
    UndefinedError,
    attribute,
    escaped,
    item,
    text,
)

_INT64 = 1 << 63


@dataclass
class Options:
    trim_blocks: bool = False
    lstrip_blocks: bool = False
    keep_trailing_newline: bool = False
    line_statement_prefix: str | None = None
    line_comment_prefix: str | None = None
    autoescape: bool = False
    strict: bool = False


# --- lexing ---------------------------------------------------------------------------------------

_OPEN = re.compile(r"\{\{[-+]?|\{%[-+]?|\{#[-+]?")
_EXPR = re.compile(
    r"""\s*(?:(?P<float>(?:\d+(?:_\d+)*)(?:\.\d+(?:_\d+)*(?:[eE][-+]?\d+)?|[eE][-+]?\d+))|(?P<int>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|[1-9]\d*(?:_\d+)*|0+(?:_0+)*)"""
    r"""|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[^\W\d]\w*)|(?P<op>//|\*\*|==|!=|>=|<=|[-+*/%~<>()\[\]{},.:|=]))""",
    re.S,
)


def _unescape(s: str) -> str:
    try:
        return s.encode("ascii", "backslashreplace").decode("unicode-escape") if "\\" in s else s
    except UnicodeDecodeError as e:
        raise TemplateSyntaxError(str(e)) from e


def lex(source: str, options: Options) -> list[tuple[str, Any]]:
    """("text", s), ("expr", tokens), ("stmt", tokens)."""
    source = re.sub(r"\r\n|\r", "\n", source)
    if not options.keep_trailing_newline and source.endswith("\n"):
        source = source[:-1]
    if options.line_statement_prefix or options.line_comment_prefix:
        source = _line_statements(source, options)
    out: list[tuple[str, Any]] = []
    at, strip = 0, False
    while m := _OPEN.search(source, at):
        head, mark = source[at : m.start()], m[0]
        if strip:
            head = head.lstrip()
        if mark.endswith("-"):
            head = head.rstrip()
        elif options.lstrip_blocks and mark[:2] != "{{" and not mark.endswith("+"):
            line = head.rfind("\n") + 1
            if not head[line:].strip(" \t") and (line or not out and at == 0 or source[at - 1 : at] == "\n" or (line == 0 and head == "" and source[at - 1 : at] == "\n")):
                head = head[:line]
        out.append(("text", head))
        kind, at = mark[:2], m.end()
        if kind == "{#":
            end = source.find("#}", at)
            if end < 0:
                raise TemplateSyntaxError("an unclosed comment")
            strip, at = source[end - 1] == "-" and end > at, end + 2
            if options.trim_blocks and source[end - 1] != "+" and source[at : at + 1] == "\n":
                at += 1
            continue
        raw = re.compile(r"\s*raw\s*([-+]?)%\}").match(source, at) if kind == "{%" else None
        if raw:
            end = re.compile(r"\{%([-+]?)\s*endraw\s*([-+]?)%\}").search(source, raw.end())
            if not end:
                raise TemplateSyntaxError("raw is not closed")
            body = source[raw.end() : end.start()]
            body = body.lstrip() if raw[1] == "-" else body[1:] if options.trim_blocks and raw[1] != "+" and body.startswith("\n") else body
            body = body.rstrip() if end[1] == "-" else body
            out.append(("text", body))
            at, strip = end.end(), end[2] == "-"
            if options.trim_blocks and not strip and source[at : at + 1] == "\n":
                at += 1
            continue
        tokens, at, sign = _tag(source, at, "}}" if kind == "{{" else "%}")
        out.append(("expr" if kind == "{{" else "stmt", tokens))
        strip = sign == "-"
        if kind == "{%" and options.trim_blocks and sign != "+" and not strip and source[at : at + 1] == "\n":
            at += 1
    rest = source[at:]
    out.append(("text", rest.lstrip() if strip else rest))
    return out


def _line_statements(source: str, options: Options) -> str:
    out = []
    for line in source.split("\n"):
        p, c = options.line_statement_prefix, options.line_comment_prefix
        if p and line.lstrip().startswith(p):
            body = line.lstrip()[len(p) :].strip().removesuffix(":") if not line.rstrip().endswith("::") else line.lstrip()[len(p) :].strip()
            out.append("\0{% " + body + " %}")
        elif c and line.lstrip().startswith(c):
            out.append("\0")
        else:
            out.append((line[: line.index(c)] if c and c in line else line) + "\n")
    joined = "".join(out).replace("\0", "")
    return joined[:-1] if joined.endswith("\n") else joined


def _tag(source: str, at: int, close: str) -> tuple[list[tuple[str, Any]], int, str]:
    tokens: list[tuple[str, Any]] = []
    brackets: list[str] = []
    while True:
        rest = re.compile(r"\s*([-+]?)" + re.escape(close)).match(source, at)
        if rest and not brackets:
            return tokens, rest.end(), rest[1]
        m = _EXPR.match(source, at)
        if not m:
            raise TemplateSyntaxError(f"unexpected text at {at}" if source[at:].strip() else "an unclosed tag")
        kind, value, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind == "op" and value in "([{":
            brackets.append({"(": ")", "[": "]", "{": "}"}[value])
        elif kind == "op" and value in ")]}":
            if not brackets or brackets.pop() != value:
                raise TemplateSyntaxError(f"unexpected {value}")
        if kind == "int":
            n = int(value.replace("_", ""), 0) if value.strip("0_") else 0
            if n >= 2 * _INT64:
                raise TemplateSyntaxError("an integer is too large")
            tokens.append(("lit", n))
        elif kind == "float":
            tokens.append(("lit", float(value.replace("_", ""))))
        elif kind == "string":
            s = _unescape(value[1:-1])
            tokens.append(("lit", s))
        else:
            tokens.append((kind, value))


# --- parsing --------------------------------------------------------------------------------------

_KEYWORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_BINARY = [{"+", "-"}, {"~"}, {"*", "/", "//", "%"}]


class _Tokens:
    def __init__(self, tokens: list[tuple[str, Any]]):
        self.tokens, self.i = [*tokens, ("end", "")], 0

    @property
    def now(self) -> tuple[str, Any]:
        return self.tokens[self.i]

    def op(self, *values: str) -> str | None:
        if self.now[0] == "op" and self.now[1] in values:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def word(self, *values: str) -> str | None:
        if self.now[0] == "name" and self.now[1] in values:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, value: str) -> None:
        if not (self.op(value) or self.word(value)):
            raise TemplateSyntaxError(f"expected {value}, found {self.now[1]!r}")

    def name(self) -> str:
        if self.now[0] != "name":
            raise TemplateSyntaxError(f"expected a name, found {self.now[1]!r}")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def done(self) -> None:
        if self.now[0] != "end":
            raise TemplateSyntaxError(f"unexpected {self.now[1]!r}")

    # expressions, by precedence

    def tuple(self, condition: bool = True, empty: bool = False, stop: tuple[str, ...] = ()) -> Any:
        items, comma = [], False
        while not (self.now[0] == "end" or self.now[0] == "op" and self.now[1] in (")", "=") or self.now[0] == "name" and self.now[1] in stop):
            items.append(self.expression(condition))
            if not self.op(","):
                break
            comma = True
        if not comma and len(items) == 1:
            return items[0]
        if not items and not empty:
            raise TemplateSyntaxError("expected an expression")
        return ("tuple", items)

    def expression(self, condition: bool = True) -> Any:
        if not condition:
            return self.either()
        e = self.either()
        while self.word("if"):
            c = self.either()
            other = self.expression() if self.word("else") else ("undefined",)
            e = ("if", c, e, other)
        return e

    def either(self) -> Any:
        e = self.both()
        while self.word("or"):
            e = ("or", e, self.both())
        return e

    def both(self) -> Any:
        e = self.negated()
        while self.word("and"):
            e = ("and", e, self.negated())
        return e

    def negated(self) -> Any:
        return ("not", self.negated()) if self.word("not") else self.compared()

    def compared(self) -> Any:
        e, rest = self.binary(0), []
        while True:
            if o := self.op("==", "!=", "<", "<=", ">", ">="):
                rest.append((o, self.binary(0)))
            elif self.word("in"):
                rest.append(("in", self.binary(0)))
            elif self.now == ("name", "not") and self.tokens[self.i + 1] == ("name", "in"):
                self.i += 2
                rest.append(("notin", self.binary(0)))
            else:
                return ("cmp", e, rest) if rest else e

    def binary(self, level: int) -> Any:
        if level == len(_BINARY):
            return self.signed()
        e = self.binary(level + 1)
        while o := self.op(*_BINARY[level]):
            e = ("bin", o, e, self.binary(level + 1))
        return e

    def signed(self, filtered: bool = True) -> Any:
        if o := self.op("-", "+"):
            e: Any = ("sign", o, self.signed(False))
        else:
            e = self.postfix(self.primary())
            while self.op("**"):
                e = ("bin", "**", e, self.raised())
        return self.filtered(e) if filtered else e

    def raised(self) -> Any:
        """The right side of a power, which binds to the left."""
        if o := self.op("-", "+"):
            return ("sign", o, self.raised())
        return self.postfix(self.primary())

    def primary(self) -> Any:
        kind, value = self.now
        self.i += 1
        if kind == "lit":
            if isinstance(value, str):
                while self.now[0] == "lit" and isinstance(self.now[1], str):
                    value += self.now[1]
                    self.i += 1
            return ("lit", value)
        if kind == "name":
            return ("lit", _KEYWORDS[value]) if value in _KEYWORDS else ("name", value)
        if value == "(":
            e = self.tuple(empty=True)
            self.need(")")
            return e
        if value == "[":
            items = []
            while not self.op("]"):
                items.append(self.expression())
                if not self.op(","):
                    self.need("]")
                    break
            return ("list", items)
        if value == "{":
            pairs = []
            while not self.op("}"):
                k = self.expression()
                self.need(":")
                pairs.append((k, self.expression()))
                if not self.op(","):
                    self.need("}")
                    break
            return ("dict", pairs)
        raise TemplateSyntaxError(f"unexpected {value!r}")

    def postfix(self, e: Any) -> Any:
        while True:
            if self.op("."):
                kind, value = self.now
                self.i += 1
                if kind == "name":
                    e = ("attr", e, value)
                elif kind == "lit" and isinstance(value, int):
                    e = ("item", e, ("lit", value))
                else:
                    raise TemplateSyntaxError("expected a name or a number")
            elif self.op("["):
                parts = [self.subscript()]
                while self.op(","):
                    parts.append(self.subscript())
                self.need("]")
                e = ("item", e, parts[0] if len(parts) == 1 else ("tuple", parts))
            elif self.op("("):
                e = ("call", e, self.arguments())
            else:
                return e

    def subscript(self) -> Any:
        parts: list[Any] = [None]
        if self.now != ("op", ":"):
            parts = [self.expression()]
            if self.now != ("op", ":"):
                return parts[0]
        while self.op(":"):
            parts.append(None if self.now in (("op", ":"), ("op", "]"), ("op", ",")) else self.expression())
        if len(parts) > 3:
            raise TemplateSyntaxError("a slice has three parts")
        return ("slice", parts + [None] * (3 - len(parts)))

    def arguments(self) -> list[tuple[str, Any, Any]]:
        """After the bracket: ("pos", None, e), ("key", name, e), ("star", None, e), ("dstar", None, e)."""
        out: list[tuple[str, Any, Any]] = []
        while not self.op(")"):
            if self.op("**"):
                out.append(("dstar", None, self.expression()))
            elif self.op("*"):
                if any(k == "dstar" for k, _, _ in out):
                    raise TemplateSyntaxError("unpacked positions stand before unpacked names")
                out.append(("star", None, self.expression()))
            elif self.now[0] == "name" and self.tokens[self.i + 1] == ("op", "="):
                name = self.name()
                self.need("=")
                if any(k == "key" and n == name for k, n, _ in out):
                    raise TemplateSyntaxError(f"{name} is given twice")
                if any(k == "dstar" for k, _, _ in out):
                    raise TemplateSyntaxError("names stand before unpacked names")
                out.append(("key", name, self.expression()))
            else:
                if any(k in ("key", "dstar") for k, _, _ in out):
                    raise TemplateSyntaxError("positions stand before names")
                if any(k == "star" for k, _, _ in out):
                    raise TemplateSyntaxError("positions stand before unpacked positions")
                out.append(("pos", None, self.expression()))
            if not self.op(","):
                self.need(")")
                break
        return out

    def filtered(self, e: Any) -> Any:
        while True:
            if self.op("|"):
                e = self.filter(e)
            elif self.word("is"):
                negative = bool(self.word("not"))
                name = self.name()
                args: list = []
                if self.op("("):
                    args = self.arguments()
                elif self.now[0] == "lit" or self.now[0] == "op" and self.now[1] in ("[", "{") or self.now[0] == "name" and self.now[1] not in ("else", "or", "and", "is", "if", "in", "not", "recursive"):
                    args = [("pos", None, self.postfix(self.primary()))]
                e = ("test", e, name, args, negative)
            elif self.now == ("op", "("):
                self.i += 1
                e = ("call", e, self.arguments())
            else:
                return e

    def filter(self, e: Any) -> Any:
        name = self.name()
        while self.op("."):
            name += "." + self.name()
        return ("filter", e, name, self.arguments() if self.op("(") else [])

    def target(self) -> Any:
        """Names to assign to: a name, ns.attr, or a tuple of them."""

        def one() -> Any:
            if self.op("("):
                t = self.target()
                self.need(")")
                return t
            n = self.name()
            if n in _KEYWORDS or n in ("not", "and", "or", "if", "in", "is", "else"):
                raise TemplateSyntaxError(f"{n} can't be assigned")
            return ("ns", n, self.name()) if self.op(".") else n

        items = [one()]
        comma = False
        while self.op(","):
            comma = True
            if self.now == ("name", "in") or self.now[0] == "end" or self.now == ("op", "="):
                break
            items.append(one())
        return ("unpack", items) if comma else items[0]


class Parser:
    """Statements: a body is a list of ("text", s), ("out", e) and statement tuples."""

    def __init__(self, source: str, options: Options):
        self.parts, self.i, self.options = lex(source, options), 0, options
        self.blocks: dict[str, Any] = {}
        self.loops = 0

    def parse(self) -> list:
        body, end, _ = self.body(())
        return body

    def body(self, ends: tuple[str, ...]) -> tuple[list, str, _Tokens | None]:
        out: list = []
        while self.i < len(self.parts):
            kind, value = self.parts[self.i]
            self.i += 1
            if kind == "text":
                if value:
                    out.append(("text", value))
                continue
            t = _Tokens(value)
            if kind == "expr":
                out.append(("out", t.tuple()))
                t.done()
                continue
            name = t.name()
            if name in ends:
                return out, name, t
            parse = getattr(self, f"_{name}", None)
            if parse is None:
                raise TemplateSyntaxError(f"unknown tag {name}")
            out.append(parse(t))
        if ends:
            raise TemplateSyntaxError(f"expected {ends[0]}")
        return out, "", None

    def inner(self, *ends: str) -> list:
        body, _, t = self.body(ends)
        t.done()
        return body

    def _if(self, t: _Tokens) -> tuple:
        arms, other = [], []
        while True:
            c = t.tuple(False)
            c = ("if", t.both(), c, t.expression() if t.word("else") else ("undefined",)) if t.word("if") else c
            t.done()
            body, end, t = self.body(("elif", "else", "endif"))
            arms.append((c, body))
            if end == "elif":
                continue
            t.done()
            if end == "else":
                other = self.inner("endif")
            return ("if", arms, other)

    def _for(self, t: _Tokens) -> tuple:
        target = t.target()
        t.need("in")
        xs = t.tuple(False, stop=("recursive", "if"))
        where = t.expression() if t.word("if") else None
        recursive = bool(t.word("recursive"))
        t.done()
        self.loops += 1
        body, end, t = self.body(("else", "endfor"))
        self.loops -= 1
        t.done()
        return ("for", target, xs, where, recursive, body, self.inner("endfor") if end == "else" else [])

    def _set(self, t: _Tokens) -> tuple:
        target = t.target()
        if t.op("="):
            e = t.tuple()
            t.done()
            return ("set", target, e)
        chain: Any = ("captured",)
        while t.op("|"):
            chain = t.filter(chain)
        t.done()
        if isinstance(target, tuple) and target[0] == "unpack":
            raise TemplateSyntaxError("a block is set to one name")
        return ("setblock", target, chain, self.inner("endset"))

    def _with(self, t: _Tokens) -> tuple:
        pairs = []
        while t.now[0] != "end":
            if pairs:
                t.need(",")
            target = t.name()
            t.need("=")
            pairs.append((target, t.expression()))
        return ("with", pairs, self.inner("endwith"))

    def _filter(self, t: _Tokens) -> tuple:
        e = t.filter(("captured",))
        while t.op("|"):
            e = t.filter(e)
        t.done()
        return ("filterblock", e, self.inner("endfilter"))

    def _autoescape(self, t: _Tokens) -> tuple:
        e = t.expression()
        t.done()
        return ("autoescape", e, self.inner("endautoescape"))

    def _print(self, t: _Tokens) -> tuple:
        items = []
        while t.now[0] != "end":
            if items:
                t.need(",")
            items.append(t.expression())
        return ("print", items)

    def _do(self, t: _Tokens) -> tuple:
        e = t.tuple()
        t.done()
        return ("do", e)

    def _break(self, t: _Tokens) -> tuple:
        t.done()
        if not self.loops:
            raise TemplateSyntaxError("break outside a loop")
        return ("break",)

    def _continue(self, t: _Tokens) -> tuple:
        t.done()
        if not self.loops:
            raise TemplateSyntaxError("continue outside a loop")
        return ("continue",)

    def _parameters(self, t: _Tokens) -> list[tuple[str, Any]]:
        out: list[tuple[str, Any]] = []
        t.need("(")
        while not t.op(")"):
            name = t.name()
            if any(n == name for n, _ in out):
                raise TemplateSyntaxError(f"{name} is a parameter twice")
            if t.op("="):
                out.append((name, t.expression()))
            elif out and out[-1][1] is not None:
                raise TemplateSyntaxError("a parameter without default follows one with default")
            else:
                out.append((name, None))
            if not t.op(","):
                t.need(")")
                break
        return out

    def _macro(self, t: _Tokens) -> tuple:
        name = t.name()
        parameters = self._parameters(t)
        t.done()
        loops, self.loops = self.loops, 0
        body = self.inner("endmacro")
        self.loops = loops
        return ("macro", name, parameters, body)

    def _call(self, t: _Tokens) -> tuple:
        parameters = self._parameters(t) if t.now == ("op", "(") else []
        e = t.expression()
        t.done()
        if e[0] != "call":
            raise TemplateSyntaxError("expected a call")
        return ("call", parameters, e, self.inner("endcall"))

    def _context(self, t: _Tokens, with_context: bool) -> bool:
        if t.now in (("name", "with"), ("name", "without")) and t.tokens[t.i + 1] == ("name", "context"):
            with_context = t.name() == "with"
            t.i += 1
        return with_context

    def _include(self, t: _Tokens) -> tuple:
        e, missing = t.expression(), False
        if t.now == ("name", "ignore") and t.tokens[t.i + 1] == ("name", "missing"):
            t.i += 2
            missing = True
        with_context = self._context(t, True)
        t.done()
        return ("include", e, missing, with_context)

    def _import(self, t: _Tokens) -> tuple:
        e = t.expression()
        t.need("as")
        name = t.name()
        with_context = self._context(t, False)
        t.done()
        return ("import", e, name, with_context)

    def _from(self, t: _Tokens) -> tuple:
        e = t.expression()
        t.need("import")
        names = []
        with_context = False
        while t.now[0] != "end":
            if t.now in (("name", "with"), ("name", "without")) and t.tokens[t.i + 1] == ("name", "context"):
                with_context = self._context(t, False)
                break
            n = t.name()
            if n.startswith("_"):
                raise TemplateSyntaxError("names with an underscore aren't exported")
            names.append((n, t.name() if t.word("as") else n))
            if not t.op(","):
                with_context = self._context(t, False)
                break
        t.done()
        return ("from", e, names, with_context)

    def _extends(self, t: _Tokens) -> tuple:
        e = t.expression()
        t.done()
        return ("extends", e)

    def _block(self, t: _Tokens) -> tuple:
        name = t.name()
        scoped = required = False
        while t.now[0] == "name":
            word = t.name()
            scoped, required = scoped or word == "scoped", required or word == "required"
        t.done()
        if name in self.blocks:
            raise TemplateSyntaxError(f"block {name} is defined twice")
        self.blocks[name] = None
        body, _, t = self.body(("endblock",))
        if t.now[0] == "name" and t.name() != name:
            raise TemplateSyntaxError("an endblock with another name")
        t.done()
        if required and any(n[0] != "text" or n[1].strip() for n in body):
            raise TemplateSyntaxError("a required block has text")
        self.blocks[name] = (body, required)
        return ("block", name, scoped)

    def _trans(self, t: _Tokens) -> tuple:
        pairs, trimmed = [], False
        while t.now[0] != "end":
            if t.op(","):
                continue
            n = t.name()
            if n in ("trimmed", "notrimmed") and t.now != ("op", "="):
                trimmed = n == "trimmed"
            else:
                pairs.append((n, t.expression() if t.op("=") else ("name", n)))
        one, end, t = self.body(("pluralize", "endtrans"))
        count, many = None, None
        if end == "pluralize":
            count = t.name() if t.now[0] == "name" else (pairs[0][0] if pairs else None)
            many = self.inner("endtrans")
        return ("trans", pairs, one, count, many, trimmed)


# --- evaluation -----------------------------------------------------------------------------------


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class Scope:
    def __init__(self, parent: Scope | None = None, values: dict | None = None):
        self.parent, self.values = parent, values if values is not None else {}

    def get(self, name: str) -> Any:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.values:
                return scope.values[name]
            scope = scope.parent
        return KeyError


class Loop:
    """What a loop tells of itself. Items are drawn one ahead; asking for the length draws the rest."""

    def __init__(self, items: Iterable, depth: int, recurse: Callable | None):
        self._source, self._ahead, self.index0 = iter(items), [], -1
        self._recurse, self._depth, self._last, self._now, self._before = recurse, depth, KeyError, KeyError, KeyError

    def _peek(self) -> Any:
        if not self._ahead:
            self._ahead += [x for _, x in zip(range(1), self._source, strict=False)]
        return self._ahead[0] if self._ahead else KeyError

    def _next(self) -> Any:
        found = self._peek()
        if found is not KeyError:
            self._ahead.pop(0)
            self._before, self._now = self._now, found
            self.index0 += 1
        return found

    @property
    def length(self) -> int:
        self._ahead += list(self._source)
        return self.index0 + 1 + len(self._ahead)

    index = property(lambda self: self.index0 + 1)
    revindex = property(lambda self: self.length - self.index0)
    revindex0 = property(lambda self: self.length - self.index0 - 1)
    first = property(lambda self: self.index0 == 0)
    last = property(lambda self: self._peek() is KeyError)
    depth = property(lambda self: self._depth)
    depth0 = property(lambda self: self._depth - 1)
    previtem = property(lambda self: self._before if self.index0 else Undefined("previtem"))
    nextitem = property(lambda self: x if (x := self._peek()) is not KeyError else Undefined("nextitem"))

    def __len__(self) -> int:
        return self.length

    def __bool__(self) -> bool:
        return True

    def __iter__(self) -> Iterator:
        """Draws what the loop has left, which then is over: each item with the loop itself."""
        while (x := self._next()) is not KeyError:
            yield x, self

    def __repr__(self) -> str:
        return f"<LoopContext {self.index}/{self.length}>"

    def cycle(self, *args: Any) -> Any:
        if not args:
            raise TemplateError("nothing to cycle through")
        return args[self.index0 % len(args)]

    def changed(self, *values: Any) -> bool:
        same, self._last = values == self._last, values
        return not same

    def __call__(self, iterable: Any) -> Any:
        if self._recurse is None:
            raise TemplateError("the loop is not recursive")
        return self._recurse(iterable)


@dataclass
class Environment:
    """Templates by name, and what users have registered."""

    templates: dict[str, str] = field(default_factory=dict)
    options: Options = field(default_factory=Options)
    filters: dict[str, Callable] = field(default_factory=lambda: dict(FILTERS))
    tests: dict[str, Callable] = field(default_factory=lambda: dict(TESTS))
    globals: dict[str, Any] = field(default_factory=dict)
    messages: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._parsed = functools.lru_cache(64)(self._parse)

    def _parse(self, source: str) -> tuple[list, dict]:
        p = Parser(source, self.options)
        return p.parse(), p.blocks

    def load(self, name: Any) -> Template:
        if name not in self.templates:
            raise LoaderError(f"no template is named {name}")
        return Template(self, *self._parsed(self.templates[name]))

    def from_string(self, source: str) -> Template:
        return Template(self, *self._parsed(source))


@dataclass
class Template:
    environment: Environment
    body: list
    blocks: dict

    def render(self, context: dict[str, Any] | None = None) -> str:
        """Errors of any kind become a TemplateError with its category."""
        try:
            return Render(self, dict(context or {})).run()
        except TemplateError:
            raise
        except RecursionError as e:
            raise TemplateError("templates are nested too deep") from e
        except (TypeError, ValueError, ArithmeticError, LookupError, AttributeError) as e:
            raise TemplateError(str(e)) from e


class Macro:
    def __init__(self, render: Render, name: str | None, parameters: list, body: list, scope: Scope):
        self.r, self.name, self.parameters, self.body, self.scope = render, name, parameters, body, scope
        self.arguments, self.autoescape = tuple(n for n, _ in parameters), render.autoescape
        used = repr(body)
        self.catch_varargs, self.catch_kwargs, uses = ("('name', '%s')" % n in used for n in ("varargs", "kwargs", "caller"))
        self.explicit_caller = "caller" in self.arguments
        self.caller = uses and not self.explicit_caller

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        scope = Scope(self.scope)
        args = list(args)
        caller = kwargs.pop("caller", None) if self.caller else None
        if "caller" in kwargs and not self.explicit_caller and not self.catch_kwargs:
            raise TypeError(f"{self.name} takes no caller")
        later = []
        for i, (n, e) in enumerate(self.parameters):
            scope.values[n] = Undefined(n, self.r.strict)
            if i < len(args):
                if n in kwargs and not self.catch_kwargs:
                    raise TypeError(f"{n} is given twice")
                scope.values[n] = args[i]
            elif n in kwargs:
                scope.values[n] = kwargs.pop(n)
            elif e is not None:
                later.append((n, e))
        for n, e in later:  # a default sees what was given, and the defaults before it
            scope.values[n] = self.r.eval(e, scope)
        rest = args[len(self.parameters) :]
        if rest and not self.catch_varargs or kwargs and not self.catch_kwargs:
            raise TypeError(f"{self.name} has too many arguments")
        scope.values["varargs"], scope.values["kwargs"] = tuple(rest), kwargs
        if self.caller:
            scope.values["caller"] = caller if caller is not None else Undefined("caller", self.r.strict)
        called, self.r.autoescape = self.r.autoescape, self.autoescape
        try:
            out = self.r.body(self.body, scope)
        finally:
            self.r.autoescape = called
        return Safe(out) if called else out

    def __repr__(self) -> str:
        return f"<Macro {self.name!r}>" if self.name else "<Macro anonymous>"


class Render:
    def __init__(self, template: Template, context: dict, parent: Render | None = None):
        self.t, self.env = template, template.environment
        self.autoescape, self.strict = self.env.options.autoescape, self.env.options.strict
        self.root = Scope(Scope(None, BUILTINS | self.env.globals | {"_": self.translate, "gettext": self.translate}), context)
        self.top = Scope(self.root)
        self.chain: dict[str, list] = {n: [b] for n, b in template.blocks.items()}
        self.parent: Template | None = None
        self.depth = 0

    def run(self) -> str:
        out = self.body(self.t.body, self.top)
        template = self.t
        for _ in range(64):
            if self.parent is None:
                return out
            template, self.parent = self.parent, None
            for n, b in template.blocks.items():
                self.chain.setdefault(n, []).append(b)
            out = self.body(template.body, self.top)
        raise TemplateError("templates extend each other")

    # --- statements ---

    def body(self, nodes: list, scope: Scope) -> str:
        out: list[str] = []
        for n in nodes:
            if n[0] == "text":
                if self.parent is None:
                    out.append(n[1])
            elif n[0] == "out":
                s = self.shown(self.eval(n[1], scope))
                if self.parent is None:
                    out.append(s)
            else:
                try:
                    s = getattr(self, "do_" + n[0])(n, scope)
                except (_Break, _Continue) as stop:
                    stop.args = ("".join(out) + (stop.args[0] if stop.args else ""),)
                    raise
                if s and self.parent is None:
                    out.append(s)
        return "".join(out)

    def shown(self, value: Any) -> str:
        return str(escaped(value)) if self.autoescape else text(value)

    def captured(self, nodes: list, scope: Scope) -> Any:
        parent, self.parent = self.parent, None
        out = self.body(nodes, scope)
        self.parent = parent
        return Safe(out) if self.autoescape else out

    def do_if(self, n: tuple, scope: Scope) -> str:
        for c, body in n[1]:
            if self.eval(c, scope):
                return self.body(body, scope)
        return self.body(n[2], scope)

    def do_for(self, n: tuple, scope: Scope) -> str:
        return self.loop(n, scope, self.eval(n[2], scope), 1)

    def loop(self, n: tuple, scope: Scope, xs: Any, depth: int) -> str:
        _, target, _, where, recursive, body, other = n
        if not hasattr(xs, "__iter__"):
            raise TypeError("a loop needs something to go through")
        if depth > 200:
            raise TemplateError("a loop is nested too deep")

        def passing() -> Iterable:
            for x in xs:
                inner = Scope(scope)
                self.assign(target, x, inner)
                if self.eval(where, inner):
                    yield x

        loop = Loop(xs if where is None else passing(), depth, (lambda ys: self.marked(self.loop(n, scope, ys, depth + 1))) if recursive else None)
        out = []
        while (x := loop._next()) is not KeyError:
            inner = Scope(scope, {"loop": loop})
            self.assign(target, x, inner)
            try:
                out.append(self.body(body, inner))
            except _Continue as stop:
                out.append(stop.args[0])
            except _Break as stop:
                out.append(stop.args[0])
                break
        return "".join(out) if loop.index0 >= 0 else self.body(other, Scope(scope))

    def marked(self, s: str) -> str:
        return Safe(s) if self.autoescape else s

    def do_break(self, n: tuple, scope: Scope) -> str:
        raise _Break

    def do_continue(self, n: tuple, scope: Scope) -> str:
        raise _Continue

    def assign(self, target: Any, value: Any, scope: Scope) -> None:
        if isinstance(target, str):
            scope.values[target] = value
        elif target[0] == "ns":
            ns = self.name(target[1], scope)
            if not isinstance(ns, Namespace):
                raise TemplateError("only a namespace's attributes can be set")
            ns[target[2]] = value
        else:
            values = list(value)
            if len(values) != len(target[1]):
                raise ValueError(f"expected {len(target[1])} values, found {len(values)}")
            for t, v in zip(target[1], values, strict=True):
                self.assign(t, v, scope)

    def do_set(self, n: tuple, scope: Scope) -> str:
        self.assign(n[1], self.eval(n[2], scope), scope)
        return ""

    def do_setblock(self, n: tuple, scope: Scope) -> str:
        value = self.captured(n[3], Scope(scope))
        self.assign(n[1], self.eval(n[2], Scope(scope, {"": value})), scope)
        return ""

    def do_filterblock(self, n: tuple, scope: Scope) -> str:
        inner = Scope(scope)
        inner.values[""] = self.captured(n[2], inner)
        return text(self.eval(n[1], inner))

    def do_with(self, n: tuple, scope: Scope) -> str:
        inner = Scope(scope)
        values = [(name, self.eval(e, scope)) for name, e in n[1]]
        inner.values.update(values)
        return self.body(n[2], inner)

    def do_autoescape(self, n: tuple, scope: Scope) -> str:
        before, self.autoescape = self.autoescape, bool(self.eval(n[1], scope))
        try:
            return self.body(n[2], Scope(scope))
        finally:
            self.autoescape = before

    def do_print(self, n: tuple, scope: Scope) -> str:
        return "".join(self.shown(self.eval(e, scope)) for e in n[1])

    def do_do(self, n: tuple, scope: Scope) -> str:
        self.eval(n[1], scope)
        return ""

    def do_macro(self, n: tuple, scope: Scope) -> str:
        scope.values[n[1]] = Macro(self, n[1], n[2], n[3], scope)
        return ""

    def do_call(self, n: tuple, scope: Scope) -> str:
        caller = Macro(self, None, n[1], n[3], scope)
        e = n[2]
        f = self.eval(e[1], scope)
        args, kwargs = self.arguments(e[2], scope)
        return self.shown(self.called(f, args, kwargs | {"caller": caller}))

    def do_include(self, n: tuple, scope: Scope) -> str:
        names = self.eval(n[1], scope)
        for name in [names] if isinstance(names, str) else names:
            if isinstance(name, Undefined):
                continue
            try:
                template = self.env.load(name)
            except LoaderError:
                continue
            if len(self.includes) > 64:
                raise TemplateError("templates include each other")
            self.includes.append(name)
            r = Render(template, self.flat(scope) if n[3] else {})
            r.includes = self.includes
            r.autoescape = self.autoescape
            out = r.run()
            self.includes.pop()
            return out
        if n[2]:
            return ""
        raise LoaderError(f"no template of {names!r}")

    includes: list = []

    def flat(self, scope: Scope | None) -> dict:
        frames = []
        while scope is not None and scope is not self.root.parent:
            frames.append(scope.values)
            scope = scope.parent
        out: dict = {}
        for f in reversed(frames):
            out |= f
        return out

    def module(self, e: Any, scope: Scope, with_context: bool) -> dict:
        name = self.eval(e, scope)
        r = Render(self.env.load(name), self.flat(scope) if with_context else {})
        out = r.run()
        return {k: v for k, v in r.top.values.items() if not k.startswith("_")} | {"": out}

    def do_import(self, n: tuple, scope: Scope) -> str:
        scope.values[n[2]] = Module(self.module(n[1], scope, n[3]))
        return ""

    def do_from(self, n: tuple, scope: Scope) -> str:
        found = self.module(n[1], scope, n[3])
        for name, own in n[2]:
            scope.values[own] = found.get(name, Undefined(name, self.strict))
        return ""

    def do_extends(self, n: tuple, scope: Scope) -> str:
        if self.parent is not None:
            raise TemplateError("a template extends one other")
        name = self.eval(n[1], scope)
        self.parent = self.env.load(name)
        return ""

    def do_block(self, n: tuple, scope: Scope) -> str:
        return "" if self.parent is not None else self.block(n[1], 0, scope if n[2] else self.top)

    def block(self, name: str, level: int, scope: Scope) -> str:
        body, required = self.chain[name][level]
        if required:
            raise TemplateError(f"block {name} is required")

        def above(at: int) -> Any:
            if at >= len(self.chain[name]):
                return Undefined("super", self.strict)
            return lambda: self.marked(self.block(name, at, scope))

        inner = Scope(scope, {"super": above(level + 1), "self": Blocks(self, scope)})
        return self.body(body, inner)

    def do_trans(self, n: tuple, scope: Scope) -> str:
        _, pairs, one, count, many, trimmed = n
        values = {name: self.eval(e, scope) for name, e in pairs}

        def plain(nodes: list) -> str:
            out = []
            for x in nodes:
                if x[0] == "text":
                    out.append(x[1].replace("%", "%%"))
                elif x[0] == "out" and x[1][0] == "name":
                    values.setdefault(x[1][1], self.name(x[1][1], scope))
                    out.append(f"%({x[1][1]})s")
                else:
                    raise TemplateSyntaxError("a translation holds text and names")
            s = "".join(out)
            return re.sub(r"\s*\n\s*", " ", s.strip()) if trimmed else s

        message = plain(one)
        if many is not None and values.get(count, 1) != 1:
            message = plain(many)
        return self.translate(message) % {k: self.shown(v) for k, v in values.items()}

    def translate(self, message: str) -> str:
        return self.env.messages.get(message, message)

    # --- expressions ---

    def name(self, name: str, scope: Scope) -> Any:
        value = scope.get(name)
        return Undefined(name, self.strict) if value is KeyError else value

    def arguments(self, args: list, scope: Scope) -> tuple[list, dict]:
        out: list = []
        named: dict = {}
        for kind, name, e in args:
            value = self.eval(e, scope)
            if kind == "pos":
                out.append(value)
            elif kind == "star":
                out += list(value)
            elif kind == "key":
                named[name] = value
            else:
                if not isinstance(value, dict):
                    raise TypeError("only a dict can be unpacked to names")
                for k, v in value.items():
                    if k in named or not isinstance(k, str):
                        raise TypeError(f"{k} is given twice")
                    named[k] = v
        return out, named

    def called(self, f: Any, args: Iterable, kwargs: dict) -> Any:
        if isinstance(f, Undefined):
            raise UndefinedError(f"{f.name} is undefined")
        if not callable(f):
            raise TypeError("it can't be called")
        return f(*args, **kwargs)

    def eval(self, e: Any, scope: Scope) -> Any:
        return getattr(self, "on_" + e[0])(e, scope)

    def on_lit(self, e: tuple, scope: Scope) -> Any:
        return e[1]

    def on_undefined(self, e: tuple, scope: Scope) -> Any:
        return Undefined("", self.strict)

    def on_captured(self, e: tuple, scope: Scope) -> Any:
        return scope.get("")

    def on_name(self, e: tuple, scope: Scope) -> Any:
        return self.name(e[1], scope)

    def on_tuple(self, e: tuple, scope: Scope) -> Any:
        return tuple(self.eval(x, scope) for x in e[1])

    def on_list(self, e: tuple, scope: Scope) -> Any:
        return [self.eval(x, scope) for x in e[1]]

    def on_dict(self, e: tuple, scope: Scope) -> Any:
        return {self.eval(k, scope): self.eval(v, scope) for k, v in e[1]}

    def on_attr(self, e: tuple, scope: Scope) -> Any:
        x = self.eval(e[1], scope)
        found = attribute(x, e[2])
        if isinstance(found, Undefined) and isinstance(x, dict):
            return x.get(e[2], Undefined(e[2], self.strict))
        if isinstance(x, dict) and callable(found) and e[2] not in x:
            return found
        return found

    def on_item(self, e: tuple, scope: Scope) -> Any:
        x = self.eval(e[1], scope)
        if e[2][0] == "slice":
            if isinstance(x, Undefined):
                raise UndefinedError(f"{x.name} is undefined")
            parts = [self.eval(p, scope) if p is not None else None for p in e[2][1]]
            return x[slice(*parts)]
        return item(x, self.eval(e[2], scope))

    def on_slice(self, e: tuple, scope: Scope) -> Any:
        return slice(*[self.eval(p, scope) if p is not None else None for p in e[1]])

    def on_call(self, e: tuple, scope: Scope) -> Any:
        f = self.eval(e[1], scope)
        args, kwargs = self.arguments(e[2], scope)
        return self.called(f, args, kwargs)

    def on_filter(self, e: tuple, scope: Scope) -> Any:
        name = e[2]
        value = self.eval(e[1], scope)
        args, kwargs = self.arguments(e[3], scope)
        return self.filter(name, value, args, kwargs)

    def filter(self, name: str, value: Any, args: list, kwargs: dict) -> Any:
        special = {"map": self.mapped, "select": self.selected, "reject": self.selected, "selectattr": self.selected, "rejectattr": self.selected}
        if name in special:
            return special[name](name, value, list(args), kwargs)
        if name not in self.env.filters:
            raise TemplateSyntaxError(f"no filter is named {name}")
        if isinstance(value, Undefined) and value.strict and name not in ("default", "d"):
            str(value)
        if name == "replace" and self.env.filters[name] is FILTERS["replace"]:
            return self.replaced(value, *args, **kwargs)
        found = self.env.filters[name](value, *args, **kwargs)
        if self.autoescape and name == "join":
            xs = list(value) if not isinstance(value, str) else list(value)
            found = Safe(str(escaped(args[0] if args else kwargs.get("d", ""))).join(str(escaped(x)) for x in xs)) if "attribute" not in kwargs and len(args) < 2 else found
        return found

    def replaced(self, s: Any, old: Any, new: Any, count: int | None = None) -> Any:
        """Plain text without autoescape; with it, markup on either side makes markup of all."""
        n = -1 if count is None else count
        if not self.autoescape:
            return str(text(s)).replace(str(text(old)), str(text(new)), n)
        if isinstance(s, Safe) or isinstance(old, Safe) or isinstance(new, Safe):
            return Safe(str(escaped(s)).replace(str(old) if isinstance(old, Safe) else str(text(old)), str(escaped(new)), n))
        return text(s).replace(text(old), text(new), n)

    def mapped(self, _: str, xs: Any, args: list, kwargs: dict) -> Any:
        if not args and "attribute" in kwargs:
            from .rendering import path

            extra = set(kwargs) - {"attribute", "default"}
            if extra:
                raise TypeError(f"unexpected {extra}")
            return (path(x, kwargs["attribute"], kwargs.get("default")) for x in xs)
        if not args:
            raise TemplateError("map needs a filter or an attribute")
        return (self.filter(args[0], x, args[1:], kwargs) for x in xs)

    def selected(self, name: str, xs: Any, args: list, kwargs: dict) -> Any:
        keep = name.startswith("select")
        get: Callable[[Any], Any] = lambda x: x
        if name.endswith("attr"):
            if not args:
                raise TemplateError(f"{name} needs an attribute")
            from .rendering import path

            attr = args.pop(0)
            get = lambda x: path(x, attr)
        test = (lambda x: self.tested(args[0], x, args[1:], kwargs)) if args else bool
        return (x for x in xs if bool(test(get(x))) == keep)

    def tested(self, name: str, value: Any, args: list, kwargs: dict) -> bool:
        if name == "filter":
            return value in self.env.filters or value in ("map", "select", "reject", "selectattr", "rejectattr")
        if name == "test":
            return value in self.env.tests or value in ("filter", "test")
        if name not in self.env.tests:
            raise TemplateSyntaxError(f"no test is named {name}")
        return self.env.tests[name](value, *args, **kwargs)

    def on_test(self, e: tuple, scope: Scope) -> Any:
        args, kwargs = self.arguments(e[3], scope)
        return bool(self.tested(e[2], self.eval(e[1], scope), args, kwargs)) != e[4]

    def on_and(self, e: tuple, scope: Scope) -> Any:
        return self.eval(e[1], scope) and self.eval(e[2], scope)

    def on_or(self, e: tuple, scope: Scope) -> Any:
        return self.eval(e[1], scope) or self.eval(e[2], scope)

    def on_not(self, e: tuple, scope: Scope) -> Any:
        return not self.eval(e[1], scope)

    def on_if(self, e: tuple, scope: Scope) -> Any:
        return self.eval(e[2] if self.eval(e[1], scope) else e[3], scope)

    def on_cmp(self, e: tuple, scope: Scope) -> Any:
        left = self.eval(e[1], scope)
        for op, x in e[2]:
            right = self.eval(x, scope)
            if not _COMPARE[op](left, right):
                return False
            left = right
        return True

    def on_sign(self, e: tuple, scope: Scope) -> Any:
        x = self._number(self.eval(e[2], scope))
        return self._checked(-x if e[1] == "-" else +x)

    @staticmethod
    def _number(x: Any) -> Any:
        if isinstance(x, Undefined):
            raise UndefinedError(f"{x.name} is undefined")
        return x

    @staticmethod
    def _checked(x: Any) -> Any:
        if isinstance(x, int) and not isinstance(x, bool) and not -_INT64 <= x < 2 * _INT64:
            raise TemplateError("an integer is out of range")
        return x

    def on_bin(self, e: tuple, scope: Scope) -> Any:
        a, b = self.eval(e[2], scope), self.eval(e[3], scope)
        if e[1] == "~":
            if self.autoescape:
                return Safe(str(escaped(a)) + str(escaped(b)))
            return str(text(a)) + str(text(b))
        return self._checked(_ARITHMETIC[e[1]](self._number(a), self._number(b)))


class Module:
    def __init__(self, names: dict):
        self.__dict__.update({k: v for k, v in names.items() if k})
        self.rendered = names[""]

    def __str__(self) -> str:
        return self.rendered


class Blocks:
    def __init__(self, r: Render, scope: Scope):
        self._r, self._scope = r, scope

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or name not in self._r.chain:
            return Undefined(name)
        return lambda: self._r.marked(self._r.block(name, 0, self._scope))


def _contains(a: Any, b: Any) -> bool:
    return a in b


_COMPARE: dict[str, Callable[[Any, Any], bool]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": _contains,
    "notin": lambda a, b: a not in b,
}


def _power(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int) and b > 64 and abs(a) > 1:
        raise TemplateError("an integer is out of range")
    return a**b


def _plus(a: Any, b: Any) -> Any:
    return a + b


def _times(a: Any, b: Any) -> Any:
    for x, n in ((a, b), (b, a)):
        if isinstance(x, str | list | tuple) and isinstance(n, int) and len(x) * n > 1 << 20:
            raise TemplateError("a repetition is too long")
    return a * b


_ARITHMETIC: dict[str, Callable[[Any, Any], Any]] = {
    "+": _plus,
    "-": lambda a, b: a - b,
    "*": _times,
    "/": lambda a, b: a / b,
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b,
    "**": _power,
}


def _namespace(*args: Any, **kwargs: Any) -> Namespace:
    return Namespace(*args, **kwargs)


BUILTINS: dict[str, Any] = {"range": range, "dict": dict, "namespace": _namespace, "cycler": Cycler, "joiner": Joiner}

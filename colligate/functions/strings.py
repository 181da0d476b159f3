"""String functions with template semantics, as columns; a pandas UDF only where no built-in has the rule."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: White space as trimming has it.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def _titled(c: Column) -> Column:
    """The title case of one letter; sharp s is Ss, and the digraphs have letters of their own."""
    digraphs = F.translate(F.lower(c), "ǆǉǌǳ", "ǅǈǋǲ")
    return F.when(c == "ß", "Ss").when(F.lower(c).isin("ǆ", "ǉ", "ǌ", "ǳ"), digraphs).otherwise(F.upper(c))


def capitalize(s: Column) -> Column:
    return F.concat(_titled(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.char_length(s))))


def title(s: Column) -> Column:
    """Every word starts large after white space, minus, and opening brackets."""
    parts = F.split(s, r"(?<=[-\s({\[<])")
    return F.array_join(F.transform(parts, capitalize), "")


def trim(s: Column, chars: str | None = None) -> Column:
    if chars is None:
        return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")
    return F.btrim(s, F.lit(chars))


def center(s: Column, width: int = 80) -> Column:
    n = F.char_length(s)
    gap = F.lit(width) - n
    left = F.floor(gap / 2).cast("int") + F.when((gap % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
    return F.when(gap <= 0, s).otherwise(F.concat(F.repeat(F.lit(" "), left), s, F.repeat(F.lit(" "), gap - left)))


def indent(s: Column, width: int | str = 4, first: bool = False, blank: bool = False) -> Column:
    """Lines end with LF; without blank, empty lines get no indentation."""
    pad = width if isinstance(width, str) else " " * width
    lines = F.split(F.regexp_replace(s, r"\r\n|\r|[\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n")
    rest = F.transform(lines, lambda x, i: F.when((i == 0) & F.lit(not first), x).when((x == "") & F.lit(not blank), x).otherwise(F.concat(F.lit(pad), x)))
    return F.array_join(rest, "\n")


def truncate(s: Column, length: int = 255, killwords: bool = False, end: str = "...", leeway: int = 5) -> Column:
    cut = F.substring(s, 1, length - len(end))
    word = F.when(cut.contains(" "), F.regexp_extract(cut, r"(?s)^(.*) ", 1)).otherwise(cut)
    return F.when(F.char_length(s) <= length + leeway, s).otherwise(F.concat(cut if killwords else word, F.lit(end)))


def wordcount(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"[\p{L}\p{N}_]+"))


def wordwrap(s: Column, width: int = 79, break_long_words: bool = True, wrapstring: str = "\n", break_on_hyphens: bool = True) -> Column:
    @F.pandas_udf(T.StringType())
    def wrap(texts: pd.Series) -> pd.Series:
        import textwrap

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            lines = [textwrap.wrap(x, width, expand_tabs=False, replace_whitespace=False, break_long_words=break_long_words, break_on_hyphens=break_on_hyphens) for x in t.splitlines()]
            return wrapstring.join(wrapstring.join(x) for x in lines)

        return texts.map(one)

    return wrap(s)


def replace(s: Column, old: str, new: str, count: int | None = None) -> Column:
    """An empty old stands at every boundary; with a count only the first ones are replaced."""
    if count is None or count < 0:
        return F.replace(s, F.lit(old), F.lit(new)) if old else F.concat(F.lit(new), F.array_join(F.split(s, ""), new), F.when(s == "", "").otherwise(new))
    if count == 0:
        return s
    if old:
        parts = F.split(s, "\\Q" + old + "\\E", count + 1)
        return F.array_join(parts, new)
    head = F.array_join(F.transform(F.split(F.substring(s, 1, count - 1), ""), lambda c: c), new) if count > 1 else F.lit("")
    return F.concat(F.lit(new), head, F.when(F.lit(count > 1) & (s != ""), F.lit(new)).otherwise(""), F.substring(s, F.lit(count), F.char_length(s)))


def escape(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def striptags(s: Column) -> Column:
    """Without comments and tags, white space collapsed, entities resolved."""
    bare = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", ""), r"(?s)<.*?>", "")
    collapsed = F.trim(F.regexp_replace(bare, f"{SPACE}+", " "))
    # texts without an ampersand don't leave the JVM's code for their result
    return F.when(collapsed.contains("&"), _unescaped(collapsed)).otherwise(collapsed)


def urlencode(s: Column) -> Column:
    """Keeps slashes; a space is %20."""
    out = F.url_encode(s)
    for raw, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(raw), F.lit(plain))
    return out


def urlencode_pairs(m: Column) -> Column:
    one = lambda t: F.replace(urlencode(t), F.lit("/"), F.lit("%2F"))
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(one(e["key"]), F.lit("="), one(e["value"].cast("string")))), "&")


def xmlattr(m: Column, autospace: bool = True) -> Column:
    """Attributes of a map; NULL values are left out, keys with separators raise."""
    bad = F.exists(F.map_keys(m), lambda k: k.rlike(r"[\s/>=]"))
    kept = F.filter(F.map_entries(m), lambda e: e["value"].isNotNull())
    out = F.array_join(F.transform(kept, lambda e: F.concat(escape(e["key"]), F.lit('="'), escape(e["value"].cast("string")), F.lit('"'))), " ")
    out = F.when(bad, F.raise_error(F.lit("an attribute name has a separator in it")).cast("string")).otherwise(out)
    return F.when(out != "", F.concat(F.lit(" "), out)).otherwise(out) if autospace else out


def _one_decimal(x: Column) -> Column:
    """Text with one decimal of a double of at least 1, rounded on its binary value, ties to even."""
    whole, one, half = F.floor(x), F.lit(1 << 52), F.lit(1 << 51)
    rest = ((x - whole.cast("double")) * float(1 << 52)).cast("long") * 10 + half
    up = F.shiftright(rest, 52)
    tie = (rest.bitwiseAND(one - 1) == 0) & (up % 2 == 1)
    tenths = whole * 10 + F.when(tie, up - 1).otherwise(up)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def filesizeformat(n: Column, binary: bool = False, largest: str | None = None) -> Column:
    """largest: the unit that all greater sizes are written in too, YB or YiB where not given."""
    base = 1024 if binary else 1000
    units = [("KMGTPEZY"[i] if binary or i else "k") + ("iB" if binary else "B") for i in range(8)]
    units = units[: units.index(largest) + 1 if largest else None]
    out = F.when(n == 1, "1 Byte").when(n < base, F.concat(n.cast("long").cast("string"), F.lit(" Bytes")))
    for i, u in enumerate(units):
        value = F.concat(_one_decimal(n.cast("double") / float(base ** (i + 1))), F.lit(f" {u}"))
        out = out.when(n < float(base ** (i + 2)), value) if i < len(units) - 1 else out.otherwise(value)
    return out


def printf(fmt: str, *args: Column) -> Column:
    """Percent formatting: the forms that Java shares are compiled; %r, %a, named fields and widths by star aren't."""
    import re

    if re.search(r"%\(|\*|%[-+ #0-9.]*[raiu]", fmt):
        return _python_format(F.lit(fmt), F.to_json(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)])))
    return F.format_string(fmt, *args)


@F.pandas_udf(T.StringType())
def _python_format(fmt: pd.Series, args: pd.Series) -> pd.Series:
    import json

    def one(f: str, a: str) -> str:
        values = json.loads(a)
        if "%(" in f:
            first = next(iter(values.values()))
            return f % (first if isinstance(first, dict) else values)
        return f % tuple(values.values())

    return pd.Series([one(f, a) for f, a in zip(fmt, args, strict=True)])


def tojson(json_text: Column) -> Column:
    """JSON text that is safe inside HTML."""
    for raw, safe in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("'", "\\u0027")):
        json_text = F.replace(json_text, F.lit(raw), F.lit(safe))
    return json_text


def urlize(s: Column, trim_url_limit: int | None = None, nofollow: bool = False, target: str | None = None, rel: str | None = "noopener", extra_schemes: tuple[str, ...] = ()) -> Column:
    from ..plans.rendering import urlized

    @F.pandas_udf(T.StringType())
    def link(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else urlized(t, trim_url_limit, nofollow, target, rel, extra_schemes))

    return link(s)


def character_length(s: Column) -> Column:
    return F.char_length(s)


def reverse(s: Column) -> Column:
    return F.reverse(s)

"""The string formats that a schema can ask for, as boolean columns. An unknown format passes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Patterns of the formats.
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = "^(" + "|".join([f"({_H}:){{7}}{_H}", *(f"({_H}:){{1,{i}}}(:{_H}){{1,{7 - i}}}" for i in range(1, 7)), f"{_H}:(:{_H}){{1,6}}", f":((:{_H}){{1,7}}|:)", f"({_H}:){{1,7}}:"]) + ")$"
_LABEL = r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
HOSTNAME = rf"^{_LABEL}(\.{_LABEL})*$"
DOMAIN = rf"^{_LABEL}(\.{_LABEL})+$"
MAC = r"^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$|^([0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}$"
_CORE = r"(0|[1-9]\d*)"
_ID = r"[0-9A-Za-z-]+"
SEMVER = rf"^{_CORE}\.{_CORE}\.{_CORE}(-{_ID}(\.{_ID})*)?(\+{_ID}(\.{_ID})*)?$"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?[^\s<>\"{}|\\^`\x00-\x1F]+$"
BASE64 = r"^[A-Za-z0-9+/]*={0,2}$"
BASE64URL = r"^[A-Za-z0-9_-]*={0,2}$"
POINTER = r"^(/([^~/\x00-\x1F]|~[01])*)*$"
COLOR = r"^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"
MIME = r"^[A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+-]+(\s*;\s*[A-Za-z0-9_-]+=[^;\s]+)*$"
CRON = r"^\s*([0-9A-Za-z*/,?#LW-]+\s+){4,6}[0-9A-Za-z*/,?#LW-]+\s*$"


def is_ip(c: Column) -> Column:
    return c.rlike(IPV4) | c.rlike(IPV6)


def is_cidr(c: Column) -> Column:
    host, prefix = F.regexp_extract(c, "^([^/]+)/([0-9]{1,3})$", 1), F.regexp_extract(c, "^([^/]+)/([0-9]{1,3})$", 2).try_cast("int")
    return F.coalesce(host.rlike(IPV4) & (prefix <= 32) | host.rlike(IPV6) & (prefix <= 128), F.lit(False))


def is_email(c: Column) -> Column:
    local, host = F.regexp_extract(c, "^([^@]+)@([^@]+)$", 1), F.regexp_extract(c, "^([^@]+)@([^@]+)$", 2)
    return local.rlike(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*$") & (F.length(local) <= 64) & host.rlike(DOMAIN)


@F.pandas_udf(T.BooleanType())
def is_balanced(texts: pd.Series) -> pd.Series:
    """Brackets match, quotes end, and the text is not empty."""

    def balanced(text: str | None) -> bool | None:
        if text is None:
            return None
        stack, quote = [], ""
        for ch in text:
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "'\"":
                quote = ch
            elif ch in "([{":
                stack.append(ch)
            elif ch in ")]}" and (not stack or "([{"[")]}".index(ch)] != stack.pop()):
                return False
        return bool(text) and not stack and not quote

    return texts.map(balanced)


@F.pandas_udf(T.BooleanType())
def is_regex(texts: pd.Series) -> pd.Series:
    import re

    def good(text: str | None) -> bool | None:
        try:
            return None if text is None else bool(re.compile(text))
        except re.error:
            return False

    return texts.map(good)


def _base64(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c.rlike(pattern) & (F.length(c) > 0) & ((F.length(c) % 4 == 0) if pattern is BASE64 else (F.length(F.regexp_replace(c, "=", "")) % 4 != 1))


FORMATS: dict[str, Callable[[Column], Column]] = {
    "ip": is_ip,
    "ipaddr": is_ip,
    "cidr": is_cidr,
    "hostname": lambda c: c.rlike(HOSTNAME) & (F.length(c) <= 253),
    "domain": lambda c: c.rlike(DOMAIN) & (F.length(c) <= 253),
    "email": is_email,
    "url": lambda c: c.rlike(URI),
    "uri": lambda c: c.rlike(URI),
    "mac": lambda c: c.rlike(MAC),
    "macaddr": lambda c: c.rlike(MAC),
    "semver": lambda c: c.rlike(SEMVER),
    "hex": lambda c: c.rlike("^[0-9A-Fa-f]+$"),
    "base64": _base64(BASE64),
    "base64url": _base64(BASE64URL),
    "currency": lambda c: c.rlike("^[A-Z]{3}$"),
    "json_pointer": lambda c: c.rlike(POINTER),
    "jsonpath": is_balanced,
    "xpath": is_balanced,
    "cron": lambda c: c.rlike(CRON),
    "color": lambda c: c.rlike(COLOR),
    "mime": lambda c: c.rlike(MIME),
    "mime_type": lambda c: c.rlike(MIME),
    "regex": is_regex,
}


def matches_format(c: Column, name: str) -> Column:
    return FORMATS[name](c) if name in FORMATS else F.lit(True)

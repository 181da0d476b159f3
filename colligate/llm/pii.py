"""Personal data by candidate gradient boosting.

Base spans come from four rules and always stay. High-recall generators then propose further spans, which
may overlap: spelled-out mail addresses, addresses with defanged dots, numbers with other separators,
numbers without a plus sign, and the parts of numbers that run together, which the base rules drop as one.
Boosted trees score each proposal by features of its format (length, digit groups, separators, check digit,
letter case) and of its context (words and characters around it). A threshold for each kind selects what is
added: the least score from which on at least PRECISION of the proposals of held-out texts are right. Of
added spans that overlap each other, the higher score stays; none overlaps a base span.

The trees are trained here, on the driver, from the proposals for TRAINING_ROWS synthetic texts with
documented formats and look-alikes (versions, dates, prices, order numbers, hashes, junk digits) among words;
a proposal is right if it is exactly what was put there. No table's text is used. Null texts are empty and
have no spans. Whole texts are searched; all rules take time in proportion to a text's length, and overlaps
are found by bisection. Rows that repeat stay. Columns other than key and text are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import blocks, bounded

KINDS = ("email", "ip", "card", "phone")
TRAINING_ROWS = 5000
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
PRECISION = 0.99
SEED = 5

Span = tuple[int, int]


# --- base rules -----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            found.append((start, end))
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    return found


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def ips(text: str) -> list[Span]:
    found, end = [], 0
    while m := _IP.search(text, end):
        if all(map(_octet, m.groups())):
            found.append(m.span())
        end = m.end()
    return found


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """The four rules, leftmost and not overlapping within a kind."""
    digit = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digit and "." in text else [],
        "card": cards(text) if digit else [],
        "phone": phones(text) if "+" in text and digit else [],
    }


# --- proposals ------------------------------------------------------------------------------------

_PROPOSALS = {
    "email": [
        re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[A-Za-z0-9-]{2,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9-])", re.I),
    ],
    "ip": [re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]| dot |\.) ?[0-9]{1,3}){3}(?![0-9.])", re.I)],
    "card": [re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{0,2}[0-9]{1,6}){2,5}(?![0-9A-Za-z])")],
    "phone": [re.compile(r"(?<![0-9A-Za-z+.])(?:\(?0{0,2}[0-9]{1,4}\)?)(?:[ ./-]{0,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])")],
}
#: What a text must have for a proposal of a kind to be possible.
_HINT = re.compile(r"[0-9@]|\bat\b|\(at|\[at|\{at", re.I)
_DOT = re.compile(r"dot|\.", re.I)


def parted(text: str) -> Iterator[tuple[str, int, int]]:
    """Numbers that run together fail the base rules as one; proposes the runs of their digit groups that
    have the digits of a card or, with a plus sign, of a phone number."""
    for m in _TOGETHER.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        if len(groups) < 2:
            continue
        for i, (a, _) in enumerate(groups):
            plus, n = text[a - 1 : a] == "+", 0
            for c, b in groups[i : i + 19]:  # each has a digit
                n += b - c
                if n > 19:
                    break
                if 16 <= n and luhn(re.sub(r"[^0-9]", "", text[a:b])):
                    yield "card", a, b
                if plus and 8 <= n <= 15:
                    yield "phone", a - 1, b


def proposals(text: str) -> list[tuple[str, int, int]]:
    out = []
    digit = _DIGIT.search(text) is not None
    if digit:
        out += parted(text)
    for kind, patterns in _PROPOSALS.items():
        if kind != "email" and not digit:
            continue
        for pattern in patterns:
            for at in _anchors(kind, text):
                for m in pattern.finditer(text, *at):
                    out.append((kind, *m.span()))
    return list(dict.fromkeys(out))


_PLAIN_AT = re.compile(r" at [A-Za-z0-9-]{2,63}\.[A-Za-z]", re.I)
_MARKED_AT = re.compile(r"[(\[{]at[)\]}]|@", re.I)
_SPELLED_DOT = re.compile(r"[(\[{ ]dot[)\]} ]", re.I)


def _anchors(kind: str, text: str) -> list[Span]:
    """The places around which a kind can occur, so that long texts without them cost one scan."""
    if kind == "email":
        points = [m.start() for m in _MARKED_AT.finditer(text)]
        points += [m.start() for m in _SPELLED_DOT.finditer(text)]
        points += [m.start() for m in _PLAIN_AT.finditer(text)]
        before, after = 140, 340
    else:
        points = [m.start() for m in _DIGITS.finditer(text)]
        before, after = 3, 60
    spans: list[list[int]] = []
    for p in sorted(points):
        a, b = max(0, p - before), min(len(text), p + after)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


_DIGITS = re.compile(r"[0-9]+")
_TOGETHER = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9])+")

#: Context words of each kind, and of look-alikes.
_CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address", "reach"),
    "ip": ("ip", "host", "server", "address", "ping", "subnet", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "cvv"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "cell", "dial", "number"),
}
_AGAINST = ("version", "v", "order", "invoice", "isbn", "section", "page", "date", "id", "hash", "ref", "price", "token", "password", "key", "serial", "build", "release")
_TLDS = ("com", "org", "net", "edu", "gov", "io", "co", "de", "fr", "es", "uk", "info", "example")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    groups = re.findall(r"[0-9]+", span)
    before = re.findall(r"[a-z-]+", text[max(0, start - 40) : start].lower())[-4:]
    after = re.findall(r"[a-z-]+", text[end : end + 25].lower())[:2]
    near = set(before) | set(after)
    parts = [int(g) for g in groups if len(g) < 10]
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        float(len(set(map(len, groups))) == 1),
        float(luhn(digits)) if digits else 0.0,
        max(parts, default=0),
        float(len(set(re.sub(r"[0-9A-Za-z]", "", span)))),
        span.count("."),
        span.count("-"),
        span.count(" "),
        float("(" in span),
        float("[" in span or "{" in span),
        float("@" in span),
        float("dot" in span.lower()),
        float(re.split(r"[^a-z]+", span.lower())[-1] in _TLDS),
        float(any(c in near for c in _CUES[kind])),
        float(any(c in near for c in _AGAINST)),
        float(text[max(0, start - 1) : start] in ("", " ", "\n", "(", ":", ",", "<", '"')),
        float(text[end : end + 1] in ("", " ", "\n", ")", ".", ",", ";", ">", '"')),
        float(digits.startswith("0")),
        float(text[max(0, start - 1) : start] in ("$", "#", "/", "=", "v")),
        float(bool(digits) and len(set(digits)) <= 2),
        float(span.startswith("+")),
        float(text[max(0, start - 2) : start].strip()[-1:].isdigit()),
        float(text[end : end + 2].strip()[:1].isdigit()),
    ]


# --- boosted trees --------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees of one depth as arrays: at each inner node a feature and a threshold, at each leaf a value."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
        """Logistic loss, Newton leaf values, splits on quantile bins."""
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        base = float(np.log(y.mean() / (1 - y.mean())))
        score, inner = np.full(len(y), base), (1 << DEPTH) - 1
        feature, cut, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                split = None
                if len(rows) >= 20:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        gb = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                        hb = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                        gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                        j = int(gain.argmax())
                        if gain[j] > best:
                            best, split = gain[j], (f, j)
                if split:
                    feature[t, k], cut[t, k] = split[0], edges[split[0]][split[1]]
                right = x[rows, feature[t, k]] > cut[t, k]
                node[rows] = 2 * k + 1 + right
            leaf = node - inner
            value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            score += value[t][leaf]
        return Boosted(base, feature, cut, value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            score += v[node - len(f)]
        return 1 / (1 + np.exp(-score))


# --- training from documented formats -------------------------------------------------------------


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(str(int(d)) for d in rng.integers(0, 10, n))


def _word(rng: np.random.Generator) -> str:
    return "".join(chr(97 + int(i)) for i in rng.integers(0, 26, rng.integers(2, 10)))


def _card_digits(rng: np.random.Generator, n: int, good: bool) -> str:
    body = ("4", "5", "37", "6")[rng.integers(4)] + _number(rng, n)
    check = next(c for c in "0123456789" if luhn(body[: n - 1] + c))
    return body[: n - 1] + (check if good else str((int(check) + int(rng.integers(1, 10))) % 10))


def _phone(rng: np.random.Generator) -> str:
    pick = lambda *x: x[rng.integers(len(x))]
    return "+" + _number(rng, int(rng.integers(1, 3))) + pick(" ", "-", " (") + _number(rng, 3) + pick(" ", "-", ") ") + _number(rng, 3) + pick(" ", "-") + _number(rng, 4)


def _item(rng: np.random.Generator) -> list[tuple[str | None, str]]:
    """Pieces of text that follow each other, each with the kind of personal data that it is, or None."""
    pick = lambda *x: x[rng.integers(len(x))]
    word, number = (lambda: _word(rng)), (lambda n: _number(rng, n))
    kind, good = pick(*KINDS, "joined"), rng.random() < 0.5
    if kind == "joined":  # numbers that run together
        ip = ".".join(str(int(i)) for i in rng.integers(1, 256, 4))
        parts = {"phone": _phone(rng), "card": _card_digits(rng, 16, True), "ip": ip, None: number(int(rng.integers(2, 7)))}
        order = [x for x in rng.permutation(np.array(["phone", "card", "ip", ""], object)).tolist()][: int(rng.integers(2, 4))]
        return [x for k in order for x in ((k or None, parts[k or None]), (None, " "))]
    cue = pick(*_CUES[kind]) + pick(": ", " ", " is ") if rng.random() < (0.5 if good else 0.15) else ""
    if not good and rng.random() < 0.6:
        cue = pick(*_AGAINST) + pick(" ", "=", "#", ": ")
    if kind == "email":
        at, dot = pick(" (at) ", " [at] ", "(at)", "[at]", " at ", " {at} "), pick(" (dot) ", " [dot] ", "[dot]", " dot ", ".")
        if good:
            return [(None, cue), ("email", word() + pick("", ".", "_") + word() + at + word() + dot + pick(*_TLDS))]
        return [(None, cue + pick(word() + " at " + word() + ". " + word(), word() + "@" + word() + ". " + word(), word() + " at " + word() + " dot " + word(), word() + " at " + word() + "." + word()))]
    if kind == "ip":
        octets = [str(int(i)) for i in rng.integers(0, 256, 4)]
        if good:
            return [(None, cue), ("ip", pick("[.]", "(.)", " [.] ", "[dot]", " dot ").join(octets))]
        return [(None, cue + (pick(" . ", ". ", " .").join(octets) if rng.random() < 0.5 else ".".join(str(int(i)) for i in rng.integers(200, 1000, 4))))]
    if kind == "card":
        n = int(pick(13, 15, 16, 16, 16, 19))
        digits = _card_digits(rng, n if good else int(rng.integers(9, 22)), good)
        value = pick(".", "/", "  ", "_", " - ", "").join(digits[i : i + 4] for i in range(0, len(digits), 4))
        return [(None, cue), ("card" if good else None, value)] if good else [(None, cue + pick(value, number(16), number(int(rng.integers(9, 40)))))]
    if good:
        value = pick("(" + number(3) + ") " + number(3) + "-" + number(4), number(3) + "-" + number(3) + "-" + number(4), "00" + number(2) + " " + number(3) + " " + number(7), "0" + number(3) + " / " + number(6), number(3) + "." + number(3) + "." + number(4))
        return [(None, pick(*_CUES["phone"]) + pick(": ", " ", " is ")), ("phone", value)]
    return [(None, cue + pick(number(4) + "-" + number(2) + "-" + number(2), number(2) + "/" + number(2) + "/" + number(4), number(int(rng.integers(5, 14))), number(3) + " " + number(3), number(2) + " " + number(4) + " " + number(2), number(3) + "-" + number(3) + "-" + number(4)))]


def synthetic(rng: np.random.Generator) -> tuple[str, set[tuple[str, int, int]]]:
    """A text of words, personal data and look-alikes, and where the personal data are."""
    text, planted = "", set()
    for _ in range(int(rng.integers(1, 4))):
        text += " ".join(_word(rng) for _ in range(rng.integers(0, 6))) + (" ", ". ", "\n", ", ")[rng.integers(4)]
        for kind, piece in _item(rng):
            if kind:
                planted.add((kind, len(text), len(text) + len(piece)))
            text += piece
        text += ("", " ", ".", ", ")[rng.integers(4)]
        text = text if text.endswith((" ", "\n")) else text + " "
    return text + " ".join(_word(rng) for _ in range(rng.integers(0, 4))), planted


class Free:
    """Which spans overlap none that were taken; those taken are kept apart, in order."""

    def __init__(self, taken: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(taken):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def has(self, a: int, b: int) -> bool:
        at = bisect.bisect_right(self.ends, a)
        return at == len(self.starts) or self.starts[at] >= b

    def take(self, a: int, b: int) -> None:
        at = bisect.bisect_right(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def proposed(text: str, base: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """The proposals that no base span overlaps."""
    if not _HINT.search(text):
        return []
    free = Free([s for spans in base.values() for s in spans])
    return [p for p in proposals(text) if free.has(p[1], p[2])]


@dataclass
class Redactor:
    trees: Boosted
    thresholds: dict[str, float]

    def spans(self, text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
        """Base spans, and base and added spans."""
        base = base_spans(text)
        out = {k: list(v) for k, v in base.items()}
        if found := proposed(text, base):
            scores = self.trees.probability(np.array([features(text, *p) for p in found]))
            added = sorted(((float(s), *p) for s, p in zip(scores, found, strict=True) if s >= self.thresholds[p[0]]), key=lambda x: (-x[0], x[2], -x[3], x[1]))
            free = Free([])
            for _, kind, a, b in added:
                if free.has(a, b):
                    free.take(a, b)
                    out[kind].append((a, b))
        return base, {k: sorted(v) for k, v in out.items()}


@functools.cache
def train(rows: int = TRAINING_ROWS, precision: float = PRECISION, seed: int = SEED) -> Redactor:
    """Fits on two thirds of the synthetic texts, calibrates on the others."""
    rng = np.random.default_rng(seed)
    x, y, of = [], [], []
    for i in range(rows):
        text, planted = synthetic(rng)
        for p in proposed(text, base_spans(text)):
            x.append(features(text, *p))
            y.append(p in planted)
            of.append(i)
    x, y, fit = np.array(x), np.array(y, float), np.array(of) % 3 > 0
    trees = Boosted.fit(x[fit], y[fit])
    score, thresholds = trees.probability(x[~fit]), {}
    for i, kind in enumerate(KINDS):
        own = x[~fit][:, 0] == i
        s, label = score[own], y[~fit][own]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        if not len(good):
            raise ValueError(f"no threshold gives {kind} the precision asked for")
        thresholds[kind] = float(s[order][good[-1]])
    return Redactor(trees, thresholds)


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in brackets; the first of overlapping spans counts."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
            end = b
    return "".join([*out, text[end:]])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", redact: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans (base and added
    ones), and with redact=True the text with all spans replaced."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(train())  # TREES small arrays

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = sent.value
        for batch in blocks(batches, "text"):
            counts, shas, spans, more, texts = [], [], [], [], []
            for t in batch.column("text").fill_null("").to_pylist():
                base, every = redactor.spans(t)
                counts.append([len(base[k]) for k in KINDS])
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                more.append(sum(len(every[k]) - len(base[k]) for k in KINDS))
                if redact:
                    texts.append(redacted(t, every))
            table = np.array(counts, np.int64).reshape(-1, 4)
            columns = [batch.column("doc_id"), *(pa.array(table[:, i]) for i in range(4)), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64()), pa.array(table.sum(1) + np.array(more, np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * redact, names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"] + ["redacted"] * redact
    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long" + ", redacted string" * redact
    return picked.mapInArrow(rows, schema)

"""Plain Python versions of what the operators return."""

import collections
import hashlib
import re
import zlib

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shards(rows, tokenizer, end=2):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = LETTERED.findall(low(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc, text in rows:
        w, hit, found = LETTERED.findall(low(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted("null" if i is None else str(i) for i in found))), bool(hit)))
    return out


def phrases(rows):
    first = {}
    for doc, text in rows:
        w = SPACED.findall(text or "")
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            if doc is not None:
                first[x] = min(first.get(x, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = SPACED.findall(text or ""), set()
        for k in range(len(w) - 12):
            if doc is not None and first[tuple(w[k : k + 13])] < doc:
                gone |= set(range(k, k + 13))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def near(rows, percent=75):
    sets = []
    for doc, text in rows:
        w = SPACED.findall(low(text))
        sets.append((doc, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), top(d) if d is not None else None, d is None or top(d) == d) if s else (d, 0, d, True) for d, s in sets]


def lines(rows):
    """Removed line numbers by document."""
    entries = []
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(text.split("\n")):
            w = [x for x in line.lower().split(" ") if x]
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            entries.append(((doc is not None, doc or 0, n), s))
    gone = collections.defaultdict(set)
    for k, s in entries:
        for j, t in entries:
            if j < k and s and t and 100 * len(s & t) >= 75 * len(s | t):
                gone[k[1] if k[0] else None].add(k[2])
                break
    return gone

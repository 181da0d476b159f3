"""Repeated phrases: words of a document that a smaller document's 13-word windows cover are removed.

1. Stretches. Of the five-word grams in each window the one with the least hash is its anchor, so documents
   that share a window share its anchor. The windows of one anchor in one place are a stretch of words.
   Stretches whose anchor occurs in one document alone are dropped; the others are grouped by hash. A
   stretch that a smaller document has too belongs to the smallest such document with all its windows.
2. Windows. Only where different stretches have one anchor can a window be in several of them. There the
   windows of each stretch's first document are grouped by hash in turn.
3. Passages. A run of windows that others look for in a document is a passage of it; a run of windows that
   belong to one smaller document is a segment that looks for it.
4. Automata. Passages and segments are dealt by the document that they belong to. There the words of its
   passages are compiled into an Aho-Corasick automaton of all their windows, and the segments are streamed
   through it; what it finds, word for word, is removed. A document whose windows recur in very many others
   is dealt to several places, each with a copy of its passages and a share of the segments.

No step collects what shares a hash: grouping keeps the least and greatest document and a count, and is
begun in each block before rows are shuffled.

Words are what stands between ASCII white space. Null texts have no words. Rows with a null id lose nothing
and are nobody's source. Rows that share an id lose nothing to each other. Empty tables give empty results;
texts are taken whole. Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import blocks, bounded, freed, mixed, spread, texts, written
from .words import SPACED, Words, find, sequence_hashes

WINDOW = 13
GRAM = 5
#: Bytes of text that the hashing kernels take at once where nothing is grouped: what caches hold.
KERNEL_BYTES = 512 << 10
#: Bytes of text whose stretches are grouped before they are shuffled, so that a frequent one is one row of each.
GROUPED_BYTES = 8 << 20
#: Documents that one place serves with the passages of a document.
SERVED = 500
#: Distinct words in one automaton, which are its letters; there are some 1.1 million code points.
LETTERS = 1_000_000


def windows_of(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of every text: its first word, its hash, and the first word of its anchor."""
    counts = np.maximum(np.diff(found.first) - WINDOW + 1, 0)
    at = spread(found.first[:-1], counts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none
    n = len(found.hashes) - WINDOW + 1
    # the low four bits of a gram's hash give way to those of its place in its text: a least one tells its place
    base = np.repeat(found.first[:-1], np.diff(found.first))
    where = (np.arange(len(base)) - base)[: n + WINDOW - GRAM].astype(np.uint64)
    marked = sequence_hashes(found.hashes, GRAM) & ~np.uint64(15) | where & np.uint64(15)
    least = marked[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, marked[j : j + n], out=least)
    anchor = at + (((least[at] & np.uint64(15)).astype(np.int64) - (at - base[at])) & 15)
    return at, sequence_hashes(found.hashes, WINDOW)[at], anchor


@dataclass
class Stretches:
    """row: text of each; first, last: of its windows; hashes; anchors; of: the stretch of each window."""

    windows: np.ndarray
    window_hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hashes: np.ndarray
    anchors: np.ndarray
    of: np.ndarray

    @staticmethod
    def find(found: Words) -> Stretches:
        at, hashes, anchor = windows_of(found)
        new = np.ones(len(at), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        # at most nine windows: the first and the last one hold all words
        own = mixed(hashes[first] * np.uint64(0xA24BAED4963EE407) + mixed(hashes[last]) + (last - first).astype(np.uint64))
        grams = sequence_hashes(found.hashes, GRAM)
        row = np.searchsorted(found.first, at[first], "right") - 1
        return Stretches(at, hashes, row, first, last, own, grams[anchor[first]] if len(at) else own, np.cumsum(new) - 1)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch of GROUPED_BYTES of text: anchor, its hash, and the documents with it."""
    for whole in blocks(batches, "text", GROUPED_BYTES):
        parts = []
        for batch in blocks(iter([whole]), "text", KERNEL_BYTES):
            found = Stretches.find(find(*texts(batch.column("text")), SPACED))
            parts.append((found.hashes, batch.column("doc").to_numpy(zero_copy_only=False)[found.row], found.anchors))
        hashes, doc, anchors = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(hashes):
            continue
        order = np.lexsort((doc, hashes))
        hashes, doc, anchors = hashes[order], doc[order], anchors[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(doc))
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors[start].view(np.int64)), pa.array(hashes[start].view(np.int64)), pa.array(doc[start]), pa.array(doc[end - 1]), pa.array(end - start)],
            ["h", "s", "m", "x", "c"],
        )


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text", KERNEL_BYTES):
        found = Stretches.find(find(*texts(batch.column("text")), SPACED))
        if len(found.first):
            yield pa.RecordBatch.from_arrays([pa.array(found.hashes.view(np.int64)), batch.column("doc").take(pa.array(found.row))], ["s", "doc"])


class Entries:
    """What is known of the stretches or windows of a block's documents, by row and hash."""

    def __init__(self, listed: pa.ListArray, key: str):
        held = listed.flatten()
        lengths = np.diff(listed.offsets.to_numpy()) * listed.is_valid().to_numpy(zero_copy_only=False)
        keys = self._keys(np.repeat(np.arange(len(listed)), lengths), held.field(key).to_numpy(zero_copy_only=False).view(np.uint64))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = {f.name: held.field(f.name).to_numpy(zero_copy_only=False)[order] for f in held.type if f.name != key}

    @staticmethod
    def _keys(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return mixed(hashes ^ mixed(rows.astype(np.uint64) + np.uint64(1)))

    def find(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is known, and its place."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        keys = self._keys(rows, hashes)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def value(self, name: str, hit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """-1 where not known."""
        return np.where(hit, self.values[name][at], -1) if len(self.keys) else np.full(len(hit), -1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, stretches: the distinct windows of a document's own stretches that share an anchor with others."""
    for batch in blocks(batches, "text", KERNEL_BYTES):
        found = Stretches.find(find(*texts(batch.column("text")), SPACED))
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        known = Entries(batch.column("stretches"), "s")
        hit, at = known.find(found.row, found.hashes)
        mine = np.flatnonzero(hit & (known.value("several", hit, at) == 1) & (known.value("m", hit, at) == doc[found.row]))
        counts = found.last[mine] - found.first[mine] + 1
        w, owner = found.window_hashes[spread(found.first[mine], counts)], np.repeat(found.row[mine], counts)
        if len(w):
            order = np.lexsort((w, owner))
            w, owner = w[order], owner[order]
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(w[new].view(np.int64)), pa.array(doc[owner[new]])], ["w", "doc"])


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last plus one of each run of places in which every key continues; keys[0] steps by one."""
    if not len(keys[0]):
        return
    new = keys[0][1:] != keys[0][:-1] + 1
    for k in keys[1:]:
        new |= k[1:] != k[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]])
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


_ROUTED = "source long, places int, place int, kind int, doc long, hash long, start int, words string"


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, hash, text, stretches, windows: passages (kind 0) and segments (kind 1) for the sources' places."""
    for batch in blocks(batches, "text", KERNEL_BYTES):
        text = find(*texts(batch.column("text")), SPACED)
        found = Stretches.find(text)
        doc, own = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc", "hash"))
        place, of = found.windows, found.of
        row = found.row[of] if len(of) else of
        stretches, windows = Entries(batch.column("stretches"), "s"), Entries(batch.column("windows"), "w")
        hit, at = stretches.find(found.row, found.hashes)
        m, k, c = (stretches.value(n, hit, at)[of] for n in ("m", "k", "c"))
        hit = hit[of]
        hit2, at2 = windows.find(row, found.window_hashes)
        m1, k1 = (windows.value(n, hit2, at2) for n in ("m", "k"))
        mine = doc[row]
        hit2 &= hit & (m == mine)  # elsewhere the stretch says where to look
        roles = (
            (0, hit & (m == mine) & (c > 1), m, k),
            (0, hit2 & (m1 == mine), m1, k1),
            (1, hit & (m < mine), m, k),
            (1, hit2 & (m1 < mine), m1, k1),
        )
        out: list[tuple] = []
        for kind, chosen, source, places in roles:
            rows = np.flatnonzero(chosen)
            for p, q in _runs(place[rows], source[rows], places[rows]):
                i, first, last = int(row[rows[p]]), int(place[rows[p]]), int(place[rows[q - 1]]) + WINDOW
                words = text.data[text.starts[first] : text.ends[last - 1]].tobytes().decode()
                s, n, h, d = int(source[rows[p]]), int(places[rows[p]]), int(own[i]), int(doc[i])
                where = range(n) if kind == 0 else (h % n,)
                out += [(s, n, j, kind, d, h, first - int(text.first[i]), words) for j in where]
        if out:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            names = [x.split()[0] for x in _ROUTED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


class PhraseAutomaton:
    """All windows of some passages, a letter for each of their words; several automata where letters run out."""

    def __init__(self):
        self.parts: list[tuple] = []

    def _open(self) -> tuple:
        import ahocorasick

        self.parts.append((ahocorasick.Automaton(), {}))
        return self.parts[-1]

    def add(self, passage: str) -> None:
        words = passage.encode().split()
        step = LETTERS - WINDOW + 1
        for first in range(0, max(1, len(words) - WINDOW + 1), step):
            self._add(words[first : first + LETTERS])

    def _add(self, words: list[bytes]) -> None:
        automaton, letters = self.parts[-1] if self.parts else self._open()
        if len(letters) + len(words) > LETTERS and letters:
            automaton, letters = self._open()
        for w in words:
            n = len(letters) + 1
            letters.setdefault(w, chr(n if n < 0xD800 else n + 0x800))
        line = "".join([letters[w] for w in words])
        for i in range(len(line) - WINDOW + 1):
            automaton.add_word(line[i : i + WINDOW], 1)

    def ready(self) -> PhraseAutomaton:
        for automaton, _ in self.parts:
            automaton.make_automaton()
        return self

    def occurrences(self, words: list[bytes]) -> list[int]:
        """The first words of all windows in these words, in ascending order."""
        found: set[int] = set()
        for automaton, letters in self.parts:
            if len(automaton):
                line = "".join([letters.get(w, "\0") for w in words])
                found.update(end - WINDOW + 1 for end, _ in automaton.iter(line))
        return sorted(found)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a place in the order of source and kind: first the passages, then what looks for them."""
    current, automaton, compiled = None, PhraseAutomaton(), False
    for batch in batches:
        out = []
        for source, places, place, kind, doc, own, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (source, places, place) != current:
                current, automaton, compiled = (source, places, place), PhraseAutomaton(), False
            if kind == 0:
                automaton.add(words)
                continue
            if not compiled:
                automaton.ready()
                compiled = True
            begin = end = -1
            for at in automaton.occurrences(words.encode().split()):
                if at > end:
                    if end > begin:
                        out.append((doc, own, start + begin, end - begin))
                    begin = at
                end = at + WINDOW
            if end > begin:
                out.append((doc, own, start + begin, end - begin))
        if out:
            doc, own, start, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(own, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["doc", "hash", "start", "n"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs: doc, hash (of the text), text. doc, hash, start, n: runs of words that go; they may overlap."""
    spark = bounded(docs.sparkSession)
    known = docs.where("doc is not null and text is not null")
    plain = known.select("doc", "text")
    places = lambda c: F.ceil(F.col(c) / SERVED).cast("int")
    # one shuffle, by anchor, serves the grouping by stretch and then by anchor
    each = plain.mapInArrow(_stretches, "h long, s long, m long, x long, c long").repartition("h")
    each = each.groupBy("h", "s").agg(F.min("m").alias("m"), F.max("x").alias("x"), F.sum("c").alias("c"))
    anchor = Window.partitionBy("h")
    each = each.select("*", F.min("m").over(anchor).alias("m1"), F.max("x").over(anchor).alias("x1"), F.count("*").over(anchor).alias("kinds"))
    recurring = each.where("m1 < x1").select("s", "m", "c", places("c").alias("k"), (F.col("kinds") > 1).alias("several"))
    recurring = freed(written(recurring, spark))
    listed = plain.mapInArrow(_occurrences, "s long, doc long").join(recurring, "s")
    listed = listed.groupBy("doc").agg(F.collect_list(F.struct("s", "m", "c", "k", "several")).alias("stretches"))
    listed = freed(written(listed, spark))
    windows = freed(written(plain.join(listed, "doc").mapInArrow(_windows, "w long, doc long"), spark))
    owners = windows.groupBy("w").agg(F.min("doc").alias("m"), F.max("doc").alias("x"), F.count("*").alias("c")).where("m < x")
    shared = windows.join(owners.select("w", "m", places("c").alias("k")), "w").groupBy("doc").agg(F.collect_list(F.struct("w", "m", "k")).alias("windows"))
    found = freed(written(listed.join(shared, "doc", "left"), spark))
    routed = known.join(found, "doc").select("doc", "hash", "text", "stretches", "windows").mapInArrow(_routed, _ROUTED)
    routed = routed.repartition("source", "places", "place").sortWithinPartitions("source", "places", "place", "kind")
    return freed(written(routed.mapInArrow(_located, "doc long, hash long, start int, n int"), spark))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        counts, removed, shas, kept_texts = [], [], [], []
        for text, spans in zip(batch.column("text").fill_null("").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.encode().split()
            counts.append(len(words))
            if spans:
                keep = np.ones(len(words), bool)
                for s in spans:
                    keep[s["start"] : s["start"] + s["n"]] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            removed.append(counts[-1] - len(words))
            kept = b" ".join(words)
            shas.append(hashlib.sha256(kept).hexdigest())
            if "kept" in batch.schema.names:
                kept_texts.append(kept.decode())
        columns = [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if kept_texts or "kept" in batch.schema.names:
            columns.append(pa.array(kept_texts, pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeated_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", kept_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and with kept_text=True the words that stay, joined by spaces."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    spans = repeated_spans(rows).groupBy("doc", "hash").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    whole = rows.join(spans, ["doc", "hash"], "left").select("doc", "text", "spans")
    whole = whole.withColumn("kept", F.lit(1)) if kept_text else whole
    return whole.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept_text)

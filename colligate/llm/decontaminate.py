"""Benchmark decontamination with suffix arrays over the training documents.

The training side is cut into shards, the Arrow blocks in which the documents arrive. A shard's suffix
array orders its word positions by the words from there on; every suffix of every benchmark item is
searched in it by bisection, which gives the longest verbatim match and all its places. A match of at
least ten words (or of a whole item that is shorter) marks the document's words that it covers.

A position can only begin a match if its words up to the window's length all occur in the benchmark, so
the array is built over the runs of such words. That leaves out no match. Words are compared as numbers
of the benchmark's vocabulary; a training word gets its number by a 64-bit hash, and every match is then
confirmed on the words themselves.

The benchmark is taken in blocks of at most BENCHMARK_BYTES of text, each sent to all executors; a pass over
the documents searches BLOCKS_A_PASS of them.

Null texts and texts without words have no words and no hits. An item without words has no window. Items
that repeat an id count once. A null item id is written as the word null. Rows that repeat stay; documents
of any length are taken whole. Empty tables give empty results, or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import blocks, bounded, spread, texts
from .words import LETTERED, Words, find, sequence_hashes

WINDOW = 10
BENCHMARK_BYTES = 4 << 20
BLOCKS_A_PASS = 4
#: Bytes of training text under one suffix array.
SHARD_BYTES = 2 << 20


class Suffixes:
    """A suffix array over numbers; 0 ends a sequence and is in no match."""

    def __init__(self, symbols: np.ndarray, depth: int):
        """Suffixes are in order by their first depth symbols, or more."""
        self.symbols = symbols
        n, rank, done = len(symbols), symbols.astype(np.int64), 1
        self.order = np.argsort(rank, kind="stable")
        while done < depth and n:
            after = np.zeros(n, np.int64)
            after[: max(0, n - done)] = rank[done:]
            key = rank * (int(after.max()) + 1) + after
            self.order = np.argsort(key, kind="stable")
            by = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[1], by[1:] != by[:-1]]))
            rank[symbols == 0] = 0
            done *= 2

    def narrow(self, low: np.ndarray, high: np.ndarray, offset: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the ranges, each over suffixes with the same first symbols, with this symbol next."""
        return self._bisect(low, high, offset, symbol, False), self._bisect(low, high, offset, symbol, True)

    def _bisect(self, low: np.ndarray, high: np.ndarray, offset: int, symbol: np.ndarray, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        n = len(self.symbols)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            at = self.order[middle] + offset
            found = np.where(at < n, self.symbols[np.minimum(at, n - 1)], 0)
            up = found <= symbol[open_] if right else found < symbol[open_]
            low[open_[up]] = middle[up] + 1
            high[open_[~up]] = middle[~up]
        return low


class Benchmark:
    """A block of benchmark items as numbers of their own vocabulary."""

    def __init__(self, ids: list, item_texts: list[str | None]):
        data = pa.array([x or "" for x in item_texts], pa.string())
        found = find(*texts(data), LETTERED)
        self.hashes, self.numbers = np.unique(found.hashes, return_inverse=True)
        self.numbers = self.numbers + 1
        place: dict[int, bytes] = {}
        for i, n in enumerate(self.numbers.tolist()):
            word = found.text(i, LETTERED)
            if place.setdefault(n, word) != word:
                raise ValueError("two benchmark words have one hash")
        words = [b"", *(place[n] for n in range(1, len(self.hashes) + 1))]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(words), np.uint8)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.ids = ["null" if x is None else str(x) for x in ids]
        counts = np.diff(found.first)
        # each suffix that can begin a window: its place, its item, and the words from there on
        of = np.repeat(np.arange(len(counts)), counts)
        left = np.repeat(found.first[1:], counts) - np.arange(len(self.numbers))
        self.need = np.minimum(counts, WINDOW)
        self.shortest = int(self.need[self.need > 0].min()) if (self.need > 0).any() else 0
        starts = np.flatnonzero(left >= self.need[of])
        self.suffix, self.item, self.left = starts, of[starts], left[starts]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == hashes[maybe], at + 1, 0)
        return out

    def search(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches of every suffix: first word in the block, number of words, item."""
        none = (np.zeros(0, np.int64),) * 3
        if not self.shortest or not len(found.hashes):
            return none
        symbols = self.number(found.hashes)
        # runs of known words inside one document, long enough for some window
        edge = np.zeros(len(symbols) + 1, bool)
        edge[found.first] = True
        known = np.concatenate([[False], symbols > 0, [False]])
        starts = np.flatnonzero(known[1:-1] & (edge[:-1] | ~known[:-2]))
        ends = np.flatnonzero(known[1:-1] & (edge[1:] | ~known[2:])) + 1
        long = ends - starts >= self.shortest
        starts, lengths = starts[long], (ends - starts)[long]
        if not len(starts):
            return none
        places = np.concatenate([spread(starts, lengths), [len(symbols)]])
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        packed, where = np.zeros(int((lengths + 1).sum()), np.int64), np.zeros(int((lengths + 1).sum()), np.int64)
        to = spread(begin, lengths)
        packed[to], where[to] = symbols[places[:-1]], places[:-1]
        array = Suffixes(packed, int(self.left.max()))
        low, high = np.zeros(len(self.suffix), np.int64), np.full(len(self.suffix), len(packed), np.int64)
        active, got, depth = np.arange(len(self.suffix)), [], 0
        while len(active):
            more = self.left[active] > depth
            symbol = np.where(more, self.numbers[np.minimum(self.suffix[active] + depth, len(self.numbers) - 1)], 0)
            l, h = low[active], high[active]
            l[more], h[more] = array.narrow(l[more], h[more], depth, symbol[more])
            h[~more] = l[~more]
            # what drops out of a range here has matched depth words and no more
            if len(full := np.flatnonzero(depth >= self.need[self.item[active]])):
                who = active[full]
                for begin, end in ((low[who], l[full]), (h[full], high[who])):
                    got.append((array.order[spread(begin, end - begin)], np.repeat(who, end - begin), np.full(int((end - begin).sum()), depth)))
            low[active], high[active] = l, h
            active = active[h > l]
            depth += 1
        at, who, length = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        first, item, suffix = where[at], self.item[who], self.suffix[who]
        right = self._same(found, symbols, first, length)
        return first[right], length[right], item[right]

    def _same(self, found: Words, symbols: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether all words of a match are what their numbers stand for; every matched word is compared once."""
        covered = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(covered, first, 1)
        np.add.at(covered, first + length, -1)
        at = np.flatnonzero(np.cumsum(covered[:-1]))
        sizes = found.ends[at] - found.starts[at]
        wrong = sizes != self.sizes[symbols[at]]
        same = np.flatnonzero(~wrong)
        mine = LETTERED.folded[found.data[spread(found.starts[at[same]], sizes[same])]]
        theirs = self.letters[spread(self.begins[symbols[at[same]]], sizes[same])]
        of = np.repeat(same, sizes[same])
        wrong[of[mine != theirs]] = True
        bad = np.zeros(len(symbols) + 1, np.int64)
        bad[at[wrong] + 1] = 1
        bad = np.cumsum(bad)
        return bad[first + length] == bad[first]


def benchmark_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Benchmark]:
    """The benchmark's items, at most BENCHMARK_BYTES of text (or one item) at the driver at a time."""
    ids, held, size = [], [], 0
    for row in benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).toLocalIterator():
        more = len((row.text or "").encode())
        if held and size + more > BENCHMARK_BYTES:
            yield Benchmark(ids, held)
            ids, held, size = [], [], 0
        ids.append(row.item)
        held.append(row.text)
        size += more
    if held:
        yield Benchmark(ids, held)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """A row for each document: key, n_words, n_hit, n_items, items_sha256, contaminated, hits (first word and
    number of words of each covered run) and items."""
    return _found(docs, benchmark, key, text, item, []).withColumnRenamed("cg_key", key)


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents without a hit, with all their columns."""
    found = _found(docs, benchmark, key, text, item, docs.columns).where("not contaminated")
    return found.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _found(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, keep: list[str]) -> DataFrame:
    out = docs.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], F.col(key).alias("cg_key"), F.col(text).alias("cg_text"))
    out = out.withColumns({"cg_spans": F.array().cast("array<int>"), "cg_items": F.array().cast("array<string>")})
    schema = out.schema
    spark = bounded(docs.sparkSession)
    sent = [spark.sparkContext.broadcast(block) for block in benchmark_blocks(benchmark, item, text)]  # at most BENCHMARK_BYTES of text each
    for i in range(0, len(sent), BLOCKS_A_PASS):
        out = out.mapInArrow(_searched(sent[i : i + BLOCKS_A_PASS]), schema)
    extra = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<int>, items array<string>"
    held = [f for f in schema if f.name not in ("cg_text", "cg_spans", "cg_items")]
    return out.mapInArrow(_summed([f.name for f in held]), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held) + ", " + extra)


def _searched(sent: list):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "cg_text", SHARD_BYTES):
            found = find(*texts(batch.column("cg_text")), LETTERED)
            spans = items = None
            for bench in (x.value for x in sent):
                first, length, item = bench.search(found)
                if not len(first):
                    continue
                if spans is None:
                    spans = batch.column("cg_spans").to_pylist()
                    items = batch.column("cg_items").to_pylist()
                doc = np.searchsorted(found.first, first, "right") - 1
                hit = sorted(set(zip(doc.tolist(), (first - found.first[doc]).tolist(), length.tolist(), strict=True)))
                for d, f, n in hit:
                    spans[d] += [f, n]
                for d, i in sorted(set(zip(doc.tolist(), item.tolist(), strict=True))):
                    items[d].append(bench.ids[i])
            if spans is not None:
                columns = {"cg_spans": spans, "cg_items": items}
                batch = pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) if f.name in columns else batch.column(f.name) for f in batch.schema], schema=batch.schema
                )
            yield batch

    return rows


def _summed(held: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "cg_text"):
            found = find(*texts(batch.column("cg_text")), LETTERED, hashed=False)
            n_words = np.diff(found.first)
            hits, items, digests, n_hit = [], [], [], []
            for spans, names in zip(batch.column("cg_spans").to_pylist(), batch.column("cg_items").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for f, n in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    if runs and f <= runs[-1][0] + runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], f + n - runs[-1][0])
                    else:
                        runs.append([f, n])
                hits.append([x for r in runs for x in r])
                n_hit.append(sum(r[1] for r in runs))
                items.append(sorted(set(names)))
                digests.append(hashlib.sha256(",".join(items[-1]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in held]
                + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit]), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                held + ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"],
            )

    return rows

"""Byte-level BPE encoding and decoding by a pair occurrence index.

A block of texts is cut into pre-tokens, and the distinct ones that are not yet known are encoded
together. All their symbols lie in one array with links to the next and the previous symbol. The index
maps each pair that has a merge rank to all its positions; the active ranks lie in a heap. The lowest is
taken, its pair is merged at all its positions, and the neighbours' new pairs enter the lists of their
ranks. In a proper vocabulary a merge never makes a pair of a lower rank, so this order gives every
pre-token what merging it alone would give; for others, each pre-token is merged alone.

Null texts count as empty, which have no ids. Special tokens in a text are ids of their own, as the
tokenizers library has it. Every row gives one row; rows that repeat stay. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import BLOCK_BYTES, blocks, bounded, spread

NO_RANK = np.int64(1 << 40)
CACHED_CHUNKS = 200_000
#: Bytes of text whose new chunks are learned together.
LEARNED_BYTES = 4 << 20
#: The byte-level pre-token pattern, and white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \x85\xa0  -     　"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    first_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    size: int
    token_bytes: list[bytes]
    specials: dict[str, int]
    proper: bool

    @staticmethod
    def read(file: str) -> Vocabulary:
        """file: the text of a tokenizers JSON file of a byte-level BPE."""
        j = json.loads(file)
        vocab, letters = j["model"]["vocab"], byte_letters()
        size = max([*vocab.values(), *(t["id"] for t in j["added_tokens"])]) + 1
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        specials = {t["content"]: t["id"] for t in j["added_tokens"]}
        for content, i in specials.items():
            token_bytes[i] = content.encode()
        first_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            first_ids[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        merged = np.array([vocab[m[0] + m[1]] for m in merges], np.int64)
        made_last = np.full(size, -1, np.int64)
        np.maximum.at(made_last, merged, np.arange(len(merges)))
        proper = bool((np.maximum(made_last[left], made_last[right]) < np.arange(len(merges))).all())
        pairs = left * size + right
        order = np.argsort(pairs)
        return Vocabulary(first_ids, pairs[order], order, merged, size, token_bytes, specials, proper)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_RANK)


class PairIndex:
    """The symbols of many pre-tokens, and the positions of every pair that can be merged."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.v = vocabulary
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        self.starts = ends - lengths
        self.symbols = vocabulary.first_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(self.symbols)
        self.next, self.previous = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.next[ends[lengths > 0] - 1] = -1
        self.previous[self.starts[lengths > 0]] = -1
        self.alive = np.ones(n, bool)
        self.pair_rank = np.full(n, NO_RANK)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._enter(np.flatnonzero(self.next >= 0))

    def _enter(self, at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the lists of their ranks."""
        ranks = self.v.rank(self.symbols[at], self.symbols[self.next[at]])
        self.pair_rank[at] = ranks
        has = ranks < NO_RANK
        at, ranks = at[has], ranks[has]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if rank in self.lists:
                self.lists[rank].append(part)
            else:
                self.lists[rank] = [part]
                heapq.heappush(self.active, rank)

    def _apart(self, at: np.ndarray) -> np.ndarray:
        """Of positions in ascending order, from the left those whose pairs don't overlap."""
        keep, taken = [], -1
        for i, j in zip(at.tolist(), self.next[at].tolist(), strict=True):
            if i != taken:
                keep.append(i)
                taken = j
        return np.array(keep, np.int64)

    def run(self) -> None:
        while self.active:
            rank = heapq.heappop(self.active)
            parts = self.lists.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[(self.pair_rank[at] == rank) & self.alive[at]]
            if not len(at):
                continue
            if self.symbols[at[0]] == self.symbols[self.next[at[0]]]:
                at = self._apart(np.sort(at))
            gone = self.next[at]
            after = self.next[gone]
            self.symbols[at] = self.v.merged[rank]
            self.alive[gone] = False
            self.pair_rank[gone] = NO_RANK
            self.next[at] = after
            linked = after >= 0
            self.previous[after[linked]] = at[linked]
            self.pair_rank[at[~linked]] = NO_RANK
            before = self.previous[at]
            before = before[before >= 0]
            changed = np.concatenate([at[linked], before])
            self._enter(np.unique(changed) if len(changed) > 1 else changed)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each word."""
        counts = np.concatenate([[0], np.cumsum(self.alive)])
        ends = np.append(self.starts[1:], len(self.symbols))
        return self.symbols[self.alive], counts[ends] - counts[self.starts]


def encode_alone(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """One pre-token, merged by the lowest rank, leftmost first."""
    ids = vocabulary.first_ids[np.frombuffer(word, np.uint8)].tolist()
    while len(ids) > 1:
        ranks = vocabulary.rank(np.array(ids[:-1]), np.array(ids[1:]))
        at = int(np.argmin(ranks))
        if ranks[at] == NO_RANK:
            break
        ids[at : at + 2] = [int(vocabulary.merged[ranks[at]])]
    return ids


class Encoder:
    """Texts to ids. Chunks (a space and what follows up to white space, or white space) are known once."""

    def __init__(self, file: str):
        self.v = Vocabulary.read(file)
        self.pre_token = regex.compile(PATTERN)
        self.chunk = regex.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        found = sorted(self.v.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        self.byte_lengths = np.array([len(b) for b in self.v.token_bytes], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.all_bytes = np.frombuffer(b"".join(self.v.token_bytes), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.v.proper:
            index = PairIndex(self.v, words)
            index.run()
            return index.ids()
        ids = [encode_alone(self.v, w) for w in words]
        return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)

    def _learn(self, chunks: list[str]) -> None:
        split = [self.pre_token.findall(c) if c not in self.v.specials else [] for c in chunks]
        words = list({w: 0 for s in split for w in s})
        number = {w: i for i, w in enumerate(words)}
        ids, counts = self._words([w.encode() for w in words]) if words else (np.zeros(0, np.int64),) * 2
        starts = np.cumsum(counts) - counts
        parts = np.array([len(s) for s in split], np.int64)
        of = np.fromiter((number[w] for s in split for w in s), np.int64, int(parts.sum()))
        ends = np.concatenate([[0], np.cumsum(counts[of])])[np.concatenate([[0], np.cumsum(parts)])]
        flat, lengths = ids[spread(starts[of], counts[of])], np.diff(ends)
        for i, c in enumerate(chunks):
            self.places[c] = len(self.lengths) + i
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        for content, i in self.v.specials.items():
            if content in self.places and self.lengths[self.places[content]] == 0:
                self.starts[self.places[content]], self.lengths[self.places[content]] = len(self.flat), 1
                self.flat = np.append(self.flat, i)

    def _chunks(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.chunk.findall(text)
        parts = self.special.split(text)
        return [c for i, p in enumerate(parts) for c in ([p] if i % 2 else self.chunk.findall(p))]

    def prepare(self, batch: list[str]) -> None:
        """Learn all chunks of these texts together, as the index has a cost for each active rank."""
        if len(self.places) > CACHED_CHUNKS:
            self.clear()
        known, missing = self.places, {}
        for text in batch:
            missing.update((c, 0) for c in self._chunks(text) if c not in known)
        if missing:
            self._learn(list(missing))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text, of texts that were prepared."""
        split = [self._chunks(x) for x in batch]
        known = self.places
        counts = np.array([len(x) for x in split], np.int64)
        place = np.fromiter((known[c] for x in split for c in x), np.int64, int(counts.sum()))
        lengths = self.lengths[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[spread(self.starts[place], lengths)], np.diff(ends)

    def decode(self, ids: np.ndarray) -> str:
        return self.all_bytes[spread(self.byte_starts[ids], self.byte_lengths[ids])].tobytes().decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(file: str) -> Encoder:
    key = zlib.crc32(file.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(file)
    return _encoders[key]


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, with ids=True the ids, and with decoded=True the decoded text.

    tokenizer: a byte-level BPE file that the driver can open. The hashes are over the ids as little-endian
    unsigned 32-bit integers and the decoded text in UTF-8.
    """
    with open(tokenizer, encoding="utf-8") as f:
        sent = bounded(docs.sparkSession).sparkContext.broadcast(f.read())  # one tokenizer's file, a few MB

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        try:
            for whole in blocks(batches, "text", LEARNED_BYTES):
                e.prepare(whole.column("text").fill_null("").to_pylist())
                yield from map(encoded, blocks(iter([whole]), "text", BLOCK_BYTES))
        finally:
            e.clear()  # the worker may go on to other work

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(sent.value)
        found, counts = e.encode(batch.column("text").fill_null("").to_pylist())
        small, at = found.astype("<u4"), np.concatenate([[0], np.cumsum(counts)])
        byte_ends = np.concatenate([[0], np.cumsum(e.byte_lengths[found])])[at]
        data = e.all_bytes[spread(e.byte_starts[found], e.byte_lengths[found])]
        shas, decoded_shas, texts = [], [], []
        for i in range(len(counts)):
            raw = data[byte_ends[i] : byte_ends[i + 1]].tobytes().decode("utf-8", "replace")
            shas.append(hashlib.sha256(small[at[i] : at[i + 1]].tobytes()).hexdigest())
            decoded_shas.append(hashlib.sha256(raw.encode()).hexdigest())
            if decoded:
                texts.append(raw)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())]
        if ids:
            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.astype(np.int32))))
        if decoded:
            columns.append(pa.array(texts, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded
    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return picked.mapInArrow(rows, schema)

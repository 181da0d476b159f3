"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The words of a block of texts (between white space) are reduced to distinct ones, each with the word mark
before it, and inserted into a trie level by level, until few words are left, which share next to nothing
and go on from their nodes alone. Every node, that is every prefix that words share, gets its forward score once: the best log-probability of cutting the prefix into pieces, and the number of
pieces of that cut (of equal scores, the fewest). The node where a word ends has the word's count; a text's
count is the sum over its words.

Pieces come from a public sentencepiece file. As that file is no unigram model, a piece's log-probability
follows its place in the file by Zipf's law, -log(place + 2). A byte that no piece covers costs a byte
token of BYTE_COST. Null and empty texts have no words and no tokens. Rows that repeat stay; texts are
taken whole. Columns other than key and text are not read.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import blocks, bounded, texts
from .words import SPACED, find

BYTE_COST = -25.0
MARK = "▁".encode()
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
FILTER_BITS = 21
#: Where no more words than this are left, each goes on alone from its node: a level costs as much as so many bytes.
ALONE = 100


@dataclass
class Pieces:
    """Piece hashes in ascending order with their scores; a bit table that most other hashes miss."""

    hashes: np.ndarray
    scores: np.ndarray
    near: np.ndarray
    longest: int
    table: dict[bytes, float]

    @staticmethod
    def of(pieces: list[tuple[bytes, float]]) -> Pieces:
        hashes = np.array([piece_hash(p) for p, _ in pieces], np.uint64)
        if len(np.unique(hashes)) != len({p for p, _ in pieces}):
            raise ValueError("two pieces have one hash")
        order = np.argsort(hashes)
        near = np.zeros(1 << FILTER_BITS, bool)
        near[_slot(hashes)] = True
        return Pieces(hashes[order], np.array([s for _, s in pieces])[order], near, max(len(p) for p, _ in pieces), dict(pieces))

    @staticmethod
    def read(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        return Pieces.of([(model.id_to_piece(i).encode(), -float(np.log(i + 2))) for i in range(model.get_piece_size()) if not special(i)])


def piece_hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(FACTOR) + b + 1) % (1 << 64)
    return h


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def counts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The number of tokens of each of the distinct words data[starts:ends]."""
    lengths = ends - starts + len(MARK)
    out = np.zeros(len(starts), np.int64)
    word, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    # of the nodes of a level: best score and count of the last levels, by way of each node's ancestors
    scores, counts = [np.zeros(1)], [np.zeros(1, np.int64)]
    tails = [np.zeros(1, np.uint64)]  # hash of the last l bytes of each node, for l = 0, 1, ...
    above: list[np.ndarray] = [np.zeros(1, np.int64)]  # ancestors l levels up, as rows of that level
    depth = 0
    while len(word) > ALONE:
        byte = np.full(len(word), MARK[depth], np.int64) if depth < len(MARK) else data[starts[word] + depth - len(MARK)].astype(np.int64)
        keys, node = np.unique(node << 8 | byte, return_inverse=True)
        parent, letter = keys >> 8, (keys & 255).astype(np.uint64) + np.uint64(1)
        depth += 1
        most = min(depth, pieces.longest)
        tails = [np.zeros(len(keys), np.uint64), *(t[parent] * FACTOR + letter for t in tails[:most])]
        above = [np.arange(len(keys)), *(a[parent] for a in above[:most])]
        best, count = scores[-1][parent] + BYTE_COST, counts[-1][parent] + 1
        for n in range(1, most + 1):
            maybe = np.flatnonzero(pieces.near[_slot(tails[n])])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(pieces.hashes, tails[n][maybe]), len(pieces.hashes) - 1)
            hit = pieces.hashes[at] == tails[n][maybe]
            maybe, at = maybe[hit], at[hit]
            if not len(maybe):
                continue
            up = above[n][maybe]
            score, number = scores[-n][up] + pieces.scores[at], counts[-n][up] + 1
            better = (score > best[maybe]) | (score == best[maybe]) & (number < count[maybe])
            best[maybe[better]], count[maybe[better]] = score[better], number[better]
        scores, counts = [*scores, best][-pieces.longest :], [*counts, count][-pieces.longest :]
        done = lengths[word] == depth
        out[word[done]] = count[node[done]]
        word, node = word[~done], node[~done]
    for w, n in zip(word.tolist(), node.tolist(), strict=True):
        known = min(depth, pieces.longest - 1) + 1
        best = [(float(scores[-1 - i][above[i][n]]), int(counts[-1 - i][above[i][n]])) for i in reversed(range(known))]
        text = MARK + data[starts[w] : ends[w]].tobytes()
        out[w] = _alone(text, depth, best, pieces)
    return out


def _alone(word: bytes, depth: int, best: list[tuple[float, int]], pieces: Pieces) -> int:
    """The count of a word from its prefix of depth bytes on. best: score and count of that prefix, last, and of those before it."""
    best, table = collections.deque(best, pieces.longest), pieces.table
    for end in range(depth + 1, len(word) + 1):
        score, count = best[-1][0] + BYTE_COST, best[-1][1] + 1
        for n in range(1, min(end, pieces.longest) + 1):
            own = table.get(word[end - n : end])
            if own is not None:
                s, c = best[-n][0] + own, best[-n][1] + 1
                if s > score or s == score and c < count:
                    score, count = s, c
        best.append((score, count))
    return best[-1][1]


def count_tokens(docs: DataFrame, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row. pieces: a sentencepiece file that the driver can open."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(Pieces.read(pieces))  # one model's pieces

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 8 << 20):
            found = find(*texts(batch.column("text")), SPACED)
            _, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
            counts = counts_of(found.data, found.starts[first], found.ends[first], sent.value)
            total = np.concatenate([[0], np.cumsum(counts[inverse])]) if len(first) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(found.first), pa.int64()), pa.array(np.diff(total[found.first]), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(rows, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")

"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its three letters'
vectors, the first rotated by two places and the second by one; a text's vector bundles (adds) those of
its trigrams, and a language's prototype bundles the unit vectors of its training texts. A text gets the
language whose prototype has the highest cosine with its vector.

Letters are taken in lower case; runs of other characters are one word end, which is a letter too. a-z
have vectors of their own; all other letters share OTHER_LETTERS vectors by code point. Since a vector is
linear in the trigram counts, a block of texts is a small matrix of counts times the bound vectors of the
trigrams that occur in it.

Training takes at most SAMPLE_ROWS rows in expectation, by a hash of the key, of those that may be
learned from. Languages share them evenly: those below the even share keep all of their rows. Prediction takes every whole text. Null texts and texts without letters are und, score 0.
With no training rows every text with letters is und. Rows that repeat stay; other columns are carried along,
and one that has the name of an added column gives way to it.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import blocks, bounded

DIMENSIONS = 1024
OTHER_LETTERS = 101
SLOTS = 128
SAMPLE_ROWS = 40_000
SEED = 20231
BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 20
#: Trigrams whose vectors are held at once.
TRIGRAMS = 1024
UNKNOWN = "und"


@functools.cache
def letter_slots() -> np.ndarray:
    """For each code point the number of its letter's vector, 0 for what is no letter."""
    slots = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            base = ord(low[0]) if len(low) == 1 else ord(unicodedata.normalize("NFC", low)[0])
            slots[code] = base - 96 if 97 <= base <= 122 else 27 + base % OTHER_LETTERS
    return slots


@functools.cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, DIMENSIONS))


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each trigram number."""
    v = letter_vectors()
    first, second, third = trigrams >> 14, trigrams >> 7 & 127, trigrams & 127
    return (np.roll(v, 2, 1)[first] * np.roll(v, 1, 1)[second] * v[third]).astype(np.float32)


def text_vectors(batch: list[str]) -> np.ndarray:
    """A row for each text, zero where it has no letters."""
    whole = np.frombuffer("\n".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    slots = letter_slots()[whole].astype(np.int32)
    ends = np.cumsum([len(x) + 1 for x in batch])
    keep = np.ones(len(slots), bool)
    keep[1:] = (slots[1:] > 0) | (slots[:-1] > 0)  # one end for a run of other characters
    at, slots = np.flatnonzero(keep), slots[keep]
    if len(slots) < 2:
        return np.zeros((len(batch), DIMENSIONS), np.float32)
    padded = np.concatenate([[0], slots, [0]])
    trigram = padded[:-2] << 14 | padded[1:-1] << 7 | padded[2:]
    whole_trigram = padded[1:-1] > 0
    trigram, of = trigram[whole_trigram], np.searchsorted(ends, at[whole_trigram], "right")
    present = np.bincount(trigram, minlength=1) > 0
    active = np.flatnonzero(present)
    if not len(active):
        return np.zeros((len(batch), DIMENSIONS), np.float32)
    column = np.cumsum(present) - 1
    counts = np.bincount(of * len(active) + column[trigram], minlength=len(batch) * len(active))
    counts = counts.reshape(len(batch), len(active))
    out = np.zeros((len(batch), DIMENSIONS), np.float32)
    for k in range(0, len(active), TRIGRAMS):  # whole numbers: the sums are the same however they are cut
        out += counts[:, k : k + TRIGRAMS].astype(np.float32) @ trigram_vectors(active[k : k + TRIGRAMS])
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray]:
        vectors = _unit(text_vectors(batch))
        if not self.languages:
            return [UNKNOWN] * len(batch), np.zeros(len(batch))
        cosines = vectors @ self.prototypes.T
        best = cosines.argmax(1)
        lettered = np.abs(vectors).max(1) > 0
        score = np.where(lettered, np.clip(cosines[np.arange(len(batch)), best], 0, 1), 0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def held_out(key: Column) -> Column:
    """Rows that are never learned from; null keys aren't among them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _most_each(counts: Iterable[int], rows: int) -> float:
    """The bound on the rows of a language with which all languages together have at most so many rows."""
    left, ordered = rows, sorted(counts)
    for i, n in enumerate(ordered):
        if n * (len(ordered) - i) > left:
            return left / (len(ordered) - i)
        left -= n
    return float(rows)


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """Prototypes of all languages of a sample of sample_rows rows (all, if there are fewer).

    A row of DIMENSIONS sums for each language goes to the driver.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    most = _most_each(counts.values(), sample_rows)
    if max(counts.values(), default=0) > most:
        limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1, most / n) * (1 << 40)))])
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < limits[F.col("lang")])
    rows = rows.select("text", "lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in blocks(batches, "text", BLOCK_BYTES, BLOCK_ROWS):
            vectors, langs = _unit(text_vectors(batch.column("text").to_pylist())), np.array(batch.column("lang").to_pylist(), object)
            for name in set(langs):
                sums[name] = sums.get(name, 0) + vectors[langs == name].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    parts = rows.mapInArrow(bundle, "lang string, sums array<double>")
    found = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    found = found.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x.s).alias("sums")).orderBy("lang").collect()
    prototypes = np.array([r.sums for r in found], np.float32).reshape(len(found), DIMENSIONS)
    return Profiles([r.lang for r in found], _unit(prototypes))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The table with the language and the score (the cosine, at least 0) after its own columns."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(profiles)  # DIMENSIONS numbers a language
    own = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*own)
    at = own[docs.columns.index(text)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at, BLOCK_BYTES, BLOCK_ROWS):
            names, score = sent.value.predict(batch.column(at).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*own, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema) + ", lang_pred string, score double"
    out = inner.mapInArrow(rows, schema)
    return out.select(*[F.col(c).alias(n) for c, n in zip(own, docs.columns, strict=True) if n not in added], F.col("lang_pred").alias(added[0]), F.col("score").alias(added[1]))

"""Token-id shards: raw id payloads with a minimal perfect hash index of document keys.

A shard is one file: the ids of its documents in ascending key order, each document closed by the end
id, as little-endian unsigned integers of 2 bytes (4 for vocabularies over 65,536), then an index block
and a footer. The index is a minimal perfect hash over the shard's keys: levels of bit arrays in which a
key that no other key of its level meets takes its slot; a slot's rank among all set bits is the key's
number. Each number has a 32-bit fingerprint, so a key that was never stored is told apart (but for one
in 2**32), and the place of its document. A lookup takes a constant number of steps.

Spark's text writer makes the files: a row is a document's bytes, the line separator is the end id. So
writing has Spark's commit protocol and works on every file system that Spark writes.

Null texts are empty documents (the end id alone). A null key is a key of its own, before all others.
Rows that repeat a key stay, next to each other, ordered by text; the index gives their run.
An empty table gives no shard with documents. Columns other than key and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import byte_letters
from .shared import blocks, bounded, mixed, partitions_for, spread, texts, work_dir, written

MAGIC = b"CGIDX1\0\0"
FOOTER = struct.Struct("<8sqqqqq")
#: Bytes of input on disk for each shard; ids take about 1.3 times as much.
SHARD_BYTES = 32 << 20
#: Shards that are summed together before their sums are.
SUMMED = 4096
CACHED_WORDS = 600_000
LEVELS = 64


# --- minimal perfect hash -------------------------------------------------------------------------


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """sizes: bits of each level; bits: all levels' bits; before: set bits before each 64-bit word."""

    sizes: np.ndarray
    bits: np.ndarray
    before: np.ndarray

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """keys: distinct 64-bit numbers."""
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, -(-len(left) * 3 // 2) + 63 & ~63)
            at = (_level_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            met = np.bincount(at, minlength=size)
            levels.append(met == 1)
            sizes.append(size)
            left = left[met[at] != 1]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        bits = np.packbits(flat, bitorder="little").view(np.uint64) if len(flat) else np.zeros(0, np.uint64)
        return PerfectHash(np.array(sizes, np.int64), bits, PerfectHash._ranks(bits))

    @staticmethod
    def _ranks(bits: np.ndarray) -> np.ndarray:
        counts = np.bitwise_count(bits).astype(np.int64)
        return np.cumsum(counts) - counts

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """0 to n - 1 for the keys it was built for; -1 or any number for others."""
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + (_level_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, start = left[~hit], start + int(size)
        return out


# --- the shard file -------------------------------------------------------------------------------


def _key_numbers(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """64-bit numbers that are distinct for distinct keys, but that null takes one of 2**64."""
    return np.where(valid, mixed(values.view(np.uint64)), np.uint64(0x6A09E667F3BCC909))


def index_block(shard: int, width: int, values: np.ndarray, valid: np.ndarray, ends: np.ndarray) -> bytes:
    """values, valid: the keys in file order; ends: ids up to the end of each document."""
    n = len(values)
    new = np.ones(n, bool)
    new[1:] = (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    keys = _key_numbers(values[first], valid[first])
    perfect = PerfectHash.build(keys)
    slot = perfect.numbers(keys)
    runs, prints = np.empty(len(first), np.int64), np.empty(len(first), np.uint32)
    runs[slot], prints[slot] = first, fingerprints(keys)
    body = b"".join(
        x.tobytes()
        for x in (values, ends.astype(np.int64), runs, perfect.sizes, perfect.bits, prints, valid.astype(np.uint8))
    )
    return body + FOOTER.pack(MAGIC, shard, n, len(first), len(perfect.sizes), len(perfect.bits))


class Shard:
    """A shard file's bytes, and its documents by key."""

    def __init__(self, content: bytes, width: int):
        self.content, self.width = content, width
        end = len(content) - width - FOOTER.size
        magic, self.number, self.n, runs, levels, words = FOOTER.unpack_from(content, end)
        if magic != MAGIC:
            raise ValueError("not an id shard")
        sizes = [(np.int64, self.n), (np.int64, self.n), (np.int64, runs), (np.int64, levels), (np.uint64, words), (np.uint32, runs), (np.uint8, self.n)]
        at, parts = end - sum(np.dtype(t).itemsize * k for t, k in sizes), []
        for kind, count in sizes:
            parts.append(np.frombuffer(content, kind, count, at))
            at += np.dtype(kind).itemsize * count
        self.values, self.ends, self.runs, level_sizes, bits, self.prints, valid = parts
        self.valid = valid.astype(bool)
        self.perfect = PerfectHash(level_sizes, bits, PerfectHash._ranks(bits))

    def find(self, values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """The place of each key's first document in file order, -1 where the key is not stored."""
        keys = _key_numbers(values, valid)
        number = self.perfect.numbers(keys)
        if not len(self.runs):
            return number
        known = (number >= 0) & (self.prints[number] == fingerprints(keys))
        return np.where(known, self.runs[number], -1)

    def run(self, place: int) -> int:
        """How many documents have the key of the document at this place, from it on."""
        last = place + 1
        while last < self.n and self.values[last] == self.values[place] and self.valid[last] == self.valid[place]:
            last += 1
        return last - place

    def start(self, place: int) -> int:
        return int(self.ends[place - 1]) if place else 0

    def ids(self, place: int) -> np.ndarray:
        """With the end id."""
        kind, start = np.dtype(f"<u{self.width}"), self.start(place)
        return np.frombuffer(self.content, kind, int(self.ends[place]) - start, start * self.width)


# --- encoding -------------------------------------------------------------------------------------


class WordEncoder:
    """Encodes texts with a tokenizers file, the model seeing each distinct pre-token of Latin text once.

    That holds for tokenizers that compose, lower the case, make white space one space, split by one
    pattern and spell the parts in byte letters; a Latin-1 text's pre-tokens are found here, and their
    ids come from the library's model. All other texts and tokenizers go through the library whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        config = json.loads(file)
        self.specials = [t["content"].lower() for t in config["added_tokens"]]
        self.pattern = self._split_pattern(config)
        letters = {b: c for c, b in byte_letters().items()}
        self.spelling = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self._clear()

    @staticmethod
    def _split_pattern(config: dict) -> re.Pattern | None:
        """The pattern with its Unicode classes spelled out for Latin-1."""
        steps = (config["normalizer"] or {}).get("normalizers", [])
        parts = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        if not plain or not parts[0]["invert"] or parts[0]["behavior"] != "Removed" or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            return None
        pattern = parts[0]["pattern"].get("Regex", "")
        latin = [chr(c) for c in range(256)]
        for name in ("\\p{L}", "\\p{N}"):
            pattern = pattern.replace(name, "".join(re.escape(c) for c in latin if regex.fullmatch(name, c)))
        space = "\t\n\v\f\r \x85\xa0"
        pattern = pattern.replace("\\s", space)
        return None if "\\p" in pattern else re.compile(pattern)

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, words: list[str]) -> None:
        tokenize, spelling = self.model.tokenize, self.spelling
        found = [[t.id for t in tokenize(w.translate(spelling))] for w in words]
        lengths, place = np.array([len(x) for x in found], np.int64), len(self.places)
        end, total = place + len(found), int(lengths.sum())
        while end > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.starts[place:end], self.lengths[place:end] = self.used + np.cumsum(lengths) - lengths, lengths
        self.places.update(zip(words, range(place, end), strict=True))
        self.used += total

    def _split(self, text: str) -> list[str] | None:
        """The pre-tokens of a Latin text without special tokens."""
        if self.pattern is None or not _latin(text):
            return None
        low = text.lower()
        return None if any(s in low for s in self.specials) else self.pattern.findall(low)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if len(self.places) > CACHED_WORDS:
            self._clear()
        split = [self._split(x) for x in batch]
        whole = [i for i, x in enumerate(split) if x is None]
        known = self.places
        missing = list({w: 0 for x in split if x is not None for w in x if w not in known})
        if missing:
            self._learn(missing)
        counts = np.array([len(x) if x is not None else 0 for x in split], np.int64)
        place = np.fromiter((known[w] for x in split if x is not None for w in x), np.int64, int(counts.sum()))
        lengths = self.lengths[place]
        ids = self.flat[spread(self.starts[place], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(ends)
        if whole:
            parts = np.split(ids, ends[1:-1])
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([batch[i] for i in whole], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.uint32)
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes


def _latin(text: str) -> bool:
    """Only letters that stand for themselves when composed, and have a lower case of one letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[int, WordEncoder] = {}


def _encoder(file: str) -> WordEncoder:
    key = zlib.crc32(file.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(file)
    return _encoders[key]


# --- writing and reading --------------------------------------------------------------------------


@dataclass
class ShardSet:
    path: str
    width: int
    end_id: int


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> ShardSet:
    """Encode every text and write the shards. tokenizer: a file that the driver can open."""
    spark = bounded(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_str(file).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    sent = spark.sparkContext.broadcast(file)  # one tokenizer's file, a few MB
    kind = np.dtype(f"<u{width}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(sent.value)
        values, valid, ends, total = [], [], [], 0
        for batch in blocks(batches, "text"):
            column = batch.column("key")
            ids, counts = encoder.encode(batch.column("text").fill_null("").to_pylist())
            ids, at = ids.astype(kind), np.concatenate([[0], np.cumsum(counts)])
            values.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            valid.append(column.is_valid().to_numpy(zero_copy_only=False))
            ends.append(total + at[1:] + np.arange(1, len(counts) + 1))
            total = int(ends[-1][-1])
            raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at * width), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([raw.cast(pa.binary())], ["value"])
        if values:
            last = index_block(TaskContext.get().partitionId(), width, *(np.concatenate(x) for x in (values, valid, ends)))
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary())], ["value"])

    (
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        .repartitionByRange(partitions_for(docs, SHARD_BYTES), "key")
        .sortWithinPartitions("key", "text")
        .mapInArrow(rows, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", end_id.to_bytes(width, "little").decode("latin-1"))
        .text(path)
    )
    return ShardSet(path, width, end_id)


def read_shards(spark: SparkSession, shards: ShardSet) -> DataFrame:
    """doc_id, shard, place, start (ids before it in its shard), n_tokens, ids_crc32, each by keyed lookup."""
    width, end_id = shards.width, shards.end_id

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                shard = Shard(raw, width)
                new = np.ones(shard.n, bool)
                new[1:] = (shard.values[1:] != shard.values[:-1]) | (shard.valid[1:] != shard.valid[:-1])
                keys = np.flatnonzero(new)
                found = shard.find(shard.values[keys], shard.valid[keys])
                out = []
                for place in found.tolist():
                    for at in range(place, place + shard.run(place)):
                        ids = shard.ids(at)
                        if ids[-1] != end_id:
                            raise ValueError("a document has no end id")
                        out.append((at, shard.start(at), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                places, starts, counts, crcs = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.values[places], mask=~shard.valid[places]), pa.array(np.full(len(places), shard.number, np.int64)), *map(pa.array, (places, starts, counts, crcs))],
                    ["doc_id", "shard", "place", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(shards.path)
    files = files.filter("length > 0").select("content")
    return files.mapInArrow(rows, "doc_id long, shard long, place long, start long, n_tokens long, ids_crc32 long")


def bases_of(totals: DataFrame) -> DataFrame:
    """totals: shard, ids. shard, base: the ids of all shards before it, summed by SUMMED shards and then by shard."""
    rows = totals.withColumn("part", F.floor(F.col("shard") / SUMMED))
    before = (Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("ids").alias("ids"))  # a row for SUMMED shards
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(*before)), F.lit(0))
    return rows.select("shard", "part", own.alias("own")).join(parts, "part").select("shard", (F.col("base") + F.col("own")).alias("base"))


def documents_of(spark: SparkSession, shards: ShardSet) -> DataFrame:
    """read_shards with start counted from the first shard on."""
    found = written(read_shards(spark, shards), spark)
    return found.join(bases_of(found.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))), "shard").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "shard", "place"
    )


def encode_to_shards(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    return documents_of(spark, write_shards(docs, work_dir(spark), tokenizer, end_id))

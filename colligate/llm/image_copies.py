"""Copies of images, cropped or edited, by local descriptors.

An image is a binary portable graymap (P5) in a binary column. On each of SCALES scales of it, corners are
the local maxima of the Harris response, the strongest of all scales, one for every PIXELS pixels but LEAST_POINTS
at least. A corner's orientation is the direction of its patch's intensity centroid, and its descriptor are
256 comparisons of smoothed pixel pairs, rotated to that orientation. A Hamming table for each of BANDS parts
of the descriptor joins the query side with the indexed side; the query side also looks up the parts with one
of its FLIPS least certain bits turned. Of the corners that share a part that more than COMMON indexed corners
have (edges of plain areas look alike everywhere), lists of at most EACH are joined, and their pairs are compared
by all their bits where the lists meet: as exact as a join of corners, without a row for each pair. Descriptors
that differ in fewer than BANDS bits share a part. Matches that differ in more than MOST_BITS bits
are dropped. Of the matches between two images those are consensus that agree on scale, rotation and shift; a pair with
LEAST_INLIERS or more distinct corners in consensus is a copy.

Only descriptors are shuffled, never images: every image is described where it is read, and of a class, the
images with equal bytes, the descriptors of its least id enter the tables, so a group of copies of any size
adds one image. The tables hold the part, the corner's number and the bits of the next four parts, so
that corners that share a part by chance make no row; points and all bits are fetched for the pairs of images that share
LEAST_INLIERS parts.

Null, empty or unreadable images have no corners and no copies. Images without corners match nothing. Rows
with a null id are left out. Rows that repeat are one image; different images of one id are described each,
and what copies any of them copies that id. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import bounded, freed, texts, written

SCALES = (1.0, 0.75, 0.5)
LEAST_POINTS = 32
PIXELS = 288
PATCH = 13
TESTS_EACH = 256
BANDS = 8
FLIPS = 4
COMMON = 32
#: Corners of a common part in one list, at most about so many.
EACH = 1024
#: Pairs of corners that are compared at once.
AT_ONCE = 1 << 15
MOST_BITS = 28
LEAST_INLIERS = 5
SEED = 11
IMAGES = 128


def _tests() -> np.ndarray:
    """Pairs of points, evenly spread over the disc of the patch."""
    rng = np.random.default_rng(SEED)
    radius, turn = PATCH * np.sqrt(rng.random((TESTS_EACH, 2))), 2 * np.pi * rng.random((TESTS_EACH, 2))
    return np.stack([radius * np.cos(turn), radius * np.sin(turn)], 2)


TESTS = _tests()


def parse(content: bytes | None) -> np.ndarray | None:
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", content or b"")
    if not m:
        return None
    width, height = int(m[1]), int(m[2])
    pixels = np.frombuffer(content, np.uint8, offset=m.end())
    return pixels[: width * height].reshape(height, width).astype(np.float32) if len(pixels) >= width * height > 0 else None


def graymap(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % pixels.shape[::-1] + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def resized(image: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear."""
    if factor == 1:
        return image
    h, w = (max(1, round(n * factor)) for n in image.shape)
    y, x = (np.clip((np.arange(n) + 0.5) / factor - 0.5, 0, m - 1) for n, m in ((h, image.shape[0]), (w, image.shape[1])))
    y0, x0 = np.minimum(y.astype(int), max(0, image.shape[0] - 2)), np.minimum(x.astype(int), max(0, image.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (image[y0][:, x0] * (1 - fy) + image[y1][:, x0] * fy) * (1 - fx) + (image[y0][:, x1] * (1 - fy) + image[y1][:, x1] * fy) * fx


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2 r + 1, edges repeated."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), "edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, scale, angle of each corner, in the image's own pixels, its bits as bytes, and the FLIPS least
    certain bits of each of its parts, as places in the part."""
    points, bits, close = [], [], []
    most = max(LEAST_POINTS, image.size // PIXELS)
    for scale in SCALES:
        a = resized(image, scale)
        margin = PATCH + 2
        if min(a.shape) <= 2 * margin + 2:
            continue
        gy, gx = np.gradient(_box(a, 1))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[margin:-margin, margin:-margin]
        window = np.lib.stride_tricks.sliding_window_view(response[margin - 2 : -margin + 2, margin - 2 : -margin + 2], (5, 5)).max((2, 3))
        ys, xs = np.nonzero((inner == window) & (inner > 1))
        strength = inner[ys, xs]
        order = np.lexsort((xs, ys, -strength))[:most]
        ys, xs = ys[order] + margin, xs[order] + margin
        if not len(ys):
            continue
        span = np.arange(-PATCH, PATCH + 1)
        patch = a[ys[:, None, None] + span[None, :, None], xs[:, None, None] + span[None, None]]
        disc = (span[:, None] ** 2 + span[None] ** 2 <= PATCH * PATCH).astype(np.float32)
        patch = (patch - patch.mean((1, 2), keepdims=True)) * disc
        angle = np.arctan2((patch * span[:, None]).sum((1, 2)), (patch * span[None]).sum((1, 2)))
        smooth = _box(a, 1)
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        tx, ty = TESTS[None, :, :, 0], TESTS[None, :, :, 1]
        px, py = np.rint(xs[:, None, None] + c * tx - s * ty).astype(int), np.rint(ys[:, None, None] + s * tx + c * ty).astype(int)
        v = smooth[np.clip(py, 0, a.shape[0] - 1), np.clip(px, 0, a.shape[1] - 1)]
        bits.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1))
        apart = np.abs(v[:, :, 0] - v[:, :, 1]).reshape(len(v), BANDS, -1)
        close.append(np.argsort(apart, axis=2, kind="stable")[:, :, :FLIPS].astype(np.uint8))
        points.append(np.stack([(xs + 0.5) / scale, (ys + 0.5) / scale, np.full(len(xs), scale), angle, strength[order]], 1))
    if not points:
        return np.zeros((0, 4), np.float32), np.zeros((0, TESTS_EACH // 8), np.uint8), np.zeros((0, BANDS, FLIPS), np.uint8)
    points, bits, close = (np.concatenate(x) for x in (points, bits, close))
    order = np.argsort(-points[:, 4], kind="stable")[:most]
    return points[order, :4].astype(np.float32), bits[order], close[order]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most IMAGES rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, IMAGES):
            yield batch.slice(at, IMAGES)


_DESCRIBED = "id long, h binary, version int, points binary, bits binary, close binary"


def described(images: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each image: id, h and version (a hash of its bytes, and some of it), and its corners in short."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            hashes, corners = [], []
            for value in batch.column("content"):
                own = value.as_py()
                pixels = parse(own)
                hashes.append(hashlib.sha256(own or b"").digest())
                corners.append([x.tobytes() for x in describe(pixels)] if pixels is not None else [b""] * 3)
            versions = np.frombuffer(b"".join(h[:4] for h in hashes), np.int32)
            columns = [batch.column("id"), pa.array(hashes, pa.binary()), pa.array(versions), *(pa.array(x, pa.binary()) for x in zip(*corners, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _DESCRIBED.split(", ")])

    kept = images.select(F.col(key).cast("long").alias("id"), F.col(content).alias("content")).where("id is not null and content is not null")
    return kept.mapInArrow(rows, _DESCRIBED)


def parts_of(images: DataFrame, probed: bool = False, whole: bool = False, sketched: bool = False) -> DataFrame:
    """Of described images a row for each part of each corner: part (with the number of its table), id, version,
    corner. probed: also for each part with one of its least certain bits turned. whole: with all bits of the corner. sketched: with u, v, the bits of the
    next four parts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            held = texts(batch.column("bits"))[0]
            bits = held.view(">u4").reshape(-1, BANDS).astype(np.int64)
            counts = np.diff(texts(batch.column("bits"))[1]) * 8 // TESTS_EACH
            parts = (bits | np.arange(BANDS, dtype=np.int64) << 32)[:, :, None]
            if probed:
                close = texts(batch.column("close"))[0].reshape(-1, BANDS, FLIPS).astype(np.int64)
                parts = np.concatenate([parts, parts ^ (1 << (31 - close))], 2)
            each = parts.shape[1] * parts.shape[2]
            first = np.repeat(np.cumsum(counts) - counts, counts)
            of, corner = pa.array(np.repeat(np.repeat(np.arange(len(counts)), counts), each)), np.arange(len(first)) - first
            out = [pa.array(parts.ravel()), batch.column("id").take(of), batch.column("version").take(of), pa.array(np.repeat(corner, each).astype(np.int32))]
            if whole:
                width = TESTS_EACH // 8
                data = np.repeat(held.reshape(-1, width), each, 0)
                out.append(pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * width), pa.py_buffer(data)]))
            if sketched:
                for k in (1, 3):
                    next_ = np.roll(bits, -k, 1) << 32 | np.roll(bits, -k - 1, 1)
                    out.append(pa.array(np.repeat(next_.ravel(), parts.shape[2])))
            yield pa.RecordBatch.from_arrays(out, ["part", "id", "version", "corner", *["bits"] * whole, *["u", "v"] * sketched])

    return images.select("id", "version", "bits", "close").mapInArrow(rows, "part long, id long, version int, corner int" + ", bits binary" * whole + ", u long, v long" * sketched)


def _met_at_rare(asked: DataFrame, indexed: DataFrame, common: DataFrame) -> DataFrame:
    """query, version, corner, class_id, version2, corner2 of the corners that share a part that isn't common, and of
    whose next four parts at most MOST_BITS bits differ, as do no more of those that match."""
    rare = parts_of(indexed, sketched=True).join(common, "part", "left_anti")
    rare = rare.select("part", F.col("id").alias("class_id"), F.col("version").alias("version2"), F.col("corner").alias("corner2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("u2"))) + F.bit_count(F.col("v").bitwiseXOR(F.col("v2")))
    met = parts_of(asked, probed=True, sketched=True).withColumnRenamed("id", "query").join(rare, "part").where(apart <= MOST_BITS)
    return met.select("query", "version", "corner", "class_id", "version2", "corner2")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two lists of corners the pairs that differ in at most MOST_BITS bits."""
    names = ["query", "version", "corner", "class_id", "version2", "corner2"]
    for batch in batches:
        for i in range(batch.num_rows):
            one, two = (batch.column(c).slice(i, 1).flatten() for c in ("asked", "held"))
            bits, bits2 = (texts(x.field("bits"))[0].view(np.uint64).reshape(len(x), -1) for x in (one, two))
            step = max(1, AT_ONCE // len(two))
            near = []
            for at in range(0, len(one), step):
                apart = np.zeros((len(bits[at : at + step]), len(two)), np.int32)
                for k in range(bits.shape[1]):
                    apart += np.bitwise_count(bits[at : at + step, k, None] ^ bits2[None, :, k])
                near.append(np.argwhere(apart <= MOST_BITS) + (at, 0))
            near = np.concatenate(near)
            if len(near):
                found = (x.field(c).take(pa.array(near[:, k])) for k, x in enumerate((one, two)) for c in ("id", "version", "corner"))
                yield pa.RecordBatch.from_arrays(list(found), names)


def _met_at_common(asked: DataFrame, indexed: DataFrame, common: DataFrame) -> DataFrame:
    """query, version, corner, class_id, version2, corner2 of the corners that share one of the common parts and
    differ in at most MOST_BITS bits; common: part, count (of indexed corners)."""
    spark = indexed.sparkSession
    dealt = lambda n: F.ceil(n / EACH).cast("int")
    mine = parts_of(asked, probed=True).join(common, "part").groupBy("part").agg(F.count("*").alias("m"), F.first("count").alias("n"))
    mine = written(mine.select("part", dealt(F.col("m")).alias("lists"), dealt(F.col("n")).alias("lists2")), spark)

    def lists(corners: DataFrame, name: str, n: str) -> DataFrame:
        of = F.pmod(F.xxhash64("id", "version", "corner"), F.col(n)).cast("int").alias(name)
        each = corners.join(mine, "part").select("part", "lists", of, F.struct("id", "version", "corner", "bits").alias("c"))
        return each.groupBy("part", name).agg(F.collect_list("c").alias("corners"), F.first("lists").alias("lists"))

    one = lists(parts_of(asked, probed=True, whole=True), "list", "lists").select("part", "list", F.col("corners").alias("asked"))
    two = lists(parts_of(indexed, whole=True), "list2", "lists2")
    two = two.select("part", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"), F.col("corners").alias("held"))
    both = one.join(two, ["part", "list"]).select("asked", "held")
    return both.mapInArrow(_compared, "query long, version int, corner int, class_id long, version2 int, corner2 int")


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """a, b: x, y, scale, angle of matched corners. The most distinct corners that one similarity maps."""
    best = 0
    turn, zoom = b[:, 3] - a[:, 3], a[:, 2] / b[:, 2]
    for i in range(len(a)):
        c, s = zoom[i] * np.cos(turn[i]), zoom[i] * np.sin(turn[i])
        dx, dy = a[:, 0] - a[i, 0], a[:, 1] - a[i, 1]
        off = np.hypot(b[i, 0] + c * dx - s * dy - b[:, 0], b[i, 1] + s * dx + c * dy - b[:, 1])
        near = (off < 4) & (np.abs(np.angle(np.exp(1j * (turn - turn[i])))) < 0.5) & (np.abs(np.log2(zoom / zoom[i])) < 0.6)
        if near.sum() > best:
            best = max(best, min(len(np.unique(np.rint(x[near, :2] / 3), axis=0)) for x in (a, b)))
    return best


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        found = []
        of = lambda c, kind, width: [np.frombuffer(x, kind).reshape(-1, width) for x in batch.column(c).to_pylist()]
        points, points2 = of("points", np.float32, 4), of("points2", np.float32, 4)
        bits, bits2 = of("bits", np.uint8, TESTS_EACH // 8), of("bits2", np.uint8, TESTS_EACH // 8)
        for i, (q, c, m) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("query", "class_id", "m")), strict=True)):
            one, two = np.array([[x["corner"], x["corner2"]] for x in m]).T
            near = np.bitwise_count(bits[i][one] ^ bits2[i][two]).sum(1) <= MOST_BITS
            n = consensus(points[i][one[near]], points2[i][two[near]])
            if n >= LEAST_INLIERS:
                found.append((q, c, n))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["query", "class_id", "inliers"])


def _first_of_class(images: DataFrame) -> DataFrame:
    """images: described. Those whose id is the least of their class, once each."""
    least = images.groupBy("h").agg(F.min("id").alias("id"))
    return images.join(least, ["h", "id"], "left_semi").dropDuplicates(["id", "h"])


def _copies(asked: DataFrame, images: DataFrame) -> DataFrame:
    """asked, images: described and written. query, class_id, inliers."""
    spark = images.sparkSession
    indexed = freed(written(_first_of_class(images), spark))
    common = written(parts_of(indexed).groupBy("part").count().where(F.col("count") > COMMON), spark)
    met = _met_at_rare(asked, indexed, common).unionByName(_met_at_common(asked, indexed, common))
    met = met.groupBy("query", "version", "class_id", "version2").agg(F.collect_set(F.struct("corner", "corner2")).alias("m"))
    met = freed(written(met.where(F.size("m") >= LEAST_INLIERS), spark))
    one = asked.select(F.col("id").alias("query"), "version", "points", "bits").dropDuplicates(["query", "version"])
    two = indexed.select(F.col("id").alias("class_id"), F.col("version").alias("version2"), F.col("points").alias("points2"), F.col("bits").alias("bits2"))
    both = met.join(one, ["query", "version"]).join(two, ["class_id", "version2"])
    found = both.select("query", "class_id", "m", "points", "bits", "points2", "bits2").mapInArrow(_matched, "query long, class_id long, inliers long")
    return found.groupBy("query", "class_id").agg(F.max("inliers").alias("inliers"))


def find_copies(queries: DataFrame, images: DataFrame, key: str = "id", content: str = "image") -> DataFrame:
    """query, class_id (the least key of a class of equal images), inliers: the classes that each query copies.

    Keys are numbers; the rows of a class are those with equal bytes, see class_members.
    """
    spark = bounded(images.sparkSession)
    return _copies(*(written(described(x, key, content), spark) for x in (queries, images)))


def class_members(images: DataFrame, key: str = "id", content: str = "image") -> DataFrame:
    """image, class_id for the id of every image that isn't null, once where a row is repeated."""
    kept = images.where(F.col(content).isNotNull() & F.col(key).isNotNull())
    return _members(kept.select(F.col(key).cast("long").alias("id"), F.sha2(F.col(content), 256).alias("h")))


def _members(hashed: DataFrame) -> DataFrame:
    least = hashed.groupBy("h").agg(F.min("id").alias("class_id"))
    return hashed.select("h", "id").distinct().join(least, "h").select(F.col("id").alias("image"), "class_id")


def copies_and_members(queries: DataFrame, images: DataFrame, key: str = "id", content: str = "image") -> DataFrame:
    """query, class_id, inliers of every copy, with image null, and image, class_id of every image, with query
    and inliers null: an image is a copy of the queries that its class is one of."""
    spark = bounded(images.sparkSession)
    asked, held = (written(described(x, key, content), spark) for x in (queries, images))
    pairs = _copies(asked, held).withColumn("image", F.lit(None).cast("long"))
    return pairs.unionByName(_members(held), allowMissingColumns=True)


# --- images for a table of vectors -----------------------------------------------------------------

SIDE = 96


def rendered(vectors: DataFrame, key: str, vector: str, edited: bool = False) -> DataFrame:
    """id, image: a texture that each vector (to two decimals) determines.

    edited: a crop of it, brighter, with less contrast and a little noise, as a copier would leave it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in _few(batches):
            made = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                if v is None:
                    made.append(None)
                    continue
                seed = zlib.crc32(np.round(np.array([x or 0 for x in v], np.float64), 2).tobytes())
                rng = np.random.default_rng(seed)
                image = resized(rng.uniform(0, 255, (SIDE // 4, SIDE // 4)).astype(np.float32), 4)
                for x, y, w, h, c in zip(*(rng.integers(a, b, 8) for a, b in ((0, 80), (0, 80), (8, 30), (8, 30), (0, 255))), strict=True):
                    image[y : y + h, x : x + w] = c
                if edited:
                    top, left = (int(n) for n in rng.integers(2, 14, 2))
                    image = image[top : top + 78, left : left + 78] * 0.8 + 30
                    image = image + np.random.default_rng(i or 0).normal(0, 1, image.shape)
                made.append(graymap(image))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "image"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).mapInArrow(rows, "id long, image binary")

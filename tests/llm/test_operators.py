import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from colligate.llm import bpe, components, decontaminate, id_shards, image_copies, language_id, line_dedup, near_dup, phrase_dedup, pii, token_counts  # noqa: E402
from colligate.llm.queries import vocabulary  # noqa: E402
from colligate.llm.shared import work_dir, written  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits array<int>, n_words string, doc string, value int"


@pytest.fixture(scope="module")
def rows():
    """Real documents, and nulls, empty texts, repeated rows, ties, near copies, a long text, odd letters."""
    import duckdb

    held = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()
    rng = random.Random(3)
    base = held[5][1]
    words = base.split(" ")
    for i in range(8):
        w = list(words)
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = f"edit{i}{rng.random()}"
        held.append((1000 + i, " ".join(w), "en"))
    held += [(2000, None, "en"), (2001, "", None), (2002, " \n\t ", "en"), (None, base, "en"), (None, None, None), (2003, base, "en"), (2003, base, "en"), (2004, base + "\n" + base.upper(), "en")]
    held += [(2005, "Ünï 日本語 🎉 á <|endoftext|> \x1c x\x85y İ", "en"), (2006, "a" * 3000, "de"), (2007, "one two", "en"), (2008, "one two", "fr"), (2009, (base + " ") * 40, "en"), (-5, base, "en")]
    return held


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 0, [1], "x", "y", 3) for d, t, lang in rows], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_id_shards(spark, docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    wanted = sorted(brute.shards([r[:2] for r in rows], t), key=repr)
    assert got(id_shards.encode_to_shards(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == wanted
    assert id_shards.encode_to_shards(docs.where("false"), path).count() == 0


def test_perfect_hash_and_keyed_access(spark, docs):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000)).astype(np.uint64)
    perfect = id_shards.PerfectHash.build(keys)
    assert sorted(perfect.numbers(keys).tolist()) == list(range(len(keys)))
    values = np.arange(100, dtype=np.int64) * 7
    block = id_shards.index_block(0, 2, values, np.ones(100, bool), np.arange(1, 101))
    content = np.arange(100, dtype="<u2").tobytes() + block + b"\0\0"
    shard = id_shards.Shard(content, 2)
    assert [int(shard.ids(p)[0]) for p in shard.find(np.array([0, 70, 693]), np.ones(3, bool))] == [0, 10, 99]
    assert (shard.find(np.arange(1, 600, 7), np.ones(86, bool)) == -1).all()
    with pytest.raises(ValueError):
        id_shards.PerfectHash.build(np.zeros(2, np.uint64))


def test_wide_vocabularies_take_four_bytes(spark, docs, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    shards = id_shards.write_shards(docs, work_dir(spark), path, end_id=300)
    assert shards.width == 2 and id_shards.documents_of(spark, shards).count() == docs.count()


def _brute_copies(asked, images):
    """All pairs of images, all pairs of their corners."""
    described = lambda rows: [(i, *image_copies.describe(image_copies.parse(x))[:2]) for i, x in rows if image_copies.parse(x) is not None]
    found, held = set(), described(images)
    for q, p, b in described(asked):
        for i, p2, b2 in held:
            near = np.argwhere(np.bitwise_count(b[:, None] ^ b2[None]).sum(2) <= image_copies.MOST_BITS)
            if len(near) and image_copies.consensus(p[near[:, 0]], p2[near[:, 1]]) >= image_copies.LEAST_INLIERS:
                found.add((q, i))
    return found


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, [float((i * 7 + k) % 11) / 10 + i for k in range(16)]) for i in range(40)] + [(40, [3.1] * 16), (41, [3.1] * 16), (42, None), (None, [1.0] * 16)], "vec_id long, embedding array<float>")


def test_images(spark, vectors):
    images = image_copies.rendered(vectors, "vec_id", "embedding").union(spark.createDataFrame([(90, bytearray(b"P5 broken")), (91, bytearray(b"")), (7, None)], "id long, image binary"))
    images = images.union(images.where("id = 3"))
    asked = image_copies.rendered(vectors.where("vec_id % 4 = 0"), "vec_id", "embedding", edited=True)
    found = {(r["query"], r.class_id) for r in image_copies.find_copies(asked, images, "id", "image").collect()}
    held = lambda df: [(r.id, bytes(r.image)) for r in df.where("id is not null and image is not null and id <> 41").collect()]
    wanted = _brute_copies(held(asked), held(images))
    assert found <= wanted and len(found) >= 0.95 * len(wanted) and all(q == i for q, i in found)
    assert {q for q, _ in wanted} == set(range(0, 41, 4))
    assert {tuple(r) for r in image_copies.class_members(images).where("image in (40, 41, 90)").collect()} == {(40, 40), (41, 40), (90, 90)}
    assert image_copies.find_copies(asked.where("false"), images, "id", "image").count() == 0
    assert image_copies.find_copies(asked, images.where("false"), "id", "image").count() == 0


def test_images_with_common_parts(spark, vectors, monkeypatch):
    """Where every part that two corners share is common, copies are found by pairs of parts."""
    monkeypatch.setattr(image_copies, "COMMON", 1)
    images = image_copies.rendered(vectors, "vec_id", "embedding").where("id < 12")
    images = images.union(images.withColumn("id", F.col("id") + 100).withColumn("image", F.concat("image", F.lit(b"x"))))
    asked = image_copies.rendered(vectors.where("vec_id % 4 = 0 and vec_id < 12"), "vec_id", "embedding", edited=True)
    found = {(r["query"], r.class_id) for r in image_copies.find_copies(asked, images).collect()}
    assert found == {(q, q + k) for q in (0, 4, 8) for k in (0, 100)}


@pytest.mark.parametrize("each", [1024, 16])
def test_images_that_share_one_common_part_only(spark, monkeypatch, each):
    """Corners whose single shared part is common, and that have no second one in common, still meet."""
    monkeypatch.setattr(image_copies, "EACH", each)
    monkeypatch.setattr(image_copies, "AT_ONCE", 64)
    rng = np.random.default_rng(8)
    points = np.column_stack([rng.uniform(0, 90, (6, 2)), np.ones(6), np.zeros(6)]).astype(np.float32)
    held, asked = [], []
    for i in range(40):
        bits = rng.integers(0, 256, (6, 32), np.uint8)
        bits[:, :4] = 7
        other = bits.reshape(6, 8, 4).copy()
        other[:, 1:, 0] ^= 3  # two bits in each part but the first
        close = np.tile(np.arange(20, 24, dtype=np.uint8), 48)
        row = lambda b: (i, bytearray([i]), i, bytearray(points.tobytes()), bytearray(b.tobytes()), bytearray(close.tobytes()))  # noqa: B023, E731
        held.append(row(bits))
        asked.append(row(other))
    asked, held = (spark.createDataFrame(x, image_copies._DESCRIBED) for x in (asked, held))
    assert {(r["query"], r.class_id, r.inliers) for r in image_copies._copies(asked, held).collect()} == {(i, i, 6) for i in range(40)}


@pytest.mark.parametrize("change, least", [("turned", 0.9), ("smaller", 0.8), ("crop", 0.8), ("noisy", 0.9)])
def test_images_of_other_sizes_and_angles(spark, change, least):
    rng = np.random.default_rng(4)
    plain, edited = [], []
    for i in range(30):
        image = image_copies.resized(rng.uniform(0, 255, (40, 40)).astype(np.float32), 4)
        for x, y, w, h, c in zip(*(rng.integers(a, b, 12) for a, b in ((0, 140), (0, 140), (8, 40), (8, 40), (0, 255))), strict=True):
            image[y : y + h, x : x + w] = c
        plain.append((i, bytearray(image_copies.graymap(image))))
        if change == "turned":
            image = np.rot90(image)
        elif change == "smaller":
            image = image_copies.resized(image, 0.75)
        elif change == "crop":
            image = image[40:120, 40:120]
        else:
            image = image * 0.7 + 40 + rng.normal(0, 4, image.shape)
        edited.append((i, bytearray(image_copies.graymap(image))))
    asked, images = (spark.createDataFrame(x, "id long, image binary") for x in (edited, plain))
    found = image_copies.find_copies(asked, images).collect()
    assert all(r["query"] == r.class_id for r in found) and len(found) >= least * 30


def test_different_images_of_one_id(spark, vectors):
    images = image_copies.rendered(vectors.where("vec_id in (1, 2, 5)"), "vec_id", "embedding")
    asked = image_copies.rendered(vectors.where("vec_id in (1, 2, 5)"), "vec_id", "embedding", edited=True)
    both = images.withColumn("id", F.when(F.col("id") == 5, 5).otherwise(1))
    assert {(r["query"], r.class_id) for r in image_copies.find_copies(asked, both).collect()} == {(1, 1), (2, 1), (5, 5)}


def test_image_query_returns_every_member(spark, tmp_path):
    """Of equal images only the class is paired, so the query's result must say which images are in it."""
    from colligate.llm import queries

    rows = [(i, [float((i * 7 + k) % 11) / 10 + i for k in range(16)]) for i in range(1, 10)] + [(i, [3.1] * 16) for i in (20, 21, 22, 22)] + [(30, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op2_image_copies(spark, str(tmp_path)).collect()
    of = {r.image: r.class_id for r in found if r.image is not None}
    assert of == {i: i for i in range(1, 10)} | {20: 20, 21: 20, 22: 20}
    classes = {r.class_id for r in found if r["query"] == 20}
    assert classes == {20} and {i for i, c in of.items() if c in classes} == {20, 21, 22}
    assert sum(r.image is not None for r in found) == 12


@pytest.mark.parametrize("each, size", [(1024, 4 << 20), (8, 4 << 20), (1024, 3000)])
def test_large_mixed_nodes_make_no_row_for_a_pair(spark, monkeypatch, each, size):
    """Members outside of a node's largest component meet all others, and only links come out."""
    monkeypatch.setattr(near_dup, "EACH", each)
    monkeypatch.setattr(near_dup, "LIST_BYTES", size)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{i}{rng.random()}"
        texts.append((i, " ".join(w)))
    texts += [(60, None), (3, "other words that stand for a second row of one document")]
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for i, t in texts if t]
    component = lambda i: 100 if i % 3 == 0 else i
    near = lambda a, b: len(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    wanted = {(i, j) for i, a in sets for j, b in sets if i < j and component(i) != component(j) and near(a, b)}
    assert 20 < len(wanted) < 60 * 59 // 2 * 0.9
    left = spark.createDataFrame([(n, i, component(i), 60, 100, 40) for i in range(61) for n in (5, 6)], "node long, rep long, component long, size long, main long, outside long")
    played = spark.createDataFrame(texts, "doc_id long, text string")
    found = near_dup._rest(left, played, 75)
    assert {(r.u, r.v) for r in found.collect()} == wanted
    # the rows that are compared are those of members, not of pairs
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_few_trigrams_are_held_at_once(monkeypatch):
    rng = random.Random(5)
    batch = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000)) for _ in range(4)] + [""]
    held, plain = [], language_id.trigram_vectors
    monkeypatch.setattr(language_id, "trigram_vectors", lambda t: held.append(len(t)) or plain(t))
    found = language_id.text_vectors(batch)
    assert len(held) > 1 and max(held) <= 1024
    monkeypatch.setattr(language_id, "TRIGRAMS", 1 << 30)
    assert (language_id.text_vectors(batch) == found).all()


def test_personal_data(spark, docs, rows):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}

    def base(text):
        return {k: [m.span() for m in re.finditer(p, text) if good[k](m[0])] for k, p in patterns.items()}

    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a1@.+- ()0Z9%2") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == base(text)
    for long in ("1" * 100_000, "a" * 100_000 + "@", "1 " * 50_000, "+1" + " " * 100_000, "a@" * 20_000, "1.1." * 20_000):
        pii.train().spans(long)
    wanted = sorted(((d, *(len(base(t or "")[k]) for k in pii.KINDS), brute.sha(pii._joined(base(t or "")))) for d, t, _ in rows), key=repr)
    found = pii.find_personal_data(docs)
    assert got(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == wanted
    assert found.where("doc_id is null and text is null" if "text" in found.columns else "n_added < 0").count() == 0


def test_personal_data_adds_and_leaves_alone():
    r = pii.train()
    for text, kind in (("mail me: john.doe (at) acme [dot] com today", "email"), ("call 555-123-4567 now", "phone"), ("server 10[.]2[.]3[.]44 down", "ip"), ("card: 4111.1111.1111.1111 ok", "card"), ("x +1 (269) 555-3296 4524132264652876 y", "card"), ("x +1 (269) 555-3296 4524132264652876 y", "phone")):
        assert r.spans(text)[1][kind], text
    for text in ("version 1.2.3", "on 2024-01-02 at 10:20", "Licensed under CC BY-NC 4.0.", "the order 12345 of 99", "", "meet me at noon. dot"):
        assert not any(r.spans(text)[1].values()), text
    assert pii.redacted("a b@c.de f", r.spans("a b@c.de f")[1]) == "a [EMAIL] f"


def test_personal_data_is_calibrated():
    """On texts that were neither fitted on nor calibrated on: what is added is right, and most of what is there is found."""
    r, rng = pii.train(), np.random.default_rng(77)
    added_right, added, there = 0, 0, 0
    for _ in range(1500):
        text, planted = pii.synthetic(rng)
        base, every = r.spans(text)
        assert base == pii.base_spans(text)
        free = pii.Free([s for v in base.values() for s in v])
        left = {p for p in planted if free.has(*p[1:])}
        more = {(k, *s) for k in pii.KINDS for s in every[k] if s not in base[k]}
        added_right, added, there = added_right + len(more & left), added + len(more), there + len(left)
    assert added_right >= 0.97 * added and added_right >= 0.7 * there and 0.05 < min(r.thresholds.values()) and max(r.thresholds.values()) < 0.99


def test_personal_data_in_numbers_that_run_together():
    r = pii.train()
    for text, kind, value in (("dede +1 (826) 555-4081 190.137.223.204 du", "phone", "+1 (826) 555-4081"), ("oui 7536784127813050 4845168114407329 de", "card", "4845168114407329"), ("write name at host.com soon", "email", "name at host.com")):
        assert value in [text[a:b] for a, b in r.spans(text)[1][kind]]
    groups = "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"
    assert ("card", 7, 7 + len(groups)) in pii.proposals("ab 999 " + groups + " 999 c")


def test_overlaps_are_those_of_all_pairs():
    rng = random.Random(6)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randrange(60) for _ in range(12))]
        free = pii.Free(spans[:5])
        taken = list(spans[:5])
        for a, b in spans[5:]:
            clear = not any(a < d and c < b for c, d in taken)
            assert free.has(a, b) == clear
            if clear:
                free.take(a, b)
                taken.append((a, b))


def test_personal_data_takes_linear_time():
    import time

    r, took = pii.train(), []
    for n in (4000, 32000):
        text = " ".join(str(x) for x in np.random.default_rng(1).integers(0, 10**9, n))
        began = time.process_time()
        r.spans(text)
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0]


def test_decontamination(spark, docs, rows):
    items = [(1, rows[0][1][:300]), (2, "one two"), (3, ""), (4, None), (5, rows[3][1]), (5, rows[3][1]), (None, rows[5][1][:200]), (6, "never seen words here at all in any of the documents ever")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(found, *columns) == sorted(brute.contamination([r[:2] for r in rows], items), key=repr)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.count() == found.where("not contaminated").count() and kept.schema.simpleString() == docs.schema.simpleString()
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    items = [(i, rows[i][1][:200]) for i in range(10)]
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 500)
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert got(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.contamination([r[:2] for r in rows], items), key=repr)


def test_phrases(docs, rows):
    found = phrase_dedup.remove_repeated_phrases(docs)
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.phrases([r[:2] for r in rows]), key=repr)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found.collect())
    assert phrase_dedup.remove_repeated_phrases(docs.where("false")).count() == 0


def test_phrases_of_a_served_document_are_dealt_to_places(docs, rows, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "SERVED", 2)
    found = phrase_dedup.remove_repeated_phrases(docs, kept_text=False)
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.phrases([r[:2] for r in rows]), key=repr)


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    wanted = []
    for d, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        wanted.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False))))
    found = bpe.encode_documents(docs, path)
    assert got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(wanted, key=repr)
    assert bpe.encode_documents(docs.where("false"), path).count() == 0
    v = bpe.Vocabulary.read(open(path).read())
    words = [b"hello", b" world", b"aaaaaaa", "é".encode(), b"x"]
    index = bpe.PairIndex(v, words)
    index.run()
    ids, counts = index.ids()
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.encode_alone(v, w) for w in words]


def test_token_counts(docs, rows):
    vocabulary_ = [("▁a".encode(), -1.0), (b"a", -2.0), (b"b", -2.0), (b"ab", -2.5), (b"abc", -9.0), ("é".encode(), -3.0)]
    pieces = token_counts.Pieces.of(vocabulary_)
    table = dict(vocabulary_)

    def count(word):
        b = token_counts.MARK + word.encode()
        best = [(0.0, 0)]
        for i in range(1, len(b) + 1):
            ways = [(best[i - 1][0] + token_counts.BYTE_COST, best[i - 1][1] + 1)]
            ways += [(best[i - n][0] + table[b[i - n : i]], best[i - n][1] + 1) for n in range(1, min(i, pieces.longest) + 1) if b[i - n : i] in table]
            best.append(max(ways, key=lambda w: (w[0], -w[1])))
        return best[-1][1]

    words = ["a", "ab", "abab", "abc", "éa", "日本", "b" * 300]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = ends - [len(w.encode()) for w in words]
    assert token_counts.counts_of(data, starts, ends, pieces).tolist() == [count(w) for w in words]
    few = [token_counts.counts_of(data, starts[i : i + 1], ends[i : i + 1], pieces)[0] for i in range(len(words))]
    assert few == [count(w) for w in words]
    path = vocabulary("piece_bpe_32k.model")
    pieces = token_counts.Pieces.read(path)
    table = pieces.table
    cache = {}
    wanted = [(d, len(w), sum(cache[x] if x in cache else cache.setdefault(x, count(x)) for x in w)) for d, w in ((d, brute.SPACED.findall(t or "")) for d, t, _ in rows)]
    found = token_counts.count_tokens(docs, path)
    assert got(found, "doc_id", "n_words", "n_tokens") == sorted(wanted, key=repr)
    assert found.where("text is null" if "text" in found.columns else "n_words = 0 and n_tokens <> 0").count() == 0
    assert token_counts.count_tokens(docs.where("false"), vocabulary("piece_bpe_32k.model")).count() == 0


def test_token_counts_of_long_words_take_time_by_byte(monkeypatch):
    import time

    pieces = token_counts.Pieces.read(vocabulary("piece_bpe_32k.model"))
    word = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8)
    began = time.perf_counter()
    alone = token_counts.counts_of(word, np.array([0]), np.array([len(word)]), pieces)
    assert time.perf_counter() - began < 10
    monkeypatch.setattr(token_counts, "ALONE", 0)
    assert token_counts.counts_of(word[:2000], np.array([0]), np.array([2000]), pieces)[0] < alone[0]


def test_shard_bases(spark, monkeypatch):
    monkeypatch.setattr(id_shards, "SUMMED", 3)
    totals = spark.createDataFrame([(i, 10 * i + 1) for i in range(11) if i != 4], "shard long, ids long")
    wanted, before = {}, 0
    for r in totals.orderBy("shard").collect():
        wanted[r.shard], before = before, before + r.ids
    assert {r.shard: r.base for r in id_shards.bases_of(totals).collect()} == wanted


def test_phrases_with_more_words_than_letters(monkeypatch):
    monkeypatch.setattr(phrase_dedup, "LETTERS", 40)
    words = [b"w%d" % i for i in range(300)]
    automaton = phrase_dedup.PhraseAutomaton()
    automaton.add(b" ".join(words).decode())
    automaton.add(b" ".join(words[5:25]).decode())
    assert automaton.ready().occurrences([b"x", *words[100:150], b"x"]) == list(range(1, 39))


def test_language(spark, docs):
    labelled = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = language_id.held_out(F.col("doc_id"))
    profiles = language_id.learn(labelled.where(~held_out))
    found = language_id.identify(labelled.where(held_out), profiles)
    right = found.where("lang = lang_pred").count() / found.count()
    assert right >= 0.95 and found.columns == [*labelled.columns, "lang_pred", "score"]
    edge = {(r.doc_id, r.text): r for r in language_id.identify(docs, profiles).collect()}
    for key in ((2000, None), (2001, ""), (2002, " \n\t "), (None, None)):
        assert (edge[key].lang_pred, edge[key].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in edge.values())
    clash = docs.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(2))
    found = language_id.identify(clash, profiles)
    assert found.columns == [*docs.columns, "lang_pred", "score"] and found.schema["score"].dataType.typeName() == "double"
    empty = language_id.learn(labelled.where("false"))
    assert language_id.identify(docs, empty).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(docs.where("false"), profiles).count() == 0


def test_rare_languages_are_learned_from_all_their_rows(spark):
    names = ["aa", "bb", "cc", "dd", "ee"]
    held = [(i, f"words of row {i}", "en") for i in range(600)] + [(1000 + i, f"some text {n}", n) for i, n in enumerate(names * 2)]
    profiles = language_id.learn(spark.createDataFrame(held, "doc_id long, text string, lang string"), sample_rows=60)
    assert profiles.languages == [*names, "en"]
    assert language_id._most_each([600, 2, 2, 2, 2, 2], 60) == 50


def test_near_duplicates(docs, rows):
    found = near_dup.near_duplicates(docs)
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near([r[:2] for r in rows]), key=repr)
    assert near_dup.near_duplicates(docs.where("false")).count() == 0
    assert got(near_dup.near_duplicates(docs, agree=0), "doc_id", "component_id") == sorted(((x[0], x[2]) for x in brute.near([r[:2] for r in rows])), key=repr)


def test_near_duplicates_of_a_cloud(spark, monkeypatch):
    """Edits of one text, many of them just above or below the threshold of each other, in a table at sf0.01."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    held = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 7)):
            w[at] = word()
        held.append((i, " ".join(w)))
    held += [(1000 + i, " ".join(base[10:40] + [word() for _ in range(80)])) for i in range(40)]
    found = near_dup.near_duplicates(spark.createDataFrame(held, "doc_id long, text string"))
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(held), key=repr)


def test_members_of_nodes_that_stay_mixed_take_no_further_paths(spark, monkeypatch):
    """Edits of one text below the threshold stay together on most paths; they are compared after the first ones."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    branched, deal = [], near_dup._branched

    def counted(large, sampled):
        branched.append(large.count())
        return deal(large, sampled)

    monkeypatch.setattr(near_dup, "_branched", counted)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    held = []
    for i in range(80):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(3, 6)):
            w[at] = word()
        held.append((i, " ".join(w)))
    found = near_dup.near_duplicates(spark.createDataFrame(held, "doc_id long, text string"))
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(held), key=repr)
    assert branched[0] and not sum(branched[1:])


def test_near_duplicates_find_all_links_of_a_table(spark):
    """Every document's class at sf0.01, against all pairs that share a shingle."""
    held = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    wanted = {x[0]: x[2] for x in brute.near(held)}
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(held, "doc_id long, text string")).collect()}
    linked = {d for d, c in wanted.items() if d != c}
    assert sum(found[d] == wanted[d] for d in linked) >= 0.99 * len(linked) and all(found[d] == d for d in set(wanted) - linked - set(wanted.values()))


def test_near_duplicates_in_large_mixed_nodes(spark, monkeypatch):
    """A passage that many documents share makes nodes that part only on further tokens."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(40)]
    held = []
    for i in range(60):
        own = [word() for _ in range(60)]
        held.append((i, " ".join(passage + own)))
        if i % 3 == 0:
            w = passage + own
            w[70] = "edited"
            held.append((100 + i, " ".join(w)))
    found = near_dup.near_duplicates(spark.createDataFrame(held, "doc_id long, text string"))
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(held), key=repr)


def test_near_duplicates_lose_few_links_over_all_branchings(spark):
    """Links of exactly 0.75 in nodes that stay large and mixed: the paths of the code, three branchings deep."""
    rng = np.random.default_rng(3)
    n, trees = 400, near_dup.TREES
    one = rng.integers(0, 256, (n, near_dup.SAMPLES), np.uint8)
    two = np.where(rng.random(one.shape) < 0.75, one, one ^ 255)
    sampled = spark.createDataFrame([(2 * i + k, 1, bytearray(s[i].tobytes())) for i in range(n) for k, s in enumerate((one, two))], "rep long, n long, samples binary")
    shares = rng.random((n, trees)) < 0.75
    nodes = spark.createDataFrame([(2 * i + k, (i * trees + t) << 4 | t) for i in range(n) for t in range(trees) if shares[i, t] for k in (0, 1)], "rep long, node long")
    for _ in range(near_dup.LEVELS):
        large = nodes.select("node", "rep", F.col("rep").alias("component"), F.lit(-1).cast("long").alias("main"))
        nodes = written(near_dup._branched(large, sampled), spark)
    met = nodes.groupBy("node", F.floor(F.col("rep") / 2).alias("pair")).agg(F.count_distinct("rep").alias("c")).where("c = 2")
    assert n - met.select("pair").distinct().count() <= 4


def test_corners_that_share_a_part_by_chance_make_no_row(spark):
    rng = random.Random(6)
    one = rng.randbytes(32)
    near, chance = bytearray(one), one[:4] + rng.randbytes(28)
    near[9], near[30] = near[9] ^ 5, near[30] ^ 255
    close = bytes(range(image_copies.FLIPS)) * image_copies.BANDS
    schema = "id long, version int, bits binary, close binary"
    asked = spark.createDataFrame([(1, 0, one, close)], schema)
    indexed = spark.createDataFrame([(2, 0, bytes(near), close), (3, 0, chance, close)], schema)
    none = spark.createDataFrame([], "part long, count long")
    assert {r.class_id for r in image_copies._met_at_rare(asked, indexed, none).collect()} == {2}


def test_connected_members_are_not_compared_again(spark):
    """Members of the first one's component make no pair; those of each other component do."""
    rows = [(1, r, 10 if r < 40 else r) for r in range(10, 50)] + [(2, 60, 60), (2, 61, 61)]
    nodes = spark.createDataFrame(rows, "node long, rep long, component long")
    of = {r: c for _, r, c in rows}
    pairs = [(r.a, r.b) for r in near_dup._with_first(nodes).collect()]
    assert all(a < b and of[a] != of[b] for a, b in pairs) and (60, 61) in pairs
    met = {x for p in pairs for x in p}
    assert met >= set(range(40, 50)) and len(pairs) in (11, 40)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)] + [(i, i + 1) for i in range(100, 140)]
    found = components.components(spark.createDataFrame(links, "u long, v long"))
    of = {r.node: r.component for r in found.collect()}
    assert (of[3], of[9], of[140]) == (1, 5, 100) and 20 not in of
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lines(docs, rows):
    found = line_dedup.dedup_lines(docs).collect()
    gone = brute.lines([r[:2] for r in rows])
    for r in found:
        if r.text is None and r.n_lines == 0:
            continue
        original = [t for d, t, _ in rows if d == r.doc_id and t is not None]
        assert any(r.text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[r.doc_id]) for t in original)
    assert len(found) == len(rows) and found[0].__fields__[: len(docs.columns)] == docs.columns
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0
    clash = docs.where("doc_id < 5").withColumn("n_lines", F.lit("x")).withColumn("n_removed", F.lit(2))
    found = line_dedup.dedup_lines(clash)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"] and found.where("n_lines > 0").count() == clash.count()


def test_lines_meet_beyond_the_first_and_the_previous(spark):
    """Lines that share a rare shingle with many others but are like one in the middle."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    shared = [word() for _ in range(5)]
    lines = [" ".join(shared + [word() for _ in range(8)]) for _ in range(12)]
    near = lines[4].split(" ")
    near[-1] = "edited"
    held = [(i, x) for i, x in enumerate(lines)] + [(50, " ".join(near)), (51, "A b\n a B ")]
    found = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(held, "doc_id long, text string")).collect()}
    assert found[50] == 1 and found[51] == 1 and sum(found.values()) == 2


def test_lines_of_hot_tokens_meet_across_salts(spark, monkeypatch):
    """Near copies whose shared prefix tokens are all hot, dealt out so that each salt has few lines."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 0)
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 4)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    passages = [[word() for _ in range(9)] for _ in range(6)]
    held = []
    for i in range(120):
        one, two = rng.sample(passages, 2)
        own = [word() for _ in range(rng.randrange(4))]
        held.append((i, " ".join(one + two + own)))
    wanted = {d: len(n) for d, n in brute.lines(held).items()}
    for salts in (3, 16, 64):
        monkeypatch.setattr(line_dedup, "SALTS", salts)
        found = line_dedup.dedup_lines(spark.createDataFrame(held, "doc_id long, text string")).collect()
        assert {r.doc_id: r.n_removed for r in found if r.n_removed} == wanted, salts


def test_open_lines_meet_in_lists_without_a_row_for_a_pair(spark, monkeypatch):
    """Lines of one shared shingle that are mostly below the threshold; rows between steps don't grow with their square."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(24)]
    held = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(6, 24), rng.choice((1, 2, 2, 2))):
            w[k] = word()
        held.append((i, " ".join(w)))
    wanted = {d: len(n) for d, n in brute.lines(held).items() if n}
    most = []

    def counted(df, session):
        out = written(df, session)
        most.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    monkeypatch.setattr(line_dedup, "EACH", 40, raising=False)
    found = line_dedup.dedup_lines(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found if r.n_removed} == wanted
    assert max(most) < 40 * len(held)

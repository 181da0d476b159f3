"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its distinct five-word shingles (all its words, where it has fewer), words being what
stands between spaces, in lower case. A line goes when an earlier line has a Jaccard similarity of 0.75 or
more with it, both as they are in the input; earlier means a smaller key, or in one document a smaller
line number. Lines without words stay.

Equal lines are found first, by two hashes of the line in lower case; a later one goes, and only the first
one takes part from there on, as what is similar to a copy is similar to the first of the copies.

Tokens are ordered by rarity: by the count of their hash bucket over all those lines (BUCKETS counts, the
only thing that goes to the driver), then by hash. Two lines that are similar share a token among the first
n - ceil(0.75 n) + 1 of both (prefix filter); what the places of a shared token still allow must reach the
overlap that 0.75 needs (positional filter), and the smaller set must be at least 0.75 of the larger
(length filter). Pairs that pass are verified on their whole token sets.

No token emits all pairs of its lines. Each line meets the first and the previous line of each of its
prefix tokens. Only lines that are left unresolved there, with more earlier lines at some token, meet all
earlier ones at those tokens, dealt out by salt where many do. A token that a large share of all lines has
is dealt out by salt for the first step; as a salt shows only some of the earlier lines, each of its lines
but the token's first meets all earlier ones where still unresolved.

Null texts are left as they are and have no lines. A null key comes before all others. Rows that repeat a
key are one document: they share decisions by line number. Extra columns are carried along; one that has
the name of an added column gives way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import freed, written

SHINGLE = 5
BUCKETS = 1 << 16
#: A token with more than this share of all tokens is hot; there are fewer than its inverse.
HOT_SHARE = 1 / 4096
#: A token with fewer lines than this isn't hot, however small the table.
HOT_LEAST = 1024
SALTS = 64
#: Lines of a token, and shingles of theirs, in one list; about, as they are dealt by hash.
EACH = 512
EACH_SHINGLES = 1 << 16
#: Steps of rarity for each doubling of a count, so that 11 bits hold any count.
STEPS = 32
NULL_KEY = -(1 << 63)


def _hashes(lines: DataFrame) -> DataFrame:
    """lines: with a line that isn't white space alone, which gives way to h, the hashes of its words."""
    words = F.split(F.lower("line"), " ")
    spaced = F.col("line").contains("  ") | F.col("line").startswith(" ") | F.col("line").endswith(" ")
    words = lines.withColumn("words", F.when(spaced, F.array_remove(words, "")).otherwise(words)).drop("line")
    return words.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).drop("words")


def _at(i: Column) -> Column:
    """The hash of the shingle from word i on; of all words where there are fewer than five."""
    return F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(SHINGLE)])


def _places() -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size("h") - SHINGLE, F.lit(0)))


def with_shingles(lines: DataFrame) -> DataFrame:
    """lines: with a line that isn't white space alone, which gives way to shingles, its distinct token hashes."""
    hashed = _hashes(lines).withColumn("shingles", F.transform(_places(), _at)).drop("h")
    return hashed.withColumn("shingles", F.array_distinct("shingles"))


def lines_of(docs: DataFrame) -> DataFrame:
    """docs: doc, text. doc, number (from 0), line."""
    return docs.where("text is not null").select("doc", F.posexplode(F.split("text", "\n")).alias("number", "line"))


def first_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, number, line of every line that no earlier one equals but for case; doc, number of those that one does.

    Lines of white space alone are in neither.
    """
    spark = docs.sparkSession
    low = F.lower("line")
    hashed = lines_of(docs).where("trim(line) <> ''").select("doc", "number", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(1), low).alias("h2"))
    # one row a line, in short: its place in the text
    firsts = hashed.groupBy("h1", "h2").agg(F.min(F.struct("doc", "number")).alias("f")).select("f.doc", "f.number")
    firsts = firsts.groupBy("doc").agg(F.collect_list("number").alias("firsts"))
    marked = docs.where("text is not null").join(firsts, "doc", "left")
    lines = marked.select("doc", F.coalesce("firsts", F.array().cast("array<int>")).alias("firsts"), F.posexplode(F.split("text", "\n")).alias("number", "line"))
    lines = lines.where("trim(line) <> ''").select("doc", "number", "line", F.array_contains("firsts", F.col("number")).alias("first"))
    lines = written(lines.withColumn("line", F.when(F.col("first"), F.col("line"))), spark)
    return lines.where("first").select("doc", "number", "line"), lines.where("not first").select("doc", "number").distinct()


def bucket_counts(lines: DataFrame) -> np.ndarray:
    """lines: line. The number of shingles in each bucket."""
    found = _hashes(lines).select("h", F.explode(_places()).alias("i")).select(_at(F.col("i")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b"))
    counts = found.groupBy("b").count()
    # packed by thousands: BUCKETS numbers in a few rows
    packed = counts.groupBy((F.col("b") / 1024).cast("int")).agg(F.collect_list("b").alias("b"), F.collect_list("count").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in packed:
        out[r.b] = r.n
    return out


def _prefixes(lines: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc, number, n, token, pos, salt (-1 unless the token is hot): the prefix tokens of every line."""
    rank = F.lit(np.minimum(np.log2(np.maximum(counts, 1)) * STEPS, 2047).astype(np.int64) << 52)
    token = lambda s: F.coalesce(F.get(rank, s.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0)).bitwiseOR(F.shiftrightunsigned(s, 12))
    ordered = with_shingles(lines).select("doc", "number", F.sort_array(F.transform("shingles", token)).alias("tokens"))
    n = F.size("tokens")
    cut = ordered.select("doc", "number", n.alias("n"), F.posexplode(F.slice("tokens", F.lit(1), n - ((3 * n + 3) / 4).cast("int") + 1)).alias("pos", "token"))
    hot = int(np.log2(max(counts.sum() * HOT_SHARE, HOT_LEAST)) * STEPS)
    salt = F.when(F.shiftrightunsigned("token", 52) >= hot, F.pmod(F.xxhash64("doc", "number"), F.lit(SALTS)).cast("int")).otherwise(-1)
    return cut.withColumn("salt", salt)


def _allowed(a: str, b: str) -> Column:
    """Length and positional filter on structs with n and pos at a shared token."""
    return _allowed_of(F.col(a), F.col(b))


def _allowed_of(a: Column, b: Column) -> Column:
    n1, n2, p1, p2 = a.n, b.n, a.pos, b.pos
    most = F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * most >= 3 * (n1 + n2))


#: Kinds of rows: a pair of lines; a line that meets more earlier ones of a token; one that they meet; the
#: first one of a salt.
PAIR, OPEN, MET, FIRST = range(4)


def _candidates(prefixes: DataFrame) -> DataFrame:
    """kind, doc, number, and of a pair a_doc, a_number: a line and an earlier one that has a token of its; of
    the other kinds token, n, pos: all lines of the tokens that have more lines than pairs are made of."""
    rows = prefixes.select("token", "salt", F.struct("doc", "number", "n", "pos").alias("b"))
    order = Window.partitionBy("token", "salt").orderBy("b.doc", "b.number")
    second = F.when(F.col("at") == 4, F.lag("b", 2).over(order))
    seen = rows.select("token", "salt", "b", F.first("b").over(order).alias("first"), F.lag("b").over(order).alias("last"), F.row_number().over(order).alias("at"))
    seen = seen.withColumn("second", second)
    hot = F.col("salt") >= 0
    found = F.array(
        F.when(_earlier("first") & _allowed("b", "first"), _pair("first")),
        F.when((F.col("last") != F.col("first")) & _earlier("last") & _allowed("b", "last"), _pair("last")),
        # within a salt, the lines before are only some of the token's earlier ones
        F.when((F.col("at") > 3) | (hot & (F.col("at") > 1)), _member(OPEN, "b")),
        F.when(hot & (F.col("at") == 1), _member(FIRST, "b")),
        *[F.when(~hot & (F.col("at") == 4), _member(MET, x)) for x in ("first", "second", "last")],
    )
    return seen.where("last is not null or salt >= 0").select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("p.*")


def _earlier(a: str) -> Column:
    """A key that repeats has several lines of one place, which aren't compared with each other."""
    return F.struct(f"{a}.doc", f"{a}.number") < F.struct("b.doc", "b.number")


def _row(kind: int, doc: Column, number: Column, **other: Column) -> Column:
    kinds = {"a_doc": "long", "a_number": "int", "token": "long", "n": "int", "pos": "int"}
    return F.struct(F.lit(kind).alias("kind"), doc.alias("doc"), number.alias("number"), *[other.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def _pair(a: str) -> Column:
    return _row(PAIR, F.col("b.doc"), F.col("b.number"), a_doc=F.col(f"{a}.doc"), a_number=F.col(f"{a}.number"))


def _member(kind: int, a: str) -> Column:
    return _row(kind, *(F.col(f"{a}.{c}") for c in ("doc", "number")), token=F.col("token"), n=F.col(f"{a}.n"), pos=F.col(f"{a}.pos"))


def _across_salts(candidates: DataFrame) -> DataFrame:
    """The first lines of a hot token's salts, at most SALTS: each but the token's first meets that, and is open."""
    firsts = candidates.where(f"kind = {FIRST}").select("token", F.struct("doc", "number", "n", "pos").alias("b"))
    split = firsts.groupBy("token").agg(F.min("b").alias("first"), F.collect_list("b").alias("each")).where("size(each) > 1")
    split = split.select("token", "first", F.explode("each").alias("b")).where("b <> first")
    found = F.array(F.when(_earlier("first") & _allowed("b", "first"), _pair("first")), _member(OPEN, "b"))
    return split.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("p.*")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, number of the lines that are similar to the earlier line they are paired with."""
    spark = lines.sparkSession
    met = pairs.select("doc", "number").union(pairs.select("a_doc", "a_number")).distinct()
    met = freed(written(lines.join(met, ["doc", "number"], "left_semi"), spark))
    # texts are shorter than their sets of hashes
    other = met.select(F.col("doc").alias("a_doc"), F.col("number").alias("a_number"), F.col("line").alias("theirs"))
    both = pairs.join(met, ["doc", "number"]).join(other, ["a_doc", "a_number"]).select("doc", "number", "line", "theirs")
    both = with_shingles(both).withColumnsRenamed({"shingles": "a", "theirs": "line"})
    both = with_shingles(both).withColumnRenamed("shingles", "b")
    # out of a generator: a filter isn't pushed below it, with a copy of the sets for each use
    found = both.select(F.explode_outer(F.array(F.struct("doc", "number", _similar(F.col("a"), F.col("b")).alias("similar")))).alias("p"))
    return found.where("p.similar").select("p.doc", "p.number").distinct()


def _similar(a: Column, b: Column) -> Column:
    """Whether 100 c >= 75 (n + m - c), for sets of n and m that share c."""
    return 175 * F.size(F.array_intersect(a, b)) >= 75 * (F.size(a) + F.size(b))


def _near_earlier(open_: DataFrame, members: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, number of the open lines (doc, number, token) that are similar to any earlier line of their tokens.

    The open lines of a token and all its lines are dealt to lists of about EACH lines or EACH_SHINGLES
    shingles; a task has one of either, with the sets, and only lines that go leave it: there is no row for a pair.
    """
    spark = lines.sparkSession
    marked = members.select("token", "doc", "number", "n", "pos").distinct()
    marked = marked.join(open_.withColumn("open", F.lit(True)), ["token", "doc", "number"], "left")
    is_open = F.col("open").isNotNull()
    lists = lambda rows, size: F.ceil(F.greatest(rows / EACH, size / EACH_SHINGLES)).cast("int")
    dealt = marked.groupBy("token").agg(
        lists(F.count("open"), F.sum(F.when(is_open, F.col("n")))).alias("tasks"),
        lists(F.count("*"), F.sum("n")).alias("lists"),
        F.max(F.when(is_open, F.struct("doc", "number"))).alias("last"),
        F.min(F.when(is_open, F.col("n"))).alias("least"),
        F.max(F.when(is_open, F.col("n"))).alias("most"),
    )
    at = marked.join(dealt.where("last is not null"), "token")
    near = (4 * F.col("n") >= 3 * F.col("least")) & (3 * F.col("n") <= 4 * F.col("most"))
    at = written(at.where(near & (F.struct("doc", "number") <= F.col("last"))).drop("last", "least", "most"), spark)
    met = at.select("doc", "number").distinct()
    met = freed(written(lines.join(met, ["doc", "number"], "left_semi"), spark))
    at = at.join(met, ["doc", "number"])
    of = lambda c: F.pmod(F.xxhash64("doc", "number"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    holds = F.transform(every("tasks"), lambda t: F.struct(F.lit(False).alias("asks"), t.alias("task"), of("lists").alias("list")))
    asks = F.transform(every("lists"), lambda x: F.struct(F.lit(True).alias("asks"), of("tasks").alias("task"), x.alias("list")))
    cells = at.select("token", "doc", "number", "n", "pos", "line", F.explode(F.when(is_open, F.concat(holds, asks)).otherwise(holds)).alias("cell"))
    cells = with_shingles(cells.select("token", "cell.*", F.struct("doc", "number", "n", "pos").alias("at"), "line"))
    both = cells.select("token", "task", "list", "asks", F.struct("at.*", "shingles").alias("x")).groupBy("token", "task", "list")
    both = both.agg(F.collect_list(F.when(F.col("asks"), F.col("x"))).alias("asked"), F.collect_list(F.when(~F.col("asks"), F.col("x"))).alias("held"))
    meets = lambda b, a: (F.struct(a.doc, a.number) < F.struct(b.doc, b.number)) & _allowed_of(b, a) & _similar(b.shingles, a.shingles)
    gone = F.filter("asked", lambda b: F.exists("held", lambda a: meets(b, a)))
    return both.select(F.explode_outer(gone).alias("b")).where("b is not null").select("b.doc", "b.number").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """docs: doc, text. doc, number of every line that goes."""
    spark = docs.sparkSession
    lines, copies = first_lines(docs)
    counts = bucket_counts(lines.select("line"))
    freed(lines)
    candidates = freed(written(_candidates(_prefixes(lines, counts)), spark))
    candidates = candidates.union(written(_across_salts(candidates), spark))
    pairs = written(candidates.where(f"kind = {PAIR}").select("doc", "number", "a_doc", "a_number").distinct(), spark)
    near = freed(written(_verified(pairs, lines), spark))
    gone = copies.union(near)
    members = candidates.where(f"kind <> {PAIR}")
    open_ = written(members.where(f"kind = {OPEN}").select("doc", "number", "token").join(near, ["doc", "number"], "left_anti").distinct(), spark)
    if open_.isEmpty():
        return gone
    return gone.union(freed(written(_near_earlier(open_, members, lines), spark)))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The table with text cut to the lines that stay, and its numbers of lines and of those that went."""
    id_ = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NULL_KEY))
    plain = docs.select(id_(key).alias("doc"), F.col(text).alias("text"))
    gone = removed_lines(plain).groupBy("doc").agg(F.collect_set("number").alias("gone"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    k, t = (own[docs.columns.index(c)] for c in (key, text))
    inner = docs.toDF(*own)
    inner = inner.withColumn("doc", id_(k)).join(gone, "doc", "left").withColumn("lines", F.split(t, "\n"))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    inner = inner.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    new = F.when(F.col("gone").isNull(), F.col(t)).otherwise(F.array_join("kept", "\n"))
    columns = [(new if c == t else F.col(c)).alias(n) for c, n in zip(own, docs.columns, strict=True) if n not in added]
    n_removed = F.coalesce(F.size("lines") - F.size("kept"), F.lit(0))
    return inner.select(*columns, F.coalesce(F.when(F.col(t).isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias(added[0]), F.when(F.col(t).isNull(), 0).otherwise(n_removed).cast("long").alias(added[1]))

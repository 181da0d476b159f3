"""MinHash near-duplicate classes by a chosen-path set similarity join.

A document's set are its distinct five-word shingles. Documents of equal sets form a class at once; one
stands for it. Each of TREES independent trees deals the classes to nodes by one minwise token. Then, level
by level:

* every member of a node is compared with one member of it, another in each node, unless they are connected
  already, and links are confirmed on full sets;
* classes that are connected need no further comparison with each other, so a node is done when all its
  members are connected. At the first level, where most members of a node are, the others are compared with
  PIVOTS of those;
* of the other nodes, small ones (up to SMALL members) are compared exhaustively, and members of large
  ones take BRANCHES paths of STEPS further minwise tokens each, which lead to the nodes of the next level.
  Members of a node's largest component only follow those of their paths that other members take too.

Documents that only share a frequent passage part on the way: a path keeps a pair of similarity s with
probability s ** STEPS. In a node that is still large and mixed below the first level, and has up to BRANCHES lists
of EACH members or is of the last level, the members outside of its largest component are compared with all others:
the texts of a node go to one place, or to one for each two of its lists, and the tokens that every two of them share
are counted there. Links alone leave it, so there is no row for a pair, and each text is sent once a node and list.
Only larger nodes branch again, as their paths are fewer than their lists.

Recall: a pair of similarity s shares no node in TREES trees with probability (1 - s) ** TREES, 6e-8 at
0.75. Where all of its nodes stay large and mixed, it branches LEVELS times, and all of its BRANCHES ** LEVELS
paths in all trees may part. A path of STEPS samples holds for a pair of similarity s with s ** STEPS, so a level keeps it with
1 - (1 - s ** STEPS) ** BRANCHES, 0.80 at 0.75, two levels with 0.71 as the paths of a level branch in turn, and
twelve trees lose it over both in 1 of 10,000 cases; the target is at most 1 in 1,000 at exactly 0.75. Before the full sets are fetched, pairs whose SAMPLES one-byte minwise
samples agree in fewer than agree places are dropped; a pair of 0.75 agrees in fewer than AGREE with
probability 1e-20, and agree=0 drops none.

Null texts and texts without words have the empty set, which has no links. Rows that repeat an id are one
document with several sets. Rows with a null id are linked with nothing and keep a null component. Empty
tables give empty results; texts are taken whole. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .shared import blocks, bounded, freed, mixed, spread, texts, written
from .words import SPACED_FOLDED, find, sequence_hashes

SHINGLE = 5
TREES = 12
#: Samples that the paths below one tree draw on; no other tree's paths do.
OWN = 16
SAMPLES = TREES * OWN
AGREE = 84
SMALL = 30
BRANCHES = 3
STEPS = 3
LEVELS = 2
PIVOTS = 8
#: Members of a node, and bytes of their texts, in one list; about, as they are dealt by hash.
EACH = 1024
LIST_BYTES = 4 << 20
#: Tokens of more members than this are counted by matrices.
RARE = 32


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, in ascending order within each, and the n + 1 offsets."""
    found = find(*texts(column), SPACED_FOLDED)
    counts = np.diff(found.first)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, 0)
    whole = sequence_hashes(found.hashes, SHINGLE)
    at = spread(found.first[:-1], sizes)
    all_, ends = whole[at] if len(at) else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    sets = []
    for i in range(len(counts)):
        if sizes[i]:
            s = np.sort(all_[ends[i] : ends[i + 1]])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif counts[i]:
            sets.append(sequence_hashes(found.hashes[found.first[i] : found.first[i + 1]], int(counts[i])) + np.uint64(counts[i]))
        else:
            sets.append(np.zeros(0, np.uint64))
    lengths = [len(s) for s in sets]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def minwise(sets: np.ndarray, offsets: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minwise tokens of every set that isn't empty, as 32-bit numbers."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    odd = np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)
    out = np.empty((len(starts), n), np.uint32)
    if len(starts):
        for j in range(n):
            out[:, j] = np.minimum.reduceat((sets * odd[j] >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        sets, offsets = shingle_sets(batch.column("text"))
        sizes = np.diff(offsets)
        has = sizes > 0
        tokens = minwise(sets, offsets, TREES + SAMPLES, 7)
        sums = np.zeros((len(sizes), 2), np.uint64)
        if has.any():
            for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                sums[has, k] = np.add.reduceat(mixed(sets ^ np.uint64(salt)), offsets[:-1][has])
        trees = np.zeros((len(sizes), TREES), np.int32)
        trees[has] = tokens[:, :TREES].view(np.int32)
        samples = np.zeros((len(sizes), SAMPLES), np.uint8)
        # the low bits of a minimum are as good as uniform
        samples[has] = (mixed(tokens[:, TREES:].astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(sums[:, 0].view(np.int64)),
                pa.array(sums[:, 1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * TREES, pa.int32()), pa.array(trees.ravel())),
                pa.array([x.tobytes() for x in samples], pa.binary()),
            ],
            ["doc_id", "n_shingles", "h1", "h2", "trees", "samples"],
        )


def _agreeing(agree: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (texts(batch.column(c))[0].reshape(-1, SAMPLES) for c in ("samples_a", "samples_b"))
                keep = pa.array((one == two).sum(1) >= agree)
                yield batch.select(["a", "b"]).filter(keep)

    return rows


def _confirmed(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text_a", 1 << 20):
            one, two = shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b"))
            keep = []
            for i in range(batch.num_rows):
                x, y = (s[o[i] : o[i + 1]] for s, o in (one, two))
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) and len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def shared_tokens(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sets of distinct tokens, one after the other. How many each two of them have in common."""
    n = len(offsets) - 1
    order = np.argsort(sets, kind="stable")
    of, tokens = np.repeat(np.arange(n), np.diff(offsets))[order], sets[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(tokens)))
    out = np.zeros((n, n), np.int32)
    # every place of a token with all places of it
    few = (counts > 1) & (counts <= RARE)
    places, start, each = spread(first[few], counts[few]), np.repeat(first[few], counts[few]), np.repeat(counts[few], counts[few])
    for k in range(0, len(places), 1 << 16):
        here = slice(k, k + (1 << 16))
        met = np.repeat(of[places[here]], each[here]) * n + of[spread(start[here], each[here])]
        out += np.bincount(met, minlength=n * n).reshape(n, n).astype(np.int32)
    first, counts = first[counts > RARE], counts[counts > RARE]
    for k in range(0, len(first), 1024):
        a, c = first[k : k + 1024], counts[k : k + 1024]
        has = np.zeros((n, len(a)), np.float32)
        has[of[spread(a, c)], np.repeat(np.arange(len(a)), c)] = 1
        out += (has @ has.T).astype(np.int32)
    return out


def _within(percent: int):
    def links(members: pa.Table) -> pa.Table:
        rep, component, inside = (members.column(c).to_numpy() for c in ("rep", "component", "inside"))
        found = [shingle_sets(b.column("text")) for b in blocks(members.select(["text"]).to_batches(), "text")]
        sizes = np.concatenate([np.diff(o) for _, o in found])
        both = shared_tokens(np.concatenate([x for x, _ in found]), np.concatenate([[0], np.cumsum(sizes)]))
        out = []
        for i in np.flatnonzero(~inside):
            c = both[i].astype(np.int64)
            near = (c > 0) & (100 * c >= percent * (sizes[i] + sizes - c)) & (component != component[i])
            out.append(np.stack([np.minimum(rep[i], rep[near]), np.maximum(rep[i], rep[near])], 1))
        u, v = np.unique(np.concatenate(out), axis=0).T if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return links


def near_duplicates(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text", agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_links (confirmed links of its class) for every row."""
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = docs.mapInArrow(_described, "doc_id long, n_shingles long, h1 long, h2 long, trees array<int>, samples binary")
    described = written(described, spark)
    listed = described.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        listed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("trees").alias("trees"), F.first("samples").alias("samples")),
        spark,
    )
    links = freed(written(_links(spark, docs, classes, percent, agree), spark))
    of = components(links).groupBy("node").agg(F.min("component").alias("component"))
    degree = links.select("u").union(links.select("v")).groupBy("u").agg(F.count("*").alias("n_links"))
    named = classes.select("h1", "h2", "rep").join(of, F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("u"), "left")
    named = named.select("h1", "h2", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = described.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), "n_links").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def _links(spark, docs: DataFrame, classes: DataFrame, percent: int, agree: int) -> DataFrame:
    """Confirmed links u, v between classes, enough to connect all that are similar."""
    sampled = classes.select("rep", "n", "samples")
    nodes = classes.select("rep", F.posexplode("trees")).select("rep", _of_tree(F.xxhash64("pos", "col"), F.col("pos")).alias("node"))
    links = spark.createDataFrame([], "u long, v long")
    of = spark.createDataFrame([], "node long, component long")
    small = played = None
    for level in range(LEVELS + 1):
        nodes = written(_mixed(nodes, of), spark)
        if played is None:
            # texts of documents that share a node with another one, from here on the only ones that are read
            ids = nodes.select(F.col("rep").alias("doc_id")).distinct()
            played = freed(written(docs.join(ids, "doc_id", "left_semi"), spark))
        pairs = _with_first(nodes)
        if small is not None:
            pairs = pairs.union(_all_pairs(_mixed(small, of)))
        found = freed(written(_verified(pairs, sampled, played, percent, agree), spark))
        links = links.union(found)
        of = _joined(of, found) if level else _labels(links)
        left = written(_mixed(nodes, of), spark)
        if level == 0:
            pairs = _with_pivots(left.where(f"size > {SMALL}"))
            links = links.union(freed(written(_verified(pairs, sampled, played, percent, agree), spark)))
            of = written(components(links), spark)
            left = written(_mixed(left, of), spark)
        if level and left.isEmpty():
            return links
        if level == LEVELS:
            return links.union(_rest(left, played, percent))
        small, large = left.where(f"size <= {SMALL}").select("node", "rep"), left.where(f"size > {SMALL}")
        if level:
            # a text goes to no more lists of its node than a member has paths
            found = freed(written(_rest(large.where(f"size <= {BRANCHES * EACH}"), played, percent), spark))
            links, of, large = links.union(found), _joined(of, found), large.where(f"size > {BRANCHES * EACH}")
        nodes = _branched(large, sampled)


def _of_tree(node: Column, tree: Column) -> Column:
    """node with the number of its tree in the low four bits."""
    return F.shiftleft(F.shiftright(node, 4), 4).bitwiseOR(tree.cast("long"))


def _labels(links: DataFrame) -> DataFrame:
    """node, component: for linked classes one that they are connected with, mostly the least; cheaper than
    the components, and enough to tell what needs no comparison."""
    spark = links.sparkSession
    both = written(links.union(links.select("v", "u")), spark)
    near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    second = both.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
    second = written(second, spark)
    above = second.select(F.col("u").alias("m"), F.col("m").alias("upper"))
    return written(second.join(above, "m", "left").select(F.col("u").alias("node"), F.least("m", "upper").alias("component")), spark)


def _joined(of: DataFrame, links: DataFrame) -> DataFrame:
    """of (node, component), with the components brought together that links connect."""
    spark = links.sparkSession
    named = links
    for c in "uv":
        named = named.join(of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    named = named.select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")).where("u <> v")
    better = _labels(named).select(F.col("node").alias("component"), F.col("component").alias("better"))
    ends = links.select("u").union(links.select("v")).distinct().join(of.select(F.col("node").alias("u")), "u", "left_anti")
    every = of.select("node", "component").union(ends.select("u", "u"))
    return written(every.join(better, "component", "left").select("node", F.coalesce("better", "component").alias("component")), spark)


def _with_first(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of a member of each node with its members of other components."""
    firsts = nodes.groupBy("node").agg(F.min_by(F.struct("rep", "component"), F.xxhash64("rep", "node")).alias("first"))
    other = nodes.join(firsts, "node").where("component <> first.component")
    return other.select(F.least("first.rep", "rep").alias("a"), F.greatest("first.rep", "rep").alias("b"))


def _with_pivots(large: DataFrame) -> DataFrame:
    """Pairs a, b of members outside of a node's largest component, where that has most members, and PIVOTS of its."""
    most = large.where("2 * outside < size")
    inside = F.col("component") == F.col("main")
    pivots = most.where(inside).groupBy("node").agg(*[F.min_by("rep", F.xxhash64("rep", "node", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)])
    pivots = pivots.select("node", F.array_distinct(F.array(*[f"p{j}" for j in range(PIVOTS)])).alias("pivots"))
    met = most.where(~inside).select("node", "rep").join(pivots, "node").select("rep", F.explode("pivots").alias("pivot"))
    return met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def _branched(large: DataFrame, sampled: DataFrame) -> DataFrame:
    """The nodes of the next level: every member takes BRANCHES paths of STEPS further tokens.

    Only pairs of different components matter, so members of a node's largest component are left out where
    no other member takes their path.
    """
    spark = large.sparkSession
    tree = F.col("node").bitwiseAND(F.lit(15))
    place = lambda k, j: (tree * OWN + F.pmod(F.xxhash64("node", F.lit(k), F.lit(j)), F.lit(OWN))).cast("int") + 1
    path = lambda k: F.concat(*[F.substring("samples", place(k, j), F.lit(1)) for j in range(STEPS)])
    paths = [_of_tree(F.xxhash64("node", F.lit(k), path(k)), tree).alias(f"p{k}") for k in range(BRANCHES)]
    members = large.join(sampled.select("rep", "samples"), "rep").select("rep", (F.col("component") == F.col("main")).alias("inside"), *paths)
    members = written(members, spark)
    every = None
    for k in range(BRANCHES):
        of_path = members.select("rep", "inside", F.col(f"p{k}").alias("node"))
        others = of_path.where("not inside").select("rep", "node")
        met = of_path.where("inside").select("rep", "node").join(others.select("node").distinct(), "node", "left_semi").select("rep", "node")
        every = others.union(met) if every is None else every.union(others).union(met)
    return every


def _mixed(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """node, rep, component, size, main, outside of the nodes with members of several components: main is
    the component with most members, outside the number of the others."""
    nodes = nodes.select("node", "rep")
    own = nodes.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("component"))
    kinds = own.groupBy("node", "component").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"))
    mixed_ = kinds.where("kinds > 1").select("node", "size", "main", (F.col("size") - F.col("most")).alias("outside"))
    return own.join(mixed_, "node").select("node", "rep", "component", "size", "main", "outside")


def _rest(left: DataFrame, played: DataFrame, percent: int) -> DataFrame:
    """Links u, v between different components of a node, one of them outside of its largest."""
    members = left.select("node", "rep", "component", (F.col("component") == F.col("main")).alias("inside"))
    sizes = played.select(F.col("doc_id").alias("sized"), F.octet_length("text").alias("bytes"))
    sizes = members.select("node", "rep").join(sizes, F.col("rep") == F.col("sized")).groupBy("node").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    lists = F.ceil(F.greatest(F.col("n") / EACH, F.col("bytes") / LIST_BYTES, F.lit(1))).cast("int")
    dealt = sizes.select("node", lists.alias("lists")).where("lists > 1")
    members = members.join(dealt, "node", "left").withColumn("lists", F.coalesce("lists", F.lit(1)))
    own, other = F.pmod(F.xxhash64("rep", "node"), F.col("lists")), F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("other")
    members = members.select("node", "rep", "component", "inside", own.cast("int").alias("own"), other)
    members = members.select("node", "rep", "component", "inside", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    members = members.join(played.select(F.col("doc_id").alias("rep"), "text"), "rep")
    return members.groupBy("node", "one", "two").applyInArrow(_within(percent), "u long, v long").distinct()


def _all_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of different components within nodes of at most SMALL members."""
    members = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rep", "component"))).alias("m"))
    pair = lambda x: F.transform(F.filter("m", lambda y: (y.rep > x.rep) & (y.component != x.component)), lambda y: F.struct(x.rep.alias("a"), y.rep.alias("b")))
    return members.select(F.explode(F.flatten(F.transform("m", pair))).alias("p")).select("p.a", "p.b")


def _verified(pairs: DataFrame, sampled: DataFrame, played: DataFrame, percent: int, agree: int) -> DataFrame:
    """Of the pairs a, b of documents those that are similar, as u, v; sizes and samples are looked at first."""
    one = sampled.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("samples").alias("samples_a"))
    two = sampled.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("samples").alias("samples_b"))
    near = pairs.distinct().join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = near.select("a", "b", "samples_a", "samples_b").mapInArrow(_agreeing(agree), "a long, b long")
    one, two = (played.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = near.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirmed(percent), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()

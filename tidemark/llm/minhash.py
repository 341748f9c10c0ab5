"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

A text's set holds its distinct shingles of K words, as 64-bit hashes (a shorter text: all words as one; no words: empty,
linked with nothing). SuperMinHash draws for each element one random permutation of the signature's places and uniform
numbers; place p of the signature is the least of (rank of p in the element's permutation + number) over the elements. The
ranks of an element are all different, so places are correlated so as to lower the variance. Rank after rank is drawn for all
texts of a slice at once, and a text stops as soon as each of its places has a value below the next rank.

1. Texts of equal sets are one class, named by its smallest doc_id; only classes go on.
2. BANDS bands of ROWS places: a pair at the threshold 0.85 shares none of them once in 10 to the 8.
3. Candidate clusters: in each bucket the members point at the smallest; these edges (fewer than bands) are contracted.
4. Each member of a cluster takes its full set there once. Clusters of up to BLOCK members are verified in one group. A larger
   one is cut by size of set into blocks; each block is verified within itself and against the largest block of its
   cluster ("hub"), then each member not yet linked to most of its cluster against all blocks whose sizes allow a link. Tasks
   return only the edges that join what was apart (union-find), so no pairs of a group are written out.
5. The edges are contracted over all documents: hooking to the smallest neighbour and pointer jumping, checkpointed.

Cases: null and empty texts have an empty set and stay alone; rows of one doc_id are one document with all its texts; a
null doc_id is kept and has no component; repeated rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import byte_slices, materialize, text_of
from .words import BETWEEN_SPACES, hashed_words, mixed, shingles

ROWS, BANDS, BLOCK, HEAVY, SLICE_BYTES = 6, 40, 512, 2_000, 1 << 19
#: Elements whose permutations are held at once; a longer text's set is taken part by part.
ELEMENTS = 40_000


def super_minhash(values: np.ndarray, counts: np.ndarray, places: int, seed: int = 0) -> np.ndarray:
    """Signatures (texts x places) of sets that lie one after another, counts of them each; infinite for an empty set."""
    out = np.full((len(counts), places), np.inf)
    text = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(values), ELEMENTS):
        own = text[at : at + ELEMENTS]
        _fold(out[own[0] : own[-1] + 1], values[at : at + ELEMENTS], own - own[0], seed)
    return out


def _fold(out: np.ndarray, values: np.ndarray, text: np.ndarray, seed: int) -> None:
    """Takes elements into the signatures of their texts. A minimum folds, so what came before stops these the earlier."""
    places = out.shape[1]
    order = np.tile(np.arange(places, dtype=np.uint16), (len(values), 1))
    live = np.arange(len(values))
    with np.errstate(over="ignore"):
        base = mixed(values ^ mixed(np.array([seed + 1], np.uint64)))
        for rank in range(places):
            if rank:
                open_ = out.max(axis=1) > rank
                live = live[open_[text[live]]]
            if not live.size:
                break
            drawn = mixed(base[live] + np.uint64(2 * rank + 1) * np.uint64(0x9E3779B97F4A7C15))
            uniform = (drawn >> np.uint64(11)).astype(np.float64) / (1 << 53)
            chosen = rank + ((mixed(drawn) >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
            place = order[live, chosen]
            order[live, chosen] = order[live, rank]
            order[live, rank] = place
            np.minimum.at(out, (text[live], place), rank + uniform)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key


def _set_names(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, equal for equal sets."""
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(values + np.uint64(s)), dtype=np.uint64)]) for s in (11, 29)]
        return tuple((s[ends] - s[ends - counts]).view(np.int64) for s in sums)


def signatures(docs: DataFrame, k: int, rows: int, bands: int, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, a, b, bands): the set's size and names, and its band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            values, counts = shingles(*hashed_words(batch.column("text"), BETWEEN_SPACES), k)
            a, b = _set_names(values, counts)
            flat = band_keys(super_minhash(values, counts, rows * bands, seed), rows, bands).ravel().view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(a), pa.array(b), lists], ["doc_id", "n_shingles", "a", "b", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, a bigint, b bigint, bands array<bigint>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of each node of the edges (u, v): root is the smallest node reachable.

    Each round points every node at the smallest of itself and its neighbours' roots, then at its root's root; edges
    between nodes of one root go. Rounds grow with the logarithm of the longest path.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, f"{name}-edges")
    tables = []
    while edges.take(1):
        both = edges.union(edges.select("v", "u"))
        # Hook: each node to its smallest neighbour if that is smaller.
        parent = both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("p"))
        parent = materialize(parent, f"{name}-parents")
        while True:  # jump: the hooks are chains of falling ids
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(parent.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), f"{name}-jumps")
            parent = jumped.select("node", "p")
            if not jumped.filter("moved").take(1):
                break
        tables.append(parent)
        of_u, of_v = parent.select(F.col("node").alias("u"), F.col("p").alias("pu")), parent.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        left = edges.join(of_u, "u").join(of_v, "v").filter("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        edges = materialize(left, f"{name}-edges")
    if not tables:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = tables[-1]
    for earlier in reversed(tables[:-1]):
        later = found.select(F.col("node").alias("p"), F.col("p").alias("q"))
        found = earlier.join(later, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
    return found.select("node", F.col("p").alias("root"))


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (one of left, one of right) with 100 * intersection >= percent * union, counted exactly by products of 0/1 matrices."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    owner, number = owner[shared], number[shared]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    at = np.full(len(sets), -1)
    at[left] = np.arange(len(left))
    into = np.full(len(sets), -1)
    into[right] = np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    step = max(1, 2_000_000 // max(1, len(sets)))
    if len(number):
        kinds = np.cumsum(np.concatenate([[0], np.diff(number) != 0]))
        for lo in range(0, int(kinds[-1]) + 1, step):
            s = slice(*np.searchsorted(kinds, [lo, lo + step]))
            o, c = owner[s], kinds[s] - lo
            width = int(c[-1]) + 1
            a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            own = at[o] >= 0
            a[at[o[own]], c[own]] = 1
            own = into[o] >= 0
            b[into[o[own]], c[own]] = 1
            common += a @ b.T
    union = size[left][:, None] + size[right][None, :] - common
    i, j = np.nonzero((100 * common.astype(np.int64) >= percent * union.astype(np.int64)) & (common > 0))
    return left[i], right[j]


def _edges(ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    """Of the linked pairs those that join what was apart."""
    forest = UnionFind(len(ids))
    kept = [(i, j) for i, j in zip(*(p.tolist() for p in pairs), strict=True) if i != j and forest.join(i, j)]
    return pd.DataFrame({"u": ids[[i for i, _ in kept]], "v": ids[[j for _, j in kept]]}, dtype=ids.dtype)


def _unpacked(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column]


def blocked(members: DataFrame) -> DataFrame:
    """Adds block: 0 for all members of a small cluster, else parts of the cluster in order of the sets' sizes.

    A member weighs 1 and a unit more for every HEAVY elements; a block weighs about BLOCK.
    """
    weight = 1 + F.floor(F.col("size") / HEAVY)
    counted = members.groupBy("cluster", "size").agg(F.sum(weight).alias("m"))
    by = W.partitionBy("cluster").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    spread = counted.withColumns({"before": F.coalesce(F.sum("m").over(by), F.lit(0)), "all": F.sum("m").over(W.partitionBy("cluster"))}).filter(F.col("all") > BLOCK)
    spread = spread.select("cluster", "size", (1 + F.floor(F.col("before") / BLOCK)).alias("part"), F.ceil(F.col("m") / BLOCK).alias("parts"))
    # A size with many sets takes several blocks; the member's hash says which.
    block = F.col("part") * 1_000_000 + F.pmod(F.xxhash64("node"), F.col("parts"))
    return members.join(spread, ["cluster", "size"], "left").withColumn("block", F.coalesce(block, F.lit(0)).cast("long")).drop("part", "parts")


def verified(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect exactly what links of the full sets connect within each cluster.

    sets: node, cluster, block, size, set (binary).
    """

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "set"])
        here = np.arange(len(pdf))
        return _edges(pdf["node"].to_numpy(), linked_pairs(_unpacked(pdf["set"]), here, here, percent))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of side 0 and 1; each of side 0 against all."""
        pdf = pdf.sort_values("side").drop_duplicates(["node", "set"])
        first = np.flatnonzero(pdf["side"].to_numpy() == 0)
        return _edges(pdf["node"].to_numpy(), linked_pairs(_unpacked(pdf["set"]), first, np.arange(len(pdf)), percent))

    kind = sets.schema["node"].dataType.simpleString()
    edge = f"u {kind}, v {kind}"
    inner = sets.select("cluster", "block", "node", "set").groupBy("cluster", "block").applyInPandas(within, edge)
    large = sets.filter("block > 0")
    blocks = materialize(large.groupBy("cluster", "block").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")), "dedup-blocks")
    if not blocks.take(1):
        return inner
    inner = materialize(inner, "dedup-inner")

    def sides(tasks: DataFrame, first: DataFrame) -> DataFrame:
        one = first.join(tasks.withColumnRenamed("one", "block"), ["cluster", "block"]).select("cluster", F.col("block").alias("one"), "two", "node", "set", F.lit(0).alias("side"))
        two = large.join(tasks.withColumnRenamed("two", "block"), ["cluster", "block"]).select("cluster", "one", F.col("block").alias("two"), "node", "set", F.lit(1).alias("side"))
        return one.union(two).groupBy("cluster", "one", "two").applyInPandas(across, edge)

    # Two blocks can hold a link only if sizes of theirs are within percent of each other.
    may = (F.col("a.block") != F.col("b.block")) & (F.col("a.hi") * 100 >= F.col("b.lo") * percent) & (F.col("b.hi") * 100 >= F.col("a.lo") * percent)

    def tasks(some: DataFrame) -> DataFrame:
        return some.alias("a").join(blocks.alias("b"), "cluster").filter(may).select("cluster", F.col("a.block").alias("one"), F.col("b.block").alias("two"))

    hub = blocks.groupBy("cluster").agg(F.max_by(F.struct("block", "n", "lo", "hi"), F.struct("n", "block")).alias("h")).select("cluster", "h.*")
    linked = materialize(inner.union(sides(tasks(hub), large)).distinct(), "dedup-linked")
    root = components(linked, "dedup-hubs")
    # Members outside the component that holds most of their cluster meet all other blocks.
    owned = large.select("cluster", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    most = owned.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = owned.join(most, "cluster").filter("root <> main").select("node").distinct()
    outside = materialize(large.join(rest, "node", "left_semi"), "dedup-outside")
    apart = outside.groupBy("cluster", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    return linked.union(sides(tasks(apart), outside))


def near_duplicates(docs: DataFrame, k: int, percent: int, rows: int = ROWS, bands: int = BANDS, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, a, b, component_id, kept) of each row. Links: Jaccard of the sets of at least percent / 100."""
    signed = materialize(signatures(docs, k, rows, bands, seed), "dedup-signatures")
    names = signed.select("doc_id", "n_shingles", "a", "b")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    classes = materialize(classes, "dedup-classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "v")
    candidates = keys.join(buckets, "key").select(F.col("node").alias("u"), "v")
    clusters = components(candidates, "dedup-clusters")
    clustered = classes.join(clusters, "node").select("node", "a", "b", "size", F.col("root").alias("cluster"))
    sets = materialize(shingle_sets(docs, blocked(clustered), k), "dedup-sets")
    edges = verified(sets, percent)
    # A document's node is the smallest doc_id of its class; a doc_id with several texts ties their classes together.
    own = names.filter("doc_id is not null and n_shingles > 0").join(classes.select("a", "b", "node"), ["a", "b"]).select("doc_id", "node").distinct()
    roots = components(edges.union(own.filter("doc_id <> node").select("doc_id", "node")), "dedup-roots")
    found = names.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    found = found.withColumn("component_id", F.coalesce("root", "doc_id")).drop("root")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def shingle_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(node, cluster, block, size, set) of the members (node, a, b, cluster, block, size): the whole sorted set of each, packed.

    Texts move once, to the narrow rows of the members.
    """
    keep = ["node", "cluster", "block", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            values, counts = shingles(*hashed_words(batch.column("text"), BETWEEN_SPACES), k)
            a, b = _set_names(values, counts)
            ends = np.cumsum(counts) * 8
            raw = values.tobytes()
            packed = pa.array([raw[e - n * 8 : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())
            same = pa.array((a == batch.column("a").to_numpy()) & (b == batch.column("b").to_numpy()))  # not another text of that doc_id
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), packed], [*keep, "set"]).filter(same)

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("node"), text_of().alias("text")).join(members.hint("shuffle_hash"), "node")
    return texts.select(*keep, "a", "b", "text").mapInArrow(run, f"node {kind}, cluster {kind}, block bigint, size bigint, set binary")

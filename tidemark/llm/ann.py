"""Nearest neighbours by inner product, by multi-index hashing.

1. Codes. A vector gets one more component, the square root of M^2 - |x|^2 with M the largest norm (queries get 0), which turns
   inner products into angles. The codes are signs of rotated principal components; the rotations are learned by iterative
   quantization on a sample of at most SAMPLE vectors (by the order of a hash). BITS bits. Equal vectors are one entry, with the
   smallest of its ids that any answer can need.
2. Index. Each code is cut into substrings whose length grows with the number of vectors (substring_bits); the index is a table of
   postings (substring's number, value, entry, code), dealt by number and value. If none of the sample's vectors has its neighbours
   within the radius that probing covers, there is nothing that it would settle, and step 5 takes all queries at once.
3. Probing. A query looks up each substring's values within FLIPS bits of its own. By the pigeonhole principle that finds every code
   within m (FLIPS + 1) - 1 of the query's, m being the number of substrings. A code that several substrings find counts at the
   first. Codes within that radius are reranked on the original vectors in double precision.
4. Stopping. The worst of the k found says how far away the codes of better ones can be: an angle t makes BITS t / pi differences on
   average, and the sample says how far above that RECALL of the neighbours lie. A query is done if that is within the radius.
5. Wider radius. The other queries - those whose neighbours are far, and those whose own buckets hold more than CROWD codes - go to the
   vectors in blocks of about BLOCK, each query to each block with the radius it needs, at most the radius within which RECALL of
   the sample's neighbours lie. A block applies the same pigeonhole rule to substrings of 8 bits, and gives its best.

Where neighbours are near, step 3 answers, and a query meets only the buckets it probes. Where all vectors are about as far from
each other, as in random data, no radius below that of most codes has the neighbours, and step 5 meets nearly all (queries x
vectors, in blocks). Queries with fewer than k found are scored against all vectors, in the same blocks.

Cases: vectors that are null, empty, zero, hold null or non-finite components or have another dimension than most take no part,
nor do null ids; rows of one id with other vectors are queries of their own, and no row of an id is its own candidate;
fewer candidates than k give all; ties go to the smaller id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import materialize

BITS, SAMPLE, BLOCK, QUERIES, RECALL, ROUNDS, FLIPS, CROWD = 128, 4_096, 8_192, 4_096, 0.94, 30, 1, 4_096


@dataclass
class Codes:
    """Learned codes: mean, rotations (one matrix), the largest norm and the search radius."""

    mean: np.ndarray
    rotation: np.ndarray
    norm: float
    radius: int = BITS
    #: How many standard deviations above the mean RECALL of the neighbours' distances lie.
    above: float = 2.0
    #: The radii that the sample's vectors would need as queries for their k nearest in the sample.
    needed: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes (rows x BITS / 8 bytes)."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        if query:
            x = x * (self.norm / np.sqrt((x**2).sum(axis=1, keepdims=True)))
        return np.packbits((np.c_[x, extra] - self.mean) @ self.rotation > 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of a from one code b."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1)


def learn(sample: np.ndarray, norm: float, k: int, seed: int = 0) -> Codes:
    rng = np.random.default_rng(seed)
    x = np.c_[sample, np.sqrt(np.maximum(norm**2 - (sample**2).sum(axis=1), 0))]
    mean = x.mean(axis=0)
    x = x - mean
    width = min(64, x.shape[1])
    parts = np.linalg.svd(x.T @ x)[0][:, :width]
    v = x @ parts
    rotations = []
    while sum(r.shape[1] for r in rotations) < BITS:
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(ROUNDS):  # iterative quantization: the codes for a rotation, then the rotation for the codes
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        rotations.append(parts @ r)
    codes = Codes(mean, np.concatenate(rotations, axis=1)[:, :BITS], norm)
    # The radius, by exact search of some of the sample in all of it.
    own, far, above, worst = codes.of(sample, False), [], [], []
    picked = np.arange(0, len(sample), max(1, len(sample) // 256))
    asked = codes.of(sample[picked], True)
    for i, q in zip(picked, asked, strict=True):
        s = sample @ sample[i]
        s[i] = -np.inf
        top = np.argsort(-s, kind="stable")[: min(k, len(sample) - 1)]
        differ = distances(own[top], q)
        far.extend(differ.tolist())
        share = np.arccos(np.clip(s[top] / (norm * np.linalg.norm(sample[i])), -1, 1)) / math.pi
        worst.extend(share[-1:].tolist())
        above.extend(((differ - BITS * share) / np.sqrt(BITS * share * (1 - share) + 1)).tolist())
    if far:
        codes.radius = int(np.quantile(far, RECALL, method="higher"))
        codes.above = float(np.quantile(above, RECALL, method="higher"))
        worst = np.array(worst)
        codes.needed = np.ceil(BITS * worst + codes.above * np.sqrt(BITS * worst * (1 - worst) + 1))
    return codes


def needed_radius(score: Column, norm: Column, codes: Codes) -> Column:
    """The radius that holds RECALL of the vectors that score as much or more."""
    share = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / (norm * codes.norm)))) / math.pi
    return F.ceil(BITS * share + codes.above * F.sqrt(BITS * share * (1 - share) + 1))


def substring_bits(n: int) -> int:
    """So many that a bucket holds less than one code on average, however many there are."""
    return min(32, max(8, math.ceil(math.log2(max(n, 1))) + 1))


def flips(bits: int) -> np.ndarray:
    """The numbers of `bits` bits with FLIPS ones at most."""
    return np.array([sum(1 << j for j in c) for d in range(FLIPS + 1) for c in combinations(range(bits), d)], np.int64)


def substrings(codes: np.ndarray, bits: int) -> np.ndarray:
    """The values of the substrings (rows x BITS // bits) of codes; bits left over are in none."""
    tables = BITS // bits
    return np.unpackbits(codes, axis=1)[:, : tables * bits].reshape(len(codes), tables, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def first_substring(bits: int) -> Column:
    """The number of the first substring in which the codes (a0, a1) and (b0, b1) differ by FLIPS bits at most."""
    each = []
    for t in range(BITS // bits):
        marks = np.zeros((1, BITS), np.uint8)
        marks[0, t * bits : (t + 1) * bits] = 1
        words = np.packbits(marks, axis=1).view(np.int64)[0].tolist()
        parts = [F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}")).bitwiseAND(F.lit(m).cast("long"))) for w, m in enumerate(words) if m]
        each.append(F.when(sum(parts[1:], parts[0]) <= FLIPS, t))
    return F.coalesce(*each)


def allowances(radius: int, tables: int) -> list[int]:
    """How many bits a code within the radius may differ by in one of the substrings at least (-1: that substring need not be looked at)."""
    a, b = divmod(radius, tables)
    return [a if t <= b else a - 1 for t in range(tables)]


class Block:
    """Entries with, for each byte of their codes, the values of all of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes, self.values = ids, x, codes, np.ascontiguousarray(codes.T)
        self.words = np.ascontiguousarray(codes.view(np.uint64).T)
        self.rough = x.astype(np.float32)
        self.error = 1e-5 * np.sqrt((x**2).sum(axis=1).max(initial=0))  # of a rough score, for a query of norm 1

    def candidates(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes lie within the radius."""
        met = np.zeros(len(self.ids), bool)
        for t, most in enumerate(allowances(radius, len(code))):
            if most >= 0:
                met |= np.bitwise_count(self.values[t] ^ code[t]) <= most
        words = code.view(np.uint64)
        apart = sum((np.bitwise_count(w ^ c) for w, c in zip(self.words[1:], words[1:], strict=True)), np.bitwise_count(self.words[0] ^ words[0]))
        return np.flatnonzero(met & (apart <= radius))

    def best(self, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best."""
        if len(rows) > 4 * k:  # those that can be among the best, by scores in single precision and their greatest error
            score = self.rough[rows] @ q.astype(np.float32)
            rows = rows[score >= np.partition(score, len(score) - k)[len(score) - k] - 2 * self.error * np.linalg.norm(q)]
        score = (self.x[rows] * q).sum(axis=1)  # sums each row alike
        first = np.lexsort((self.ids[rows], -score))[:k]
        return rows[first], score[first]


def _valid(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found to each row for which is_query holds."""
    spark = df.sparkSession
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), x.alias("x"), is_query.alias("asks")).filter(F.col("id").isNotNull() & _valid(F.col("x")))
    kinds = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm2"), F.sum(F.col("asks").cast("long")).alias("q"))
    most = kinds.orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if most is None or not most["q"]:
        return empty
    rows = rows.filter(F.size("x") == most["d"]).withColumn("entry", F.xxhash64("x"))
    asked = materialize(rows.filter("asks").select("id", "entry").distinct(), "ann-queries")
    need = k + asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]  # no answer needs more, its own rows taken out
    # One entry for each vector, with its smallest ids. The window cuts copies down before the shuffle.
    number = F.dense_rank().over(W.partitionBy("entry").orderBy("id"))
    few = rows.select("entry", "id", "x").withColumn("n", number).filter(F.col("n") <= need)
    entries = materialize(few.groupBy("entry").agg(F.first("x").alias("x"), F.sort_array(F.collect_set("id")).alias("ids")), "ann-entries")
    n = entries.count()
    sample = np.array([r["x"] for r in entries.orderBy(F.xxhash64("entry"), "entry").select("x").limit(SAMPLE).collect()])
    codes = learn(sample, math.sqrt(most["norm2"]), k, seed)
    sent = spark.sparkContext.broadcast(codes)
    queries = materialize(entries.join(asked.select("entry").distinct(), "entry", "left_semi").select(F.col("entry").alias("query"), "x"), "ann-asked")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))

    bits = substring_bits(n)
    radius = index_radius(bits)
    if (codes.needed <= radius).any():
        near = materialize(probed(entries, queries, bits, sent, need), "ann-near")
    else:
        near = spark.createDataFrame([], "query long, vec_id long, score double, rank int")
    worst = near.groupBy("query").agg(F.max("rank").alias("n"), F.min("score").alias("worst"))
    reached = queries.join(worst, "query", "left").withColumn("radius", F.when(F.col("n") >= need, needed_radius(F.col("worst"), norm, codes)).otherwise(BITS))
    far = materialize(reached.filter(F.col("radius") > radius).select("query", "x", F.least(F.col("radius"), F.lit(codes.radius)).cast("int").alias("radius")), "ann-far")
    found = near.join(far.select("query"), "query", "left_anti")
    if far.take(1):
        wide = materialize(ranked(blockwise(entries, far, n, sent, need), entries, need), "ann-wide")
        enough = wide.filter(F.col("rank") == min(need, k + 1)).select("query")
        short = materialize(far.join(enough, "query", "left_anti").withColumn("radius", F.lit(BITS)), "ann-short")
        if short.take(1):
            wide = wide.join(enough, "query", "left_semi").unionByName(ranked(blockwise(entries, short, n, sent, need), entries, need))
        found = found.unionByName(wide)
    # Each query's answers are one short list, which all ids of its vector read: no window over the ids of a vector that many have.
    answers = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    mine = asked.select(F.col("id").alias("query_id"), F.col("entry").alias("query")).join(answers, "query")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    each = mine.select("query_id", F.posexplode(others).alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def ranked(scored: DataFrame, entries: DataFrame, need: int) -> DataFrame:
    """(query, vec_id, score, rank): the best `need` of each query's scored entries (query, entry, score), by their ids."""
    named = scored.join(entries.select("entry", F.explode("ids").alias("vec_id")), "entry").select("query", "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= need)


def index_radius(bits: int) -> int:
    """Within which the probes find every code."""
    return BITS // bits * (FLIPS + 1) - 1


def probed(entries: DataFrame, queries: DataFrame, bits: int, sent: Broadcast, need: int) -> DataFrame:
    """The best of the entries that the queries' probes find within the index's radius. Crowded queries find none."""
    change = flips(bits)
    tables = BITS // bits

    def coded(query: bool, flip: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                    found = codes.of(x, query)
                    values = substrings(found, bits)[:, :, None] ^ (change if flip else change[:1])
                    each = values.shape[1] * values.shape[2]
                    row = pa.array(np.repeat(np.arange(part.num_rows), each))
                    two = [pa.array(np.repeat(w, each)) for w in found.view(np.int64).T]
                    number = np.tile(np.repeat(np.arange(tables, dtype=np.int32), values.shape[2]), part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), *two, pa.array(number), pa.array(values.ravel())], [part.schema.names[0], "c0", "c1", "t", "v"])

        return run

    kind = "c0 long, c1 long, t int, v long"
    postings = materialize(entries.select("entry", "x").mapInArrow(coded(False, False), f"entry long, {kind}"), "ann-postings")
    sizes = postings.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
    own = queries.select("query", "x").mapInArrow(coded(True, False), f"query long, {kind}").join(sizes, ["t", "v"]).groupBy("query").agg(F.sum("n").alias("n"))
    free = queries.join(own, "query", "left").filter(F.coalesce("n", F.lit(0)) <= CROWD).select("query", "x")
    free = free.mapInArrow(coded(True, True), f"query long, {kind}").select("query", F.col("c0").alias("a0"), F.col("c1").alias("a1"), "t", "v")
    radius = index_radius(bits)
    met = free.join(postings.select("entry", F.col("c0").alias("b0"), F.col("c1").alias("b1"), "t", "v"), ["t", "v"])
    apart = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in range(1, BITS // 64)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    met = met.filter((apart <= radius) & (F.col("t") == first_substring(bits))).select("query", "entry")
    both = met.join(entries.select("entry", "x"), "entry").join(queries.select("query", F.col("x").alias("q")), "query")
    score = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return ranked(both.select("query", "entry", score.alias("score")), entries, need)


def blockwise(entries: DataFrame, queries: DataFrame, n: int, sent: Broadcast, need: int) -> DataFrame:
    """(query, entry, score) of the best entries within each query's own radius. queries: query, x, radius."""
    blocks, parts = -(-n // BLOCK), -(-queries.count() // QUERIES)

    def task(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names, entries, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(data) and len(asked):
            codes = sent.value
            own = np.stack(data["x"].to_numpy())
            block = Block(data["first"].to_numpy(), own, codes.of(own, False))
            entry, everything = data["entry"].to_numpy(), np.arange(len(own))
            x = np.stack(asked["x"].to_numpy())
            for name, q, c, radius in zip(asked["query"], x, codes.of(x, True), asked["radius"].tolist(), strict=True):
                rows, score = block.best(q, everything if radius >= BITS else block.candidates(c, radius), need)
                names.append(np.full(len(rows), name))
                entries.append(entry[rows])
                scores.append(score)
        return pd.DataFrame({"query": np.concatenate(names), "entry": np.concatenate(entries), "score": np.concatenate(scores)})

    # Blocks are replicated once for each part of the queries, the queries once for each block.
    data = entries.select("entry", "x", F.get("ids", F.lit(0)).alias("first"), F.pmod("entry", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = queries.select("query", "x", "radius", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod("query", F.lit(parts)).alias("part"))
    by = [F.col("block").cast("long").alias("block"), F.col("part").cast("long").alias("part")]
    data, asked = data.select("entry", "x", "first", *by), asked.select("query", "x", "radius", *by)
    found = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(task, "query long, entry long, score double")
    # The best of all blocks' best; entries of one score in the order of their first ids.
    first = found.join(entries.select("entry", F.get("ids", F.lit(0)).alias("first")), "entry")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "first"))
    return first.withColumn("n", rank).filter(F.col("n") <= need).select("query", "entry", "score")

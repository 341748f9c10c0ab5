import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ann


def brute(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            scores = sorted(((-float(np.dot(np.array(x), np.array(y))), v) for v, y in rows if v != q))[:k]
            out[q] = [v for _, v in scores]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).toPandas()
    want = brute(rows, 20)
    assert (found.groupby("query_id").size() == 20).all() and set(found.query_id) == set(want)
    assert sum(len(set(g.vec_id) & set(want[q])) for q, g in found.groupby("query_id")) / (20 * len(want)) >= 0.9
    r = found.iloc[5]
    assert abs(r.score - float(np.dot(x[int(r.query_id)], x[int(r.vec_id)]))) < 1e-12


def test_odd_rows_and_ties(spark):
    one, two = [1.0, 0.0], [0.0, 2.0]
    rows = [(0, one), (0, one), (1, one), (2, one), (3, two), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (None, one), (20, [float("inf"), 1.0]), (40, two), (60, [1.0]), (8, [])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")), F.col("vec_id") % 20 == 0, 2)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 1.0), (40, 1): (3, 4.0), (40, 2): (0, 0.0)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.search(empty, F.col("vec_id") % 20 == 0, 2).count() == 0


def test_blocks_find_all_codes_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 16)).astype(np.uint8)
    block = ann.Block(np.arange(500), np.zeros((500, 2)), codes)
    for radius in (7, 40, 58):
        for i in range(5):
            near = codes[i] ^ (rng.random(16) < 0.3).astype(np.uint8)
            assert block.candidates(near, radius).tolist() == np.flatnonzero(ann.distances(codes, near) <= radius).tolist()


def test_probes_find_all_codes_within_their_radius(spark):
    """Each code within the radius is found by a probe, and counted at one substring only."""
    rng = np.random.default_rng(2)
    code = rng.integers(0, 256, (1, 16)).astype(np.uint8)
    for bits in (8, 13, 17, 32):
        radius = 128 // bits * (ann.FLIPS + 1) - 1
        others = np.unpackbits(np.repeat(code, 300, axis=0), axis=1)
        for row in others:
            row[rng.choice(128, rng.integers(0, radius + 8), replace=False)] ^= 1
        others = np.packbits(others, axis=1)
        mine, theirs = (ann.substrings(c, bits) for c in (code, others))
        probes = mine[:, :, None] ^ ann.flips(bits)
        found = (theirs[:, :, None] == probes).any(axis=2)
        near = ann.distances(others, code[0]) <= radius
        assert found[near].any(axis=1).all()
        a, words = code.view(np.int64)[0].tolist(), others.view(np.int64).tolist()
        df = spark.createDataFrame([(*a, *w) for w in words], "a0 long, a1 long, b0 long, b1 long")
        first = [r[0] for r in df.select(ann.first_substring(bits)).collect()]
        assert first == [int(np.argmax(f)) if f.any() else None for f in found]


def test_near_neighbours_are_found_by_the_index(spark, monkeypatch):
    """Vectors in tight groups are answered by probes alone, with copies and crowds; the result is that of brute force."""
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((60, 24))
    x = np.repeat(centers, 40, axis=0) + 0.02 * rng.standard_normal((2400, 24))
    x[100:160] = x[100]  # copies
    rows = [(i, [float(v) for v in r / np.linalg.norm(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20)
    met = {4_096: 0, 300: 0}
    wide = ann.blockwise
    monkeypatch.setattr(ann, "blockwise", lambda e, q, *a: met.update({ann.CROWD: met[ann.CROWD] + q.count()}) or wide(e, q, *a))
    for crowd in met:
        monkeypatch.setattr(ann, "CROWD", crowd)
        found = ann.search(df, F.col("vec_id") % 20 == 0, 20).toPandas()
        assert (found.groupby("query_id").size() == 20).all()
        assert sum(len(set(g.vec_id) & set(want[q])) for q, g in found.groupby("query_id")) / (20 * len(want)) > 0.95
        assert found[(found.query_id == 100)].sort_values("rank").vec_id.tolist() == list(range(101, 121))
    assert met[4_096] == 0 and met[300] > 60

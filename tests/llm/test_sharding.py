import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.queries import op9_shards


def naive(sizes, capacity):
    """Best fit by a scan of all bins; of equal rooms the first."""
    free, out = [], []
    for s in sizes:
        fits = [(room, i) for i, room in enumerate(free) if room >= s]
        if fits:
            i = min(fits)[1]
            free[i] -= s
        else:
            i = len(free)
            free.append(capacity - s)
        out.append(i)
    return out


def one_by_one(ranges, sizes):
    """The bin of each size, as packed by counts."""
    bins = {(s, i): b for s, b, first, last in ranges for i in range(first, last)}
    assert len(bins) == len(sizes)
    return [bins[s, sizes[:i].count(s)] for i, s in enumerate(sizes)]


def test_best_fit_equals_a_scan():
    rng = random.Random(3)
    for n in (0, 1, 50, 700):
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        assert one_by_one(sharding.best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), 101), sizes) == naive(sizes, 101)


def test_whole_packing_equals_brute_force(spark):
    """Shards of a table against best fit by a scan at the least capacity that suffices, with groups larger than a share."""
    rng = random.Random(8)
    for shards, large in ((7, []), (5, [90_000, 90_000, 12_000])):
        sizes = sorted([rng.randint(17, 900) for _ in range(400)] + large, reverse=True)
        left, alone = list(sizes), []
        while len(alone) < shards - 1 and left[0] * (shards - len(alone)) > sum(left):
            alone.append(left.pop(0))
        capacity = next(c for c in range(max(-(-sum(left) // (shards - len(alone))), left[0]), 10**7) if max(naive(left, c)) < shards - len(alone))
        loads = Counter(alone)
        for b, n in Counter({b: sum(s for s, x in zip(left, naive(left, capacity), strict=True) if x == b) for b in range(shards - len(alone))}).items():
            loads[n] += 1
        df = spark.createDataFrame([(i, s, i) for i, s in enumerate(sizes)], "doc_id long, size long, g long")
        exact = all(s < 1 << sharding.BITS for s in left)
        found = sharding.shard(df, shards, "size", "g", ["doc_id"]).groupBy("shard").agg(F.sum("size").alias("n")).collect()
        assert exact and Counter(r.n for r in found) == Counter({k: v for k, v in loads.items() if k})


def test_fixed_capacity(spark):
    rng = random.Random(9)
    sizes = sorted([rng.randint(10, 99) for _ in range(200)] + [400], reverse=True)
    df = spark.createDataFrame([(i, s, i) for i, s in enumerate(sizes)], "doc_id long, size long, g long")
    found = sharding.shard(df, None, "size", "g", ["doc_id"], capacity=300).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    want = naive([s for s in sizes if s < 400], 300)
    assert sorted(r.n for r in found if r.n != 400) == sorted(sum(s for s, x in zip(sizes[1:], want, strict=True) if x == b) for b in set(want)) and len(found) == max(want) + 2


def test_shards_are_even_and_groups_whole(spark, tmp_path):
    found = op9_shards(spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = found.join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert len(rows) == docs.count()
    assert (rows.groupby("text").shard.nunique() == 1).all()
    each = rows.groupby("shard").agg(b=("size", "sum"), n=("slot", "size"), last=("slot", "max"), distinct=("slot", "nunique"))
    assert len(each) == 40 and (each.n == each["last"] + 1).all() and (each.n == each.distinct).all()
    assert each.b.max() - each.b.min() < 0.001 * each.b.mean()


def test_hot_group_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 10)
    monkeypatch.setattr(sharding, "HOT", 3)
    rows = [(i, "same text") for i in range(300)] + [(i, f"text {i}") for i in range(300, 900)] + [(1000, None), (1001, ""), (None, "x"), (5, "same text"), (5, "same text")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    got = op9_shards(spark, path).toPandas()
    assert len(got) == len(rows)
    hot = got[got.text_crc32 == got.text_crc32.mode()[0]]
    assert hot.shard.nunique() == 1
    assert (got.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s))))).all()
    assert got[got.doc_id == 1000]["size"].tolist() == [16]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op9_shards(spark, str(tmp_path)).count() == 0

import math
import random

from pyspark.sql import functions as F

from tidemark.llm import quality


def test_held_out_labels(spark):
    """Rejects junk and toxic documents, keeps the rest."""
    where = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    found = quality.judge(docs, seen).join(labels.filter(F.xxhash64("doc_id") % 2 != 0).withColumnRenamed("toxic", "was_toxic"), "doc_id").toPandas()
    clean = (found.quality == 1) & (found.was_toxic == 0)
    assert found[clean].kept.mean() > 0.99
    assert found[found.was_toxic == 1].kept.mean() < 0.1 and found[found.quality == 0].kept.mean() < 0.1


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, None, None), (None, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(odd_docs, labels).count() == 8
    none = labels.limit(0)
    assert quality.judge(odd_docs, none).filter("kept").count() == 8
    assert quality.judge(no_docs, labels).count() == 0 and quality.judge(no_docs, none).count() == 0
    whole = quality.judge(odd_docs, labels, text=True)
    assert set(odd_docs.columns) <= set(whole.columns)


def test_sparse_sites_shrink(spark):
    rows = [(i, "big", "p", 0.0, -9.0) for i in range(100)] + [(i, "bad", "p", -6.0, -9.0) for i in range(100, 200)] + [(200, "rare", "p", -6.0, -9.0)]
    scored = spark.createDataFrame(rows, "doc_id long, source string, lang string, good_evidence double, toxic_evidence double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    prior = {r["_host"]: r["good_prior"] for r in quality.sites(scored, labels, "source", "lang").collect()}
    assert prior["bad"] < prior["rare"] < prior["big"]


def test_training_reads_whole_texts(spark):
    """What comes after a long beginning teaches its label, and long texts are judged as they were learned."""
    tail = {0: "calm gentle kindly friend ", 1: "vile nasty wicked insult "}
    rows = [(i, f"start{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]} " + "filler words of it " * 1_200 + tail[i % 3 % 2] * 20, i % 3 % 2) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    clean, toxic = model.evidence(["new " + "filler words of it " * 1_200 + tail[y] * 20 for y in (0, 1)])[:, 1]
    assert clean < -1 and toxic > 1


def test_posteriors_equal_a_plain_computation(spark):
    """Sites and posteriors recomputed in plain Python from the documents' evidence and labels, with null hosts and repeated rows."""
    rng = random.Random(6)
    evidence = [(i, rng.choice(["a", "b", "c", None, f"h{i % 9}"]), rng.choice(["x", "y", None]), rng.gauss(2, 3), rng.gauss(-4, 2)) for i in range(300)]
    evidence += evidence[:5]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 3)] + [(0, 1, 1)]
    scored = spark.createDataFrame(evidence, "doc_id long, source string, lang string, good_evidence double, toxic_evidence double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.decide(scored, quality.sites(scored, known, "source", "lang"), "source", "lang").collect()

    best = {}
    for i, *y in labels:
        best[i] = [max((v for v in (a, b) if v is not None), default=None) for a, b in zip(best.get(i, (None, None)), y, strict=True)]
    logistic = lambda v: 1 / (1 + math.exp(-v))
    odds = lambda v: math.log(v / (1 - v))

    def strength(groups):  # (n, rate, parent's rate)
        n = sum(g[0] for g in groups)
        between = (sum(m * (r - p) ** 2 for m, r, p in groups) - sum(p * (1 - p) for _, _, p in groups)) / n
        return max(1.0, sum(m * p * (1 - p) for m, _, p in groups) / n / max(between, 1e-9) - 1)

    prior = {}
    for label in (0, 1):
        values = [(h or "", p or "", best[i][label] if best.get(i, (None, None))[label] is not None else logistic(e[label])) for i, h, p, *e in evidence]
        rate = (sum(v for *_, v in values) + 0.5) / (len(values) + 1)
        hosts, paths = {}, {}
        for h, p, v in values:
            hosts.setdefault(h, []).append(v)
            paths.setdefault((h, p), []).append(v)
        k = strength([(len(v), sum(v) / len(v), rate) for v in hosts.values()])
        host = {h: (sum(v) + k * rate) / (len(v) + k) for h, v in hosts.items()}
        k = strength([(len(v), sum(v) / len(v), host[x[0]]) for x, v in paths.items()])
        for x, v in paths.items():
            prior[label, x] = odds((sum(v) + k * host[x[0]]) / (len(v) + k)) - odds(rate)
    assert len(found) == len(evidence)
    for r in found:
        site = (r.source or "", r.lang or "")
        good, toxic = logistic(r.good_evidence + prior[0, site]), logistic(r.toxic_evidence + prior[1, site])
        assert abs(r.good - good) < 1e-9 and abs(r.toxic - toxic) < 1e-9 and r.kept == (good >= 0.5 and toxic <= 0.5)


def test_columns_of_any_name_pass_through(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    names = ["_host", "_PATH", "good_prior", "toxic_prior", "__host"]
    docs = odd_docs.withColumns({n: F.lit(n) for n in names})
    found = quality.judge(docs, labels, text=True)
    assert found.count() == docs.count() and all(r[n] == n for r in found.collect() for n in names)

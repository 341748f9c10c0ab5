import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontaminate as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def brute(docs, items, width):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    named |= found
        out.append((i, len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return out


def rows(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=str)


def check(spark, docs, items, width=5):
    got = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width)
    assert rows(got) == sorted(brute(docs, items, width), key=str)


def cases(prose):
    items = [(1, " ".join(prose[0].split()[:20])), (2, prose[1]), (3, "Två ord"), (4, None), (5, ""), (6, " ".join(prose[0].split()[3:14])), (None, " ".join(prose[5].split()[:8]))]
    part = " ".join(prose[0].split()[2:12]).upper()
    docs = [(i, t) for i, t in enumerate(prose[6:30])]
    docs += [(100, f"{prose[7]}! {part}, {prose[8]}"), (101, None), (102, ""), (103, part), (103, part), (103, "other " + part), (104, f"två-ord {prose[1]} två ord"), (105, prose[5]), (None, part)]
    return docs, items


def test_equals_brute_force(spark, prose):
    docs, items = cases(prose)
    check(spark, docs, items)
    check(spark, docs, [x for x in items if x[0] != 3], width=8)


def test_without_the_filter_on_pairs(spark, prose, monkeypatch):
    monkeypatch.setattr(d, "PAIRS", 1)
    check(spark, *cases(prose))


def test_windows_of_one_word(spark, prose):
    docs, items = cases(prose)
    check(spark, docs, [*items, (7, "Ord"), (8, prose[9].split()[3])])
    check(spark, docs, [(7, "Ord")])


def test_empty_tables(spark, prose, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(no_docs, items).count() == 0
    assert rows(d.contamination(spark.createDataFrame([(1, prose[0])], "doc_id long, text string"), items)) == [(1, len(prose[0].split()), 0, [])]


def test_rule(spark):
    rows = spark.createDataFrame([(0, 0), (1, 20), (1, 21), (3, 60)], "n_hit long, n_words long")
    assert [r[0] for r in rows.select(d.is_contaminated()).collect()] == [False, True, False, True]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x red a b green c"), (2, "green a b c d e f red"), (3, "red red"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "red green"), (8, "red missing")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.proximity(docs, items, 4).collect()] == [(1, 9)]
    assert {r.doc_id for r in d.proximity(docs, items, 8).collect()} == {1, 2}


def test_document_key_is_of_the_text(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "doc_id long, text string")
    assert rows.select(d.document_key().alias("k")).distinct().count() == 2
    assert rows.filter(F.col("doc_id") == 1).count() == 3


def test_columns_of_inner_names(spark, prose):
    """Columns that the operator uses inside may stand in the tables."""
    docs, items = cases(prose)
    plain = rows(d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    names = ("key", "terms", "places", "term", "window", "n_hit", "first")
    more = lambda df: df.withColumns({n: F.lit("x") for n in names})
    again = d.contamination(more(spark.createDataFrame(docs, "doc_id long, text string")), more(spark.createDataFrame(items, "item_id long, text string")))
    assert rows(again) == plain


def test_repeated_terms(spark):
    """Windows of one term again and again, in texts of the same: every place counts."""
    check(spark, [(1, "a " * 40), (2, "a b " * 20), (3, "b a"), (4, "a " * 12)], [(1, "a " * 14), (2, "a b " * 8), (3, "a " * 12 + "b")])


def test_proximity_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i % 25, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for i in range(40)]
    items = [(i, " ".join(rng.choices("abcdefghz", k=rng.randint(1, 5)))) for i in range(12)]
    for span in (3, 6):
        found = d.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span)
        want = {(i, j) for i, t in docs for j, q in items if any(set(q.split()) <= set(t.split()[p : p + span]) for p in range(30))}
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want

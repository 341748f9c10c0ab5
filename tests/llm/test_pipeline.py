import re

import corpus_pipeline as p
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_minhash import brute as groups
from tidemark.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, vocabulary):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in p.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if stage is p.keep_one_of_each_group:
            # In doc_id order the first of each group stays.
            assert set(after) == {root for _, _, root in groups(sorted(before.items()), 5, 80)}
        elif stage is p.drop_contaminated:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {i for i, n, hit, _ in contamination(list(before.items()), items, 13) if hit and 20 * hit >= n}
            assert set(after) == set(before) - bad
        elif stage is p.hide_private:
            assert set(after) == set(before)
            assert all(after[i] == t for i, t in before.items() if "@" not in t and not any(c.isdigit() for c in t))
            valid = re.compile("|".join(f"(?:{pii.KINDS[k]})" for k in ("secret", "email")))
            private = {i: [m[0] for m in valid.finditer(t)] for i, t in before.items()}
            assert any(private.values()) and not any(v in after[i] for i, found in private.items() for v in found)
            assert all(r.n_chars == len(r.text) for r in docs.collect() if before[r.doc_id] != r.text)
    last = p.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(vocabulary)
    assert {r.doc_id: list(r.ids) for r in last} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in after.items()}
    assert all(r.round_trip for r in last)


def test_quality_leaves_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = p.keep_good(spark, docs, "/root/testdata/sf0.01")
    named = labels.join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").toPandas()
    clean = named[(named.quality == 1) & (named.toxic == 0)]
    assert clean.k.notna().mean() > 0.97
    assert named[(named.quality == 0) | (named.toxic == 1)].k.notna().mean() < 0.25


def test_odd_rows(spark, odd_docs, no_docs):
    for _, stage in p.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        found = stage(spark, odd_docs, SF)
        assert found.count() >= 5
    good = p.keep_good(spark, odd_docs, SF)
    assert good.schema["kept"].dataType.simpleString() == "bigint" and {(r.doc_id, r.kept) for r in good.collect()} <= {(r.doc_id, r.kept) for r in odd_docs.collect()}
    kept = p.keep_one_of_each_group(spark, odd_docs, SF)
    assert kept.columns == odd_docs.columns and kept.count() == 7  # the repeated row goes
    both = odd_docs.unionByName(odd_docs.filter("doc_id = 1").withColumn("text", F.lit("another text of that document")))
    assert p.keep_one_of_each_group(spark, both, SF).count() == 8  # what differs stays


def test_columns_of_any_name_pass_through(spark, odd_docs):
    docs = odd_docs.withColumns({n: F.lit(n) for n in ("_host", "_path", "good_prior", "_key", "_met", "_new", "_private", "_own_kept", "good")})
    for _, stage in p.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        assert all(r[n] == n for r in found.collect() for n in ("_host", "_path", "good_prior", "_key", "_met", "_new", "_private", "_own_kept", "good"))

"""A training corpus from raw documents, in stages. It belongs to tidemark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all but the
last return the columns of docs. Nulls, empty and very long texts, repeated rows and other columns are taken as each operator's
docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, minhash, pii, quality
from tidemark.llm.queries import PII_KEY, tokenizer_path
from tidemark.llm.shared import fresh, materialize, ship, table

#: Rows of one 64-bit key that are sent to all tasks; more are joined by a shuffle.
SENT_KEYS = 500_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: good and not toxic."""
    alike = [c for c in docs.columns if c in quality.OUTPUTS]  # columns that only share a name with the judge's
    own = dict(zip(alike, fresh(docs.columns, *(f"_own_{c}" for c in alike)), strict=True))
    judged = quality.judge(docs.withColumnsRenamed(own), table(spark, sf_dir, "labels"), text=True)
    return judged.filter("kept").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group: five-word shingles, Jaccard 0.8 or more. Rows without doc_id stay.

    Of rows that are alike in all columns one stays; rows of one doc_id that differ are one document, and all of them stay.
    """
    ship(spark)
    found = minhash.near_duplicates(docs, k=5, percent=80, rows=5, bands=48)
    kept = materialize(found.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "dedup-kept")
    rest = docs.join(kept.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    if kept.filter("n > 1").take(1):  # repeated rows
        rest = rest.distinct()
    return rest.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the rule of decontaminate.is_contaminated."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    (own,) = fresh(docs.columns, "_key")
    bad = materialize(found.filter(decontaminate.is_contaminated()).select(F.col("key").alias(own)).distinct(), "contaminated")
    if bad.count() <= SENT_KEYS:
        bad = F.broadcast(bad)
    return docs.join(bad, decontaminate.document_key() == F.col(own), "left_anti")


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values replaced by pseudonyms; n_chars follows the text."""
    (own,) = fresh(docs.columns, "_private")
    hidden = pii.pseudonymise(docs, PII_KEY, found=own)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.col(own) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return hidden.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with the number of them and whether they decode to the text."""
    ship(spark)
    found = bpe.bpe_encode(docs, tokenizer_path(), decoded="decoded")
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("PII", hide_private),
    ("BPE encoding and decoding", encode),
]
#: No SQL expresses a fitted classifier or byte-level merges; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

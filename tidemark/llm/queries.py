"""The queries of this package's operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codebooks, conversations, decontaminate, html_text, language, minhash, pii, quality, sharding, substrings, url_filter
from .oracles import OP5_ORACLE, OP7_ORACLE, OP10_ORACLE, OP11_ORACLE, OP12_ORACLE, OP13_ORACLE
from .shared import table, text_of

QUERIES = {}
#: The others have no SQL: fitted models, merges, approximate search, keyed permutations, packing.
ORACLES = {"op5_decontaminate": OP5_ORACLE, "op7_urls": OP7_ORACLE, "op10_near_duplicates": OP10_ORACLE, "op11_codebooks": OP11_ORACLE, "op12_conversations": OP12_ORACLE, "op13_substrings": OP13_ORACLE}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    found = bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    found = sharding.shard(docs, 40, "size", "text_hash", ["doc_id", "text_hash"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


@query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = language.learn(docs.filter(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "source", "lang", "good", "toxic", "kept")


#: Stands for the secret key that a user passes.
PII_KEY = "key-of-the-example-queries"


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", "n_private")


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, F.col("vec_id") % 20 == 0, k=20)


@query
def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, entries = codebooks.train(table(spark, sf_dir, "embeddings"))
    found = codebooks.with_label_error(codes)
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks.digest(entries)).alias("codebooks_sha256"))


@query
def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.turns_of(table(spark, sf_dir, "conversations"))
    conv_id = F.col("conv_id")
    head = F.crc32(conv_id.cast("string").cast("binary")) % 6
    return conversations.trie(conversations.with_shared_heads(turns, conv_id - conv_id % 100, head, 5))

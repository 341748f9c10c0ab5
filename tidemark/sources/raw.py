"""Raw responses: gzip JSON files with an index of runs or manifests beside them, and lists in CSV."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pick_first


def locations(runs: DataFrame, job_type: str, after_run_id: int | None = None) -> DataFrame:
    """(ingestion_run_id, location) of the successful runs of a job after a run id, in order."""
    rows = runs.filter((F.col("job_type") == job_type) & (F.col("status") == "succeeded") & F.col("raw_path").isNotNull())
    if after_run_id is not None:
        rows = rows.filter(F.col("ingestion_run_id") > after_run_id)
    return rows.select("ingestion_run_id", F.col("raw_path").alias("location")).orderBy("ingestion_run_id")


def pending(runs: DataFrame, base: str) -> DataFrame:
    """(ingestion_run_id, location) of runs whose raw file is not yet under the published base, in order."""
    rows = runs.filter(F.col("raw_path").isNotNull() & ~F.col("raw_path").startswith(base.rstrip("/") + "/"))
    return rows.select("ingestion_run_id", F.col("raw_path").alias("location")).orderBy("ingestion_run_id")


def without_lost(found: DataFrame) -> DataFrame:
    """Without local files that are gone; a path in a store stays, so that its absence is an error."""
    rows = [tuple(r) for r in found.collect() if "://" in r["location"] or os.path.exists(r["location"])]
    return found.sparkSession.createDataFrame(rows, found.schema)


def read_arrays(spark: SparkSession, found: DataFrame, schema: str) -> DataFrame:
    """The records of JSON array files, each with its file's run id.

    Paths are one for each file, so they go through the driver; the files are read by the executors. A file is the unit of work, as gzip cannot be
    split. A missing file raises.
    """
    rows = found.collect()
    if not rows:
        return spark.createDataFrame([], f"{schema}, ingestion_run_id bigint")
    paths = [r["location"] for r in rows]
    index = spark.createDataFrame([(_name(r["location"]), r["ingestion_run_id"]) for r in rows], "_name string, ingestion_run_id bigint")
    read = spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("_name", _name_column(F.col("_metadata.file_path")))
    return read.join(index, "_name").drop("_name")


def _name(path: str) -> str:
    """The path without its scheme, as stores write them differently."""
    return re.sub(r"^(?:[a-z0-9]+:)?/*", "", path)


def _name_column(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:[a-z0-9]+:)?/*", "")


def _inflated(files: DataFrame) -> DataFrame:
    """(_name, payload_json, _sha) of gzip files; Spark has no function that unpacks a column."""

    def run(batches):
        import gzip
        import hashlib

        for batch in batches:
            bodies = [gzip.decompress(b) for b in batch["content"]]
            yield batch[["_name"]].assign(payload_json=[b.decode("utf-8") for b in bodies], _sha=[hashlib.sha256(b).hexdigest() for b in bodies])

    return files.select(_name_column(F.col("path")).alias("_name"), "content").mapInPandas(run, "_name string, payload_json string, _sha string")


def read_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """Manifests under paths that name an endpoint. A file that is no JSON object, as an array of objects, raises."""
    schema = "run_id string, source string, endpoint string, unit_key string, snapshot_date date, request_url string, fetched_at timestamp, http_status int, record_count bigint, response_sha256 string, local_raw_path string, raw_uri string, status string"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(glob, wholetext=True)
    files = files.select("value", F.col("_metadata.file_path").alias("_path")).filter(F.contains("_path", F.lit("endpoint=")))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT<")), F.lit(False))
    checked = F.when(is_object, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no manifest: "), "_path")).cast("string"))
    return files.select(F.from_json(checked, schema).alias("m")).select("m.*")


def _bodies(rows: DataFrame, location: str) -> DataFrame:
    """The rows with the inflated files that they name, and no others; a file that is not there raises. One path for each file goes through the driver."""
    spark = rows.sparkSession
    named = rows.withColumn("_name", _name_column(F.col(location)))
    paths = [r[0] for r in rows.select(location).distinct().collect()]
    if not paths:
        return named.withColumns({"payload_json": F.lit(None).cast("string"), "_sha": F.lit(None).cast("string")})
    return named.join(_inflated(spark.read.format("binaryFile").load(paths)), "_name")


def responses(manifests: DataFrame, folder: str) -> DataFrame:
    """Successful manifests with their payload; a body whose hash is not the manifest's raises. Relative paths are of the folder."""
    path = F.col("local_raw_path")
    located = F.when(path.startswith("/") | F.contains(path, F.lit("://")), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
    rows = _bodies(manifests.filter("status = 'succeeded'").withColumn("_at", located), "_at")
    checked = F.when(F.col("_sha") == F.col("response_sha256"), F.col("payload_json")).otherwise(F.raise_error(F.concat(F.lit("hash differs: "), "_name")).cast("string"))
    key = F.concat_ws("/", "source", "endpoint", "unit_key", "response_sha256")
    return rows.withColumns({"payload_json": checked, "raw_object_key": key}).drop("_sha", "_name", "_at")


def responses_of_runs(runs: DataFrame, job_type: str, source: str, endpoint: str) -> DataFrame:
    """Successful runs as responses: the file's array under data, its hash, and the snapshot's day (else the fetch's, else the run's start)."""
    wanted = runs.filter((F.col("job_type") == job_type) & (F.col("status") == "succeeded") & F.col("raw_path").isNotNull())
    rows = _bodies(wanted, "raw_path")
    found = F.try_parse_json("payload_json")
    whole = F.coalesce(F.startswith(F.schema_of_variant(found), F.lit("ARRAY<OBJECT")) | (F.schema_of_variant(found) == "ARRAY<VOID>"), F.lit(False))
    array = F.when(whole, F.col("payload_json")).otherwise(F.raise_error(F.concat(F.lit("no array of objects: "), "_name")).cast("string"))
    moments = [F.col(c).cast("timestamp") for c in ("fetched_at", "finished_at", "started_at") if c in runs.columns]
    fetched = F.coalesce(*moments)
    return rows.select(
        F.concat_ws("/", F.lit(source), F.lit(endpoint), F.col("ingestion_run_id").cast("string")).alias("raw_object_key"),
        "ingestion_run_id",
        F.coalesce("snapshot_date", fetched.cast("date")).alias("snapshot_date"),
        fetched.alias("fetched_at"),
        F.col("_sha").alias("response_sha256"),
        F.col("raw_path").alias("raw_uri"),
        F.concat(F.lit('{"data":'), array, F.lit("}")).alias("payload_json"),
    )


def response_years(items: DataFrame, year: str = "fiscal_year") -> DataFrame:
    """Rows and first and last year of each response."""
    return items.groupBy("raw_object_key").agg(F.count(F.lit(1)).alias("record_count"), F.min(year).alias("min_fiscal_year"), F.max(year).alias("max_fiscal_year"))


def exploded(responses: DataFrame, array: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each item of a JSON array in the payload. fields: column to (path, type); what does not fit its type is null."""
    payloads = responses.withColumn("_v", F.parse_json("payload_json"))
    items = responses.sparkSession.sql(f"select p.*, t.value as _item from {{payloads}} p, lateral variant_explode(variant_get(_v, '$.{array}', 'variant')) t", payloads=payloads)
    return items.select(*responses.columns, *(F.try_variant_get("_item", path, kind).alias(c) for c, (path, kind) in fields.items()), F.to_json("_item").alias("_item_json")).withColumn("source_record_hash", F.sha2("_item_json", 256)).drop("_item_json")


def latest_disclosures(items: DataFrame) -> DataFrame:
    """One row for each code and disclosure number: of the latest run, then the latest fetch."""
    return pick_first(items, ["jpx_code", "disclosure_number"], [F.desc("ingestion_run_id"), F.col("fetched_at").desc_nulls_last()])


def read_codes(spark: SparkSession, path: str, industry: str | None = None) -> DataFrame:
    """The distinct codes of a CSV list with a header (UTF-8, with or without a mark), in order."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    lacking = {"jpx_code", "industry"} - set(rows.columns)
    if lacking:
        raise ValueError(f"the list lacks {', '.join(sorted(lacking))}")
    if industry is not None:
        rows = rows.filter(F.trim("industry") == industry)
    return rows.select(F.trim("jpx_code").alias("code")).filter("code <> ''").distinct().orderBy("code")

"""Publishing raw files: copies that never overwrite, paths that are moved only if nobody else did, and archives that say what is done."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import raw, sinks

#: The columns of a table of published paths.
PUBLISHED = "ingestion_run_id bigint, previous string, raw_path string"


def publish_pending(runs: DataFrame, folder: str, base: str, threads: int = 8) -> tuple[DataFrame, dict[str, int]]:
    """Copies the raw files that are not yet under `base` to it, by their place in `folder`. Gives (run, previous path, new path) and counts.

    Files that are gone are counted as missing. Work is one copy for each new file, some at once, and none is held in memory whole but one for each thread.
    """
    spark = runs.sparkSession
    found = raw.pending(runs, base).collect()
    root = folder.rstrip("/") + "/"

    def copy(row) -> tuple[int, str, str] | None:
        path = row["location"] if row["location"].startswith("/") or "://" in row["location"] else root + row["location"]
        body = sinks.read_bytes(spark, path)
        if body is None:
            return None
        if not path.startswith(root):
            raise ValueError(f"{path} is not under {folder}")
        target = f"{base.rstrip('/')}/{path[len(root) :]}"
        sinks.put_packed(spark, body, target)
        return row["ingestion_run_id"], row["location"], target

    with ThreadPoolExecutor(threads) as pool:
        moved = [m for m in pool.map(copy, found) if m]
    return spark.createDataFrame(moved, PUBLISHED), {"uploaded": len(moved), "missing": len(found) - len(moved)}


def moved_paths(runs: DataFrame, published: DataFrame) -> DataFrame:
    """The runs with their published paths. A run whose path is no longer the one that was published raises."""
    new = published.select("ingestion_run_id", "previous", F.col("raw_path").alias("_new"))
    rows = runs.join(new, "ingestion_run_id", "left")
    changed = F.raise_error(F.concat(F.lit("run changed while publishing: "), F.col("ingestion_run_id").cast("string"))).cast("string")
    path = F.when(F.col("_new").isNull(), F.col("raw_path")).when(F.col("raw_path").eqNullSafe(F.col("previous")), F.col("_new")).otherwise(changed)
    return rows.withColumn("raw_path", path).select(*runs.columns)


def store(spark: SparkSession, root: str, source: str, endpoint: str, unit: str, day: dt.date, body: bytes, **known) -> dict:
    """Puts a response into the archive, then its manifest: a unit is done when its manifest is there. known: more fields of the manifest."""
    digest = hashlib.sha256(body).hexdigest()
    path = f"{source}/{endpoint}/snapshot_date={day}/unit={unit}/response-{digest}.json.gz"
    sinks.put_bytes(spark, body, f"{root.rstrip('/')}/{path}")
    records = json.loads(body)
    records = records.get("data", records) if isinstance(records, dict) else records
    years = [r["fiscal_year"] for r in records if isinstance(r, dict) and isinstance(r.get("fiscal_year"), int)] if isinstance(records, list) else []
    manifest = {
        "source": source, "endpoint": endpoint, "unit_key": unit, "snapshot_date": str(day), "record_count": len(records) if isinstance(records, list) else 1,
        "min_fiscal_year": min(years, default=None), "max_fiscal_year": max(years, default=None), "response_sha256": digest, "status": "succeeded", "local_raw_path": path,
    } | known
    sinks.put_plain(spark, json.dumps(manifest, ensure_ascii=False, indent=2).encode(), f"{root.rstrip('/')}/{source}/manifests/snapshot_date={day}/endpoint={endpoint}/unit={unit}.json")
    return manifest


def remaining(units: DataFrame, manifests: DataFrame) -> DataFrame:
    """The units (endpoint, unit_key, snapshot_date) that no successful manifest names: where a run that stopped goes on."""
    done = manifests.filter("status = 'succeeded'").select("endpoint", "unit_key", "snapshot_date").distinct()
    return units.join(done, ["endpoint", "unit_key", "snapshot_date"], "left_anti")

"""The incremental build as a file stream: each batch of new raw files is merged into the parts of the dataset that it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import keep_last


def follow(spark: SparkSession, raw: str, schema: str, build: Callable[[DataFrame], DataFrame], keys: Sequence[str], part: Column, dataset: str, checkpoint: str) -> StreamingQuery:
    """Reads what is new under `raw`, builds rows and writes the parts (as years) that they touch anew, under dataset/rows/batch=N/part=P.

    A key's rows must be of one part. Then dataset/commits/batch=N names the parts, and only what is named counts: a batch that fails halfway
    leaves nothing to be seen, and one that is run again writes the same folders over the state before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        fresh = rows = build(batch).withColumn("part", part.cast("string")).persist()
        touched = [r.part for r in rows.select("part").distinct().collect()]  # one row for each part
        old = _committed(spark, dataset, number)
        kept = {p: n for p, n in old.items() if p in touched}
        if kept:
            rows = _read(spark, dataset, kept).unionByName(rows)
        keep_last(rows, keys).write.mode("overwrite").partitionBy("part").parquet(f"{dataset}/rows/batch={number}")
        spark.createDataFrame([(p,) for p in touched], "part string").coalesce(1).write.mode("overwrite").parquet(f"{dataset}/commits/batch={number}")
        fresh.unpersist()

    stream = spark.readStream.schema(schema).option("multiLine", True).json(raw)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _committed(spark: SparkSession, dataset: str, before: int | None = None) -> dict[str | None, int]:
    """The latest committed batch of each part."""
    try:
        rows = spark.read.schema("part string, batch long").parquet(f"{dataset}/commits")
    except AnalysisException:  # nothing is there yet
        return {}
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return {r.part: r.batch for r in rows.groupBy("part").agg(F.max("batch").alias("batch")).collect()}


def _read(spark: SparkSession, dataset: str, batches: dict[str | None, int]) -> DataFrame:
    """The parts of these batches; both are partition columns, so no other file is read."""
    rows = spark.read.option("basePath", f"{dataset}/rows").option("mergeSchema", False).parquet(*(f"{dataset}/rows/batch={n}" for n in sorted(set(batches.values()))))
    rows = rows.withColumn("part", F.col("part").cast("string"))
    wanted = [(F.col("batch") == n) & F.col("part").eqNullSafe(p) for p, n in batches.items()]
    return rows.filter(reduce(lambda a, b: a | b, wanted)).drop("batch")


def current(spark: SparkSession, dataset: str) -> DataFrame:
    """The dataset as of the last commit."""
    found = _committed(spark, dataset)
    if not found:
        raise ValueError(f"nothing is committed under {dataset}")
    return _read(spark, dataset, found).drop("part")

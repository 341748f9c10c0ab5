"""The last row of each key as a stream: the state store holds it, so no batch reads again what was written.

A key's row is the greatest by run, then by its other columns, as in ingest.keep_last: a maximum, which does not depend on the order in which
rows arrive or on how they are cut into batches, and which a late correction moves at any time. Each batch writes the keys whose row it
changed; the state is as large as the number of keys and lies with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import pick_first


def latest(rows: DataFrame, keys: Sequence[str], run: str = "ingestion_run_id") -> DataFrame:
    """The last row of each key; of a stream, to be written in update mode."""
    rest = [c for c in rows.columns if c not in keys and c != run]
    last = rows.groupBy(*keys).agg(F.max(F.struct(run, *rest)).alias("_last"))
    return last.select(*keys, "_last.*").select(*rows.columns)


def follow_latest(rows: DataFrame, keys: Sequence[str], dataset: str, checkpoint: str, run: str = "ingestion_run_id") -> StreamingQuery:
    """Writes each batch's changed rows under dataset/batch=N. A batch that is run again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dataset}/batch={number}")

    return latest(rows, keys, run).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, dataset: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The last row of each key as of the last batch that was written."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(dataset)
    return pick_first(rows, keys, [F.desc("batch")]).drop("batch")

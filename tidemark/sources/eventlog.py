"""The log of rule events: rows are added and never changed, dealt into buckets by their keys once, when they are written.

Whether an event is new is a join of its keys with the log's. The log is read in its buckets, so it is not dealt again for a run; only the
run's own events are. Two runs at once may both add an event: both write it, and events() gives the first of a key, again bucket by bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import suppress
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pick_first

KEYS = ("rule_id", "event_key", "mode")


@dataclass(frozen=True)
class EventLog:
    """table: a name in the session's catalog; path: where its files are, of this and of earlier sessions. schema has the keys."""

    spark: SparkSession
    table: str
    path: str
    schema: str
    keys: Sequence[str] = KEYS
    buckets: int = 64

    def create(self) -> EventLog:
        """Binds the table to its files, new or old. Each run has a folder of its own, so runs at once do not meet in one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        columns = f"{self.schema}, added_at timestamp, added_by string"
        self.spark.sql(f"create table if not exists {self.table} ({columns}) using parquet partitioned by (added_by) clustered by ({', '.join(self.keys)}) into {self.buckets} buckets location '{self.path}'")
        self.refresh()
        return self

    def refresh(self) -> None:
        """Sees what other sessions have added. A catalog that keeps lists of partitions is told of new ones; others look at the folder."""
        with suppress(AnalysisException):
            self.spark.catalog.recoverPartitions(self.table)
        self.spark.catalog.refreshTable(self.table)

    def rows(self) -> DataFrame:
        """All that was ever added."""
        return self.spark.table(self.table)

    def events(self) -> DataFrame:
        """Each event once, as it was added first."""
        return pick_first(self.rows(), self.keys, [F.asc("added_at"), F.asc("added_by")]).drop("added_at", "added_by")

    def lacking(self, found: DataFrame) -> DataFrame:
        """Those of the found events that the log does not have, each once."""
        known = self.rows().select(*(F.col(k).alias(f"_{k}") for k in self.keys)).hint("merge")
        same = F.lit(True)
        for k in self.keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        dealt = found.repartition(self.buckets, *self.keys)  # as the log is
        return pick_first(dealt, self.keys, [F.col(c).asc_nulls_first() for c in found.columns if c not in self.keys]).join(known, same, "left_anti")

    def add(self, found: DataFrame, run: str) -> None:
        """Adds what is lacking. A key with a null part is of no event and is not added."""
        whole = F.lit(True)
        for k in self.keys:
            whole = whole & F.col(k).isNotNull()
        fresh = self.lacking(found.filter(whole)).withColumn("added_at", F.current_timestamp())
        own = uuid.uuid4().hex
        # There are as many tasks as buckets, each of one, so a run adds one file to a bucket.
        fresh.write.format("parquet").bucketBy(self.buckets, *self.keys).option("path", f"{self.path.rstrip('/')}/added_by={run}-{own}").saveAsTable(f"added_{own}")
        self.spark.sql(f"drop table added_{own}")  # the name only; the files are the log's
        self.refresh()

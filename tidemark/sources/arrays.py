"""JSON arrays of objects in gzip files, item by item.

Spark inflates a file as a stream and hands it on in pieces that end at a closing brace; a task puts the pieces of an item together again
and hashes the file as it goes by. So neither a file nor a list of paths is ever whole in a task or in the driver: a file's items are
rows, of which a task holds one batch. A gzip file cannot be split and is the unit of work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "file string, position bigint, item string, sha256 string"
_SPECIAL = re.compile(r'["\\{}\[\]]')
_BETWEEN = re.compile(r"[\s,]*\Z")


class Splitter:
    """Cuts a JSON array into its objects. A text may be fed in pieces, cut at any place but between a backslash and what it escapes."""

    def __init__(self):
        self.depth, self.quoted, self.held, self.done = 0, False, [], False

    def feed(self, text: str) -> Iterator[str]:
        start, skip = 0, -1  # where what is not yet taken begins, and an escaped place
        for m in _SPECIAL.finditer(text):
            at, c = m.start(), m[0]
            if at == skip:
                continue
            if self.quoted:
                if c == "\\":
                    skip = at + 1
                elif c == '"':
                    self.quoted = False
                continue
            if c == '"':
                self.quoted = True
                if self.depth < 2:
                    raise ValueError("no array of objects")
            elif c in "{[":
                if self.depth < 2:
                    self._outside(text[start:at])
                    if self.done or c != "[{"[self.depth]:
                        raise ValueError("no array of objects")
                    start = at
                self.depth += 1
            elif c in "}]":
                self.depth -= 1
                if self.depth == 1:
                    self.held.append(text[start : at + 1])
                    yield "".join(self.held)
                    self.held, start = [], at + 1
                elif self.depth <= 0:
                    if self.depth < 0 or c != "]":
                        raise ValueError("no array of objects")
                    self._outside(text[start:at])
                    self.done, start = True, at + 1
            if self.depth == 1 and c == "[":
                start = at + 1
        if self.depth > 1:
            self.held.append(text[start:])
        else:
            self._outside(text[start:])

    def _outside(self, text: str) -> None:
        """Between items there is white space and commas only."""
        if not _BETWEEN.match(text):
            raise ValueError("no array of objects")

    def close(self) -> None:
        if not self.done:
            raise ValueError("no whole array")


def items(spark: SparkSession, folder: str, glob: str = "*.gz") -> DataFrame:
    """(file, position, item, sha256) of all files under a folder: their items in order, and for each file a last row with the number of its
    items as its position, a null item and the hash of the inflated file. What is no array of objects raises.
    """
    pieces = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, splitter, sha, n, last = None, None, None, 0, ""
        out: list[tuple] = []

        def take(text: str) -> None:
            nonlocal n
            sha.update(text.encode())
            try:
                for item in splitter.feed(text):
                    out.append((file, n, item, None))
                    n += 1
            except ValueError as e:
                raise ValueError(f"{e}: {file}") from e

        def end() -> None:
            take(last)
            try:
                splitter.close()
            except ValueError as e:
                raise ValueError(f"{e}: {file}") from e
            out.append((file, n, None, sha.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "position", "item", "sha256"])
            out.clear()
            return made

        for batch in batches:
            for path, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if path != file:
                    if file is not None:
                        end()
                    file, splitter, sha, n = path, Splitter(), hashlib.sha256(), 0
                else:
                    take(last + "}")
                last = value
            yield batch_of()
        if file is not None:
            end()
        yield batch_of()

    return pieces.select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, ITEM)


def place(path: Column) -> Column:
    """A path without its scheme, as stores write them differently."""
    return F.regexp_replace(path, r"^(?:[a-z0-9]+:)?/*", "")


def records(spark: SparkSession, found: DataFrame, folder: str, schema: str) -> DataFrame:
    """The records of the files that `found` (ingestion_run_id, location) names under a folder, each with its run. A file that is not there raises.

    Files and runs meet by a join on the path, so the list of files stays distributed.
    """
    lost = F.raise_error(F.concat(F.lit("no such file: "), "location")).cast("bigint")
    runs = found.withColumn("_place", place(F.col("location"))).join(listed(spark, folder), "_place", "left").select("_place", F.when(F.col("_there").isNull(), lost).otherwise(F.col("ingestion_run_id")).alias("ingestion_run_id"))
    rows = items(spark, folder).filter("item is not null").withColumn("_place", place(F.col("file")))
    joined = rows.join(runs.filter("ingestion_run_id is not null"), "_place")
    return joined.select(F.from_json("item", schema).alias("_r"), "ingestion_run_id").select("_r.*", "ingestion_run_id")


def listed(spark: SparkSession, folder: str, glob: str = "*.gz") -> DataFrame:
    """(_place, _there) of the files under a folder, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(place(F.col("path")).alias("_place"), F.lit(True).alias("_there"))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """The items of the files that (location, sha256) names. A file of another hash, or one that is not there, raises; a hash of null takes any.

    found: as items() gives it, better materialized, as its items and its last rows are read apart.
    """
    ends = found.filter("item is null").select(place(F.col("file")).alias("_place"), F.col("sha256").alias("_is"))
    wanted = expected.select(place(F.col("location")).alias("_place"), "location", F.col("sha256").alias("_want"))
    wrong = F.raise_error(F.concat(F.lit("hash differs or no file: "), "location")).cast("string")
    same = F.col("_is").isNotNull() & (F.col("_want").isNull() | (F.col("_is") == F.col("_want")))
    good = wanted.join(ends, "_place", "left").select(F.when(F.coalesce(same, F.lit(False)), F.col("_place")).otherwise(wrong).alias("_good"))
    rows = found.filter("item is not null").withColumn("_place", place(F.col("file")))
    return rows.join(good.filter("_good is not null"), F.col("_place") == F.col("_good"), "left_semi").select("file", "position", "item")

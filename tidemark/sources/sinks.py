"""Writing the lake, and raw files that never change."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_year(df: DataFrame, path: str, day: str, sort: Sequence[str] = ("security_key",), rows_per_file: int = 5_000_000) -> None:
    """Zstd Parquet by year, dealt by ranges of year, key and day: a year has as many tasks as its share of the rows, each file a range of keys for pruning.

    The number of ranges is the session's spark.sql.shuffle.partitions. Overwrites the whole dataset: a year that is no longer there goes.
    """
    order = ["year", *sort, day]
    rows = df.withColumn("year", F.year(day)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("year").parquet(path)


def write_reference(df: DataFrame, path: str) -> None:
    """A small dataset as one file."""
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_version(df: DataFrame, path: str, version: str) -> str:
    """A new folder for each version; readers are pointed to it when it is whole."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def put_raw(spark: SparkSession, records: list, path: str) -> str:
    """Writes one response as gzip JSON and gives its hash. An equal one that is there is success, another one an error."""
    return put_bytes(spark, json.dumps(records, ensure_ascii=False, separators=(",", ":")).encode(), path)


def put_bytes(spark: SparkSession, body: bytes, path: str) -> str:
    """Writes a body as gzip and gives its hash. An equal one that is there is success, another one an error."""
    put_packed(spark, gzip.compress(body, mtime=0), path)
    return hashlib.sha256(body).hexdigest()


def put_packed(spark: SparkSession, packed: bytes, path: str) -> None:
    """Writes a gzip file as it is; what is there already is compared by what it holds."""
    if gzip.decompress(put_plain(spark, packed, path, compare=False)) != gzip.decompress(packed):
        raise ValueError(f"{path} holds another response")


def put_new(spark: SparkSession, content: bytes, path: str) -> bool:
    """Creates a whole file, or gives False if there is one: of several writers exactly one creates it, and no reader sees a part of it.

    A local disk links a finished file to the name, a file system with renames moves one there without overwriting, and any other store
    is asked to create without overwriting, which it decides when the file is closed.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        return False
    scheme = fs.getUri().getScheme()
    if scheme not in ("file", "hdfs", "viewfs", "webhdfs"):
        return _created(lambda: _fill(fs.createFile(target).overwrite(False).recursive().build(), content))
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    _fill(fs.create(part, False), content)
    try:
        if scheme == "file":
            at = jvm.java.nio.file.Paths
            place = lambda p: at.get(fs.makeQualified(p).toUri())
            return _created(lambda: jvm.java.nio.file.Files.createLink(place(target), place(part)))
        none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        return _created(lambda: jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), none))
    finally:
        fs.delete(part, False)


def _fill(out, content: bytes) -> None:
    out.write(bytearray(content))
    out.close()


def _created(f) -> bool:
    """Whether f went through; False if a file was there."""
    try:
        f()
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def put_plain(spark: SparkSession, content: bytes, path: str, compare: bool = True) -> bytes:
    """Writes a file that is not there yet and gives what then stands there, so of several writers only those of an equal content succeed."""
    put_new(spark, content, path)
    there = read_bytes(spark, path)
    if there is None:
        raise OSError(f"{path} could not be put in place")
    if compare and there != content:
        raise ValueError(f"{path} holds another content")
    return there


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """One file's content; None if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def raw_path(root: str, source: str, job: str, day, run_id: int) -> str:
    return f"{root.rstrip('/')}/{source}/{job}/{day:%Y/%m/%d}/run-{run_id}.json.gz"

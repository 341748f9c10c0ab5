"""A dataset as immutable parts and numbered snapshots that name them.

    root/parts/<build>/part_source=S/part_year=Y/   rows of one source and year, never changed
    root/snapshots/0000000007.json                  parts, watermarks and counts as of the seventh commit

Readers resolve the highest snapshot. A commit creates the next number without overwriting, so of two builds on one snapshot one has to
look again: if the other left its sources and jobs alone, it commits its parts onto the new snapshot, else it merges anew. Until the snapshot is
there nothing of a build can be seen, so one that is stopped at any step loses nothing. vacuum() removes what no snapshot names any more.
A snapshot has a row for each source and year: a few hundred at most.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import keep_last
from . import sinks

Part = tuple[str, str]
#: How often a build begins again because others committed to its sources meanwhile.
ATTEMPTS = 20


@dataclass(frozen=True)
class Snapshot:
    """number: 0 is the empty dataset. parts: folder of each (source, year), under the root. watermarks: highest run taken in, by job."""

    number: int = 0
    parts: Mapping[Part, str] = field(default_factory=dict)
    watermarks: Mapping[str, int] = field(default_factory=dict)

    def text(self) -> bytes:
        parts = [{"source": s, "year": y, "path": p} for (s, y), p in sorted(self.parts.items())]
        return json.dumps({"number": self.number, "watermarks": dict(sorted(self.watermarks.items())), "parts": parts}).encode()

    @staticmethod
    def of(text: bytes) -> Snapshot:
        x = json.loads(text)
        return Snapshot(x["number"], {(p["source"], p["year"]): p["path"] for p in x["parts"]}, x["watermarks"])

    def part_of(self, sources, jobs) -> tuple:
        """What a build of these sources by these jobs rests on."""
        return {k: v for k, v in self.parts.items() if k[0] in sources}, {j: self.watermarks.get(j) for j in jobs}


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    root: str
    keys: Sequence[str]
    day: str = "obs_date"
    source: str = "source_key"
    sort: Sequence[str] = ("security_key",)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{path}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, fs = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("snapshots") if n.endswith(".json") and n[:-5].isdigit())

    def at(self, number: int) -> Snapshot:
        found = sinks.read_bytes(self.spark, f"{self.root.rstrip('/')}/snapshots/{number:010d}.json")
        if found is None:
            raise KeyError(f"no snapshot {number} under {self.root}")
        return Snapshot.of(found)

    def head(self) -> Snapshot:
        """The last commit; the empty dataset if there is none."""
        found = self.numbers()
        return self.at(found[-1]) if found else Snapshot()

    def read(self, schema: str, snapshot: Snapshot | None = None, sources: Sequence[str] | None = None, years: Sequence[str] | None = None) -> DataFrame:
        """The rows of a snapshot, the last one by default; of some sources or years only their parts are opened."""
        snapshot = snapshot or self.head()
        paths = [f"{self.root.rstrip('/')}/{p}" for (s, y), p in sorted(snapshot.parts.items()) if (sources is None or s in sources) and (years is None or y in years)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, name: str) -> dict[Part, str]:
        """New parts; what was written is listed, not read. Ranges of source, year and key: a year has as many tasks as its share of the rows."""
        order = ["part_source", "part_year", *self.sort, self.day]
        dealt = rows.withColumns({"part_source": F.col(self.source), "part_year": F.coalesce(F.year(self.day).cast("string"), F.lit("none"))}).repartitionByRange(*order).sortWithinPartitions(*order)
        dealt.write.mode("errorifexists").option("compression", "zstd").partitionBy("part_source", "part_year").parquet(f"{self.root.rstrip('/')}/parts/{name}")
        found = {}
        for source in (n for n in self._names(f"parts/{name}") if n.startswith("part_source=")):
            for year in (n for n in self._names(f"parts/{name}/{source}") if n.startswith("part_year=")):
                found[unquote(source.partition("=")[2]), year.partition("=")[2]] = f"parts/{name}/{source}/{year}"
        return found

    def commit(self, base: Snapshot, parts: Mapping[Part, str], watermarks: Mapping[str, int]) -> Snapshot | None:
        """The snapshot after `base`, or None if somebody else made it."""
        new = Snapshot(base.number + 1, parts, watermarks)
        return new if sinks.put_new(self.spark, new.text(), f"{self.root.rstrip('/')}/snapshots/{new.number:010d}.json") else None

    def build(self, sources: Sequence[str], schema: str, fresh: Callable[[Snapshot], tuple[DataFrame, Mapping[str, int]] | None], full: bool = False) -> Snapshot | None:
        """Merges what `fresh` gives for a snapshot: rows of `sources`, with the highest run of each job; None if there is nothing new.

        Only the parts that have new rows are merged and written; `full` replaces all parts of the sources. Parts of other sources stay
        as they are, and a new part without an older one is not written twice.
        """
        for _ in range(ATTEMPTS):
            base = self.head()
            if (given := fresh(base)) is None:
                return None
            rows, runs = given
            build = uuid.uuid4().hex
            parts = self.write(rows, build)
            if not full and (touched := sorted(k for k in parts if k in base.parts)):
                old, new = ([f"{self.root.rstrip('/')}/{x[k]}" for k in touched] for x in (base.parts, parts))
                both = self.spark.read.schema(schema).parquet(*old, *new)
                parts |= self.write(keep_last(both, self.keys), f"{build}-merged")
            watermarks = {j: max(n, base.watermarks.get(j, n)) for j, n in runs.items()}
            rests_on = base.part_of(sources, runs)
            while base.part_of(sources, runs) == rests_on:  # others' commits to other sources are taken along
                kept = {k: p for k, p in base.parts.items() if not (full and k[0] in sources)}
                if done := self.commit(base, kept | parts, dict(base.watermarks) | watermarks):
                    return done
                base = self.head()
        raise RuntimeError(f"others kept committing to {', '.join(sources)} under {self.root}")

    def vacuum(self, older_than_s: float = 7 * 24 * 3600) -> list[str]:
        """Removes snapshots of that age but the last, then builds of that age of which no snapshot that is left names a part."""
        before = (time.time() - older_than_s) * 1000
        numbers = self.numbers()
        for n in numbers[:-1]:
            path, fs = self._fs(f"snapshots/{n:010d}.json")
            if fs.getFileStatus(path).getModificationTime() < before:
                fs.delete(path, False)
        named = {p.split("/")[1] for n in self.numbers() for p in self.at(n).parts.values()}
        gone = []
        for name in self._names("parts"):
            path, fs = self._fs(f"parts/{name}")
            if name not in named and fs.getFileStatus(path).getModificationTime() < before:
                fs.delete(path, True)
                gone.append(name)
        return gone

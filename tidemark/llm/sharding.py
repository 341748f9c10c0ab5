"""Indivisible groups into shards of nearly equal bytes, or of a fixed capacity, by best-fit-decreasing bin packing.

Every group (equal texts here) is an item of its own: sorted by size, each enters the bin whose free room is the tightest that
holds it, found in a balanced tree. Groups of one size are alike, so the driver packs how many groups there are of each size, and
a bin takes as many of them in a row as best fit would give it one by one. A size is a number of bytes of BITS significant binary
digits, rounded up: exact below 2^BITS, 1/8,192 too large at most beyond, so there are some 100,000 sizes for groups of up to 16 MB
and 350,000 whatever the input. The numbers say which groups go where: the groups of a size are numbered, and each bin owns a range of numbers.

shards given: the least capacity for which the shards suffice is found by bisection; a group larger than an equal share has a shard
to itself, and the rest is packed over the other shards. capacity given: as few shards of it as best fit finds; a larger group is
alone.

Cases: a null text counts as empty; equal texts share a shard; repeated rows get slots of their own; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import materialize

BITS = 14
#: A group of more than one row in HOT is joined by being sent to all tasks; there are fewer than HOT of them.
HOT = 4_096
#: Rows that are numbered in one task.
RUN = 20_000


class FreeRoom:
    """Bins by their free room: a balanced tree of two levels, sorted chunks that split when they are full."""

    CHUNK = 64

    def __init__(self):
        self.chunks: list[list[tuple[int, int]]] = [[]]

    def add(self, room: int, bin_: int) -> None:
        at = self._chunk((room, bin_))
        bisect.insort(self.chunks[at], (room, bin_))
        if len(self.chunks[at]) > self.CHUNK:
            half = self.chunks[at][self.CHUNK // 2 :]
            del self.chunks[at][self.CHUNK // 2 :]
            self.chunks.insert(at + 1, half)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes the bin with the least free room of those with `least` or more."""
        at = self._chunk((least, -1))
        for i in (at, at + 1):
            if i < len(self.chunks) and (j := bisect.bisect_left(self.chunks[i], (least, -1))) < len(self.chunks[i]):
                found = self.chunks[i].pop(j)
                if not self.chunks[i] and len(self.chunks) > 1:
                    del self.chunks[i]
                return found
        return None

    def _chunk(self, key: tuple[int, int]) -> int:
        lo, hi = 0, len(self.chunks) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.chunks[mid][0] <= key:
                lo = mid
            else:
                hi = mid - 1
        return lo


#: (size, shard, first, last): the groups of that size numbered first to last - 1 go into that shard.
Range = tuple[int, int, int, int]


def best_fit_decreasing(counts: list[tuple[int, int]], capacity: int) -> list[Range]:
    """Bins from 0 on. counts: (size, how many), sizes in descending order; as few bins of that capacity as best fit finds."""
    room, bins, out = FreeRoom(), 0, []
    for size, n in counts:
        done = 0
        while done < n:
            found = room.take(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            free, bin_ = found
            # The bin stays the tightest that holds this size until it no longer does.
            more = min(n - done, free // size) if size else n - done
            out.append((size, bin_, done, done + more))
            done += more
            room.add(free - more * size, bin_)
    return out


def pack(counts: list[tuple[int, int]], shards: int) -> list[Range]:
    """The least capacity for which best fit decreasing needs no more than `shards` bins."""
    left = sorted(counts, reverse=True)
    out: list[Range] = []
    total, used, taken = sum(s * n for s, n in left), 0, 0
    while left and used < shards - 1 and left[0][0] * (shards - used) > total:  # larger than an equal share of what is left
        size, n = left[0]
        out.append((size, used, taken, taken + 1))
        total, used, taken = total - size, used + 1, taken + 1
        if n == 1:
            left, taken = left[1:], 0
        else:
            left[0] = (size, n - 1)
    begun = (left[0][0], taken) if left and taken else (None, 0)  # numbers of this size that are placed already
    bins = shards - used
    lo = max([-(-total // bins), *(s for s, _ in left[:1])])
    hi = 2 * lo
    while lo < hi:
        mid = (lo + hi) // 2
        if max((r[1] for r in best_fit_decreasing(left, mid)), default=0) < bins:
            hi = mid
        else:
            lo = mid + 1
    more = [(s, used + b, f, l) for s, b, f, l in best_fit_decreasing(left, hi)]
    return out + [(s, b, f + begun[1], l + begun[1]) if s == begun[0] else (s, b, f, l) for s, b, f, l in more]


def size_class(n: Column) -> Column:
    """n rounded up to BITS significant binary digits."""
    unit = F.pow(F.lit(2), F.greatest(F.length(F.conv(n.cast("string"), 10, 2)) - BITS, F.lit(0))).cast("long")
    return (F.ceil(n / unit) * unit).cast("long")


def _numbered(rows: DataFrame, within: str, order: list[str], name: str) -> DataFrame:
    """Adds a gapless number from 0 within each value of a column. Rows are numbered in runs, a hash of `order`, and each run begins
    where the one before ends, so a value that most rows have is no single task."""
    runs = max(1, rows.count() // RUN)
    rows = rows.withColumn("_run", F.pmod(F.xxhash64(*order), F.lit(runs)))
    counted = rows.groupBy("_run", within).agg(F.count(F.lit(1)).alias("_n"))
    before = counted.withColumn("_before", F.sum("_n").over(W.partitionBy(within).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("_run", within, F.coalesce("_before", F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("_run", within).orderBy(*order)).cast("long") - 1
    return rows.withColumn(name, number).join(before, ["_run", within]).withColumn(name, F.col(name) + F.col("_before")).drop("_run", "_before")


def shard(df: DataFrame, shards: int | None, size: str, group: str, order: list[str], capacity: int | None = None) -> DataFrame:
    """Adds shard (from 0) and slot (gapless from 0 within each).

    size: a bigint column. group: a bigint column; rows of equal value stay together. order: columns that number the rows.
    Either shards or capacity (bytes) says how many shards there are.
    """
    spark = df.sparkSession
    rows = materialize(df, "shard-rows")  # narrow rows, which are read several times
    groups = rows.groupBy(group).agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    groups = materialize(groups.withColumn("_class", size_class(F.col("_bytes"))), "shard-groups")
    counts = sorted(((r[0], r[1]) for r in groups.groupBy("_class").agg(F.count(F.lit(1))).collect()), reverse=True)  # one for each size
    ranges = pack(counts, shards) if capacity is None else best_fit_decreasing(counts, capacity)
    placed = spark.createDataFrame(ranges, "_class long, shard int, _first long, _last long")  # about one for each size or bin
    numbered = _numbered(groups, "_class", [group], "_number")
    mine = (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_last"))
    owned = numbered.withColumnRenamed("_class", "_own").join(F.broadcast(placed), (F.col("_own") == F.col("_class")) & mine)
    owned = materialize(owned.select(group, "_rows", "shard"), "shard-owned")
    hot = owned.filter(F.col("_rows") * HOT > rows.count()).select(group, F.col("shard").alias("_hot"))  # fewer than HOT
    met = rows.join(F.broadcast(hot), group, "left")
    columns = [*df.columns, "shard"]
    rest = met.filter("_hot is null").join(owned.select(group, "shard"), group)
    rows = met.filter("_hot is not null").withColumn("shard", F.col("_hot")).select(*columns).unionByName(rest.select(*columns))
    return _numbered(materialize(rows, "shard-placed"), "shard", order, "slot")

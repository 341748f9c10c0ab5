"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def security_key() -> Column:
    """A security is named by its exchange code, else by its ticker."""
    return F.coalesce("jpx_code", "target_key")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null if b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pick_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order. row_number with a limit is cut down before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def join_few(rows: DataFrame, few: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Inner join on keys that have few values, as rules and metrics, where a value's rows would all be one task's: they are dealt by a hash of `by`
    too, into as many shares as a shuffle has partitions. Each of the few stands once for each share."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*by), F.lit(n)))
    each = few.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return dealt.join(each, [*keys, "_share"]).drop("_share")


def any_present(columns: Sequence[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNotNull()
    return found


def valid_on(day: Column, start: str | Column, end: str | Column, inclusive_end: bool = False) -> Column:
    """Whether [start, end) holds at a day; an open end is null. inclusive_end: [start, end]."""
    end = F.col(end) if isinstance(end, str) else end
    start = F.col(start) if isinstance(start, str) else start
    return (start <= day) & (end.isNull() | (end >= day if inclusive_end else end > day))


def exact_decimal(c: Column) -> Column:
    """A double by its shortest decimal form, so that comparing with a decimal limit is exact; null if that has no such form, being
    10^23 or more, or with digits beyond the fifteenth decimal place."""
    found = c.cast("string").try_cast("decimal(38,15)")
    return F.when(found.cast("double") == c, found)


def tokyo_date(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "Asia/Tokyo").cast("date")


def next_year(day: Column) -> Column:
    return F.add_months(day, 12)

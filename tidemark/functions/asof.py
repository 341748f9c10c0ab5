"""As-of join: each left row with the latest right row before it. Spark SQL has no public operator for it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, take: Sequence[str], inclusive: bool = False, part: Callable[[Column], Column] = scan.year_of
) -> DataFrame:
    """All left rows with the columns `take` of the last right row of the same key whose right_on is before left_on (or equal, if inclusive).

    Both sides are united, dealt by key and part of the order (years of dates), and the last right row is carried forward within a part
    and from part to part, so the work is linear and no key is one task's. part: gives the part of left_on's and right_on's values; it
    must not fall where they rise. For other types than dates pass one, as a fraction of the number or a constant.
    take is a struct on the way: a matched row whose own columns are null stays matched. Rows without a key or a left_on
    keep nulls. right must have one row for each key and right_on; if not, the last in arrival order counts.
    """
    mine, side = left.columns, F.lit(1 if inclusive else 0)
    payload = F.struct(*(F.col(c) for c in take))
    keyed = left.filter(F.col(key).isNotNull())
    # The left's columns stay columns, so those that nobody reads are not carried.
    own = {c: f"_l_{i}" for i, c in enumerate(mine)}
    rows = keyed.select(F.col(key).alias("_k"), F.col(left_on).alias("_t"), side.alias("_side"), F.lit(True).alias("_mine"), *(F.col(c).alias(n) for c, n in own.items()), F.lit(None).alias("_r"))
    marks = right.filter(F.col(key).isNotNull() & F.col(right_on).isNotNull())
    marks = marks.select(F.col(key).alias("_k"), F.col(right_on).alias("_t"), (1 - side).alias("_side"), F.lit(False).alias("_mine"), *(F.lit(None).alias(n) for n in own.values()), payload.alias("_r"))
    both = rows.unionByName(marks)
    both = both.withColumn("_part", part(F.col("_t")))
    joined = scan.running(both, "_k", "_part", [F.col("_t"), F.col("_side")], {"_last": ("last", F.col("_r"))}).filter("_mine")
    joined = joined.select(*(F.col(n).alias(c) for c, n in own.items()), *(F.col("_last")[c].alias(c) for c in take))
    bare = left.filter(F.col(key).isNull())
    return joined.unionByName(bare.select(*mine, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take)))

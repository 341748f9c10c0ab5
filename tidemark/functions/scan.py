"""Running values in two levels, so that a key's whole history is never one task's.

A key's rows are cut into parts of its order, as years. Windows run within (key, part); what each part adds is summed up by a grouped
aggregation, a row for each (key, part), and one small window over these rows gives every part what came before it. Rows meet that again
by (key, part), as which they are dealt already.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Stands for the year of a null day, which comes first.
BEFORE_ALL = -1_000_000


def year_of(day: Column) -> Column:
    return F.coalesce(F.year(day), F.lit(BEFORE_ALL))


def running(rows: DataFrame, key: str, part: str, order: Sequence[Column], wanted: Mapping[str, tuple[str, Column]], split: bool = True) -> DataFrame:
    """Adds to each row running values up to it, in the order of `order` (nulls first) within a key.

    part: a column that never falls in that order. wanted: by name, ("sum" | "min" | "last", column); "last" is the last that is not null.
    Of rows with equal order "last" takes any; rows whose key is null run within their part only. split: False runs over each key at once,
    which spares the totals where no key has many rows.
    """
    place = F.struct(*order)
    here = W.partitionBy(key, *([part] if split else [])).orderBy(*(c.asc_nulls_first() for c in order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    within = {"sum": F.sum, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    added = {"sum": F.sum, "min": F.min, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place))}
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "last": F.coalesce}
    local = rows.withColumns({n: within[kind](c).over(here) for n, (kind, c) in wanted.items()})
    if not split:
        return local
    totals = rows.filter(F.col(key).isNotNull()).groupBy(key, part).agg(*(added[kind](c).alias(n) for n, (kind, c) in wanted.items()))
    carry = totals.select(F.col(key).alias("_ck"), F.col(part).alias("_cp"), *(within[kind](F.col(n)).over(before).alias(f"_c_{n}") for n, (kind, _) in wanted.items()))
    joined = local.join(carry, (F.col(key) == F.col("_ck")) & (F.col(part) == F.col("_cp")), "left")
    return joined.select(*rows.columns, *(join[kind](F.col(n), F.col(f"_c_{n}")).alias(n) for n, (kind, _) in wanted.items()))

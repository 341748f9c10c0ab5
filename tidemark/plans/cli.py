"""python -m tidemark.plans.cli NAME --lake ROOT: shows a definition over a lake."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pick_first
from ..sources.lake import DEFINITIONS, Lake


def shown(lake: Lake, name: str, target: str | None = None, latest: bool = False, below_book: bool = False, order_by: str | None = None, limit: int = 20) -> DataFrame:
    """The definition, of one security, then its latest rows, then those below book value: in this order, which results depend on."""
    rows = lake.run(name)
    day = next((c for c in ("as_of_date", "obs_date", "actual_disclosed_date") if c in rows.columns), None)
    if target is not None:
        rows = rows.filter(F.col("security_key") == target)
    if latest:
        rows = pick_first(rows, ["security_key"], [F.desc(day)])
    if below_book:
        rows = rows.filter((F.col("calculation_status") == "ok") & F.col("is_below_book_value"))
    return rows.orderBy(F.col(order_by or day).desc_nulls_last()).limit(limit)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("name", choices=sorted(DEFINITIONS))
    p.add_argument("--lake", required=True)
    p.add_argument("--target")
    p.add_argument("--latest", action="store_true")
    p.add_argument("--below-book", action="store_true")
    p.add_argument("--order-by")
    p.add_argument("--limit", type=int, default=20)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    shown(Lake(spark, a.lake), a.name, a.target, a.latest, a.below_book, a.order_by, a.limit).show(a.limit, truncate=False)


if __name__ == "__main__":
    main()

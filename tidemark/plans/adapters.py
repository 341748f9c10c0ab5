"""Inputs of the domain's shape from the driver's tables, in SQL that Spark and DuckDB both read. Oracles carry the same text as CTEs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PRICES = """
select concat('S', lpad(cast(l_suppkey as string), 6, '0')) as security_key,
       cast(l_shipdate as date) as obs_date,
       case when l_linestatus = 'O' then 'official' else 'backfill' end as source_key,
       case when l_returnflag = 'R' and l_linenumber = 7 then 'unadjusted' else 'adjusted' end as price_basis,
       max(l_extendedprice) as raw_close_price,
       max(case when l_linenumber = 6 then null else l_extendedprice end) as close_price,
       max(l_extendedprice) as open_price,
       max(l_extendedprice) + max(l_quantity) - 3 as high_price,
       min(l_extendedprice) as low_price,
       sum(l_quantity) as volume,
       min(case when l_linenumber = 7 and l_orderkey % 50 = 0 then null when l_linenumber = 5 and l_orderkey % 40 = 0 then cast(0.5 as double) when l_linenumber = 4 and l_orderkey % 40 = 1 then cast(2 as double) else cast(1 as double) end) as adjustment_factor,
       max(l_orderkey) as ingestion_run_id
from lineitem group by 1, 2, 3, 4
"""

DISCLOSURES = """
select concat('S', lpad(cast(o_custkey % (select count(*) from supplier) as string), 6, '0')) as security_key,
       cast(o_orderkey as string) as disclosure_number,
       cast(o_orderdate as date) as disclosed_date,
       case when o_orderkey % 13 = 0 then null else concat(lpad(cast(9 + o_orderkey % 7 as string), 2, '0'), ':00:00') end as disclosed_time,
       cast(concat(cast(cast(o_orderdate as date) as string), ' ', case when o_orderkey % 13 = 0 then '23:59:59' else concat(lpad(cast(9 + o_orderkey % 7 as string), 2, '0'), ':00:00') end) as timestamp) - interval 9 hours as available_at,
       case o_orderpriority when '2-HIGH' then '1Q' when '3-MEDIUM' then '2Q' when '4-NOT SPECIFIED' then '3Q' else 'FY' end as fiscal_period_type,
       case when o_orderkey % 37 = 0 then null when o_orderkey % 31 = 0 then make_date(cast(year(o_orderdate) - 1 as int), 7, 1)
            else make_date(cast(year(o_orderdate) - 1 as int), 1, 1) end as fiscal_year_start,
       make_date(cast(year(o_orderdate) - 1 as int), 12, 31) as fiscal_year_end,
       case when o_orderkey % 41 = 0 then null else make_date(cast(year(o_orderdate) - 1 as int), 12, 31) end as period_end,
       case when o_orderkey % 29 = 0 then null when o_orderstatus = 'O' then 'non_consolidated' else 'consolidated' end as reporting_scope,
       case when o_orderstatus = 'P' then 'IFRS' else 'JP' end as accounting_standard,
       cast(floor(o_totalprice) as bigint) as revenue,
       case when o_orderkey % 23 = 0 then null else cast(floor(o_totalprice) as bigint) % 100000 - 30000 end as operating_income,
       case when o_orderkey % 43 = 0 then null else cast(floor(o_totalprice) as bigint) % 70000 - 20000 end as net_income,
       case when o_orderkey % 17 = 0 then null else cast(floor(o_totalprice) as bigint) % 80000 - 15000 end as forecast_operating_income,
       case when o_orderkey % 21 = 0 then null else cast(floor(o_totalprice) as bigint) + 500 end as next_forecast_revenue,
       case when o_orderkey % 19 = 0 then null else cast(floor(o_totalprice) as bigint) % 90000 - 20000 end as next_forecast_operating_income,
       case when o_orderkey % 25 = 0 then null else cast(floor(o_totalprice) as bigint) % 60000 - 9000 end as next_forecast_net_income,
       case when o_orderkey % 11 = 0 then null else cast(floor(o_totalprice) as bigint) % 50000 - 2000 end as bps,
       case when o_orderkey % 3 = 0 then null else concat('raw/', cast(o_orderkey as string)) end as raw_uri,
       o_orderkey as ingestion_run_id
from orders
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_NAMED = re.compile(rf"\b(from|join)\s+({'|'.join(TABLES)})\b")


#: A task's rows are many times as large in sorts and aggregations as in Parquet, so its share of a file or shuffle is bounded.
SHARES = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over a folder's tables, which are its arguments: no view of the session is touched, so threads may ask of different folders.

    Tasks take SHARES of the input and of shuffles unless the session has set others."""
    for name, most in SHARES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)
    used = {m[1] for m in _NAMED.findall(text)}
    plain = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(_NAMED.sub(r"\1 {\2}", plain), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PRICES)


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, DISCLOSURES)

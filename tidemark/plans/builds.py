"""Named queries over builds, staging, raw files, control tables and rule versions. Importing this module registers them."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import checks, comparisons, control, ingest, rules
from ..sources import arrays, publish, raw, schemas, sinks, staging
from ..sources.lake import Lake
from ..streaming import latest
from . import jobs
from . import runs as gated
from .adapters import disclosures as read_disclosures
from .adapters import sql
from .registry import DAY, RUNS, SCOPES, VERSION_ROWS, WEIGHT_ROWS, _day, _fact, _pref, _rules, query


_made: list[str] = []


def clean(spark: SparkSession) -> None:
    """Deletes what this process's queries have built. Call it when no result is needed any more: results are read from there."""
    while _made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, until clean(); only a local session gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    _made.append(f"{where.rstrip('/')}/lake-{uuid.uuid4().hex}")
    return _made[-1]


# ---- builds from the providers' records

#: Five-character codes, of which those that end in 0 have a ticker; whole numbers as text, some empty or no number; some flags unknown.
QUOTES = """select concat(lpad(cast(1000 + l_suppkey % 9000 as string), 4, '0'), case when l_suppkey % 5 = 0 then '5' else '0' end) as Code, cast(cast(l_shipdate as date) as string) as Date,
    cast(cast(floor(l_extendedprice) as bigint) as string) as C, case when l_linenumber = 5 then '' when l_linenumber = 4 and l_orderkey % 9 = 0 then 'n/a' else cast(cast(floor(l_extendedprice) as bigint) as string) end as AdjC,
    cast(cast(floor(l_quantity) as bigint) as string) as AdjVo, case when l_linenumber = 7 then 'maybe' when l_linenumber = 6 then '' else cast(l_linenumber % 2 as string) end as UL,
    cast(l_linenumber % 2 as string) as LL, l_orderkey * 10 + l_linenumber as ingestion_run_id from lineitem"""
_QUOTES_BUILT = f"""select Code as security_key, case when Code like '%0' then concat(substr(Code, 1, 4), '.T') end as target_key, Date as obs_date, try_cast(C as double) as raw_close_price, try_cast(AdjC as double) as close_price,
    try_cast(AdjVo as double) as volume, case UL when '1' then true when '0' then false end as upper_limit_flag, ingestion_run_id
    from ({QUOTES}) where coalesce(UL in ('0', '1', ''), true) qualify row_number() over (partition by Code, Date order by ingestion_run_id desc) = 1"""
_BUILT = ["security_key", "target_key", "obs_date", "raw_close_price", "close_price", "volume", "upper_limit_flag", "ingestion_run_id"]


def _quotes(spark, sf_dir):
    rows = sql(spark, sf_dir, QUOTES)
    lacking = [c.split()[0] for c in schemas.RAW_PRICE.split(", ") if c.split()[0] not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("string") for c in lacking})


def _whole_price(rows):
    """All columns of the stored schema; those that a build does not give are null."""
    return rows.sparkSession.createDataFrame([], schemas.PRICE).unionByName(rows.drop("security_key"), allowMissingColumns=True)


@query("", _QUOTES_BUILT)
def price_build(spark, sf_dir):
    return ingest.build_prices(_quotes(spark, sf_dir), "official").select(*_BUILT)


@query("", f"select Code as code, Date as obs_date, UL as flag, ingestion_run_id from ({QUOTES}) where UL = 'maybe'")
def price_rejects(spark, sf_dir):
    return ingest.rejected_prices(_quotes(spark, sf_dir)).select(F.col("Code").alias("code"), F.col("Date").alias("obs_date"), F.col("UL").alias("flag"), "ingestion_run_id")


@query("", f"select (select count(*) from ({QUOTES})) as records, count(*) as n_rows, count(*) filter (target_key is null) as unmapped, (select count(*) from ({QUOTES})) - count(*) as replaced from ({_QUOTES_BUILT})")
def build_counters(spark, sf_dir):
    rows = _quotes(spark, sf_dir)
    return ingest.source_counts(rows, ingest.build_prices(rows, "official"), ingest.PRICE_KEYS).withColumnRenamed("rows", "n_rows")


@query("", f"select year(cast(obs_date as date)) as year, security_key, obs_date, close_price, ingestion_run_id from ({_QUOTES_BUILT})")
def price_lake(spark, sf_dir):
    """Built, written by year and read back as the lake."""
    root = scratch(spark)
    sinks.write_by_year(_whole_price(ingest.build_prices(_quotes(spark, sf_dir), "official")).withColumn("security_key", F.coalesce("jpx_code", "target_key")), f"{root}/observed/market_price", "obs_date")
    return Lake(spark, root).observations().select(F.year("obs_date").alias("year"), "security_key", "obs_date", "close_price", "ingestion_run_id")


_BY_SOURCE = f"""select *, case when ingestion_run_id % 2 = 0 then 'official' else 'backfill' end as source_key from ({QUOTES})"""


@query(
    "",
    f"""select source_key, Code as security_key, Date as obs_date, try_cast(AdjC as double) as close_price, ingestion_run_id from ({_BY_SOURCE}) where coalesce(UL in ('0', '1', ''), true)
    qualify row_number() over (partition by source_key, Code, Date order by ingestion_run_id desc) = 1""",
)
def price_snapshot_lake(spark, sf_dir):
    """Quotes of two sources, built in three commits: the later source's whole past comes first, the other's runs in two steps, the later ones first to be lost
    if its watermark were not its own. Then one source is built in full again; the lake reads the last snapshot."""
    lake = Lake(spark, scratch(spark))
    data, quotes = jobs.price_dataset(lake), _quotes(spark, sf_dir)
    own = {"official": F.col("ingestion_run_id") % 2 == 0, "backfill": F.col("ingestion_run_id") % 2 == 1}
    middle = quotes.agg(F.avg("ingestion_run_id").alias("m")).first().m or 0

    def commit(source, upto=None, full=False):
        def fresh(base):
            rows = quotes.filter(own[source])
            rows = rows if upto is None else rows.filter(F.col("ingestion_run_id") <= upto)
            rows = rows if full or source not in base.watermarks else rows.filter(F.col("ingestion_run_id") > base.watermarks[source])
            top = rows.agg(F.max("ingestion_run_id").alias("top")).first().top
            built = spark.createDataFrame([], jobs.PRICE).unionByName(ingest.build_prices(rows, source), allowMissingColumns=True)
            return None if top is None else (built, {source: top})

        return data.build([source], jobs.PRICE, fresh, full)

    commit("backfill"), commit("official", middle), commit("official"), commit("backfill", full=True)
    return lake.observations().select("source_key", "security_key", F.col("obs_date").cast("string").alias("obs_date"), "close_price", "ingestion_run_id")


@query("", f"select user_id, cast(day as varchar) as day, event_type, ingestion_run_id, value from (select *, row_number() over (partition by user_id, day, event_type order by ingestion_run_id desc) as n from ({RUNS})) where n = 1")
def streamed_latest(spark, sf_dir):
    """Events that arrive in four files, out of their order, as a stream that keeps the last of each key in its state."""
    root, keys = scratch(spark), ["user_id", "day", "event_type"]
    rows = sql(spark, sf_dir, RUNS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows.repartition(4, F.xxhash64("ingestion_run_id")).write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    latest.follow_latest(arriving, keys, f"{root}/out", f"{root}/check").awaitTermination()
    return latest.current(spark, f"{root}/out", schema, keys).withColumn("day", F.col("day").cast("string"))


@query("", """select c_custkey as k, concat('a"}{[', c_name, chr(92)) as name, c_acctbal as v, c_nationkey as n, row_number() over (partition by c_nationkey order by c_custkey) - 1 as position from customer""")
def raw_array_items(spark, sf_dir):
    """Customers as one response for each nation, with braces and quotes in their names, read item by item; the file's own count must agree."""
    root = scratch(spark)
    rows = sql(spark, sf_dir, """select c_custkey as k, concat('a"}{[', c_name, char(92)) as name, c_acctbal as v, c_nationkey as n from customer""")
    bodies = rows.groupBy("n").agg(F.to_json(F.array_sort(F.collect_list(F.struct("k", "name", "v")))).alias("body"))
    bodies.withColumn("nation", F.col("n")).select("nation", "body").repartition("nation").write.option("compression", "gzip").partitionBy("nation").text(root)
    found = arrays.items(spark, root)
    whole = found.filter("item is null").select("file", F.col("position").alias("_all"))
    each = found.filter("item is not null").join(whole, "file").filter("position < _all")
    read = each.select(F.from_json("item", "k bigint, name string, v double").alias("r"), F.regexp_extract("file", r"nation=(\d+)", 1).cast("int").alias("n"), "position")
    return read.select("r.*", "n", "position")


LIBRARY = "select concat(lpad(cast(1000 + s_suppkey % 9000 as string), 4, '0'), case when s_suppkey % 6 = 0 then '.X' else '.T' end) as target_key, cast('2001-01-05' as date) as obs_date, s_acctbal as open, s_acctbal + 1 as high, s_acctbal - 1 as low, s_acctbal as close, 5 as volume, s_suppkey as ingestion_run_id from supplier"


@query("", f"select target_key, case when target_key like '%.T' then concat(substr(target_key, 1, 4), '0') end as jpx_code, cast(obs_date as varchar) as obs_date, close as close_price, ingestion_run_id from ({LIBRARY}) qualify row_number() over (partition by target_key order by ingestion_run_id desc) = 1")
def library_build(spark, sf_dir):
    return ingest.build_library_prices(sql(spark, sf_dir, LIBRARY), "backfill").select("target_key", "jpx_code", "obs_date", "close_price", "ingestion_run_id")


FILINGS = """select concat(lpad(cast(1000 + o_custkey % 9000 as string), 4, '0'), '0') as Code, cast(o_orderkey as string) as DiscNo, cast(cast(o_orderdate as date) as string) as DiscDate,
    case when o_orderkey % 13 = 0 then '' else '15:00:00' end as DiscTime, case when o_orderkey % 11 = 0 then 'EarnForecastRevision' when o_orderstatus = 'O' then 'FYFinancialStatements_NonConsolidated_JP' else '2QFinancialStatements_Consolidated_IFRS' end as DocType,
    case when o_orderkey % 2 = 0 then 'FY' else '2Q' end as CurPerType, concat(cast(cast(floor(o_totalprice) as bigint) as string), case when o_orderkey % 4 = 0 then '.5' else '' end) as Sales,
    case when o_orderkey % 7 = 0 then '' else cast(cast(floor(o_totalprice) as bigint) % 1000 as string) end as NCSales, 'x' as OP, '12.25' as BPS, '7.5' as NCBPS, o_orderkey as ingestion_run_id from orders"""
_FILED = f"""select Code as jpx_code, DiscNo as disclosure_number, DiscDate as disclosed_date, nullif(DiscTime, '') as disclosed_time, case when DocType like '%NonCons%' then 'JP' when DocType like '%Cons%' then 'IFRS' end as accounting_standard,
    case when DocType like '%NonCons%' then 'non_consolidated' else 'consolidated' end as reporting_scope, case when DocType like '%NonCons%' then NCSales else Sales end as sold, case when DocType like '%NonCons%' then 7.5::double else 12.25::double end as bps, ingestion_run_id from ({FILINGS})"""


def _filings(spark, sf_dir):
    rows = sql(spark, sf_dir, FILINGS)
    lacking = [c.split()[0] for c in schemas.RAW_FINANCIAL.split(", ") if c.split()[0] not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("string") for c in lacking})


@query("", f"select jpx_code, disclosure_number, disclosed_date, disclosed_time, accounting_standard, reporting_scope, cast(case when sold like '%.5' then 2 * round(try_cast(sold as double) / 2) else try_cast(sold as double) end as bigint) as revenue, cast(null as bigint) as operating_income, bps, ingestion_run_id from ({_FILED})")
def financial_build(spark, sf_dir):
    found = ingest.build_financials(_filings(spark, sf_dir), "official")
    return found.select("jpx_code", "disclosure_number", "disclosed_date", "disclosed_time", "accounting_standard", "reporting_scope", "revenue", "operating_income", "bps", "ingestion_run_id")


LISTED = "select concat(cast(s_suppkey as string), '0') as jpx_code, case when s_suppkey % 8 = 0 then null else s_name end as company_name, make_date(2000, 1, 1 + cast(s_suppkey % 3 as int)) as source_date, s_suppkey as ingestion_run_id from supplier"


@query("", f"select jpx_code, company_name from ({LISTED}) where source_date = (select max(source_date) from ({LISTED})) and company_name is not null")
def master_build(spark, sf_dir):
    return ingest.build_master(sql(spark, sf_dir, LISTED)).select("jpx_code", "company_name")


# ---- staging from raw responses

#: One response for each order, with the filing twice: the second item is a correction of the first's number for odd orders.
RESPONSES = f"""select concat('k', DiscNo) as raw_object_key, ingestion_run_id, cast(DiscDate as timestamp) as fetched_at, cast(null as string) as raw_uri, cast(null as string) as response_sha256,
    concat('{{"data":[{{"Code":"', Code, '","DiscNo":"', DiscNo, '","DiscDate":"', DiscDate, '","DiscTime":"', DiscTime, '","DocType":"', DocType, '","CurPerType":"', CurPerType, '","Sales":"', Sales, '","NCSales":"', NCSales, '","OP":"x"}},{{"Code":"', Code, '","DiscNo":"', DiscNo, 'b","DiscDate":"bad","DocType":"A_Consolidated_JP","CurPerType":"FY","Sales":"1"}}]}}') as payload_json from ({FILINGS})"""


@query(
    "",
    f"""select concat(substr(jpx_code, 1, 4), '.T') as security_key, disclosure_number, disclosed_date, cast(cast(concat(disclosed_date, ' ', coalesce(disclosed_time, '23:59:59')) as timestamp) - interval 9 hours as varchar) as available_at,
      accounting_standard, reporting_scope, try_cast(sold as double) as revenue, ingestion_run_id from ({_FILED})
    union all select concat(substr(jpx_code, 1, 4), '.T'), concat(disclosure_number, 'b'), null, null, 'JP', 'consolidated', 1, ingestion_run_id from ({_FILED})""",
)
def staged_disclosures(spark, sf_dir):
    found = staging.financial_disclosure(sql(spark, sf_dir, RESPONSES))
    return found.select("security_key", "disclosure_number", "disclosed_date", "available_at", "accounting_standard", "reporting_scope", F.col("revenue").cast("double").alias("revenue"), "ingestion_run_id")


#: Odd orders were answered again by a later run, with another figure under the same numbers.
_AGAIN = f"""{RESPONSES} union all select concat('late', raw_object_key), ingestion_run_id + 100000000, fetched_at, raw_uri, response_sha256, replace(payload_json, '"Sales":"', '"Sales":"9') from ({RESPONSES}) where ingestion_run_id % 2 = 1"""


@query(
    "",
    f"""select concat(substr(jpx_code, 1, 4), '.T') as security_key, disclosure_number, case when ingestion_run_id % 2 = 1 and reporting_scope = 'consolidated' then try_cast(concat('9', sold) as double) else try_cast(sold as double) end as revenue,
      case when ingestion_run_id % 2 = 1 then ingestion_run_id + 100000000 else ingestion_run_id end as ingestion_run_id from ({_FILED})
    union all select concat(substr(jpx_code, 1, 4), '.T'), concat(disclosure_number, 'b'), case when ingestion_run_id % 2 = 1 then 91 else 1 end, case when ingestion_run_id % 2 = 1 then ingestion_run_id + 100000000 else ingestion_run_id end from ({_FILED})""",
)
def staged_corrections(spark, sf_dir):
    """Of two responses with one code and number that of the later run counts."""
    found = staging.financial_disclosure(sql(spark, sf_dir, _AGAIN))
    return found.select("security_key", "disclosure_number", F.col("revenue").cast("double").alias("revenue"), "ingestion_run_id")


@query("", f"select year(cast(disclosed_date as date)) as year, jpx_code as security_key, disclosure_number, disclosed_date, try_cast(bps as double) as bps, ingestion_run_id from ({_FILED})")
def financial_lake(spark, sf_dir):
    """Disclosures built, written by year and read back as the lake."""
    root = scratch(spark)
    built = ingest.build_financials(_filings(spark, sf_dir), "official")
    whole = spark.createDataFrame([], schemas.FINANCIAL).unionByName(built, allowMissingColumns=True).withColumn("security_key", F.coalesce("jpx_code", "target_key"))
    sinks.write_by_year(whole, f"{root}/observed/financial_summary", "disclosed_date", sort=("security_key", "disclosure_number"))
    return Lake(spark, root).disclosures().select(F.year("disclosed_date").alias("year"), "security_key", "disclosure_number", F.col("disclosed_date").cast("string").alias("disclosed_date"), "bps", "ingestion_run_id")


@query("", f"select jpx_code, company_name, 1 as n_files from ({LISTED}) where source_date = (select max(source_date) from ({LISTED})) and company_name is not null")
def master_file(spark, sf_dir):
    """The master, built, written as one file and read back as the lake."""
    root = scratch(spark)
    built = spark.createDataFrame([], schemas.MASTER).unionByName(ingest.build_master(sql(spark, sf_dir, LISTED)), allowMissingColumns=True)
    sinks.write_reference(built, f"{root}/reference/security_master")
    rows = Lake(spark, root).master()
    return rows.select("jpx_code", "company_name", F.lit(len(rows.inputFiles())).alias("n_files"))


ANNUAL = """select concat('a', cast(o_orderkey as string)) as raw_object_key, o_orderkey as ingestion_run_id, concat('{"data":[{"edinet_code":"E', cast(o_custkey as string), '","fiscal_year":', cast(year(o_orderdate) as string), ',"operating_income":', cast(o_orderkey as string),
    ',"submit_date":"', cast(cast(o_orderdate as date) as string), ' 09:30"},{"edinet_code":"E', cast(o_custkey as string), '","fiscal_year":"none"}]}') as payload_json from orders"""


@query("", "select concat('E', cast(o_custkey as varchar)) as edinet_code, cast(year(o_orderdate) as bigint) as fiscal_year, cast(o_orderkey as double) as operating_income, concat(cast(cast(o_orderdate as date) as varchar), ' 00:30:00') as available_at from orders union all select concat('E', cast(o_custkey as varchar)), null, null, null from orders")
def staged_annuals(spark, sf_dir):
    return staging.financial_actual(sql(spark, sf_dir, ANNUAL)).select("edinet_code", "fiscal_year", F.col("operating_income").cast("double").alias("operating_income"), "available_at")


@query("", "select concat('a', cast(o_orderkey as varchar)) as raw_object_key, cast(2 as bigint) as record_count, cast(year(o_orderdate) as bigint) as min_fiscal_year, cast(year(o_orderdate) as bigint) as max_fiscal_year from orders")
def response_years(spark, sf_dir):
    return raw.response_years(staging.financial_actual(sql(spark, sf_dir, ANNUAL)))


@query("", "select n_name, r_name as endpoint, cast(n_nationkey as bigint) as fiscal_year from nation join region on n_regionkey = r_regionkey")
def archive_round_trip(spark, sf_dir):
    """Nations as one response for each region: archived with manifests, published, found by their manifests, checked against their hashes and unpacked."""
    root, day = scratch(spark), dt.date(2001, 1, 5)
    found: dict[str, list] = {}
    for r in sql(spark, sf_dir, "select r_name, n_name, n_nationkey from nation join region on n_regionkey = r_regionkey order by n_nationkey").collect():  # a table of 25 rows by definition
        found.setdefault(r.r_name, []).append({"n_name": r.n_name, "fiscal_year": r.n_nationkey})
    for endpoint, items in found.items():
        publish.store(spark, root, "s", endpoint, "all", day, json.dumps({"data": items}).encode(), run_id="1")
    rows = raw.responses(raw.read_manifests(spark, root), root)
    return raw.exploded(rows.select("endpoint", "payload_json"), "data", {"n_name": ("$.n_name", "string"), "fiscal_year": ("$.fiscal_year", "bigint")}).select("n_name", "endpoint", "fiscal_year")


@query("", "select n_name, cast(n_regionkey as bigint) as ingestion_run_id from nation")
def published_runs(spark, sf_dir):
    """Raw files put in place, published under another root, their paths moved, and read from there by the index of runs."""
    root = scratch(spark)
    found: dict[int, list] = {}
    for r in sql(spark, sf_dir, "select n_name, n_regionkey from nation").collect():  # a table of 25 rows by definition
        found.setdefault(r.n_regionkey, []).append({"n_name": r.n_name})
    paths = [(k, "job", "succeeded", f"{root}/raw/run-{k}.json.gz") for k in found]
    for k, _, _, path in paths:
        sinks.put_raw(spark, found[k], path)
    runs = spark.createDataFrame(paths, "ingestion_run_id long, job_type string, status string, raw_path string")
    moved, _ = publish.publish_pending(runs, f"{root}/raw", f"{root}/published")
    return raw.read_arrays(spark, raw.locations(publish.moved_paths(runs, moved), "job"), "n_name string").select("n_name", "ingestion_run_id")


RAW_RUNS = "select event_id as ingestion_run_id, event_type as job_type, case when event_id % 3 = 0 then 'failed' else 'succeeded' end as status, case when event_id % 5 = 0 then null when event_id % 2 = 0 then concat('hdfs://lake/', cast(event_id as string)) else concat('/raw/', cast(event_id as string)) end as raw_path from events"


@query("", f"select ingestion_run_id, raw_path as location from ({RAW_RUNS}) where job_type = 'click' and status = 'succeeded' and raw_path is not null and ingestion_run_id > 100")
def raw_index(spark, sf_dir):
    return raw.locations(sql(spark, sf_dir, RAW_RUNS), "click", 100)


@query("", f"select ingestion_run_id, raw_path as location from ({RAW_RUNS}) where raw_path is not null and raw_path not like 'hdfs://lake/%'")
def pending_raw(spark, sf_dir):
    return raw.pending(sql(spark, sf_dir, RAW_RUNS), "hdfs://lake")


@query("", f"select ingestion_run_id, raw_path from ({RAW_RUNS}) where status = 'succeeded' and raw_path is not null and ingestion_run_id > (select max(event_id) from events where event_id <= (select avg(event_id) from events))")
def new_runs(spark, sf_dir):
    """Runs after the last one loaded."""
    loaded = sql(spark, sf_dir, "select event_id as ingestion_run_id from events where event_id <= (select avg(event_id) from events)")
    return gated.new_runs(sql(spark, sf_dir, RAW_RUNS), loaded).select("ingestion_run_id", "raw_path")


UNITS = "select n_name as endpoint, cast(n_nationkey as string) as unit_key, make_date(2000, 1, 1) as snapshot_date from nation"
MANIFESTS = "select n_name as endpoint, cast(n_nationkey as string) as unit_key, make_date(2000, 1, 1) as snapshot_date, case when s_suppkey % 4 > 0 then 'failed' else 'succeeded' end as status from supplier join nation on s_nationkey = n_nationkey"


@query("", f"select endpoint, unit_key from ({UNITS}) u where not exists (select 1 from ({MANIFESTS}) m where m.unit_key = u.unit_key and status = 'succeeded')")
def remaining_units(spark, sf_dir):
    return publish.remaining(sql(spark, sf_dir, UNITS), sql(spark, sf_dir, MANIFESTS)).select("endpoint", "unit_key")


# ---- checks and the gated run


#: The fact with keys lost and given twice, values of no vocabulary, references of the same day or later, and bases lost.
_BROKEN = """select * replace (case when n % 11 = 0 then null when n % 13 = 0 then 'one' else comparison_key end as comparison_key, case when n % 17 = 0 then 'profit' else metric_key end as metric_key,
    case when n % 19 = 0 then null when n % 23 = 0 then 'twice' else comparison_type end as comparison_type, case when n % 5 = 0 then null else reporting_scope end as reporting_scope) from (select *, cast(disclosure_number as bigint) as n from fact)"""


@query(
    "fact",
    f"""select * from (with b as materialized ({_BROKEN}) select 'key_missing' as check_name, count(*) filter (comparison_key is null) as violations from b union all select 'key_twice', (select count(*) from (select comparison_key from b group by 1 having count(*) > 1))
    union all select 'metric_unknown', count(*) filter (metric_key not in ('revenue', 'operating_income', 'net_income')) from b union all select 'comparison_unknown', count(*) filter (comparison_type not in ('forecast_variance', 'yoy', 'absolute', 'sign_transition')) from b
    union all select 'reference_not_before', count(*) filter (reference_disclosure_number is not null and n % 3 = 0) from b union all select 'ok_without_basis', count(*) filter (comparison_status = 'ok' and (reporting_scope is null or accounting_standard is null)) from b)""",
)
def fact_checks_broken(spark, sf_dir):
    """What the checks find where there is something to find."""
    n = F.col("current_disclosure_number").cast("bigint")
    hit = lambda k, new, c: F.when(n % k == 0, new).otherwise(F.col(c))
    fact = _fact(spark, sf_dir).withColumns({
        "comparison_key": F.when(n % 11 == 0, None).when(n % 13 == 0, "one").otherwise(F.col("comparison_key")),
        "metric_key": hit(17, "profit", "metric_key"),
        "comparison_type": F.when(n % 19 == 0, None).when(n % 23 == 0, "twice").otherwise(F.col("comparison_type")),
        "reporting_scope": hit(5, None, "reporting_scope"),
        "reference_available_at": F.when((n % 3 == 0) & F.col("reference_disclosure_number").isNotNull(), F.col("current_available_at")).when(n % 3 == 0, None).otherwise(F.col("reference_available_at")),
    })
    return checks.counts(gated.fact_checks(fact))


@query(
    "fact",
    """select 'key_missing' as check_name, count(*) filter (comparison_key is null) as violations from fact union all select 'key_twice', (select count(*) from (select comparison_key from fact group by 1 having count(*) > 1))
    union all select 'metric_unknown', count(*) filter (metric_key not in ('revenue', 'operating_income', 'net_income')) from fact union all select 'comparison_unknown', count(*) filter (comparison_type not in ('forecast_variance', 'yoy', 'absolute', 'sign_transition')) from fact
    union all select 'reference_not_before', 0 union all select 'ok_without_basis', count(*) filter (comparison_status = 'ok' and (reporting_scope is null or accounting_standard is null)) from fact""",
)
def fact_checks(spark, sf_dir):
    return checks.counts(gated.fact_checks(_fact(spark, sf_dir)))


@query("fact", "select metric_key, comparison_type, comparison_status, count(*) as n from fact group by 1, 2, 3")
def fact_mart(spark, sf_dir):
    """The fact as a published mart: written as a version, checked, made current and read."""
    marts = gated.Marts(spark, scratch(spark))
    marts.publish("metric_comparison_fact", _fact(spark, sf_dir), "1", gated.fact_checks)
    return marts.current("metric_comparison_fact").groupBy("metric_key", "comparison_type", "comparison_status").agg(F.count(F.lit(1)).alias("n"))


@query("lake", f"select security_key, metric_key, comparison_type, observed_value from lake where metric_key in ('revenue', 'net_income') and comparison_type = 'yoy' and available_on <= date '{DAY}'")
def selected_facts(spark, sf_dir):
    facts = comparisons.metric_comparison_input(read_disclosures(spark, sf_dir))
    return comparisons.select_facts(facts, ["revenue", "net_income"], ["yoy"], None, dt.date.fromisoformat(DAY)).select("security_key", "metric_key", "comparison_type", "observed_value")


# ---- control tables and rule versions

VERSIONED = "select p_size as rule_id, p_partkey as version_no, p_name as rule_name, p_partkey % 2 = 0 as enabled from part"


@query("", f"select cast(rule_id as bigint) as rule_id, version_no, rule_name from ({VERSIONED}) qualify row_number() over (partition by rule_id order by version_no desc) = 1")
def current_rule_versions(spark, sf_dir):
    return rules.current_versions(sql(spark, sf_dir, VERSIONED), "rule_id").select("rule_id", "version_no", "rule_name")


@query("", f"select cast(rule_id as bigint) as rule_id, version_no, rule_name from ({VERSIONED}) union all select cast(rule_id as bigint), max(version_no) + 1, 'next' from ({VERSIONED}) group by 1")
def added_rule_versions(spark, sf_dir):
    rows = sql(spark, sf_dir, VERSIONED)
    changed = rows.select("rule_id").distinct().withColumns({"rule_name": F.lit("next"), "enabled": F.lit(True)})
    return rules.add_version(rows, changed, "rule_id").select("rule_id", "version_no", "rule_name")


SOME_RULES = "select distinct p_size as rule_id from part where p_brand < 'Brand#3'"


@query("", f"select version_no, case when rule_id in ({SOME_RULES}) then false else enabled end as enabled from ({VERSIONED})")
def disabled_rules(spark, sf_dir):
    return rules.set_enabled(sql(spark, sf_dir, VERSIONED), sql(spark, sf_dir, SOME_RULES), False).select("version_no", "enabled")


@query("", f"select 'versions' as table_name, count(*) filter (rule_id in ({SOME_RULES})) as deleted, count(*) filter (rule_id not in ({SOME_RULES})) as remaining from ({VERSIONED})")
def deleted_rules(spark, sf_dir):
    left, gone = rules.delete_rules({"versions": sql(spark, sf_dir, VERSIONED)}, sql(spark, sf_dir, SOME_RULES))
    n = left["versions"].agg(F.count(F.lit(1)).alias("remaining"))
    return gone.withColumnRenamed("table", "table_name").crossJoin(F.broadcast(n))  # one row each


LISTED_RULES = "select o_custkey as rule_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as position, lower(o_orderstatus) as metric_key, o_orderpriority as comparison_type, case when o_orderkey % 2 = 0 then 'lt' else 'gte' end as operator, cast(o_orderkey % 100 as decimal(20,4)) as threshold_value from orders"


@query("", f"""select rule_id, concat('[', string_agg(concat('{{"metric_key":"', metric_key, '","comparison_type":"', comparison_type, '","operator":"', operator, '","threshold_value":', cast(threshold_value as varchar), '}}'), ',' order by position), ']') as conditions from ({LISTED_RULES}) group by 1""")
def rule_condition_lists(spark, sf_dir):
    """A customer's orders as the conditions of a rule, listed in their order."""
    return rules.conditions_json(sql(spark, sf_dir, LISTED_RULES))


#: Customers as stored rules: with a list of conditions, of the older form, of both or of none, by their keys.
_FORMS = "c_custkey as rule_id, c_custkey % 3 as n_listed, case when c_custkey % 4 in (0, 1) then 'revenue' end as metric_key, case when c_custkey % 4 in (0, 1) and c_custkey % 7 > 0 then 'yoy' end as comparison_type, case when c_custkey % 4 in (0, 1) then 'gt' end as operator, case when c_custkey % 4 = 0 then cast(c_acctbal as decimal(20,4)) end as threshold_value from customer"


def _stored_rules(spark, sf_dir):
    rows = sql(spark, sf_dir, f"select {_FORMS}")
    one = F.struct(F.lit("net_income").alias("metric_key"), F.lit("absolute").alias("comparison_type"), F.lit("lt").alias("operator"), F.col("rule_id").cast("decimal(20,4)").alias("threshold_value"))
    return rows.withColumn("conditions", F.array_repeat(one, F.col("n_listed").cast("int"))).drop("n_listed")


@query("", f"""select rule_id, cast(p as bigint) as position, 'net_income' as metric_key, 'absolute' as comparison_type, 'lt' as operator, cast(rule_id as double) as threshold_value from (select rule_id, unnest(range(1, n_listed + 1)) as p from (select {_FORMS}))
    union all select rule_id, 1, metric_key, comparison_type, operator, cast(threshold_value as double) from (select {_FORMS}) where n_listed = 0 and metric_key is not null""")
def rule_forms(spark, sf_dir):
    found = rules.conditions_of(_stored_rules(spark, sf_dir))
    return found.withColumns({"position": F.col("position").cast("long"), "threshold_value": F.col("threshold_value").cast("double")})


@query("", f"""select rule_id, violation from (select rule_id, unnest([case when n_listed = 0 and metric_key is null then 'conditions_missing' end, case when n_listed > 0 and (metric_key is not null or threshold_value is not null) then 'two_forms' end,
    case when n_listed = 0 and metric_key is not null and comparison_type is null then 'condition_incomplete' end]) as violation from (select {_FORMS})) where violation is not null""")
def rule_form_violations(spark, sf_dir):
    return rules.form_violations(_stored_rules(spark, sf_dir))


THEMES = "select p_partkey as theme_id, concat(case when p_partkey % 2 = 0 then '  ' else '' end, case when p_partkey % 3 = 0 then upper(p_type) else lower(p_type) end) as theme_name, p_size % 4 <> 0 as is_active from part"


@query("", f"select theme_id from ({THEMES}) t where is_active and exists (select 1 from ({THEMES}) o where o.is_active and o.theme_id <> t.theme_id and lower(trim(o.theme_name)) = lower(trim(t.theme_name)))")
def theme_name_clashes(spark, sf_dir):
    return control.name_clashes(sql(spark, sf_dir, THEMES)).select("theme_id")


@query(
    "",
    f"""select cast(rule_id as bigint) as rule_id, scope_type, cast(scope_id as bigint) as scope_id, case scope_type when 'target' then s_name when 'mandate' then n_name when 'theme' then r_name else case when watchlist_status is null then 'watchlist' else concat('watchlist: ', watchlist_status) end end as scope_label
    from ({SCOPES}) left join supplier on scope_type = 'target' and s_suppkey = scope_id left join nation on scope_type = 'mandate' and n_nationkey = scope_id left join region on scope_type = 'theme' and r_regionkey = scope_id""",
)
def scope_labels(spark, sf_dir):
    named = [sql(spark, sf_dir, t) for t in ("select s_suppkey as target_id, s_name as target_name from supplier", "select n_nationkey as mandate_id, n_name as mandate_name from nation", "select r_regionkey as theme_id, r_name as theme_name from region")]
    return rules.scope_labels(sql(spark, sf_dir, SCOPES), *named).select("rule_id", "scope_type", F.col("scope_id").cast("long").alias("scope_id"), "scope_label")


#: Each supplier is a mandate with an ended version and a current one; those in debt get a next. Its lines are assignments, some of them ended.
_VERSIONS = "select s_suppkey as mandate_id, s_suppkey * 10 + v as mandate_version_id, v as version_no, s_acctbal as weight, case when v = 1 then cast('2001-01-01' as date) else cast('2003-01-01' as date) end as effective_from, case when v = 1 then cast('2003-01-01' as date) end as effective_until from supplier cross join (select 1 as v union all select 2) as t"
_ASSIGNED = "select l_suppkey * 10 + 1 + l_linenumber % 2 as mandate_version_id, l_partkey as target_id, case when l_quantity < 10 then cast(l_shipdate as date) end as effective_until from lineitem"
_NEXT = "select s_suppkey as mandate_id, s_suppkey * 10 + 3 as mandate_version_id, -1.0 as weight from supplier where s_acctbal < 0"


def _rolled(spark, sf_dir):
    return control.roll_version(*(sql(spark, sf_dir, x) for x in (_VERSIONS, _ASSIGNED)), sql(spark, sf_dir, _NEXT).withColumn("weight", F.lit(-1.0)), F.lit("2005-01-01").cast("date"))


@query(
    "",
    f"""select mandate_id, mandate_version_id, cast(version_no as bigint) as version_no, cast(weight as double) as weight, cast(case when effective_until is null and mandate_id in (select mandate_id from ({_NEXT})) then date '2005-01-01' else effective_until end as varchar) as effective_until from ({_VERSIONS})
    union all select mandate_id, mandate_version_id, 3, -1.0, null from ({_NEXT})""",
)
def rolled_versions(spark, sf_dir):
    found = _rolled(spark, sf_dir)[0]
    return found.select("mandate_id", "mandate_version_id", F.col("version_no").cast("long").alias("version_no"), F.col("weight").cast("double").alias("weight"), F.col("effective_until").cast("string").alias("effective_until"))


@query(
    "",
    f"""with a as (select * from ({_ASSIGNED})), n as (select * from ({_NEXT}))
    select a.mandate_version_id, target_id, cast(case when a.effective_until is null and a.mandate_version_id % 10 = 2 and n.mandate_id is not null then date '2005-01-01' else a.effective_until end as varchar) as effective_until from a left join n on n.mandate_id = a.mandate_version_id // 10
    union all select n.mandate_version_id, target_id, null from a join n on n.mandate_id = a.mandate_version_id // 10 where a.effective_until is null and a.mandate_version_id % 10 = 2""",
)
def rolled_assignments(spark, sf_dir):
    return _rolled(spark, sf_dir)[1].withColumn("effective_until", F.col("effective_until").cast("string"))


TARGET_NAMES = "select concat('S', lpad(cast(s_suppkey as string), 6, '0')) as security_key, s_suppkey as target_id, s_name as target_name from supplier where s_acctbal >= 0"


@query("pref", f"select security_key, cast(max(obs_date) as varchar) as obs_date, any_value(target_id) as target_id, any_value(target_name) as target_name from pref left join ({TARGET_NAMES}) using (security_key) group by 1")
def latest_prices_named(spark, sf_dir):
    """Each security's last day, with the ids that people keep for it."""
    last = _pref(spark, sf_dir).groupBy("security_key").agg(F.max("obs_date").alias("obs_date"))
    return control.with_ids(last, sql(spark, sf_dir, TARGET_NAMES))


@query("", f"select scope, round(weight, 9) as weight from (select cast(mandate_version_id as varchar) as scope, sum(target_weight) as weight from ({WEIGHT_ROWS}) where status in ('draft', 'active') group by 1 union all select 'all', sum(allocation_weight) from ({VERSION_ROWS})) where weight > 1 + 1e-9")
def overallocated(spark, sf_dir):
    return control.overallocated(sql(spark, sf_dir, VERSION_ROWS), sql(spark, sf_dir, WEIGHT_ROWS)).select("scope", F.round("weight", 9).alias("weight"))


@query("", f"select target_id, round(cast(cast(cast(1000000.55 as decimal(20,2)) * cast(allocation_weight as decimal(12,8)) * cast(target_weight as decimal(12,8)) as decimal(20,2)) as double), 1) as target_amount from ({WEIGHT_ROWS}) join ({VERSION_ROWS}) v using (mandate_version_id)")
def assignment_amounts(spark, sf_dir):
    found = control.assignment_amounts(sql(spark, sf_dir, VERSION_ROWS), sql(spark, sf_dir, WEIGHT_ROWS), F.lit("1000000.55"))
    return found.select("target_id", F.round(F.col("target_amount").cast("double"), 1).alias("target_amount"))


HELD = "select distinct c_custkey as id, 'held' as state from customer join orders on c_custkey = o_custkey where o_orderstatus = 'F'"
GIVEN = "select distinct c_custkey as id, 'given' as state from customer join orders on c_custkey = o_custkey where o_orderstatus = 'O'"


@query("", f"select coalesce(a.id, b.id) as id, coalesce(b.state, a.state) as state from ({HELD}) a full join ({GIVEN}) b on a.id = b.id")
def upserted(spark, sf_dir):
    return control.upsert(sql(spark, sf_dir, HELD), sql(spark, sf_dir, GIVEN), ["id"])


@query("", f"select coalesce(a.id, b.id) as id, coalesce(a.state, b.state) as state from ({HELD}) a full join ({GIVEN}) b on a.id = b.id")
def inserted_only(spark, sf_dir):
    return control.insert_only(sql(spark, sf_dir, HELD), sql(spark, sf_dir, GIVEN), ["id"])


THEME_CODES = "select n_regionkey as theme_id, cast(s_suppkey as string) as code, make_date(1995, 1, 1) as valid_from, cast(null as date) as valid_to from supplier join nation on s_nationkey = n_nationkey"
NEW_CODES = "select distinct cast(l_suppkey as string) as code from lineitem where l_returnflag = 'R' and l_quantity > 49"


@query(
    "",
    f"""select cast(theme_id as bigint) as theme_id, code, cast(valid_from as varchar) as valid_from, case when theme_id = 1 and code not in ({NEW_CODES}) then '{DAY}' end as valid_to from ({THEME_CODES})
    union all select 1, code, '{DAY}', null from ({NEW_CODES}) where code not in (select code from ({THEME_CODES}) where theme_id = 1)""",
)
def replaced_members(spark, sf_dir):
    members = sql(spark, sf_dir, THEME_CODES)
    changes = control.membership_changes(members.filter("theme_id = 1 and valid_to is null"), sql(spark, sf_dir, NEW_CODES), "replace")
    return control.apply_membership(members, changes, 1, _day(DAY)).select("theme_id", "code", "valid_from", "valid_to")

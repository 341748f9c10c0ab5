"""From raw records to the lake's datasets: typed, one row for each business key, partitioned by year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..functions.columns import pick_first
from ..sources import schemas

#: A security without an exchange code is told apart by its ticker, so different ones do not collapse into one.
PRICE_KEYS = ("security_key", "obs_date", "source_key")
FINANCIAL_KEYS = ("jpx_code", "disclosure_number", "source_key")


def keep_last(df: DataFrame, keys: Sequence[str], run: str = "ingestion_run_id") -> DataFrame:
    """Of each business key the row of the highest run; of equal runs that which sorts last by all columns."""
    rest = [F.col(c).desc_nulls_last() for c in df.columns if c not in keys and c != run]
    return pick_first(df, keys, [F.col(run).desc_nulls_last(), *rest])


def build_prices(raw: DataFrame, source: str) -> DataFrame:
    """Price rows from the provider's records; those with an unknown flag are rejected (see rejected_prices)."""
    rows = raw.filter(~is_rejected())
    field = {
        "raw_open_price": "O", "raw_high_price": "H", "raw_low_price": "L", "raw_close_price": "C", "raw_volume": "Vo", "turnover_value": "Va",
        "open_price": "AdjO", "high_price": "AdjH", "low_price": "AdjL", "close_price": "AdjC", "volume": "AdjVo",
        "adjustment_factor": "AdjFactor", "market_cap_million_yen": "MktCap",
    }
    rows = rows.select(
        n.ticker_of(n.text(F.col("Code"))).alias("target_key"),
        n.text(F.col("Code")).alias("jpx_code"),
        F.lit(source).alias("source_key"),
        n.day(F.col("Date")).alias("obs_date"),
        *(n.number(F.col(f)).alias(c) for c, f in field.items()),
        F.lit("adjusted").alias("price_basis"),
        n.text(F.col("ExRT")).alias("ex_rights_type"),
        n.flag(F.col("UL")).alias("upper_limit_flag"),
        n.flag(F.col("LL")).alias("lower_limit_flag"),
        "ingestion_run_id",
    )
    rows = rows.withColumn("security_key", F.coalesce("jpx_code", "target_key"))
    return keep_last(rows, PRICE_KEYS)


def build_library_prices(records: DataFrame, source: str) -> DataFrame:
    """Price rows from a library's records: target_key, obs_date, open, high, low, close, volume, all adjusted."""
    kinds = {"open_price": "open", "high_price": "high", "low_price": "low", "close_price": "close"}
    rows = records.select(
        "target_key",
        n.code_of(F.col("target_key")).alias("jpx_code"),
        F.lit(source).alias("source_key"),
        F.col("obs_date").cast("date").alias("obs_date"),
        *(F.col(f).cast("double").alias(c) for c, f in kinds.items()),
        F.col("volume").cast("double").alias("volume"),
        F.lit("adjusted").alias("price_basis"),
        "ingestion_run_id",
    )
    return keep_last(rows.withColumn("security_key", F.coalesce("jpx_code", "target_key")), PRICE_KEYS)


def is_rejected() -> Column:
    """Whether a provider's record has a flag that is not known."""
    return n.is_bad_flag(F.col("UL")) | n.is_bad_flag(F.col("LL"))


def rejected_prices(raw: DataFrame) -> DataFrame:
    return raw.filter(is_rejected())


def build_financials(raw: DataFrame, source: str) -> DataFrame:
    """Disclosure rows; each figure is taken from the fields of the document's scope."""
    standard, scope = n.reporting(F.col("DocType"))
    rows = raw.withColumns({"_standard": standard, "_scope": F.coalesce(scope, F.lit("consolidated"))})
    pick = lambda pair: n.scoped(F.col("_scope"), F.col(pair[0]), F.col(pair[1]))
    hashed = n.record_hash(*(F.col(c) for c in sorted(raw.columns) if c != "ingestion_run_id"))
    rows = rows.select(
        n.text(F.col("Code")).alias("jpx_code"),
        n.ticker_of(n.text(F.col("Code"))).alias("target_key"),
        F.lit(source).alias("source_key"),
        n.text(F.col("DiscNo")).alias("disclosure_number"),
        n.day(F.col("DiscDate")).alias("disclosed_date"),
        n.text(F.col("DiscTime")).alias("disclosed_time"),
        n.text(F.col("DocType")).alias("document_type"),
        n.text(F.col("CurPerType")).alias("fiscal_period_type"),
        *(n.day(F.col(f)).alias(c) for c, f in {"period_start": "CurPerSt", "period_end": "CurPerEn", "fiscal_year_start": "CurFYSt", "fiscal_year_end": "CurFYEn"}.items()),
        F.col("_standard").alias("accounting_standard"),
        F.col("_scope").alias("reporting_scope"),
        hashed.alias("source_record_hash"),
        "ingestion_run_id",
        *(n.whole(pick(p)).alias(c) for c, p in sorted(schemas.AMOUNTS.items())),
        *(n.number(pick(p)).alias(c) for c, p in sorted(schemas.PER_SHARE.items())),
    )
    return keep_last(rows, FINANCIAL_KEYS)


def build_master(raw: DataFrame) -> DataFrame:
    """The latest snapshot of the list of securities; rows without code or name go."""
    last = raw.agg(F.max("source_date").alias("_d"))
    rows = raw.join(F.broadcast(last), F.col("source_date") == F.col("_d")).drop("_d")  # one row
    return keep_last(rows.filter("jpx_code is not null and company_name is not null"), ["jpx_code"])


def incremental(base: DataFrame, fresh: DataFrame, keys: Sequence[str], run: str = "ingestion_run_id") -> DataFrame:
    """The base with what came after its highest run. Equals a rebuild from everything. The highest run is one value, joined as such."""
    last = base.agg(F.max(run).alias("_last"))
    newer = fresh.crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col(run) > F.col("_last"))).drop("_last")
    return keep_last(base.unionByName(newer), keys, run)


def insert_only_merge(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The target with the incoming rows whose key it lacks; of equal incoming keys one."""
    return target.unionByName(incoming.dropDuplicates([key]).join(target.select(key), key, "left_anti").select(*target.columns))


def source_counts(raw: DataFrame, built: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a build made of its input: records, rows, rows without a ticker, and records that others of their key replaced."""
    a = raw.agg(F.count(F.lit(1)).alias("records"))
    b = built.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("target_key").isNull()).alias("unmapped"))
    return a.crossJoin(b).withColumn("replaced", F.col("records") - F.col("rows"))

"""What providers send, as typed columns. Field names and code forms are fixed by the providers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Missing and empty are null."""
    return F.nullif(c.cast("string"), F.lit(""))


def number(c: Column) -> Column:
    return text(c).try_cast("double")


def whole(c: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(number(c).cast("decimal(38,6)"), 0).cast("long")


def day(c: Column) -> Column:
    return text(c).try_cast("date")


def flag(c: Column) -> Column:
    """0 and 1; anything else is null, and is_bad_flag tells it from a missing one."""
    return F.when(text(c) == "1", True).when(text(c) == "0", False)


def is_bad_flag(c: Column) -> Column:
    return F.coalesce(~text(c).isin("0", "1"), F.lit(False))


def ticker_of(code: Column) -> Column:
    """Five characters that end in 0 name a ticker of four; other codes have none."""
    return F.when((F.length(code) == 5) & code.endswith("0"), F.concat(F.substring(code, 1, 4), F.lit(".T")))


def code_of(ticker: Column) -> Column:
    """The code of a ticker of four characters with the exchange's ending."""
    return F.when(ticker.rlike(r"^[0-9A-Z]{4}\.T$"), F.concat(F.substring(ticker, 1, 4), F.lit("0")))



def _parts(document_type: Column) -> Column:
    return F.split(document_type, "_")


def reporting(document_type: Column, strict: bool = True) -> tuple[Column, Column]:
    """Accounting standard and reporting scope from a document type such as FYFinancialStatements_Consolidated_JP.

    strict: only of types that say FinancialStatements; else of all with three parts or more.
    """
    parts = _parts(document_type)
    ok = F.size(parts) >= 3
    if strict:
        ok = ok & F.contains(F.get(parts, F.lit(0)), F.lit("FinancialStatements"))
    reit = F.contains(document_type, F.lit("REIT"))
    scope = F.when(F.get(parts, F.lit(1)) == "Consolidated", "consolidated").when(F.get(parts, F.lit(1)) == "NonConsolidated", "non_consolidated")
    return F.when(ok, F.get(parts, F.lit(2))), F.when(reit & ~ok, "non_consolidated").when(ok, scope)


def scoped(scope: Column, consolidated: Column, alone: Column) -> Column:
    """The field of the scope; an unknown scope takes the consolidated one."""
    return F.when(scope == "non_consolidated", alone).otherwise(consolidated)


def available_at(disclosed: Column, time: Column, zone: str = "Asia/Tokyo") -> Column:
    """The moment of disclosure in UTC; a missing time counts as the day's end."""
    local = F.try_to_timestamp(F.concat_ws(" ", disclosed.cast("string"), F.coalesce(text(time), F.lit("23:59:59"))), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.to_utc_timestamp(local, zone)


def record_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON text, names in order; a null stands as null, so a field that turns null is told from one that goes."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)

"""The lake: three datasets under one root, and the definitions over them by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import security_key
from ..operators import comparisons, forecasts, prices, valuation
from . import schemas
from .snapshots import Dataset


@dataclass(frozen=True)
class Lake:
    """root: a path of any store that Spark reads."""

    spark: SparkSession
    root: str
    sources: tuple[str, ...] = (prices.PREFERRED,)

    def _read(self, path: str, schema: str) -> DataFrame:
        """The dataset's last snapshot if it has one, else its folder, where partition discovery gives year for pruning. The declared columns."""
        snapshots = Dataset(self.spark, f"{self.root.rstrip('/')}/{path}", ())
        if snapshots.numbers():
            return snapshots.read(schema)
        columns = [c.strip().split()[0] for c in schema.split(",")]
        return self.spark.read.schema(schema + ", year int").parquet(f"{self.root.rstrip('/')}/{path}").select(*columns)

    def observations(self) -> DataFrame:
        return self._read("observed/market_price", schemas.PRICE).withColumn("security_key", security_key())

    def disclosures(self) -> DataFrame:
        return self._read("observed/financial_summary", schemas.FINANCIAL).withColumn("security_key", security_key())

    def master(self) -> DataFrame:
        return self.spark.read.schema(schemas.MASTER).parquet(f"{self.root.rstrip('/')}/reference/security_master")

    def views(self) -> dict[str, Callable[[], DataFrame]]:
        return {"market_price": self.observations, "preferred_price": lambda: self.run("preferred_price"), "financial_disclosure": self.disclosures, "security_master": self.master}

    def bind(self, *names: str) -> None:
        """Temporary views of the session, for SQL: all datasets, or those named, so that the others need not be there."""
        views = self.views()
        if unknown := set(names) - set(views):
            raise KeyError(f"no dataset {', '.join(sorted(unknown))}; there are {', '.join(sorted(views))}")
        for name in names or views:
            views[name]().createOrReplaceTempView(name)

    def bind_files(self, name: str, glob: str, schema: str | None = None) -> None:
        """A view over the Parquet files of a pattern under the root."""
        read = self.spark.read.schema(schema) if schema else self.spark.read
        read.parquet(f"{self.root.rstrip('/')}/{glob}").createOrReplaceTempView(name)

    def run(self, name: str) -> DataFrame:
        """A definition as a lazy DataFrame; what it builds on is resolved along."""
        if name not in DEFINITIONS:
            raise KeyError(f"no definition {name!r}; there are {', '.join(sorted(DEFINITIONS))}")
        return DEFINITIONS[name](self)


DEFINITIONS: dict[str, Callable[[Lake], DataFrame]] = {
    "preferred_price": lambda k: prices.preferred_price(k.observations()),
    "daily_return": lambda k: prices.daily_return(k.run("preferred_price")),
    "point_in_time_pbr": lambda k: valuation.point_in_time_pbr(prices.preferred_price(k.observations(), by_day=True), k.disclosures(), k.sources),
    "point_in_time_forecast": lambda k: forecasts.point_in_time_forecast(k.disclosures()),
    "forecast_accuracy": lambda k: forecasts.forecast_accuracy(k.run("point_in_time_forecast"), k.disclosures()),
    "metric_comparison_input": lambda k: comparisons.metric_comparison_input(k.disclosures()),
}

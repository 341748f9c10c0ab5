"""The corpus queries against their oracles, on the smallest tables."""

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    ours = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert ours == sorted(tuple(str(r[found.columns.index(c)]) for c in columns) for r in found.fetchall())


def test_every_query_gives_each_row_once(spark):
    for name, table in (("op2_quality", "documents"), ("op3_html", "pages"), ("op4_bpe", "documents"), ("op6_language", "documents"), ("op8_pii", "documents"), ("op9_shards", "documents"), ("op13_substrings", "documents")):
        assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()

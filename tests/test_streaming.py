import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, ingest
from tidemark.streaming import latest

SCHEMA = "k string, ingestion_run_id long, v double, note string"


@pytest.mark.parametrize("seed", range(3))
def test_any_order_and_any_cut_end_in_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randint(0, 15)}", rng.choice([None, *range(40)]), rng.choice([None, rng.random()]), rng.choice("ab")) for _ in range(120)]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, 120), rng.randint(0, 4)))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 120], strict=True)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 1:  # a stream that stops and goes on
            latest.follow_latest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["k"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    latest.follow_latest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["k"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    right = ingest.keep_last(spark.createDataFrame(rows, SCHEMA), ["k"])
    found = latest.current(spark, str(tmp_path / "out"), SCHEMA, ["k"])
    assert checks.dataset_differences(found, right, F.lit("all")).count() == 0 and found.count() == right.count() > 10

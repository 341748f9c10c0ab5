import datetime as dt
import json

import pytest

from tidemark.plans import jobs, people
from tidemark.sources import demo

CONDITION = "array<struct<metric_key:string,comparison_type:string,operator:string,threshold_value:decimal(20,4)>>"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("people")
    lake = demo.build(spark, str(root / "lake"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(root / f"control/{name}"))
    old = dt.datetime(2000, 1, 1)
    rules = [(1, 1, False, "all", old, None, "revenue", "absolute", "gt", "0"), (1, 2, True, "all", old, None, "revenue", "absolute", "gt", "0"), (2, 1, True, "any", old, [("operating_income", "absolute", "gt", None), ("net_income", "absolute", "lt", None)], None, None, None, None), (3, 1, False, "all", old, None, "revenue", "absolute", "gt", "0")]
    from decimal import Decimal

    rules = [(*r[:5], None if r[5] is None else [(*c[:3], Decimal(0)) for c in r[5]], *r[6:9], None if r[9] is None else Decimal(r[9])) for r in rules]
    put("rules", rules, f"rule_id long, version_no long, enabled boolean, logic string, created_at timestamp, conditions {CONDITION}, metric_key string, comparison_type string, operator string, threshold_value decimal(20,4)")
    codes = sorted(r.security_key for r in lake.disclosures().select("security_key").distinct().collect())
    put("targets", list(enumerate(codes)), "target_id long, security_key string")
    put("scopes", [(1, "target", 0, None), (2, "theme", 7, None), (3, "target", 0, None)], "rule_id long, scope_type string, scope_id long, watchlist_status string")
    put("mandates", [], "mandate_id long, target_id long, effective_from date, effective_until date, status string, version_from date, version_until date")
    put("watchlist", [], "target_id long, status string")
    (root / "list.csv").write_text("jpx_code,industry\n" + "".join(f"{c},cars\n" for c in codes[1:]))
    return root, codes


def run(spark, capsys, root, *args):
    code = people.main([args[0], "--control", str(root / "control"), *args[1:]], spark)
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_lists_rules_and_queue(spark, kept, capsys):
    root, codes = kept
    take = ["import-members", "--list", str(root / "list.csv"), "--theme", "7", "--mode", "replace", "--as-of", "2020-01-01"]
    assert run(spark, capsys, root, *take) == (0, [{"added": len(codes) - 1}])
    assert run(spark, capsys, root, *take) == (jobs.NOTHING_NEW, [])
    (root / "list.csv").write_text(f"jpx_code,industry\n{codes[1]},cars\nX0000,ships\n")
    assert run(spark, capsys, root, *take[:-1], "2090-01-01", "--industry", "cars")[1] == [{"removed": len(codes) - 2, "unchanged": 1}]
    members = people.Control(spark, str(root / "control")).members()
    assert members.filter("valid_to is null").count() == 1 and members.count() == len(codes) - 1

    judge = ["evaluate", "--lake", str(root / "lake"), "--as-of", "2080-01-01"]
    code, lines = run(spark, capsys, root, *judge, "--run", "first")
    assert code == 0 and {x["rule_id"] for x in lines} == {1, 2}
    n = sum(x["n"] for x in lines)
    log = people.Control(spark, str(root / "control")).log()
    assert log.events().count() == n and {r.security_key for r in log.events().filter("rule_id = 1").collect()} == {codes[0]}
    assert {r.security_key for r in log.events().filter("rule_id = 2").collect()} <= set(codes[1:])
    assert run(spark, capsys, root, *judge, "--run", "again") == (0, [])
    assert run(spark, capsys, root, *judge, "--run", "replay", "--mode", "replay", "--rule-id", "1")[1][0]["rule_id"] == 1
    fired = log.events().filter("status = 'fired' and mode = 'live'").count()
    assert run(spark, capsys, root, "queue") == (0, [{"actionable": fired, "unhandled": fired}])

import gzip
import hashlib
import json
import random

import pytest

from tidemark.plans import jobs
from tidemark.sources import arrays
from tidemark.sources.lake import Lake


def value(rng, depth=0):
    kind = rng.randint(0, 5 if depth < 3 else 3)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == 5:
        return {rng.choice(['a"', "}", "{", "[b]", "\\"]) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    return [None, rng.random(), rng.choice(['}{"', "\\", '\\"}', "é\n,", ""]), True][kind]


def test_any_cut_gives_the_items():
    rng = random.Random(1)
    for _ in range(200):
        want = [{"k": value(rng)} for _ in range(rng.randint(0, 5))]
        text = json.dumps(want, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        s, got = arrays.Splitter(), []
        pieces = [p + "}" for p in text.split("}")]
        pieces[-1] = pieces[-1][:-1]
        for p in pieces:
            got += s.feed(p)
        s.close()
        assert [json.loads(x) for x in got] == want


@pytest.mark.parametrize("text", ["{}", '[1, {"a": 1}]', '["x"]', "[[]]", '[{"a": 1}', "", '[{"a": 1}] x', '[{"a": 1}][]', '{"data": []}', "null", '[{}, null]', "[}]"])
def test_what_is_no_array_of_objects_raises(text):
    with pytest.raises(ValueError, match="array"):
        s = arrays.Splitter()
        list(s.feed(text))
        s.close()


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()))
    return str(path)


def test_files_are_read_item_by_item(spark, tmp_path):
    big = json.dumps([{"k": i, "t": "x}" * (i % 50), "more": [{"a": i}]} for i in range(40_000)])
    texts = {"a/big.json.gz": big, "b/empty.json.gz": "[]", "b/one.json.gz": ' [ {"k": 1} ] \n'}
    for name, text in texts.items():
        put(tmp_path / name, text)
    found = arrays.items(spark, str(tmp_path)).collect()
    for name, text in texts.items():
        mine = [r for r in found if r.file.endswith(name)]
        end = next(r for r in mine if r.item is None)
        assert end.sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [json.loads(r.item) for r in sorted(mine, key=lambda r: r.position) if r.item is not None] == json.loads(text) and end.position == len(mine) - 1
    put(tmp_path / "c/bad.json.gz", '{"no": "array"}')
    with pytest.raises(Exception, match="no array of objects: file:.*bad.json.gz"):
        arrays.items(spark, str(tmp_path)).count()


def test_builds_without_paths_in_the_driver(spark, tmp_path):
    quote = lambda day, close: {"Date": day, "Code": "52340", "C": close, "AdjC": close, "UL": "0", "LL": "0"}
    paths = [put(tmp_path / f"raw/{i}.json.gz", json.dumps([quote(f"2026-07-0{i}", str(i))])) for i in (1, 2, 3)]
    runs = lambda *rows: spark.createDataFrame([(i, "j", "succeeded", p) for i, p in rows], "ingestion_run_id long, job_type string, status string, raw_path string")
    lake = Lake(spark, str(tmp_path / "lake"))
    assert jobs.build(lake, runs((1, paths[0]), (2, paths[1])), {"j": "s"}, raw_root=str(tmp_path / "raw"))[0]["records"] == 2
    assert sorted(r.close_price for r in lake.observations().collect()) == [1.0, 2.0]
    with pytest.raises(Exception, match="no such file"):
        jobs.build(lake, runs((3, str(tmp_path / "raw/gone.json.gz"))), {"j": "s"}, raw_root=str(tmp_path / "raw"))
    assert jobs.build(lake, runs((3, paths[2])), {"j": "s"}, raw_root=str(tmp_path / "raw"))[0]["rows"] == 1


def test_hashes_are_checked(spark, tmp_path):
    texts = {"a.json.gz": '[{"k": 1}, {"k": 2}]', "b.json.gz": '[{"k": 3}]'}
    paths = {n: put(tmp_path / n, t) for n, t in texts.items()}
    want = lambda **other: spark.createDataFrame([(paths[n], other.get(n[0], hashlib.sha256(t.encode()).hexdigest())) for n, t in texts.items()], "location string, sha256 string")
    found = arrays.items(spark, str(tmp_path))
    assert sorted(json.loads(r.item)["k"] for r in arrays.verified(found, want(b=None)).collect()) == [1, 2, 3]
    assert arrays.verified(found, want().filter("location like '%a.json.gz'")).count() == 2
    with pytest.raises(Exception, match="hash differs"):
        arrays.verified(found, want(b="0")).collect()
    with pytest.raises(Exception, match="hash differs or no file"):
        arrays.verified(found, want().union(spark.createDataFrame([("gone", "x")], "location string, sha256 string"))).collect()

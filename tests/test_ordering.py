import gzip
import json
import random

import pytest
from conftest import bodies, rows, uid

from paperloom.operators import ordering
from paperloom.plans import jobs
from paperloom.sources import documents


def docs(spark, names):
    lines = [{"file": f, "i": i} for i, f in enumerate(names)]
    return bodies(spark, lines).selectExpr("*", "from_json(body, 'file STRING').file AS file")


def test_unsigned_and_case_blind(spark):
    names = [f"{p}{uid(1)[2:]}.json" for p in ("ff", "80", "7f", "00", "AB", "aa")]
    got = [r.file[:2] for r in ordering.sort_by_uuid(docs(spark, names)).collect()]
    assert got == ["00", "7f", "80", "aa", "AB", "ff"]


def test_duplicates(spark):
    names = [uid(2) + ".json", uid(1) + ".a.json", uid(2) + ".b.json", uid(1) + ".c.json"]
    frame = docs(spark, names)
    order = [r.line_pos for r in ordering.sort_by_uuid(frame).collect()]
    assert order == [1, 3, 0, 2]
    last = ordering.sort_by_uuid(frame.repartition(3), on_duplicate="last").collect()
    assert [r.line_pos for r in last] == [3, 2]
    repeated = ordering.sort_by_uuid(frame, on_duplicate="repeat_last").collect()
    assert [r.file for r in repeated] == [names[3], names[3], names[2], names[2]]


def test_rows_without_key(spark):
    frame = docs(spark, [uid(1) + ".json", None, "short", "x" * 40])
    assert ordering.unkeyed(frame).count() == 3
    assert ordering.sort_by_uuid(frame).count() == 1
    with pytest.raises(Exception, match="row without a UUID"):
        ordering.sort_by_uuid(frame, strict=True).collect()


def test_position_is_the_global_order(spark):
    rng = random.Random(1)
    # a third of the rows share one key
    keys = [rng.randrange(1 << 128) for _ in range(2000)] + [5] * 1000
    rng.shuffle(keys)
    frame = docs(spark, [uid(k) + ".json" for k in keys]).repartition(6)
    got = ordering.with_position(ordering.sort_by_uuid(frame)).select("position", "file", "line_pos")
    want = sorted((uid(k) + ".json", i) for i, k in enumerate(keys))
    assert rows(got) == [(n, f, i) for n, (f, i) in enumerate(want)]


def test_sort_job(spark, tmp_path):
    rng = random.Random(2)
    names = [uid(rng.randrange(1 << 128)) + ".json" for _ in range(500)]
    path = tmp_path / "x.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.writelines(json.dumps({"file": n, "v": 1.5}) + "\n" for n in names)
    jobs.sort_jsonl(spark, str(path), str(tmp_path / "sorted"))
    read = []
    for part in sorted((tmp_path / "sorted").glob("part-*.gz")):
        with gzip.open(part, "rt") as f:
            read += [json.loads(line)["file"] for line in f]
    assert read == sorted(names)
    assert documents.scan_jsonl(spark, str(tmp_path / "sorted")).count() == 500


def test_order_key_sorts_as_its_columns(spark):
    data = [(p, b, n) for p in ("b", "a", None, "") for b in (0, 1 << 30, -5) for n in (7, None)]
    df = spark.createDataFrame(data, "file_path STRING, block_start BIGINT, line_pos INT")
    keyed = ordering.with_order_key(df, ("file_path", "block_start", "line_pos"))
    by_key = [tuple(r)[:3] for r in keyed.orderBy(ordering.ORDER_KEY).collect()]
    assert by_key == [tuple(r) for r in df.orderBy("file_path", "block_start", "line_pos").collect()]
    assert keyed.select(ordering.ORDER_KEY).distinct().count() == len(data)


def test_order_keys_that_do_not_fit(spark):
    wide = spark.createDataFrame([(1 << 62, 1 << 62), (0, 0)], "a BIGINT, b BIGINT")
    assert ordering.with_order_key(wide, ("a", "b")) is None
    assert ordering.with_order_key(wide.withColumn("c", wide.a.cast("double")), ("c",)) is None
    assert ordering.with_order_key(wide.limit(0), ("a", "b")).collect() == []


def test_bodies_are_in_no_aggregate(spark):
    docs = [(uid(k % 3) + ".json", "f", 0, k // 2, f"body {k}") for k in range(12)] + [(uid(9) + ".json", "f", 0, 0, "one")]
    df = spark.createDataFrame(docs, "file STRING, file_path STRING, block_start BIGINT, line_pos BIGINT, body STRING")
    last = ordering.last_per_key(ordering.with_key(df))
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    want = {}
    for file, _, _, at, body in docs:
        want[file] = max(want.get(file, (-1, "")), (at, body))
    assert {r.file: (r.line_pos, r.body) for r in last.collect()} == want


def test_spread_keeps_the_source_order(spark, tmp_path):
    lines = [json.dumps({"file": f"{uid(i % 5)}.json", "i": i}) for i in range(200)]
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    for n, spread in enumerate((None, 7)):
        out = str(tmp_path / f"out{n}")
        jobs.sort_jsonl(spark, str(tmp_path / "x.jsonl.gz"), out, "last", spread)
        assert sorted(json.loads(r.value)["i"] for r in spark.read.text(out).collect()) == list(range(195, 200))


@pytest.mark.parametrize("on_duplicate", ["keep", "last", "repeat_last"])
def test_a_sort_of_bodies_reads_a_table_and_not_its_source_twice(spark, on_duplicate):
    docs = [(uid(n) + ".json", n % 3, json.dumps({"n": n})) for n in (2, 1, 1, 1)]
    source = spark.createDataFrame(docs, "file STRING, place INT, body STRING")
    ordered = ordering.sort_by_uuid(source, ("place",), on_duplicate)
    assert ordered.inputFiles()  # none before for "keep", as rows came from the source itself
    n = {"keep": 4, "last": 2, "repeat_last": 4}[on_duplicate]
    assert [r.file for r in ordered.collect()] == [uid(1) + ".json"] * (n - 1) + [uid(2) + ".json"]

import gzip
import json

import pytest
from conftest import bodies, rows, uid
from pyspark.sql import functions as F

from paperloom.plans import jobs
from paperloom.sources import documents, sinks


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in dir"
    files = {
        f"00/{uid(1)}.json": {"year": 1999, "a": 1},
        f"00/{uid(1)}.software.json": {"mentions": [], "file": "old"},
        f"1e/deep/er/{uid(2)}.jats.software.json": '{"k": 1, "k": 2} trailing',
        f"1e/{uid(3)}.pub2tei.tei.software.json": "{bad",
        f"1e/{uid(4)}.latex.tei.software.json": "[1, 2]",
        f"1e/{uid(5)}.grobid.tei.software.json": '{"t": "<&>\\n\\"q\\"é"}',
        f"1e/{uid(6)}.other.json": {"x": 1},
        f"1e/{uid(7).upper()}.json".replace("7", "A"): {"x": 1},
        "1e/short.json": {"x": 1},
        f"1e/{uid(8)}.json.txt": {"x": 1},
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(root)


def test_scan_documents(spark, tree):
    found = documents.scan_documents(spark, tree)
    assert rows(found.select("shard", "kind", "paper_id")) == [
        ("00", "paper", uid(1)),
        ("00", "software", uid(1)),
        ("1e", "grobid", uid(5)),
        ("1e", "jats", uid(2)),
        ("1e", "latex", uid(4)),
        ("1e", "pub2tei", uid(3)),
    ]
    listed = documents.list_documents(spark, tree)
    assert rows(listed) == rows(found.drop("body"))
    assert documents.scan_documents(spark, tree, kinds=["paper"]).count() == 1
    assert documents.scan_documents(spark, tree, shards=["1e"]).count() == 4
    assert rows(documents.scan_documents(spark, "file://" + tree + "/").select("shard").distinct()) == [("00",), ("1e",)]


def test_tasks_list_and_read_a_tree(spark, tree, tmp_path, monkeypatch):
    odd = tmp_path / "in dir" / "a b" / "_hidden"
    odd.mkdir(parents=True)
    (odd / f"{uid(9)}.json").write_text("{}")
    (odd.parent / f".{uid(9)}.json").write_text("{}")
    (odd.parent / f"{uid(9)}.json").write_bytes(b'{"a": "\xff"}')
    (odd.parent / f"{uid(10)}.json").write_bytes(b"")
    (tmp_path / "in dir" / f"{uid(11)}.json").write_text("{}")
    as_bytes = lambda df: rows(df.select("shard", "file", "kind", "paper_id", F.hex(F.col("body").cast("binary"))).na.fill("none"))
    assert documents.scan_tree(spark, tree).inputFiles() == []  # no listing on the driver
    own = as_bytes(documents.scan_tree(spark, tree)), rows(documents.list_documents(spark, tree))
    monkeypatch.setattr(documents, "_listed", lambda *_: None)
    theirs = as_bytes(documents.scan_tree(spark, tree)), rows(documents.list_documents(spark, tree))
    assert [set(a) ^ set(b) for a, b in zip(own, theirs, strict=True)] == [set(), set()] and own == theirs


def test_malformed_documents_are_rejected_not_lost(spark, tree):
    found = documents.scan_documents(spark, tree)
    bad = documents.rejects(found)
    assert rows(bad.select("kind", "body")) == [("latex", "[1, 2]"), ("pub2tei", "{bad")]
    good = documents.drop_malformed(found)
    assert good.count() + bad.count() == found.count()
    # the last of two equal keys counts, text after the first value is ignored
    assert rows(good.where("kind = 'jats'").selectExpr("to_json(doc)")) == [('{"k":2}',)]
    with pytest.raises(Exception, match="not a JSON object"):
        documents.fail_on_malformed(found).collect()


def test_provenance_overwrites_the_file_key(spark, tree):
    good = documents.drop_malformed(documents.scan_documents(spark, tree))
    out = {r.kind: json.loads(r.body) for r in documents.with_provenance(good).collect()}
    assert out["software"] == {"mentions": [], "file": f"{uid(1)}.software.json"}
    assert out["paper"] == {"year": 1999, "a": 1, "file": f"{uid(1)}.json"}
    assert out["grobid"]["t"] == '<&>\n"q"é'


def test_compact_and_read_back(spark, tree, tmp_path):
    out = str(tmp_path / "merged")
    rejected = jobs.compact(spark, tree, out)
    assert rejected.count() == 2
    merged = documents.scan_merged(spark, out)
    assert rows(merged.select("shard", "kind")) == [
        ("00", "paper"), ("00", "software"), ("1e", "grobid"), ("1e", "jats"),
    ]
    assert merged.where("shard = '1e'").count() == 2
    assert list((tmp_path / "merged" / "shard=00" / "kind=paper").glob("*.gz"))
    assert jobs.pending(spark, tree, out).count() == 2
    assert jobs.processed(spark, tree, out).count() == 4
    assert jobs.removable(spark, tree).count() == 6


def test_two_kind_form(spark, tree, tmp_path):
    docs = documents.drop_malformed(documents.scan_documents(spark, tree))
    sinks.write_paper_and_software(documents.with_provenance(docs), str(tmp_path / "two"))
    found = documents.scan_merged(spark, str(tmp_path / "two"))
    assert rows(found.select("shard", "kind")) == [("00", "paper"), ("00", "software")]


def test_scan_jsonl(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"n": 1}\n\n{"n": 2}\n{"n": 3}')
    with gzip.open(folder / "b.jsonl.gz", "wt") as f:
        f.write('{"n": 4}\n{"n": 5}\n')
    found = documents.scan_jsonl(spark, str(folder)).withColumn(
        "n", F.get_json_object("body", "$.n").cast("int")
    )
    assert [r.n for r in found.orderBy(*documents.SOURCE_ORDER).collect()] == [1, 2, 3, 4, 5]
    parts = [str(folder / "a.jsonl"), str(folder / "b.jsonl.gz")]
    assert documents.scan_jsonl(spark, parts, spread=3).count() == 5


def test_line_order_across_splits(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    path.write_text("".join(f'{{"n": {i}}}\n' for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = documents.scan_jsonl(spark, str(path)).withColumn(
            "n", F.get_json_object("body", "$.n").cast("int")
        )
        assert found.rdd.getNumPartitions() > 4
        ordered = [r.n for r in found.repartition(7).orderBy(*documents.SOURCE_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == list(range(20000))


def test_scan_shards(spark, tmp_path):
    names = [
        "00.software.jsonl.gz", "ff.software.jsonl.gz", "x7a.software.jsonl.gz.old.gz", "0g.software.jsonl.gz",
        "00.jsonl.gz", "sub/01.software.jsonl.gz", "02.software.jsonl.gz.d/03.software.jsonl.gz",
    ]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        with gzip.open(path, "wt") as f:
            f.write(json.dumps({"at": name}) + "\n")
    found = documents.scan_shards(spark, str(tmp_path))
    at = sorted(json.loads(r.body)["at"] for r in found.collect())
    assert at == sorted([
        "00.software.jsonl.gz", "ff.software.jsonl.gz", "x7a.software.jsonl.gz.old.gz",
        "02.software.jsonl.gz.d/03.software.jsonl.gz",
    ])
    (row,) = jobs.profile_path(spark, str(tmp_path))[0].collect()
    assert (row.path, row.n, row.n_distinct) == (".at", 4, 4)
    (row,) = jobs.profile_path(spark, str(tmp_path / "00.jsonl.gz"))[0].collect()
    assert (row.path, row.n) == (".at", 1)


def test_decode(spark):
    docs = bodies(spark, ['{"file": "f", "year": 3, "x": {}}', '{"year": "no"}', "{bad", "{}"])
    found = documents.decode(docs, "file STRING, year INT").orderBy("line_pos").collect()
    assert [(r.file, r.year, r.bad_body is None) for r in found] == [
        ("f", 3, True), (None, None, False), (None, None, False), (None, None, True),
    ]
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.decode(docs, "file STRING, year INT", strict=True).collect()


def test_documents_beyond_the_engine_s_limits(spark):
    big, deep = "x" * 21_000_000, 1500
    bodies = {
        "a": '{"s":"' + big + '"}',
        "b": '{"d":' * deep + "1" + "}" * deep,
        "c": '{"file":"old","s":"' + big + '","n":12345678901234567890}',
        "d": '{"s":"' + big + '"',
        "e": '{"n":1e400}',
        "f": '{"n":-1E+999, "t":"Infinity"}',
        "g": '{"n":1e300, "t":"Infinity", "big":' + "9" * 400 + "}",
        "h": '{"n":1e300, "t":"Infinity"}',
        "i": '{"d":' * deep + "1" + "}" * (deep - 1),
        "j": "{}",
    }
    df = spark.createDataFrame(list(bodies.items()), "file STRING, body STRING")
    good, bad = documents.rewritten(documents.parsed(df))
    got = {r.file: r.body for r in good.collect()}
    assert sorted(got) == ["a", "b", "c", "h", "j"]
    assert got["a"] == bodies["a"][:-1] + ',"file":"a"}'
    assert got["b"].startswith('{"d":{"d":') and got["b"].endswith('},"file":"b"}')
    assert json.loads(got["c"])["file"] == "c" and json.loads(got["c"])["n"] == 12345678901234567890
    assert json.loads(got["h"]) == {"n": 1e300, "t": "Infinity", "file": "h"}
    assert json.loads(got["j"]) == {"file": "j"}
    assert {r.file: r.body for r in bad.collect()} == {k: bodies[k] for k in "defgi"}


def test_files_of_one_name_in_two_folders_keep_their_order(spark, tmp_path):
    for folder, n in (("b", 2), ("a", 1)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.jsonl").write_text("".join(f'{{"n": {n}{i}}}\n' for i in range(3)))
    for paths in (["b", "a"], ["a", "b"]):
        lines = documents.scan_jsonl(spark, [str(tmp_path / p) for p in paths])
        for n in (1, 5):
            ordered = lines.repartition(n).orderBy(*documents.SOURCE_ORDER).collect()
            assert [json.loads(r.body)["n"] for r in ordered] == [10, 11, 12, 20, 21, 22]


def test_overflows_are_looked_for_once_and_in_numbers(spark, capsys):
    uuid = "aaaaaaa3-e123-4e56-8e99-1e1234567890"
    wide = "1" * 250 + "." + "2" * 309 + "e99"
    bad = ['{"a":1e400}', '{"a": -1E+400}', '{"a":[1,2.5e0999]}', f'{{"a":{"9" * 310}}}', f'{{"a":{wide}}}', f'{{"f":"{uuid}","a":\n1e999}}']
    good = [f'{{"file":"{uuid}.json"}}', '{"a":1e300}', '{"a":1e-400}', '{"a":"1e400 ,1e400"}', '{"a":"Infinity","b":"x, 2e999"}']
    docs = spark.createDataFrame([(b,) for b in bad + good], "body STRING")
    assert {r.body for r in documents.rejects(docs).collect()} == set(bad)
    kept = documents.drop_malformed(docs)
    assert {r.body for r in kept.collect()} == set(good)
    kept.select(F.try_variant_get("doc", "$.file", "string")).explain()
    assert capsys.readouterr().out.count("RLIKE") == 1

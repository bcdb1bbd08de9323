import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import warc as A

KIND = "key BIGINT, record_id STRING, target_uri STRING, warc_date STRING, content_type STRING, payload BINARY, n INT"


def records(spark, rows):
    full = [
        (k, f"urn:page:{k}", u, "2024-01-01T00:00:00Z", "text/html", None if p is None else bytearray(p.encode()), 0)
        for k, u, p in rows
    ]
    return A.with_revisits(spark.createDataFrame(full, KIND))


ROWS = [
    (1, "http://a/1", "x" * 2000),
    (2, "http://a/2", "x" * 2000),
    (3, None, "short"),
    (4, "http://b/4", "short"),
    (5, "http://b/5\r\nX: y", None),
    (6, "http://b/6", "WARC/1.1\r\n\r\n" + "é" * 700),
    (7, "http://c/7", "x" * 2000),
    (7, "http://c/7", "x" * 2000),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    A.write_warc(records(spark, ROWS), path)
    return path


def test_round_trip(spark, archive):
    got = A.read_warc(spark, archive).collect()
    assert len(got) == 8
    for r in got:
        payload = (next(p for k, _, p in ROWS if r.record_id == f"urn:page:{k}") or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in got if r.record_type == "revisit")
    assert kinds == [(f"urn:page:{k}", "revisit", "urn:page:7") for k in (1, 2)]
    assert {r.target_uri for r in got} == {u and u.replace("\r\n", " ") for _, u, _ in ROWS}


def test_filters_and_headers_only(spark, archive):
    df = A.read_warc(spark, archive)
    some = df.where("record_type = 'revisit'")
    assert sorted(r.record_id for r in some.collect()) == ["urn:page:1", "urn:page:2"]
    assert df.where("record_id IN ('urn:page:3', 'urn:page:9')").count() == 1
    assert df.where(F.col("target_uri").startswith("http://b/")).count() == 3
    bare = A.read_warc(spark, archive, payload="false").collect()
    assert len(bare) == 8 and all(r.payload is None for r in bare)


def test_refused_payloads_are_not_inflated(archive, monkeypatch):
    reader = A.WarcReader({"path": archive}, A.StructType.fromDDL(A.SCHEMA))
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_bytes",), 3)])) != []
    seen = []
    monkeypatch.setattr(A, "finished", lambda row, block: seen.append(row["record_type"]) or row | {"payload": None, "payload_bytes": 0})
    for p in reader.partitions():
        list(reader.read(p))
    assert seen == ["revisit"] * 2


def test_ranges_have_every_record_once(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i} " * (i % 50) * 20) for i in range(300)]
    A.write_warc(records(spark, rows).coalesce(1), str(tmp_path / "w"), fileBytes="20000")
    for split in ("500", "3000", "1000000"):
        df = A.read_warc(spark, str(tmp_path / "w"), splitBytes=split)
        assert sorted(r.record_id for r in df.collect()) == sorted(f"urn:page:{i}" for i in range(300))


def test_archives_of_other_writers(spark, tmp_path):
    row = {"record_type": "response", "record_id": "urn:x:1", "target_uri": "http://x/", "warc_date": "d", "content_type": "t/p"}
    raws = []
    for i in range(3):
        payload = b"p" * (10 + i * 100000)
        raws.append(A.record(row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": "00" * 20, "refers_to": None}))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(info + b"".join(raws))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [info, *raws]))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(info + b"".join(raws)))
    for name in ("plain.warc", "members.warc.gz", "one.warc.gz"):
        df = A.read_warc(spark, str(tmp_path / name))
        assert sorted(r.payload_bytes for r in df.collect()) == [4, 10, 100010, 200010]
        assert [r.payload_bytes for r in df.where("record_type = 'warcinfo'").collect()] == [4]


def test_only_committed_files_are_read(spark, archive, tmp_path):
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(archive, copy)
    part = next(copy.glob("*.warc.gz"))
    (copy / "part-of-a-lost-attempt.warc.gz").write_bytes(part.read_bytes())
    assert A.read_warc(spark, str(copy)).count() == 8


def test_empty_table_and_null_keys(spark, tmp_path):
    A.write_warc(records(spark, []), str(tmp_path / "none"))
    assert A.read_warc(spark, str(tmp_path / "none")).count() == 0
    null = records(spark, [(None, "u", "y" * 1500), (None, "u", "y" * 1500)])
    assert {(r.record_type, r.refers_to) for r in null.collect()} == {("response", None)}
    mixed = records(spark, [(None, "u", "y" * 1500), (4, "u", "y" * 1500)])
    assert {(r.key, r.record_type, r.refers_to) for r in mixed.collect()} == {(None, "revisit", "urn:page:4"), (4, "response", None)}

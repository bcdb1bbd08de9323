import gzip
import json

import pytest
from conftest import bodies, rows, uid
from pyspark.sql import functions as F

from paperloom.operators import mentions
from paperloom.plans import jobs
from paperloom.sources import typed


def mention(name, wikidata=None, kind=None):
    m = {"software-name": {"normalizedForm": name}, "extra": [1]}
    if wikidata is not None:
        m["software-name"]["wikidataId"] = wikidata
    if kind is not None:
        m["software-type"] = kind
    return m


def doc(n, *ms):
    return {"file": f"{uid(n)}.software.json", "mentions": list(ms), "other": {"a": 1}}


def test_explode_keeps_every_mention(spark):
    docs = typed.decode_mentions(bodies(spark, [doc(1, mention("R"), mention("R")), doc(2), {"file": "x", "mentions": [{}]}]))
    found = mentions.explode_mentions(docs)
    assert rows(found.select("line_pos", "mention_pos", "normalizedForm", "wikidataId", "softwareType")) == [
        (0, 0, "R", "", ""), (0, 1, "R", "", ""), (2, 0, "", "", ""),
    ]
    assert rows(mentions.project_mentions(found)) == [(uid(1), "R")] * 2
    assert rows(mentions.unidentified(docs).select("file")) == [("x",)]


def test_first_mention_describes_the_software(spark):
    a = bodies(spark, [doc(1, mention("R", "Q1", "env"), mention("R", "Q2")), doc(2, mention("S"))])
    b = bodies(spark, [doc(3, mention("S", "Q9"), mention("R", "Q0"))]).withColumn("file_path", F.lit("a"))
    exploded = mentions.explode_mentions(typed.decode_mentions(a.unionByName(b)))
    # file "a" is before file "f", whatever the order of rows
    assert rows(mentions.software_dimension(exploded.repartition(3))) == [("R", "Q0", ""), ("S", "Q9", "")]
    only = mentions.explode_mentions(typed.decode_mentions(a))
    assert rows(mentions.software_dimension(only)) == [("R", "Q1", "env"), ("S", "", "")]


def test_years(spark):
    docs = bodies(spark, [{"file": uid(1) + ".json", "year": y} for y in (0, 65535, 65536, -1)] + [{"file": uid(2) + ".json"}])
    papers = typed.decode_papers(docs)
    assert rows(mentions.project_papers(papers).select("year")) == [(0,), (0,), (65535,)]
    with pytest.raises(Exception, match="bad paper row"):
        mentions.project_papers(papers, strict=True).collect()


def test_counts_are_raw(spark):
    docs = typed.decode_mentions(bodies(spark, [doc(1, mention("b"), mention("b"), mention("code")), doc(2, mention("a"))]))
    report = mentions.order_report(mentions.mention_counts(mentions.explode_mentions(docs)), "normalizedForm")
    assert [tuple(r) for r in report.collect()] == [("b", 2), ("a", 1), ("code", 1)]


def test_extract_and_count_jobs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for shard in range(2):
        lines = [doc(100 * shard + i, mention("R", f"Q{shard}"), mention("S"), mention("R")) for i in range(60)]
        with gzip.open(folder / f"0{shard}.software.jsonl.gz", "wt") as f:
            f.write("\n".join(json.dumps(x) for x in lines))
    jobs.extract_software(spark, str(folder), str(tmp_path / "out"))
    table = typed.read_table(spark, str(tmp_path / "out"), "mentions")
    software = typed.read_table(spark, str(tmp_path / "out"), "software")
    assert table.count() == 360
    assert rows(software) == [("R", "Q0", ""), ("S", "", "")]
    assert rows(mentions.mentions_with_software(table, software).groupBy("wikidataId").count()) == [("", 120), ("Q0", 240)]
    n, top, together = jobs.count_mentions(spark, str(tmp_path / "out"))
    assert rows(n) == [(2,)] and rows(top) == [(0, "R", 120), (1, "S", 120)]
    assert rows(together) == [("R", "S", 120)]

    (folder / "papers.jsonl").write_text(json.dumps({"file": uid(1) + ".json", "year": 2001}))
    jobs.extract_papers(spark, str(folder / "papers.jsonl"), str(tmp_path / "out"))
    assert rows(typed.read_table(spark, str(tmp_path / "out"), "papers")) == [(uid(1), 2001)]


def test_extract_stops_on_bad_input(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    good = json.dumps(doc(1, mention("R")))
    for i, bad in enumerate(["{bad", json.dumps({"file": "short", "mentions": [mention("R")]})]):
        path.write_text(good + "\n" + bad + "\n")
        with pytest.raises(Exception, match="(?i)malformed|without a paper id"):
            jobs.extract_software(spark, str(path), str(tmp_path / f"strict{i}"))
        jobs.extract_software(spark, str(path), str(tmp_path / f"lax{i}"), strict=False)
        assert rows(typed.read_table(spark, str(tmp_path / f"lax{i}"), "mentions")) == [(uid(1), "R")]


def test_convert_mentions_job(spark, tmp_path):
    tree = tmp_path / "tree" / "ab"
    tree.mkdir(parents=True)
    (tree / f"{uid(1)}.software.json").write_text(json.dumps({"mentions": [mention("R"), mention("R"), mention("S")]}))
    (tree / f"{uid(2)}.grobid.tei.software.json").write_text("{}")
    (tree / f"{uid(3)}.json").write_text("{}")
    (tree / "short.software.json").write_text("{bad")
    jobs.convert_mentions(spark, str(tmp_path / "tree"), str(tmp_path / "out"), str(tmp_path / "counts"))
    stored = typed.read_paper_mentions(spark, str(tmp_path / "out"))
    got = {bytes(r.id).hex()[-1]: [m.normalized_form for m in r.mentions] for r in stored.collect()}
    assert got == {"1": ["R", "R", "S"], "2": []}
    assert [r.value for r in spark.read.text(str(tmp_path / "counts")).collect()] == ["R;2", "S;1"]
    (tree / f"{'z' * 36}.software.json").write_text("{}")
    with pytest.raises(Exception, match="not a UUID"):
        jobs.convert_mentions(spark, str(tmp_path / "tree"), str(tmp_path / "out2"))

import json

import pytest
from conftest import bodies, rows, uid
from pyspark.sql import functions as F

from paperloom.functions import identifiers as ids
from paperloom.operators import identifiers as ops
from paperloom.operators import licences
from paperloom.plans import jobs
from paperloom.schemas import LICENCES
from paperloom.sources import typed

ISTEX = "4B98414E076FB3C1053BA36A5A2A7C2FA4ED35A1"
GOOD = {"id": uid(10), "doi": "10.1/x", "arxiv": "arXiv:1501.00001", "pmid": "12862144",
        "pmcid": "PMC6665909", "istexId": ISTEX, "resources": ["json", "pdf", "latex", "xml"],
        "license": "cc-by", "oa_link": "https://x"}


def ident(spark, *docs):
    return typed.decode_paper_ids(bodies(spark, docs))


def test_good_row(spark):
    (r,) = ops.normalise_paper_ids(ident(spark, GOOD)).collect()
    assert bytes(r.id).hex() == uid(10).replace("-", "")
    assert (r.pmid, r.pmcid, bytes(r.istex_id).hex().upper()) == (12862144, 6665909, ISTEX)
    assert (r.resources, r.license) == ([1, 2, 3, 4], 1)
    assert ops.roundtrip_mismatches(ident(spark, GOOD)).count() == 0
    (back,) = ops.denormalise_paper_ids(ops.normalise_paper_ids(ident(spark, GOOD))).collect()
    assert back.asDict() == GOOD


def test_missing_fields(spark):
    (r,) = ops.normalise_paper_ids(ident(spark, {"id": uid(1)})).collect()
    assert (r.doi, r.pmid, r.pmcid, r.istex_id, r.resources, r.license) == ("", None, None, None, [], 0)
    assert ops.roundtrip_mismatches(ident(spark, {"id": uid(1)})).count() == 0


@pytest.mark.parametrize(
    "field,value",
    [("pmcid", "PMC1.2"), ("pmcid", "PM"), ("pmcid", "PMC"), ("pmcid", "PMC-4"), ("pmid", "-1"),
     ("pmid", "2147483648"), ("pmid", " 1"), ("pmid", "1e3"), ("pmid", "9" * 50), ("istexId", ISTEX[1:]),
     ("istexId", "G" + ISTEX[1:]), ("resources", ["json", "epub"]), ("license", "CC-BY"),
     ("license", "CC by"), ("id", "x"), ("id", ""), ("id", uid(1)[:-1]), ("id", "(" + uid(1) + ")")],
)
def test_bad_fields_are_named(spark, field, value):
    docs = ident(spark, {**GOOD, field: value}, GOOD)
    (r,) = ops.paper_id_errors(docs).collect()
    assert r.errors == [field]
    assert ops.normalise_paper_ids(docs).count() == 1
    with pytest.raises(Exception, match=f"bad fields: {field}"):
        ops.normalise_paper_ids(docs, strict=True).collect()


@pytest.mark.parametrize(
    "field,value,after",
    [("pmid", "007", "7"), ("pmid", "+7", "7"), ("pmid", "-0", "0"), ("pmcid", "ABC12", "PMC12"), ("istexId", ISTEX.lower(), ISTEX),
     ("id", uid(10).upper().replace("A", "A"), uid(10)), ("id", "{" + uid(10) + "}", uid(10)),
     ("id", "URN:UUID:" + uid(10), uid(10)), ("id", uid(10).replace("-", ""), uid(10))],
)
def test_lossy_forms_are_reported(spark, field, value, after):
    docs = ident(spark, {**GOOD, field: value})
    assert ops.paper_id_errors(docs).count() == 0
    (r,) = ops.roundtrip_mismatches(docs).collect()
    assert (r.field, r.before, r.after) == (field, value, after)


def test_every_licence_spelling(spark):
    spellings = [(label, code) for code, label, _ in LICENCES]
    spellings += [(alias, code) for code, _, alias in LICENCES if alias]
    assert len(spellings) == 24
    docs = ident(spark, *[{"id": uid(i), "license": s} for i, (s, _) in enumerate(spellings)])
    stored = ops.normalise_paper_ids(docs)
    assert sorted(r.license for r in stored.collect()) == sorted(c for _, c in spellings)
    assert ops.roundtrip_mismatches(docs).count() == 0
    labels = stored.select(ids.licence_label(F.col("license"))).distinct()
    assert labels.count() == 17


def test_histogram_has_all_licences(spark):
    docs = ident(spark, *[{"id": uid(i), "license": s} for i, s in enumerate(["CC0", "cc0", "pd", ""])])
    found = [tuple(r) for r in licences.licence_histogram(ops.normalise_paper_ids(docs)).collect()]
    assert len(found) == 17
    assert found[:4] == [(7, "cc0", 2), (0, "", 1), (10, "pd", 1), (1, "cc-by", 0)]


def test_convert_job(spark, tmp_path):
    path = tmp_path / "ids.jsonl"
    lines = [GOOD, {**GOOD, "id": uid(2), "pmid": "01", "license": "CC BY"}]
    path.write_text("\n".join(json.dumps(x) for x in lines))  # no newline at the end
    lossy = jobs.convert_paper_ids(spark, str(path), str(tmp_path / "out"), oa_link=False)
    assert rows(lossy.select("id", "field")) == [(uid(2), "pmid")]
    stored = typed.read_paper_ids(spark, str(tmp_path / "out"))
    assert stored.count() == 2 and rows(stored.select("oa_link").distinct()) == [("",)]
    assert jobs.count_licences(spark, str(tmp_path / "out")).first().n == 2
    with pytest.raises(ValueError):
        jobs.convert_paper_ids(spark, str(tmp_path / "ids.json"), str(tmp_path / "o2"))

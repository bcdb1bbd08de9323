import importlib
import random

import pytest

import corpus_pipeline as P
from paperloom.llm.queries import vocabulary

from .fixtures import components, shingle_set, tiktoken_of

SF = "/root/testdata/sf0.001"


def test_stages_have_their_order():
    assert [n for n, _ in P.STAGES] == ["language", "near_copies", "decontamination", "personal_data", "bpe"]
    assert P.ORACLE_SQL is None


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Documents with copies, a benchmark passage, personal data, junk, nulls and repeats."""
    rng = random.Random(8)
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [tuple(r) for r in real]
    base = max(rows, key=lambda r: r[4])[1].split()[:300]
    near = " ".join(w if rng.random() > 0.01 else "changed" for w in base)
    rows += [(9001, " ".join(base), "en", "s", 1), (9002, near, "en", "s", 1), (9003, " ".join(base), "en", "s", 1)]
    rows += [(9004, "of the and " + item + " by the of", "en", "s", 1)]
    rows += [(9005, "the of and was thonre mail me@ex.org by the that", "en", "s", 1)]
    rows += [(9006, "12345 %%%", "en", "s", 1), (9007, None, None, None, None), (9008, "", "en", "s", 0)]
    rows += [(9009, "the that was there of and in to thre", "en", "s", 1)] * 2 + [(None, "and by the thion of an inthe was", None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(path)
    return spark.read.parquet(path)


def test_each_stage(spark, docs, tmp_path):
    taken, before = {}, docs
    for name, function in P.STAGES:
        out = function(spark, before, SF)
        assert name == "bpe" or out.columns == list(P.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        taken[name] = (before.collect(), after.collect())
        before = after
    ids = lambda rows: sorted(str(r.doc_id) for r in rows)
    before, after = taken["language"]
    assert {"9006", "9007", "9008"} == set(ids(before)) - set(ids(after))
    # one row of each group by brute force
    before, after = taken["near_copies"]
    sets = [shingle_set(r.text, 5) for r in before]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    root = components(len(sets), links)
    groups = {}
    for r, k in zip(before, root, strict=True):
        groups.setdefault(k, set()).add(r.text)
    assert len(after) == len(groups)
    assert all(sum(r.text in g for r in after) == 1 for g in groups.values())
    before, after = taken["decontamination"]
    assert "9004" in ids(before) and "9004" not in ids(after) and "9005" in ids(after)
    before, after = taken["personal_data"]
    assert ids(before) == ids(after)
    changed = next(r for r in after if r.doc_id == 9005)
    assert "<email>" in changed.text and "@" not in changed.text and changed.n_chars == len(changed.text)
    before, after = taken["bpe"]
    assert ids(before) == ids(after)

    exact = tiktoken_of(*vocabulary())
    by_id = {r.doc_id: r for r in after}
    assert all(by_id[r.doc_id].ids == exact.encode_ordinary(r.text or "") for r in before)


def test_empty_table(spark, docs, tmp_path):
    before = docs.limit(0)
    for name, function in P.STAGES:
        function(spark, before, SF).write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
    assert before.count() == 0


def test_query_is_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    out = entry.queries()["pipeline"](spark, SF)
    assert 0 < out.count() <= 200 and "ids" in out.columns


def test_rows_keep_their_ids_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    """As after the loss of an executor: the scan after the links packs the files otherwise."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(i, text(i % 20), "en", "s", 1) for i in range(24)]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    path, key = str(tmp_path / "d"), "spark.sql.files.minPartitionNum"
    spark.createDataFrame(rows, schema).repartition(8, "doc_id").write.parquet(path)
    whole = P.near_copies.near_copies

    def then_split(*args, **kwargs):
        found = whole(*args, **kwargs)
        spark.conf.set(key, "1")
        return found

    monkeypatch.setattr(P.near_copies, "near_copies", then_split)
    spark.conf.set(key, "8")
    try:
        got = [r.text for r in P.one_of_near_copies(spark, spark.read.parquet(path), SF).collect()]
    finally:
        spark.conf.unset(key)
    assert sorted(got) == sorted(text(i) for i in range(20))

from types import SimpleNamespace

import pytest
from conftest import rows

from paperloom import session


def fake(folder, master, app="a1"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=app),
    )


def test_shared_folder_is_the_cluster_s():
    assert session.shared_folder(fake("hdfs:///shared/", "spark://x")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(None, "spark://x"))
    own = session.shared_folder(fake(None, "local[2]"))
    assert own == session.shared_folder(fake(None, "local[2]"))
    assert own != session.shared_folder(fake(None, "local[2]", "a2"))


def test_stage_and_drop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    df = session.stage(spark.range(10).selectExpr("id", "cast(id as string) s"), "t")
    assert df.count() == 10 and df.inputFiles()[0].startswith(f"file://{tmp_path}")
    session.drop_staged(spark)
    assert not list((tmp_path / "paperloom").iterdir())


def test_spread_only_few_files(spark, tmp_path):
    for n, parts in ((1, 4), (6, None)):
        spark.range(100).repartition(n).write.parquet(str(tmp_path / str(n)))
        df = spark.read.parquet(str(tmp_path / str(n)))
        dealt = session.spread(df)
        assert dealt.rdd.getNumPartitions() == (parts or df.rdd.getNumPartitions())
        assert rows(dealt) == rows(df)


def test_spread_deals_large_files_over_more_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b [1]%20"
    spark.range(1000).repartition(6).write.parquet(str(folder / "t"))
    df = spark.read.parquet(str(folder / "t").replace("[", "\\[").replace("]", "\\]"))
    size = sum(f.stat().st_size for f in (folder / "t").glob("*.parquet"))
    monkeypatch.setattr(session, "DEALT_BYTES", size // 20)
    dealt = session.spread(df)
    assert dealt.rdd.getNumPartitions() in (20, 21)
    assert rows(dealt) == rows(df)


def test_job_folder_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    with session.job_folder(spark) as job:
        path = session.stage(spark.range(3), "t").inputFiles()[0]
        assert job in path and session.stage(spark.range(3), "t").count() == 3
    assert job not in session.stage(spark.range(3), "t").inputFiles()[0]
    assert not list(tmp_path.glob(f"paperloom/*/{job}"))


def test_local_session_has_its_folder(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")

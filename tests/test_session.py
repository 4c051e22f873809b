"""Session helpers: broadcast proofs, source spreading, written intermediates, package shipping."""

import os

import pytest

from skillsift import session as ss


def test_checked_broadcast_respects_bound(spark):
    df = spark.range(10)
    _, small = ss.checked_broadcast(df, 10)
    assert small
    _, small = ss.checked_broadcast(df, 9)
    assert not small
    _, small = ss.checked_broadcast(df, 5, known_rows=3)  # a proven bound replaces the count
    assert small


def test_checked_broadcast_counts_bytes(spark):
    from pyspark.sql import functions as F
    wide = spark.range(4).select(F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit(1)).alias("a"))
    assert ss.checked_broadcast(wide, 10, max_bytes=10_000)[1]
    assert not ss.checked_broadcast(wide, 10, max_bytes=3_000)[1]
    assert not ss.checked_broadcast(wide, 10, known_rows=4, known_bytes=20_000, max_bytes=10_000)[1]


class _Context:
    """A stand-in for a cluster session's context without a checkpoint folder."""
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}


def test_cluster_without_shared_folder_is_refused():
    class Session:
        sparkContext = _Context()
        conf = {}
    with pytest.raises(RuntimeError):
        ss.ensure_checkpoint_dir(Session())
    for master in ("local-cluster[2,1,1024]", "yarn", "k8s://x"):
        _Context.master = master
        with pytest.raises(RuntimeError):
            ss.ensure_checkpoint_dir(Session())


def test_clean_scratch_removes_own_folders(spark, tmp):
    kept = dict(ss._OWN)
    ss._OWN.clear()
    try:
        spark.range(3).write.parquet(f"{tmp}/other")
        m = ss.materialize(spark.range(5), spark, "scratch-test")
        assert m.count() == 5
        assert ss.clean_scratch(spark) == 1 and ss.clean_scratch(spark) == 0
        assert spark.read.parquet(f"{tmp}/other").count() == 3
    finally:
        ss._OWN.update(kept)


def test_balance_only_spreads_under_split_sources(spark, tmp):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp}/one")
    spark.range(1000).repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{tmp}/many")
    one = ss.balance(spark.read.parquet(f"{tmp}/one"), "id")
    many = spark.read.parquet(f"{tmp}/many")
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert ss.balance(many, "id") is many
    assert one.count() == 1000


def test_materialize_writes_under_checkpoint_or_path(spark, tmp):
    base = ss.ensure_checkpoint_dir(spark)
    m = ss.materialize(spark.range(5), spark, "t")
    path_part = base.split(":", 1)[-1].lstrip("/")  # file:/x and file:///x name the same folder
    assert m.count() == 5 and all(path_part in f for f in m.inputFiles())
    p = os.path.join(tmp, "explicit")
    m2 = ss.materialize(spark.range(3), spark, "t", p)
    assert m2.count() == 3 and all(p in f for f in m2.inputFiles())


def test_ship_package_once(spark):
    ss.ship_package(spark)
    ss.ship_package(spark)
    assert spark.sparkContext.applicationId in ss._SHIPPED

"""Steps whose shuffles, spills and files must not outgrow the input."""

import os

from pyspark.sql import functions as F

from skillsift import session
from skillsift.operators import index as ix
from skillsift.operators import skills as sk
from skillsift.plans import etl, landing

from .conftest import SF0001, rows


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_skill_candidates_are_verified_in_their_documents_row(spark):
    skills = spark.createDataFrame([(1, "deep machine learning"), (2, "data analysis"), (3, "sql")], "skill_id long, phrase string")
    docs = spark.createDataFrame([(1, "learning machine, deep"), (1, "SQL"), (2, "analysis of data"), (None, "sql")],
                                 "doc_id long, text string")
    got = sk.extract_skills(docs, "doc_id", "text", skills)
    assert rows(got) == [(None, ""), (1, "deep machine learning, sql"), (1, "deep machine learning, sql"), (2, "data analysis")]
    pairs = sk.skill_pairs(docs, "doc_id", "text", skills)
    assert "hashpartitioning" not in _plan(pairs).split("== Physical Plan ==")[1]


def test_runs_count_terms_inside_the_row(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, "aa"), (2, None), (None, "aa aa"), (3, "")],
                                 "id long, t string")
    got = ix.doc_runs(docs, "id", "t").select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.term", "r.tf")
    assert rows(got) == rows(ix.doc_term_tf(docs, "id", "t"))
    alone = ix.doc_runs(docs.where("id = 2 or id = 3"), "id", "t", (1, 2), unique=True)
    assert [r["runs"] for r in alone.collect()] == [[("aa", 1)]]


def test_index_is_the_same_past_the_broadcast_bound(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, "aa dd"), (None, "aa ee")], "id long, t string")
    near, far = (ix.fit_course_index(docs, "id", "t", vocab_broadcast_rows=n).postings.withColumn("weight", F.round("weight", 9))
                 for n in (100, 2))
    assert rows(near) == rows(far) and near.count() == 7


def test_only_rare_keys_are_shuffled(spark):
    big = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 9)], "k string, v int")
    dim = spark.createDataFrame([("a", 8, 1.0), ("b", 1, 2.0)], "k string, f long, w double")
    out = ix.split_hot_join(big, dim, "k", "f", ["w"], 2)
    assert "LeftAnti" in _plan(out)
    assert rows(out) == [("a", i, 1.0) for i in range(8)] + [("b", 9, 2.0)]


def test_balance_grows_with_the_bytes(spark, tmp, monkeypatch):
    spark.range(50_000).coalesce(1).write.parquet(f"{tmp}/t")
    monkeypatch.setattr(session, "BALANCED_BYTES", 10_000)
    assert session.balance(spark.read.parquet(f"{tmp}/t"), "id").rdd.getNumPartitions() > 10


def test_landings_are_compressed(spark, tmp):
    landing.land_job_details(spark, SF0001, f"{tmp}/details")
    assert all(f.endswith((".gz", ".crc", "_SUCCESS")) for f in os.listdir(f"{tmp}/details"))


def test_written_orders_repeated_ids_only(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS growth_db")
    spark.createDataFrame([("a", "old", "20240101"), ("a", "new", "20240102"), ("b", "one", "20240101"),
                           ("c", "other", "20240101")], "k string, v string, load_date string") \
        .write.mode("overwrite").saveAsTable("growth_db.silver")
    delta = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(etl._written(spark, "growth_db.silver", delta, "k").select("k", "v")) == [("a", "new"), ("b", "one")]
    once = etl._written(spark, "growth_db.silver", delta.where("k = 'b'"), "k")
    assert rows(once.select("k", "v")) == [("b", "one")] and "Window" not in _plan(once)

"""Steps that must not leave files behind, and texts that must not travel twice."""

import os
import time

from pyspark.sql import functions as F

from skillsift import session as ss
from skillsift.functions.text import PY_WHITESPACE_CLASS, strip_non_alnum
from skillsift.operators import delta as dl
from skillsift.plans import etl

from .conftest import rows


def test_kept_characters_are_the_same_ones(spark):
    codes = [i for i in range(0x10000) if not 0xD800 <= i < 0xE000] + [0x1F600, 0x10FFFF]
    d = spark.createDataFrame([(f"a{chr(i)}{chr(i)}Z{chr(i)}",) for i in codes] + [(None,), ("",)], "t string")
    old = F.regexp_replace("t", "[^a-zA-Z0-9" + PY_WHITESPACE_CLASS + "]", "")
    assert d.where(~strip_non_alnum("t").eqNullSafe(old)).count() == 0


def test_descriptions_are_not_broadcast(spark):
    jobs = spark.createDataFrame([("u1",), ("u2",), (None,)], "job_uuid string")
    details = spark.createDataFrame([("u1", "<b>A</b>"), ("u1", "<i>later</i>"), ("u9", "x")], "uuid string, description string")
    out = dl.with_description(jobs, details)
    assert rows(out) == [(None, None), ("u1", "a"), ("u2", None)]
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_silver_is_not_joined_for_a_first_load(spark, monkeypatch):
    monkeypatch.setattr(etl, "DELTA_BROADCAST_ROWS", 1)
    spark.sql("CREATE DATABASE IF NOT EXISTS disk_db")
    silver = spark.createDataFrame([("a", "one", "20240101"), ("b", "two", "20240101")], "k string, v string, load_date string")
    silver.write.mode("overwrite").saveAsTable("disk_db.silver")
    delta = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    own = etl._written(spark, "disk_db.silver", delta, "k")
    assert rows(own) == rows(silver) and "Join" not in own._jdf.queryExecution().toString()
    part = etl._written(spark, "disk_db.silver", delta.where("k = 'a'").unionByName(delta.where("k = 'z'")), "k")
    assert rows(part.select("k", "v")) == [("a", "one")]


def _shuffle_files(spark) -> int:
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(".data" in n for n in local.getAllFiles().mkString("\n").split("\n"))


def test_written_steps_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    m = ss.materialize(spark.range(1000).repartition(4, "id"), spark, "shuffled")
    left = _shuffle_files(spark)
    for _ in range(20):                                    # they are deleted in the background
        if left <= before:
            break
        time.sleep(0.5)
        left = _shuffle_files(spark)
    assert left <= before and m.count() == 1000 and spark.conf.get(ss.DROP_SHUFFLES, "false") == "false"


def test_dropped_scratch_is_gone_and_other_tables_stay(spark, tmp):
    mine, other = ss.materialize(spark.range(5), spark, "mine"), ss.materialize(spark.range(5), spark, path=f"{tmp}/other")
    folder = mine.inputFiles()[0].rsplit("/", 1)[0].split(":", 1)[-1].replace("//", "", 1)
    assert os.path.isdir(folder)
    ss.drop_scratch(spark, mine)
    ss.drop_scratch(spark, other)
    assert not os.path.exists(folder) and other.count() == 5


def test_passes_change_nothing(spark, monkeypatch):
    from skillsift.operators import blocks as bl
    from skillsift.operators import index as ix
    from skillsift.operators import title_terms as tt
    from skillsift.operators.recommend import skill_queries
    from skillsift.session import materialize
    jobs = materialize(spark.createDataFrame([(t, f"aa bb {t} cc aa bb{i % 3}") for i in range(40) for t in ("red rod", "cold cup", "old hat")],
                                             "title string, skills_extracts string"))
    courses = spark.createDataFrame([(i, f"aa bb{i % 7} cc{i % 5}") for i in range(60)] + [(None, "aa dd")], "cid long, text string")
    asked = spark.createDataFrame([("a", "red rod"), ("b", "cold cup"), (None, "old hat")], "query_id string, query string")
    index = ix.fit_course_index(courses, "cid", "text")
    read = []
    for size in (ss.PASS_BYTES, 300):
        monkeypatch.setattr(ss, "PASS_BYTES", size)
        n = ss.passes_over(jobs)
        kept = tt.fit_title_terms(jobs, passes=n)
        b = bl.block_index(index, size=8)
        read.append((n, rows(kept.counts), rows(kept.heads), rows(skill_queries(asked, jobs)), rows(b.blocked, "course_id", "term", "weight"),
                     rows(b.maxima.groupBy("term").agg(F.max("most")))))
    assert read[0][0] == 1 and read[1][0] > 2 and read[0][1:] == read[1][1:]
    assert len(read[0][3]) == 6


def test_packed_counts_are_added_past_the_bound(spark, monkeypatch):
    """Counts of a bucket are summed in between where they outgrow the bound, and a single table is taken as it is."""
    import pyarrow as pa
    from skillsift.operators import gram_counts as gc
    monkeypatch.setattr(gc, "FOLD", 3)
    table = lambda *r: gc._written(pa.RecordBatch.from_arrays([pa.array([x[0] for x in r]), pa.array([x[1] for x in r]), pa.array([x[2] for x in r], pa.int64())], gc.PACKED))
    packed = pa.RecordBatch.from_arrays([
        pa.array([1, 1, 1, 2], pa.int32()), pa.array([1, 1, 2, 2], pa.int64()),
        pa.array([table((7, "a", 1), (None, "b", 2), (7, "c", 1)), table((7, "a", 4), (None, "b", 1), (8, "d", 1)),
                  table((7, "a b", 3)), table((7, "a b", 5))], pa.binary())], ["bucket", "n", "counts"])
    got = [tuple(r.values()) for b in gc._added(["g", "n", "term", "cnt"])(iter([packed, packed.slice(3)])) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted([(7, 1, "a", 5), (None, 1, "b", 3), (7, 1, "c", 1), (8, 1, "d", 1), (7, 2, "a b", 3),
                                           (7, 2, "a b", 10)], key=str)

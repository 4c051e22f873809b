"""Plan-shape tests: the scale properties the README claims, checked on executed plans."""

import re

from pyspark.sql import functions as F

from skillsift.operators import delta as dl
from skillsift.operators import index as ix

from .conftest import rows


def plan_of(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _depth(line: str) -> int:
    marks = [i for i in (line.find("+- "), line.find(":- ")) if i >= 0]
    return min(marks) if marks else 0


TRANSPARENT = ("ColumnarToRow", "Filter", "Project", "InputAdapter")


def consumer_of(lines: list[str], i: int) -> str:
    """The first operator above node ``i`` that is not a row-wise pass-through
    (filters, projections, columnar conversion) in Spark's tree rendering."""
    while True:
        d = _depth(lines[i])
        j = next((j for j in range(i - 1, -1, -1) if lines[j].strip() and _depth(lines[j]) < d), None)
        if j is None:
            return ""
        if not any(t in lines[j] for t in TRANSPARENT):
            return lines[j]
        i = j


def test_dedupe_limits_hot_key_before_shuffle(spark):
    # one key holds a third of all rows
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                  F.col("id").alias("v"))
    out = dl.dedupe(df, "k", [F.desc("v")])
    p = plan_of(out)
    assert "WindowGroupLimit" in p and "Partial" in p
    assert out.where("k = 0").collect()[0]["v"] == 2997


def test_small_batch_delta_does_not_shuffle_target(spark, tmp):
    spark.range(0, 200000).select(F.col("id").alias("key")).write.parquet(f"{tmp}/target")
    target = spark.read.parquet(f"{tmp}/target")
    batch = spark.createDataFrame([(5,), (199999,), (300000,)], "id long")
    out = dl.delta_rows(batch, target, "id", "key", batch_broadcast_rows=1000)
    assert rows(out) == [(300000,)]
    lines = plan_of(out).split("\n")
    # the target scan feeds the broadcast semi-join directly: no exchange between them
    i = next(i for i, line in enumerate(lines) if "FileScan parquet [key" in line)
    assert "BroadcastHashJoin" in consumer_of(lines, i) and "LeftSemi" in consumer_of(lines, i)


def test_broadcast_scoring_scans_postings_in_place(spark):
    c = spark.createDataFrame([(1, "python data"), (2, "data engineering"), (3, "pasta")], "cid long, text string")
    idx = ix.fit_course_index(c, "cid", "text")  # written index, as served
    q = spark.createDataFrame([(1, "data python")], "query_id long, text string")
    s = ix.score_courses(ix.vectorize(q, ["query_id"], "text", idx), ["query_id"], idx, known_rows=10)
    lines = plan_of(s).split("\n")
    i = next(i for i, line in enumerate(lines) if re.search(r"FileScan parquet \[course_id#\d+L?,term#", line))
    assert "BroadcastHashJoin" in consumer_of(lines, i)


def test_batch_metrics_folds_keys_before_join(spark):
    batch = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    base = spark.createDataFrame([(7,)], "k long")
    m = dl.batch_metrics(batch, base, "k")
    r = m.first()
    # ids not divisible by 3 (7 among them) plus the hot key 7: 2000 distinct, 7 known
    assert (r["rows_in"], r["unique_keys"], r["delta_keys"]) == (3000, 2000, 1999)
    assert "partial_count" in plan_of(m)


def test_norms_need_no_exchange_after_the_counts(spark, tmp):
    """M2: between the counts per (id, term) and the norm per id nothing is shuffled."""
    import skillsift.operators.index as mod
    written = []
    keep, mod.materialize = mod.materialize, lambda df, *a, **k: (written.append(df), keep(df, *a, **k))[1]
    try:
        c = spark.createDataFrame([(1, "python data"), (2, "data engineering"), (3, "pasta")], "cid long, text string")
        ix.fit_course_index(c, "cid", "text")
    finally:
        mod.materialize = keep
    lines = written[-1]._jdf.queryExecution().executedPlan().toString().split("\n")
    window = next(i for i, x in enumerate(lines) if "Window " in x)
    generate = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    between = [x for x in lines[window:generate] if "Exchange" in x and "Broadcast" not in x]
    assert not between, between

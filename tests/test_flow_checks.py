"""Broken, repeated and missing pages, dates, bronze by run, feedback sent twice."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skillsift.functions.dates import any_date
from skillsift.plans import etl
from skillsift.sinks.tables import content_key
from skillsift.sources import landing as src

from .conftest import rows


def course(i, end=None):
    c = {"referenceNumber": f"C{i}", "title": f"course {i}", "objective": "python data"}
    return c if end is None else {**c, "courseSupportEndDate": end}


def course_page(ids, total, number=None):
    page = {"meta": {"total": total}, "data": {"courses": [course(i) for i in ids]}}
    return page if number is None else {"page": number, **page}


def land(path, *documents):
    os.makedirs(path, exist_ok=True)
    for i, d in enumerate(documents):
        with open(os.path.join(path, f"{len(os.listdir(path))}-{i}.json"), "w") as f:
            f.write(d if isinstance(d, str) else json.dumps(d))
    return path


@pytest.fixture()
def skills(spark):
    return spark.createDataFrame([(1, "python")], "skill_id long, phrase string")


@pytest.fixture()
def db(spark, tmp):
    name = "fc_" + os.path.basename(tmp).replace("-", "_")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    return name


def run_courses(spark, db, skills, path, **more):
    return etl.run_courses(spark, path, skills, f"{db}.c", f"{db}.cg", as_of="2024-01-15", **more)


@pytest.mark.parametrize("numbered", [True, False])
def test_a_page_twice_and_one_never(spark, tmp, db, skills, numbered):
    first = course_page(range(100), 200, 0 if numbered else None)
    r = run_courses(spark, db, skills, land(f"{tmp}/in", first, first))
    assert (r.rows_in, r.unique_keys, r.missing_pages, r.repeated_pages, r.bad_documents) == (200, 100, 1, 1, 0)


@pytest.mark.parametrize("numbered", [True, False])
def test_a_truncated_page(spark, tmp, db, skills, numbered):
    n = (lambda i: i) if numbered else (lambda i: None)
    cut = json.dumps(course_page(range(100, 200), 200, n(1)))[:500]
    path = land(f"{tmp}/in", course_page(range(100), 200, n(0)), cut, "no json at all", '{"error": "try later"}', "  ")
    aside = f"{tmp}/aside"
    for _ in range(2):                                     # a re-run replaces what it put aside
        r = run_courses(spark, db, skills, path, quarantine=aside)
        assert (r.rows_in, r.missing_pages, r.repeated_pages, r.bad_documents) == (100, 1, 0, 3)
    kept = src.read_bronze(spark, aside, "20240115", r.run)
    assert sorted(x["record"] for x in kept.collect()) == sorted([cut, "no json at all", '{"error": "try later"}'])
    assert kept.where(F.col("file").isNull()).count() == 0


def test_empty_and_short_pages_are_sound(spark, tmp):
    d = src.landed_course_documents(spark, land(f"{tmp}/in", course_page([], 0), course_page([1], 1, 3)), multiline=True)
    assert rows(d, "page", "rows", "bad") == [(None, 0, False), (3, 1, False)]


def test_an_empty_landing(spark, tmp, db, skills):
    r = run_courses(spark, db, skills, land(f"{tmp}/in", course_page([], 0)))
    assert (r.rows_in, r.delta_rows, r.missing_pages, r.bad_documents) == (0, 0, 0, 0)


@pytest.mark.parametrize("text,date", [
    ("20300102", "2030-01-02"), ("2030-01-02", "2030-01-02"), ("2030-01-02T00:00:00", "2030-01-02"), ("02/01/2030", "2030-01-02"),
    (" 2030-01-02 ", "2030-01-02"), ("2030-01-02T10:20:30.5Z", "2030-01-02"), ("2 Jan 2030", "2030-01-02"), ("02-01-2030", "2030-01-02"),
    ("2030/01/02", "2030-01-02"), ("to be announced", None), ("31/31/2030", None), ("", None), (None, None)])
def test_any_date(spark, text, date):
    got = spark.createDataFrame([(text,)], "t string").select(any_date("t").cast("string")).first()[0]
    assert got == date


def test_unread_dates_are_kept_and_counted(spark, tmp, db, skills):
    ends = {1: "20300101", 2: "2030-01-01T00:00:00", 3: "31/12/2030", 4: "soon", 5: None, 6: "20100101", 7: "01/01/2010"}
    page = {"page": 0, "meta": {"total": 7}, "data": {"courses": [course(i, e) for i, e in ends.items()]}}
    r = run_courses(spark, db, skills, land(f"{tmp}/in", page))
    assert [x[0] for x in rows(spark.read.table(f"{db}.cg"), "referenceNumber")] == ["C1", "C2", "C3", "C4", "C5"]
    assert (r.unread_dates, r.delta_rows) == (1, 5)


def job_page(ids, total, number, title="data engineer"):
    post = lambda i: {"uuid": f"u{i}", "title": f"{title} {i}", "metadata": {"jobPostId": f"J{i}"}}
    return {"page": number, "countWithoutFilters": total, "results": [post(i) for i in ids]}


def test_bronze_keeps_every_run_of_a_date(spark, tmp, db, skills):
    details = land(f"{tmp}/details", {"uuid": "u1", "description": "python"})
    bronze = f"{tmp}/bronze"
    first = land(f"{tmp}/first", job_page([1, 2, 3], 5, 0))
    second = land(f"{tmp}/second", job_page([4, 5], 5, 1))

    def run(path, **more):
        return etl.run_jobs(spark, path, details, bronze, skills, f"{db}.j", f"{db}.g", as_of="2024-01-15", **more)

    names = {run(p).run for p in (first, second, first, second)}
    day = lambda: rows(src.read_bronze(spark, bronze, "20240115"), "job_id")
    ids = [("J1",), ("J2",), ("J3",), ("J4",), ("J5",)]
    assert len(names) == 2 and day() == ids == rows(spark.read.table(f"{db}.g"), "jobPostId")
    # Two searches over one landing are two runs; the same search again replaces its own.
    runs = {run(first, keyword=k).run for k in ("engineer 1", "engineer 2", "engineer 1")}
    assert len(runs) == 2 and day() == sorted(ids + [("J1",), ("J2",)])
    # The name depends on the documents, not on the folder or the number of files.
    again = land(f"{tmp}/third", job_page([4, 5], 5, 1))
    assert run(again).run in names and day() == sorted(ids + [("J1",), ("J2",)])
    plan = src.read_bronze(spark, bronze, "20240115", min(names))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in plan and "run" in plan


def test_feedback_is_kept_once_a_day(spark, tmp):
    schema = "Search_input string, Feedback string, User_rating int, Recommended_course_number int, Show_score boolean"
    fb = spark.createDataFrame([(None, "great", 5, 5, True), ("", "great", 5, 5, True), ("x", None, None, None, None)], schema)
    for at in ("2024-01-15 10:30:00", "2024-01-15 23:59:59", "2024-01-16 00:00:00"):
        etl.record_feedback(fb.unionByName(fb), f"{tmp}/fb", as_of=at, once=True)
    back = spark.read.parquet(f"{tmp}/fb")
    assert back.count() == 6 and back.select("key").distinct().count() == 6
    assert {str(r[0]) for r in back.select("Timestamp").collect()} == {"2024-01-15 10:30:00", "2024-01-16 00:00:00"}


def test_content_key_keeps_null_and_empty_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None), ("a", "")], "x string, y string")
    assert df.select(content_key(["x", "y"]).alias("k")).distinct().count() == 4

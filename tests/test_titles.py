"""Title matching and the similarity ratio."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skillsift.functions.similarity import ratio, similarity_ratio
from skillsift.operators.titles import (contained_ratio, keyword_filter, match_jobs, match_titles,
                                        similar_titles)

from .conftest import rows


def test_match_cases(spark):
    titles = ["Data Scientist", "senior data scientist", "cold rod", "red plate", "x" * 210 + " data"]
    jobs = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "job_id long, title string")
    req = spark.createDataFrame([(1, "data scientist"), (2, "DATA SCIENTIST"), (3, "red plates"),
                                 (4, "data"), (5, "old rod"), (6, "red plat e")],
                                "query_id long, query string")
    got = rows(match_jobs(req, jobs), "query_id", "job_id")
    # exact (other case) matches; 'data' is contained but too short; 'old rod' in 'cold rod' is 14/15.
    assert got == [(1, 0), (2, 0), (5, 2)]


def test_match_qgram_path_equals_broadcast_path(spark):
    names = ["red plate", "cold rod", "a red plate", "plate", "ab", "AB", "abc", "zz top", ""]
    titles = spark.createDataFrame([(n,) for n in names], "title string")
    qs = ["red plat", "old rod", "plate", "ab", "b", "", "xyz", "RED PLATE"]
    req = spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")
    for th in (0.9, 0.6, 0.0):
        small = rows(match_titles(req, titles, th), "query_id", "title")
        big = rows(match_titles(req, titles, th, broadcast_rows=0), "query_id", "title")
        assert small == big and small, th


def test_keyword_filter(spark):
    df = spark.createDataFrame([("Red Plate",), ("blue cup",)], "title string")
    assert keyword_filter(df, "").count() == 2
    assert rows(keyword_filter(df, "PLATE")) == [("Red Plate",)]


def test_similarity_ratio_values(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "")], "a string, b string")
    got = [r["r"] for r in df.select(similarity_ratio("a", "b").alias("r")).collect()]
    assert got == [0.25, 0.5, 1.0]
    assert ratio(None, "x") is None


def test_similar_titles_against_difflib(spark):
    names = ["red plate", "red plates", "bed plate", "old rod", "cold rod", "tide", "diet"]
    titles = spark.createDataFrame([(n,) for n in names], "title string")
    req = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "query_id long, query string")
    got = rows(similar_titles(req, titles, 0.7), "query", "title")
    want = sorted((q, t) for q in names for t in names if SequenceMatcher(None, q, t).ratio() >= 0.7)
    assert got == want


def test_similar_titles_random_against_difflib(spark):
    """The rare-item filter loses no pair: random texts over few letters, repeats and empty texts included."""
    import random
    rnd = random.Random(5)
    names = ["".join(rnd.choices("abcde ", k=rnd.randint(0, 9))) for _ in range(120)] + ["", "A", "a"]
    titles = spark.createDataFrame([(n,) for n in names] * 2, "title string")
    req = spark.createDataFrame([(i, n) for i, n in enumerate(names[:60])] + [(0, names[0]), (98, ""), (99, None)],
                                "query_id long, query string")
    asked = set(enumerate(names[:60])) | {(98, "")}
    for th in (0.6, 0.9, 1.0):
        got = rows(similar_titles(req, titles, th), "query_id", "title", "ratio")
        want = sorted((i, t, SequenceMatcher(None, q.lower(), t.lower()).ratio()) for i, q in asked for t in set(names)
                      if SequenceMatcher(None, q.lower(), t.lower()).ratio() >= th)
        assert got == want, th


def test_similar_titles_refuses_all_pairs(spark):
    df = spark.createDataFrame([(1, "a", "a")], "query_id long, query string, title string")
    with pytest.raises(ValueError):
        similar_titles(df, df, 0.0)
    plan = similar_titles(df, df, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan          # computed once, before the threshold reads it


def test_repeated_requests_do_not_change_matches(spark):
    titles = spark.createDataFrame([("red plate",), ("ab",), ("red plate",)], "title string")
    req = spark.createDataFrame([(1, "red plate"), (1, "red plate"), (2, "ab"), (2, "ab")], "query_id long, query string")
    small = rows(match_titles(req, titles, broadcast_rows=100))
    assert small == rows(match_titles(req, titles, broadcast_rows=1)) == [(1, "red plate", "red plate"), (2, "ab", "ab")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcde ", min_size=0, max_size=12), st.text(alphabet="abcde ", max_size=12),
       st.text(alphabet="abcde ", max_size=12))
def test_closed_form_equals_difflib_when_contained(pre, q, post):
    t = pre + q + post
    closed = 1.0 if len(q) + len(t) == 0 else 2.0 * len(q) / (len(q) + len(t))
    assert abs(closed - SequenceMatcher(None, q, t).ratio()) < 1e-12


def test_contained_ratio_column(spark):
    df = spark.createDataFrame([("cold rod", "old rod"), ("", "")], "t string, q string")
    got = [r["r"] for r in df.select(contained_ratio(F.col("t"), F.col("q")).alias("r")).collect()]
    assert got == [14 / 15, 1.0]

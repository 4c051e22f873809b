"""Score bounds, counts per title and substring matching against the plain computations."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skillsift.operators import blocks as bl
from skillsift.operators import index as ix
from skillsift.operators import title_terms as tt
from skillsift.operators.recommend import recommend, skill_queries
from skillsift.operators.titles import LONG_TITLE, match_titles
from skillsift.session import materialize
from skillsift.sources.landing import load_serving
from skillsift.plans import etl

from .conftest import SF0001, rows


def corpus(spark, n=600, seed=3):
    """Courses in a few topics with words of falling frequency, some equal, some empty."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        topic = rng.choice("abcd")
        words = [f"{topic}{int(rng.paretovariate(0.9)) % 40:02d}" for _ in range(rng.randint(0, 30))]
        out.append((i, " ".join(words)))
    out += [(n + i, "a01 a01 a02") for i in range(20)]                    # a tie longer than any k
    return spark.createDataFrame(out, "cid long, text string")


@pytest.fixture(scope="module")
def fitted(spark):
    c = corpus(spark)
    plain = ix.fit_course_index(c, "cid", "text")
    return c, plain, bl.block_index(plain, size=16)


def queries(spark):
    texts = ["a01 a02 a03", "b01", "c01 c02 d01 d05", "a39 b38", "unknown", "a01", "a01 a01 a02", "a01 b01 c01 d01"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


@pytest.mark.parametrize("k,first", [(1, 1), (5, 2), (5, 8), (25, 1), (1000, 3)])
def test_top_scores_keep_the_best(spark, fitted, k, first):
    c, plain, blocked = fitted
    q = queries(spark)
    qv = materialize(ix.vectorize(q, ["query_id"], "text", plain), spark)
    want = ix.top_courses(ix.score_courses(qv, ["query_id"], plain), ["query_id"], q, c, "cid", k)
    got = ix.top_courses(bl.top_scores(qv, ["query_id"], blocked, k, first), ["query_id"], q, c, "cid", k)
    r = lambda df: rows(df.withColumn("score", F.round("score", 9)))
    assert r(got) == r(want)


def test_fewer_pairs_are_scored(spark, fitted):
    _, plain, blocked = fitted
    q = queries(spark)
    qv = materialize(ix.vectorize(q, ["query_id"], "text", plain), spark)
    every = ix.score_courses(qv, ["query_id"], plain)
    some = bl.top_scores(qv, ["query_id"], blocked, 5, 2)
    assert some.count() < every.count() * 0.85
    exact = {(r.query_id, r.course_id): round(r.score, 9) for r in every.collect()}
    assert all(exact[r.query_id, r.course_id] == round(r.score, 9) for r in some.collect())


def test_blocks_hold_every_course_once(spark, fitted):
    _, plain, blocked = fitted
    n = plain.postings.select("course_id").distinct().count()
    per = blocked.blocked.select("block", "course_id").distinct()
    assert per.count() == n and per.groupBy("block").count().agg(F.max("count")).first()[0] <= 16
    assert rows(blocked.blocked.select("course_id", "term", "weight")) == rows(plain.postings.select("course_id", "term", "weight"))
    assert rows(blocked.blocked.groupBy("term", "block").agg(F.max("weight").alias("most"))) == \
        rows(blocked.maxima, "term", "block", "most")


def test_blocks_of_an_empty_index(spark):
    empty = spark.createDataFrame([], "cid long, text string")
    blocked = bl.block_index(ix.fit_course_index(empty, "cid", "text"))
    q = queries(spark)
    qv = materialize(ix.vectorize(q, ["query_id"], "text", blocked), spark)
    assert bl.top_scores(qv, ["query_id"], blocked, 5).count() == 0


def postings(spark, n=400, titles=12, seed=5):
    rng = random.Random(seed)
    names = [f"{a} {b}" for a in ("red", "cold", "old", "bold") for b in ("rod", "plate", "cup")][:titles]
    out = [(i, rng.choice(names[:1] * 6 + names), " ".join(
        rng.choice("pq") + str(int(rng.paretovariate(0.8)) % 50) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    out += [(n, None, "p1 p2"), (n + 1, "no skills", None), (n + 2, "no skills", ""), (n + 3, "one term", "zz top")]
    return spark.createDataFrame(out, "job_id long, title string, skills_extracts string")


@pytest.mark.parametrize("threshold", [0.9, 0.7, 0.5])
def test_queries_from_kept_counts(spark, threshold):
    jobs = postings(spark)
    kept = tt.fit_title_terms(jobs)
    req = spark.createDataFrame([(1, "red rod"), (2, "old rod"), (3, "rod"), (4, "plate"), (5, "nothing"), (6, "no skills"),
                                 (7, "ONE TERM"), (8, None), (9, "o"), (9, "d c")], "query_id long, query string")
    want = rows(skill_queries(req, jobs, threshold))
    assert want and rows(skill_queries(req, kept, threshold)) == want


def test_no_request_matches(spark):
    kept = tt.fit_title_terms(postings(spark))
    req = spark.createDataFrame([(1, "astronaut")], "query_id long, query string")
    assert skill_queries(req, kept).count() == 0
    none = tt.fit_title_terms(postings(spark).where("false"))
    assert skill_queries(req, none).count() == 0


def test_small_counts_are_not_read(spark):
    """A request of one title reads only counts from its floor on; the filter reaches the scan."""
    jobs = postings(spark)
    kept = tt.fit_title_terms(jobs, (1,))
    m = materialize(spark.createDataFrame([(1, "red rod")], "query_id long, title string"))
    got = tt.served_counts(m, kept, (1,))
    floor = kept.heads.where("title = 'red rod'").first()["floor"]
    assert got.agg(F.min("cnt")).first()[0] == floor and got.count() < kept.counts.where("title = 'red rod'").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cnt" in plan and "split(" not in plan


def test_served_recommendations_equal_fitted_ones(spark, tmp):
    jobs = postings(spark).withColumnRenamed("job_id", "jobPostId")
    courses = corpus(spark, 80).select(F.col("cid").alias("referenceNumber"), F.lit("t").alias("title"),
                                       F.regexp_replace("text", "[abcd]", "p").alias("SkillsTaxonomy"))
    root = f"{tmp}/serving"
    for cap in (None, 150):
        etl.export_serving(spark, courses, jobs, root, max_jobs=cap)
        sv = load_serving(spark, root)
        assert sv["jobs"].count() == (cap or jobs.count())
        index = bl.load_blocks(spark, root, ix.load_index(spark, root))
        req = spark.createDataFrame([(1, "red rod"), (2, "old rod")], "query_id long, query string")
        want = recommend(req, sv["jobs"], ix.load_index(spark, root), sv["courses"], k=4)
        got = recommend(req, tt.load_title_terms(spark, root), index, sv["courses"], k=4)
        assert rows(got) == rows(want) and got.count() == 16


def test_serving_plan_reads_no_texts(spark):
    from skillsift.plans import queries as q
    plan = q.QUERIES["top_terms_served"](spark, SF0001)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "skills_extracts" not in plan


def brute_matches(req, titles, th):
    out = set()
    for i, q in req:
        for t in titles:
            a, b = (q or "").lower(), (t or "").lower()
            if q is not None and t is not None and a in b and (2 * len(a) / (len(a) + len(b)) if a or b else 1.0) >= th:
                out.add((i, t))
    return sorted(out)


@pytest.mark.parametrize("th", [0.0, 0.02, 0.3, 0.9, 1.0])
def test_substring_matches(spark, th):
    rng = random.Random(11)
    titles = ["".join(rng.choice("aab") for _ in range(rng.randint(0, 14))) for _ in range(80)]
    titles += ["x" * LONG_TITLE, "x" * (LONG_TITLE + 1), "ab" * 700, "ab" * 700 + "c", "ÄÖ İstanbul", None, ""]
    req = list(enumerate(["a", "aa", "", "aab", "abaab", None, "AABA", "x" * (LONG_TITLE - 9), "x" * (LONG_TITLE + 1),
                          "ab" * 690, "ba", "äö", "i̇stanbul", "baabaabb"]))
    got = match_titles(spark.createDataFrame(req, "query_id long, query string"),
                       spark.createDataFrame([(t,) for t in titles], "title string"), th)
    assert rows(got, "query_id", "title") == brute_matches(req, titles, th)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300), st.sampled_from([0.1, 0.5, 0.7, 0.9, 0.95, 1.0]))
def test_shortest_match_misses_nothing(q, t, th):
    """The length bound in plain numbers: no matching length lies below it."""
    import math
    low = max(math.ceil(t * (th / (2.0 - th)) - 1e-9), 0)
    if q <= t and (2.0 * q / (q + t) if q + t else 1.0) >= th:
        assert q >= low


def test_matching_has_no_nested_loop(spark):
    titles = spark.createDataFrame([("red plate",), ("cold rod",)], "title string")
    req = spark.createDataFrame([(i, f"red {i}") for i in range(40)], "query_id long, query string")
    for bound in (0, 100):
        plan = match_titles(req, titles, broadcast_rows=bound)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan

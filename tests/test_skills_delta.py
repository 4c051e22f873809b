"""M1 skill tagging; F1/A2/A3/J1/J2/M9 de-dup and delta selection."""

from pyspark.sql import functions as F

from skillsift.operators import delta as dl
from skillsift.operators.skills import extract_skills

from .conftest import rows

DICT = [(1, "machine learning"), (2, "learning"), (3, "data analysis"), (4, "deep machine learning"),
        (5, "sql")]


def test_extract_skills_cases(spark):
    skills = spark.createDataFrame(DICT, "skill_id long, phrase string")
    docs = spark.createDataFrame([
        (1, "We do machine learning and machine learning."),   # phrase twice, part of another
        (2, "nothing relevant here"),                            # no match
        (3, None),                                               # null text
        (4, "analysis of the data"),                             # partial: both tokens, not adjacent
        (5, "deep machine learning with SQL"),                   # overlapping phrases
    ], "doc_id long, text string")
    got = dict(rows(extract_skills(docs, "doc_id", "text", skills)))
    assert got[1] == "learning, machine learning"
    assert got[2] == "" and got[3] == ""
    assert got[4] == "data analysis"
    assert got[5] == "deep machine learning, learning, machine learning, sql"


def test_extract_skills_theta(spark):
    skills = spark.createDataFrame([(1, "alpha beta gamma delta")], "skill_id long, phrase string")
    docs = spark.createDataFrame([(1, "delta beta alpha"), (2, "alpha beta")], "doc_id long, text string")
    assert dict(rows(extract_skills(docs, "doc_id", "text", skills, theta=0.75))) == \
        {1: "alpha beta gamma delta", 2: ""}
    assert dict(rows(extract_skills(docs, "doc_id", "text", skills, theta=0.5)))[2] == "alpha beta gamma delta"


def test_dedupe_and_null_filter(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("nan", 4)], "k string, v int")
    out = dl.drop_null_keys(dl.dedupe(df, "k", [F.desc("v")]), "k")
    assert rows(out) == [("a", 2), ("nan", 4)]
    assert dl.dedupe(df, "k").where("k = 'a'").count() == 1


def test_delta_rows_cases(spark):
    batch = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    base = spark.createDataFrame([(1,), (None,)], "key long")
    assert rows(dl.delta_rows(batch, base, "id", "key")) == [(None,), (2,)]  # NULL keys never match
    assert rows(dl.delta_rows(batch, base, "id", "key", batch_broadcast_rows=10)) == [(None,), (2,)]
    all_known = spark.createDataFrame([(1,), (2,)], "id long")
    assert dl.delta_rows(all_known, all_known, "id", batch_broadcast_rows=10).count() == 0
    assert dl.delta_rows(all_known, all_known, "id").count() == 0
    empty = spark.createDataFrame([], "id long")
    assert dl.delta_rows(all_known, empty, "id").count() == 2
    assert not dl.has_rows(empty) and dl.has_rows(all_known)


def test_batch_metrics(spark):
    batch = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,)], "k long")
    base = spark.createDataFrame([(1,)], "k long")
    r = dl.batch_metrics(batch, base, "k").first()
    assert (r["rows_in"], r["unique_keys"], r["null_keys"], r["delta_keys"]) == (5, 3, 1, 2)


def test_extract_skills_against_brute_force(spark):
    """M1 on sf0.001 documents vs a direct Python evaluation of the definition."""
    import re

    from skillsift.plans import fixtures as fx

    from .conftest import SF0001

    pat = re.compile(r"[\w]+[+#]*")
    dic = [r["phrase"] for r in fx.skill_dictionary(spark, SF0001).collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    want = {}
    for d, text in docs.items():
        t = pat.findall(text.lower())
        grams = {" ".join(t[i:i + n]) for n in (1, 2) for i in range(len(t) - n + 1)}
        present = set(t)
        hits = set()
        for ph in dic:
            pt = pat.findall(ph.lower())
            if not pt:
                continue
            if " ".join(pt) in grams:
                hits.add(ph)
            elif len(pt) >= 2 and sum(x in present for x in set(pt)) / len(set(pt)) >= 0.75:
                hits.add(ph)
        want[d] = ", ".join(sorted(hits))
    got = dict(rows(extract_skills(spark.read.parquet(f"{SF0001}/documents.parquet"), "doc_id", "text",
                                   fx.skill_dictionary(spark, SF0001))))
    assert got == want


def test_extract_skills_full_only_and_long_phrases(spark):
    skills = spark.createDataFrame([(1, "deep machine learning"), (2, "machine learning"), (3, "Deep-Learning"),
                                    (4, "z")], "skill_id long, phrase string")
    docs = spark.createDataFrame([(1, "deep machine learning rocks"), (2, "learning machine, deep"),
                                  (3, "deep learning!")], "doc_id long, text string")
    full = dict(rows(extract_skills(docs, "doc_id", "text", skills, theta=None)))
    assert full == {1: "deep machine learning, machine learning", 2: "", 3: "Deep-Learning"}
    part = dict(rows(extract_skills(docs, "doc_id", "text", skills)))
    # all tokens present but not in order -> partial matches (theta 0.75)
    assert part[2] == "Deep-Learning, deep machine learning, machine learning"


def test_one_letter_and_symbol_phrases(spark):
    """No phrase loses a token: C programming is not programming, C and C++ are phrases of their own."""
    names = ["C programming", "R programming", "C", "R", "C++", "C#", "data analysis"]
    skills = spark.createDataFrame(list(enumerate(names)), "skill_id long, phrase string")
    docs = spark.createDataFrame([(1, "we need programming experience"), (2, "C and R wanted, c++ too"),
                                  (3, "C programming, (C#)"), (4, "b+ data_analysis")], "doc_id long, text string")
    got = dict(rows(extract_skills(docs, "doc_id", "text", skills)))
    assert got == {1: "", 2: "C, C++, R", 3: "C, C programming, C#", 4: ""}
    from skillsift.operators.skills import prepare_dictionary
    count = {r["phrase"]: len(r["ptok"]) for r in prepare_dictionary(skills).collect()}
    assert count == {n: len(n.split()) for n in names}


def test_with_skills_joins_once_and_keeps_rows(spark):
    from skillsift.operators.skills import with_skills
    skills = spark.createDataFrame(DICT, "skill_id long, phrase string")
    docs = spark.createDataFrame([(1, "sql"), (1, "sql"), (2, "x"), (None, "sql")], "doc_id long, text string")
    out = with_skills(docs, "doc_id", "text", skills)
    assert rows(out) == [(None, "sql", ""), (1, "sql", "sql"), (1, "sql", "sql"), (2, "x", "")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


def test_one_description_per_uuid(spark):
    jobs = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None), (4, "u1")], "job_id long, job_uuid string")
    details = spark.createDataFrame([("u1", "<p>B</p>"), ("u1", "<p>A</p>"), ("u2", None), ("u9", "z"), (None, "n")],
                                    "uuid string, description string")
    out = dl.with_description(jobs, details)
    assert rows(out, "job_id", "job_description") == [(1, "a"), (2, None), (3, None), (4, "a")]
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    clean = next(i for i, x in enumerate(lines) if "regexp_replace" in x)
    assert any("LeftSemi" in x for x in lines[clean + 1:])        # only the jobs' own details are cleaned


def test_text_bytes(spark):
    df = spark.createDataFrame([(1, "é"), (22, None)], "a long, b string")
    assert rows(dl.text_bytes(df)) == [(3, 2, 5, 2)]

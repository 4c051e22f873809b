"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator group.

Each reads the driver tables (whole tables, through ``plans.fixtures``) and
returns a lazy DataFrame whose column names match the DuckDB SQL of the same
name in ``plans.oracle``. Integer outputs are bigint, scores are rounded to 9
digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions.text import clean_html, ngrams, tokens
from ..operators import delta as dl
from ..operators import index as ix
from ..operators import shape as sh
from ..operators.blocks import block_index, load_blocks
from ..operators.recommend import present, recommend
from ..operators.skills import extract_skills
from ..operators.title_terms import fit_title_terms, load_title_terms, served_counts
from ..operators.titles import keyword_filter, match_jobs, match_titles, similar_titles
from ..session import materialize, scratch_path
from ..sinks.tables import write_bronze
from ..sources import landing as src
from ..streaming.ingest import ingest_feedback, ingest_job_pages
from . import etl
from . import fixtures as fx
from . import landing as land

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _course_index(spark: SparkSession, sf_dir: str) -> ix.CourseIndex:
    return ix.fit_course_index(fx.courses(spark, sf_dir), "referenceNumber", "combined_features")


def _recommend(spark: SparkSession, sf_dir: str, requests: DataFrame, sizes, k: int) -> DataFrame:
    return recommend(requests, fx.jobs(spark, sf_dir), _course_index(spark, sf_dir),
                     fx.courses(spark, sf_dir), k=k, ngram_sizes=sizes)


def _noun_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct nouns (last words) of the titles as requests."""
    return (fx.table(spark, sf_dir, "part").groupBy(F.element_at(F.split("p_name", " "), -1).alias("query"))
              .agg(F.min("p_partkey").alias("query_id")).select("query_id", "query"))


# --- M4 and its parts ------------------------------------------------------

@query("recommend_unigram")
def q_recommend_unigram(spark, sf_dir):
    return _recommend(spark, sf_dir, fx.single_request(spark, "red plate"), (1,), 10)


@query("recommend_bigram")
def q_recommend_bigram(spark, sf_dir):
    return _recommend(spark, sf_dir, fx.single_request(spark, "red plate"), (2,), 10)


@query("recommend_batch")
def q_recommend_batch(spark, sf_dir):
    return _recommend(spark, sf_dir, fx.title_requests(spark, sf_dir), (1, 2), 5)


@query("recommend_served")
def q_recommend_served(spark, sf_dir):
    """M7 + S6 + M4: courses, counts per title and the blocked index exported, loaded back, and every title
    answered from them: no fit, no posting text, only courses that can be among the best."""
    root = scratch_path(spark, "serving")
    jobs = fx.jobs(spark, sf_dir).select(F.concat(F.lit("JOB-"), F.col("job_id").cast("string")).alias("jobPostId"),
                                         "title", "skills_extracts")
    etl.export_serving(spark, fx.courses(spark, sf_dir).withColumnRenamed("combined_features", "SkillsTaxonomy"),
                       jobs, root)
    sv = src.load_serving(spark, root)
    index = load_blocks(spark, root, ix.load_index(spark, root))
    return recommend(fx.title_requests(spark, sf_dir), load_title_terms(spark, root), index, sv["courses"], k=5)


@query("recommend_pruned")
def q_recommend_pruned(spark, sf_dir):
    """M4 over an index with blocks: only courses whose bound reaches a query's floor are scored."""
    return recommend(fx.title_requests(spark, sf_dir), fx.jobs(spark, sf_dir), block_index(_course_index(spark, sf_dir)),
                     fx.courses(spark, sf_dir), k=5)


@query("top_terms_served")
def q_top_terms_served(spark, sf_dir):
    """T1 + X12 per title from counts kept per title: no posting text is read for a request."""
    kept = fit_title_terms(fx.jobs(spark, sf_dir), (1,))
    req = fx.title_requests(spark, sf_dir)
    m = materialize(match_titles(req, kept.titles()).select("query_id", "title").distinct(), spark, "title-matches")
    top = ix.top_terms(served_counts(m, kept, (1,)).drop("n"), 10, ["query_id"])
    return (top.join(ix.terms_text(top, ["query_id"]), "query_id")
               .select("query_id", "rank", "term", "cnt", "skills_query"))


@query("top_terms_rolled")
def q_top_terms_rolled(spark, sf_dir):
    """Counts per title rolled up: requests are the titles' nouns at threshold 0.7, so they match many titles."""
    kept = fit_title_terms(fx.jobs(spark, sf_dir))
    m = materialize(match_titles(_noun_requests(spark, sf_dir), kept.titles(), 0.7).select("query_id", "title")
                    .distinct(), spark, "title-matches")
    top = ix.top_terms(served_counts(m, kept), 10, ["query_id", "n"])
    return top.select("query_id", "n", "rank", "term", "cnt")


@query("recommend_display")
def q_recommend_display(spark, sf_dir):
    """M4 + P14 + P15: the displayed tables for 'red plate' (both n), score hidden."""
    recs = _recommend(spark, sf_dir, fx.single_request(spark, "red plate"), (1, 2), 5)
    return present(recs, show_score=False)


@query("top_terms")
def q_top_terms(spark, sf_dir):
    """T1 + X12 per title: ten most frequent unigrams over the matched postings."""
    req = fx.title_requests(spark, sf_dir)
    m = match_jobs(req, fx.jobs(spark, sf_dir).select("title", "skills_extracts"))
    counts = ix.term_counts(m, "skills_extracts", 1, ["query_id"])
    top = ix.top_terms(counts, 10, ["query_id"])
    return (top.join(ix.terms_text(top, ["query_id"]), "query_id")
               .select("query_id", "rank", "term", "cnt", "skills_query"))


@query("tokens")
def q_tokens(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return (d.select("doc_id", F.posexplode(tokens("text")).alias("pos", "term"))
             .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term"))


@query("ngrams_2")
def q_ngrams_2(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return (d.select("doc_id", tokens("text").alias("_tok"))
             .select("doc_id", F.posexplode(ngrams(F.col("_tok"), 2)).alias("pos", "term"))
             .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term"))


@query("term_counts_1")
def q_term_counts_1(spark, sf_dir):
    return ix.term_counts(fx.table(spark, sf_dir, "documents"), "text", 1)


@query("term_counts_2")
def q_term_counts_2(spark, sf_dir):
    return ix.term_counts(fx.table(spark, sf_dir, "documents"), "text", 2)


@query("idf")
def q_idf(spark, sf_dir):
    v = ix.fit_idf(fx.courses(spark, sf_dir), "referenceNumber", "combined_features")
    return v.select("term", "df", F.round("idf", 9).alias("idf"))


@query("course_index")
def q_course_index(spark, sf_dir):
    p = _course_index(spark, sf_dir).postings
    return p.select("course_id", "term", "tf", F.round("weight", 9).alias("weight"))


@query("score_courses")
def q_score_courses(spark, sf_dir):
    """M3 for many queries at once: every benchmark text scored against all courses."""
    index = _course_index(spark, sf_dir)
    q = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    qv = ix.vectorize(q, ["query_id"], "text", index)
    s = ix.score_courses(qv, ["query_id"], index)
    return s.select("query_id", "course_id", F.round("score", 9).alias("score"))


# --- title search -----------------------------------------------------------

@query("match_title")
def q_match_title(spark, sf_dir):
    m = match_jobs(fx.single_request(spark, "red plate"), fx.jobs(spark, sf_dir).select("job_id", "title"))
    return m.select("job_id", "title")


@query("match_titles_batch")
def q_match_titles_batch(spark, sf_dir):
    """Every distinct noun of the titles (last word) as a query against all postings,
    threshold 0.7: a noun matches titles with a short adjective only."""
    part = fx.table(spark, sf_dir, "part")
    req = _noun_requests(spark, sf_dir)
    jobs = part.select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"))
    return match_jobs(req, jobs, 0.7).select("query_id", "query", "job_id", "title")


@query("keyword_filter")
def q_keyword_filter(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"),
                                                  F.col("p_name").alias("title"))
    return keyword_filter(part, "Plate")


# --- text scalars -------------------------------------------------------------

@query("clean_html")
def q_clean_html(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", clean_html("html").alias("description"))


@query("clean_html_refs")
def q_clean_html_refs(spark, sf_dir):
    """X1 over character references made from the page id, inside every page's url as text."""
    p = fx.table(spark, sf_dir, "pages")
    n = F.col("page_id")
    names = F.array(*[F.lit(x) for x in ("amp", "AMP", "nbsp", "ensp", "emsp", "thinsp", "Tab", "NewLine", "lt", "hellip")])
    html = F.concat(F.lit("<p>x&#"), (n % 300).cast("string"), F.lit(";y&#x"), F.hex(n % 12400), F.lit(";z&"),
                    F.get(names, (n % 10).cast("int")), F.lit(";w &#"), (n % 90 + 38).cast("string"), F.lit(" &amp;lt; & &;</p>"),
                    F.col("url"))
    return p.select("page_id", clean_html(html).alias("description"))


@query("page_descriptions")
def q_page_descriptions(spark, sf_dir):
    """S3 + J3 + X1 + P12: landed detail HTML joined by uuid, cleaned, combined with the skills text."""
    part = fx.table(spark, sf_dir, "part")
    jobs = part.select(F.col("p_partkey").alias("job_id"),
                       F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("job_uuid"),
                       sh.skills_text(F.split("p_name", " ")).alias("skills"))
    details = src.read_job_details(spark, land.land_job_details(spark, sf_dir))
    j = dl.with_description(jobs, details)
    return j.select("job_id", F.col("job_description").alias("description"),
                    sh.combined_description("skills", "job_description").alias("combined_description"))


# --- skills -----------------------------------------------------------------

@query("extract_skills")
def q_extract_skills(spark, sf_dir):
    """M1 over every document with the benchmark-bigram dictionary."""
    docs = fx.table(spark, sf_dir, "documents")
    return extract_skills(docs, "doc_id", "text", fx.skill_dictionary(spark, sf_dir))


@query("extract_skills_short")
def q_extract_skills_short(spark, sf_dir):
    """M1 with one-letter and symbol phrases: c, c++, t###, "c t"."""
    return extract_skills(fx.table(spark, sf_dir, "documents"), "doc_id", "text", fx.short_skills(spark, sf_dir))


@query("similar_titles")
def q_similar_titles(spark, sf_dir):
    """F4 + X7: every title pair with stdlib similarity ratio >= 0.7 (query first)."""
    return similar_titles(fx.title_requests(spark, sf_dir),
                          fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("title")), 0.7)


# --- dates ------------------------------------------------------------------

@query("effective_since")
def q_effective_since(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return (dt.effective_since(o, "o_orderdate", 365, as_of="2001-08-01")
              .select("o_orderkey", "o_custkey", "o_orderstatus"))


@query("date_texts")
def q_date_texts(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", dt.load_date_text("ts").alias("load_date"), dt.stamp_text("ts").alias("stamp"),
                    dt.feedback_time_text("ts").alias("shown_at"),
                    dt.load_date_text(dt.days_before(dt.as_of_date("2024-01-31"))).alias("cutoff"))


# --- de-dup / delta -----------------------------------------------------------

@query("dedupe_latest")
def q_dedupe_latest(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    d = dl.dedupe(dl.drop_null_keys(li, "l_partkey"), "l_partkey",
                  [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"),
                   F.desc("l_quantity"), F.desc("l_returnflag")])
    return d.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("distinct_keys")
def q_distinct_keys(spark, sf_dir):
    return dl.distinct_keys(fx.table(spark, sf_dir, "lineitem"), "l_partkey")


@query("batch_metrics")
def q_batch_metrics(spark, sf_dir):
    """M9: lineitem keyed by part against a gold of the PROMO parts."""
    gold = fx.table(spark, sf_dir, "part").where(F.col("p_type") == "PROMO")
    return dl.batch_metrics(fx.table(spark, sf_dir, "lineitem"), gold, "l_partkey", "p_partkey")


@query("delta_anti_diff_key")
def q_delta_anti_diff_key(spark, sf_dir):
    """Customers with no urgent order (keys named differently)."""
    urgent = fx.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    c = fx.table(spark, sf_dir, "customer")
    return dl.delta_rows(c, urgent, "c_custkey", "o_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query("delta_anti_using")
def q_delta_anti_using(spark, sf_dir):
    """Documents without a label row (shared key name)."""
    d = fx.table(spark, sf_dir, "documents")
    return dl.delta_rows(d, fx.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars")


@query("missing_pages")
def q_missing_pages(spark, sf_dir):
    """S8 + A9 + X11: per site, pages 0..ceil(total/100)-1 not landed; each landed page reports
    total = (its number + 1) * 100."""
    pg = fx.table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"//([^/:?#]+)", 1).alias("source"),
        F.regexp_extract("url", r"/([0-9]+)", 1).cast("bigint").alias("page"))
    landed = pg.withColumn("countWithoutFilters", (F.col("page") + 1) * 100)
    totals = dl.reported_total(landed, ["source"])
    return src.missing_pages(totals, landed, ["source"])


# --- shaping --------------------------------------------------------------------

@query("flatten_nested")
def q_flatten_nested(spark, sf_dir):
    """S1 + P1-P3 + P9: job pages landed as JSON, read with a schema, flattened."""
    rows = sh.flatten_jobs(src.read_job_pages(spark, land.land_job_pages(spark, sf_dir)))
    return rows.withColumn("skills", sh.skills_text("skills"))


@query("pluck_first")
def q_pluck_first(spark, sf_dir):
    """P2 + P3 on arrays of structs built per order (items sorted by line number)."""
    li = fx.table(spark, sf_dir, "lineitem")
    items = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))  # total order
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    return o.select("o_orderkey", sh.first_of("items", "l_partkey").alias("first_part"),
                    F.array_join(sh.pluck("items", "l_partkey").cast("array<string>"), ",").alias("parts"))


@query("flatten_struct")
def q_flatten_struct(spark, sf_dir):
    """S2 + P4 + P5: course pages landed as JSON, flattened to dotted names, whitelisted."""
    c = src.read_course_pages(spark, land.land_course_pages(spark, sf_dir)).select("total", "c")
    flat = sh.flatten_struct(c)
    keep = ["c.referenceNumber", "c.title", "c.content", "c.outcome", "c.fieldOfStudies1", "total"]
    out = sh.select_existing(flat, keep + ["c.not_there"], strict=True)
    return out.toDF(*[n.replace(".", "_") for n in out.columns])


@query("array_text")
def q_array_text(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    a = F.split("p_name", " ")
    return p.select("p_partkey", sh.skills_text(a).alias("plain"), sh.skills_text(a, bracketed=True).alias("bracketed"))


@query("course_concat")
def q_course_concat(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    maybe = F.when(F.col("p_size") > 45, F.lit(None)).otherwise(F.col("p_type"))
    return p.select("p_partkey", sh.course_concat(F.col("p_name"), F.col("p_brand"), maybe,
                                                  F.col("p_type")).alias("concat"))


@query("cast_all")
def q_cast_all(spark, sf_dir):
    return sh.cast_all_string(fx.table(spark, sf_dir, "part"))


@query("union_pages")
def q_union_pages(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    a = d.where(F.col("lang") == "en").select("doc_id", "lang", "source")
    b = d.where(F.col("lang") != "en").select("doc_id", "lang", "n_chars")
    return sh.union_pages([a, b])


@query("array_union_skills")
def q_array_union_skills(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    u = sh.merge_lists(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " "))
    return p.select("p_partkey", F.array_join(u, ", ").alias("skills"))


# --- order / limit ----------------------------------------------------------------

@query("latest_n")
def q_latest_n(spark, sf_dir):
    """T4: the newest 5 pages of 100 orders (date desc, key asc)."""
    o = fx.table(spark, sf_dir, "orders")
    return (sh.preview(o, 5 * 100, [F.desc("o_orderdate"), F.asc("o_orderkey")])
              .select("o_orderkey", "o_custkey", "o_orderpriority"))


@query("snapshot_limit")
def q_snapshot_limit(spark, sf_dir):
    """T3 + P16: the first 10,000 orders by key (the snapshot cap)."""
    o = fx.table(spark, sf_dir, "orders")
    return sh.preview(o, 10_000, [F.asc("o_orderkey")]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("table_bytes")
def q_table_bytes(spark, sf_dir):
    """Text bytes per column of ``part`` and in total (numbers counted as their text)."""
    return dl.text_bytes(fx.table(spark, sf_dir, "part"))


# --- sinks and flows --------------------------------------------------------------------

@query("bronze_roundtrip")
def q_bronze_roundtrip(spark, sf_dir):
    """K1 + P8 + S9: events written by load date, one date read back (partition pruning)."""
    e = fx.table(spark, sf_dir, "events")
    path = scratch_path(spark, "bronze-events")
    # A month of dates in one batch (a backfill): clustered by date and a salt, 4 files per date.
    write_bronze(sh.with_load_date(e, dt.load_date_text("ts")), path, files_per_date=4)
    write_bronze(sh.with_load_date(e, dt.load_date_text("ts")), path, files_per_date=4)  # re-run replaces
    b = src.read_bronze(spark, path, "20240115")
    return b.select("event_id", "user_id", "event_type", "value", F.col("load_date").cast("string"))


@query("key_estimates")
def q_key_estimates(spark, sf_dir):
    """A2 from sketches kept per load date of the events: distinct users per month from the dates' sketches, beside the
    exact count; the estimate lies within 5 % (six standard errors)."""
    e = sh.with_load_date(fx.table(spark, sf_dir, "events"), dt.load_date_text("ts"))
    kept = materialize(dl.key_sketches(e, "user_id", ["load_date"]), spark, "user-sketches")
    month = F.substring("load_date", 1, 6).alias("month")
    est = dl.estimated_keys(kept.select(month, "rows", "sketch"), ["month"])
    exact = e.groupBy(month).agg(F.countDistinct("user_id").alias("exact_keys"))
    return est.join(exact, "month").select("month", "rows", "exact_keys", (
        F.abs(F.col("keys") - F.col("exact_keys")) <= F.col("exact_keys") * 0.05).alias("within"))


def _scratch_db(spark) -> str:
    name = "ss_" + scratch_path(spark, "db").rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{scratch_path(spark, 'warehouse')}'")
    return name


@query("jobs_gold_load")
def q_jobs_gold_load(spark, sf_dir):
    """M5 end to end, run twice on the same landing (second run appends nothing); gold rows."""
    db = _scratch_db(spark)
    pages, details = land.land_job_pages(spark, sf_dir), land.land_job_details(spark, sf_dir)
    bronze = scratch_path(spark, "bronze-jobs")
    skills = fx.skill_dictionary(spark, sf_dir)
    for _ in range(2):
        etl.run_jobs(spark, pages, details, bronze, skills, f"{db}.jobsdata", f"{db}.jobswithdescription",
                     as_of="2024-01-15")
    return spark.read.table(f"{db}.jobswithdescription")


@query("courses_gold_load")
def q_courses_gold_load(spark, sf_dir):
    """M6 end to end, run twice (idempotent); gold rows."""
    db = _scratch_db(spark)
    pages = land.land_course_pages(spark, sf_dir)
    skills = fx.skill_dictionary(spark, sf_dir)
    for _ in range(2):
        etl.run_courses(spark, pages, skills, f"{db}.courseData", f"{db}.coursewithdescription",
                        as_of="2024-01-15")
    return spark.read.table(f"{db}.coursewithdescription")


@query("flow_summary")
def q_flow_summary(spark, sf_dir):
    """M9 + A9 + S8 as the flows report them, each over a landing with page 0 twice, page 1 left out and page 2 broken
    off; ``quarantined``: documents found in the quarantine afterwards."""
    db = _scratch_db(spark)
    skills = fx.skill_dictionary(spark, sf_dir)
    wrong = {"repeat_page": 0, "skip_page": 1, "cut_page": 2}
    aside = scratch_path(spark, "quarantine")
    jobs = etl.run_jobs(spark, land.land_job_pages(spark, sf_dir, **wrong), land.land_job_details(spark, sf_dir),
                        scratch_path(spark, "bronze-jobs"), skills, f"{db}.jobsdata", f"{db}.jobswithdescription",
                        as_of="2024-01-15", quarantine=aside)
    courses = etl.run_courses(spark, land.land_course_pages(spark, sf_dir, odd_dates=True, **wrong), skills,
                              f"{db}.courseData", f"{db}.coursewithdescription", as_of="2024-01-15", quarantine=aside)
    kept = src.read_quarantine(spark, aside)
    out = None
    for flow, r in (("jobs", jobs), ("courses", courses)):
        n = kept.where((F.col("run") == r.run) & F.col("record").isNotNull()).agg(F.count(F.lit(1)))
        row = r.frame(spark).withColumn("flow", F.lit(flow)).withColumn("quarantined", n.scalar())
        out = row if out is None else out.unionByName(row)
    return out


@query("bronze_runs")
def q_bronze_runs(spark, sf_dir):
    """K1 + S9 by run: two landings of one date (even and odd pages), each run twice; bronze rows of the date with the
    number of runs, and whether gold holds them."""
    db = _scratch_db(spark)
    skills, details = fx.skill_dictionary(spark, sf_dir), land.land_job_details(spark, sf_dir)
    bronze = scratch_path(spark, "bronze-jobs")
    landings = [land.land_job_pages(spark, sf_dir, where=F.col("page") % 2 == i) for i in (0, 1)]
    for pages in landings * 2:
        etl.run_jobs(spark, pages, details, bronze, skills, f"{db}.jobsdata", f"{db}.jobswithdescription",
                     as_of="2024-01-15")
    b = src.read_bronze(spark, bronze, "20240115")
    gold = spark.read.table(f"{db}.jobswithdescription").select(F.col("jobPostId").alias("job_id"), F.lit(1).alias("g"))
    runs = b.select(F.countDistinct("run")).scalar()
    return b.join(gold, "job_id", "left").select("job_id", "title", F.col("load_date").cast("string"),
                                                 runs.alias("runs"), F.col("g").isNotNull().alias("in_gold"))


@query("serving_capped")
def q_serving_capped(spark, sf_dir):
    """K4 + M7: an export capped at 300 jobs (first ids) loaded back, with the distinct words kept for each job's title."""
    root = scratch_path(spark, "serving")
    jobs = fx.jobs(spark, sf_dir).select(F.concat(F.lit("JOB-"), F.col("job_id").cast("string")).alias("jobPostId"),
                                         "title", "skills_extracts")
    etl.export_serving(spark, fx.courses(spark, sf_dir).withColumnRenamed("combined_features", "SkillsTaxonomy"),
                       jobs, root, max_jobs=300)
    sv = src.load_serving(spark, root)
    words = sv["title_terms"].where(F.col("n") == 1).groupBy("title").agg(F.count(F.lit(1)).alias("words"))
    return sv["jobs"].join(words, "title", "left").select("jobPostId", "title", F.coalesce("words", F.lit(0)).alias("words"))


@query("jobs_newest_keyword")
def q_jobs_newest_keyword(spark, sf_dir):
    """M5 with F7 and T4: the 300 newest postings with "plate" in the title; their silver rows."""
    db = _scratch_db(spark)
    etl.run_jobs(spark, land.land_job_pages(spark, sf_dir), land.land_job_details(spark, sf_dir),
                 scratch_path(spark, "bronze-jobs"), fx.skill_dictionary(spark, sf_dir), f"{db}.jobsdata",
                 f"{db}.jobswithdescription", as_of="2024-01-15", keyword="Plate", newest=300)
    return spark.read.table(f"{db}.jobsdata").select("job_id", "title", F.col("load_date").cast("string"))


@query("serving_export")
def q_serving_export(spark, sf_dir):
    """M7 + K4 + S6: gold courses and all jobs -> serving tables -> loaded back; terms per course, jobs served."""
    db = _scratch_db(spark)
    skills = fx.skill_dictionary(spark, sf_dir)
    etl.run_courses(spark, land.land_course_pages(spark, sf_dir), skills, f"{db}.courseData",
                    f"{db}.coursewithdescription", as_of="2024-01-15")
    jobs_gold = fx.jobs(spark, sf_dir).select(F.concat(F.lit("JOB-"), F.col("job_id").cast("string")).alias("jobPostId"),
                                              "title", "skills_extracts")
    root = scratch_path(spark, "serving")
    etl.export_serving(spark, spark.read.table(f"{db}.coursewithdescription"), jobs_gold, root)
    sv = src.load_serving(spark, root)
    n = sv["postings"].groupBy(F.col("course_id").alias("referenceNumber")).agg(F.count(F.lit(1)).alias("n_terms"))
    served = sv["jobs"].select(F.countDistinct("jobPostId")).scalar()
    return (sv["courses"].join(n, "referenceNumber", "left")
              .select("referenceNumber", "title", "combined_features",
                      F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms"), served.alias("n_jobs")))


@query("feedback_append")
def q_feedback_append(spark, sf_dir):
    """M8 + K5: user turns as feedback rows, appended with a pinned server time, read back."""
    c = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    fb = c.select(
        F.when(F.col("turn") == 0, F.lit(None)).otherwise(F.concat(F.lit("conv "), F.col("conv_id").cast("string")))
         .alias("Search_input"),
        F.col("text").alias("Feedback"),
        (F.col("turn") % 6).cast("int").alias("User_rating"),
        (F.col("conv_id") % 6 + 5).cast("int").alias("Recommended_course_number"),
        (F.col("turn") % 2 == 0).alias("Show_score"))
    path = scratch_path(spark, "feedback")
    etl.record_feedback(fb, path, as_of="2024-01-15 10:30:00")
    back = spark.read.parquet(path)
    return back.select("Search_input", "Feedback", "User_rating", "Recommended_course_number", "Show_score",
                       dt.feedback_time_text("Timestamp").alias("Timestamp"))


@query("feedback_once")
def q_feedback_once(spark, sf_dir):
    """M8 + K5 once: every turn as feedback, all sent three times on one day and once on the next; read back."""
    c = fx.table(spark, sf_dir, "conversations")
    fb = c.select(F.col("role").alias("Search_input"), F.col("text").alias("Feedback"),
                  (F.col("turn") % 6).cast("int").alias("User_rating"), F.lit(5).alias("Recommended_course_number"),
                  F.when(F.col("turn") > 2, F.lit(True)).alias("Show_score"))
    path = scratch_path(spark, "feedback")
    etl.record_feedback(fb.unionByName(fb), path, as_of="2024-01-15 10:30:00", once=True)
    etl.record_feedback(fb, path, as_of="2024-01-15 10:31:00", once=True)
    etl.record_feedback(fb, path, as_of="2024-01-16 09:00:00", once=True)
    return spark.read.parquet(path).select("Search_input", "Feedback", "User_rating", "Recommended_course_number",
                                           "Show_score", dt.feedback_time_text("Timestamp").alias("Timestamp"))


# --- streaming ingest ------------------------------------------------------------------

@query("stream_bronze_ingest")
def q_stream_bronze_ingest(spark, sf_dir):
    """Job pages ingested by an availableNow file stream into bronze; run twice, the
    second run finds no new file. Bronze read back."""
    landing = land.land_job_pages(spark, sf_dir)
    bronze, ckpt = scratch_path(spark, "stream-bronze"), scratch_path(spark, "stream-ckpt")
    for _ in range(2):
        ingest_job_pages(spark, landing, bronze, ckpt, as_of="2024-01-15").awaitTermination()
    return spark.read.parquet(bronze).withColumn("load_date", F.col("load_date").cast("string"))


@query("stream_feedback_once")
def q_stream_feedback_once(spark, sf_dir):
    """Feedback landed, streamed, landed again in full (a retry) and streamed again within the day: kept once."""
    c = fx.table(spark, sf_dir, "conversations")
    landing = scratch_path(spark, "feedback-landing")
    fb = c.select(F.col("role").alias("Search_input"), F.col("text").alias("Feedback"),
                  (F.col("turn") % 6).cast("int").alias("User_rating"), F.lit(5).alias("Recommended_course_number"),
                  F.lit(True).alias("Show_score"))
    sink, ckpt = scratch_path(spark, "feedback-sink"), scratch_path(spark, "feedback-ckpt")
    for at in ("2024-01-15 10:30:00", "2024-01-15 18:00:00"):
        fb.write.mode("append").json(landing)
        ingest_feedback(spark, landing, sink, ckpt, as_of=at, once_within="1 day").awaitTermination()
    return spark.read.parquet(sink).select("Search_input", "Feedback", "User_rating", "Recommended_course_number",
                                           "Show_score", dt.feedback_time_text("Timestamp").alias("Timestamp"))


@query("stream_feedback")
def q_stream_feedback(spark, sf_dir):
    """Feedback rows landed as JSON, appended by an availableNow stream with a pinned time."""
    c = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    landing = scratch_path(spark, "feedback-landing")
    c.select(F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("Search_input"),
             F.col("text").alias("Feedback"), (F.col("turn") % 6).cast("int").alias("User_rating"),
             F.lit(5).alias("Recommended_course_number"), F.lit(True).alias("Show_score")
             ).write.json(landing)
    sink, ckpt = scratch_path(spark, "feedback-sink"), scratch_path(spark, "feedback-ckpt")
    ingest_feedback(spark, landing, sink, ckpt, as_of="2024-01-15 10:30:00").awaitTermination()
    back = spark.read.parquet(sink)
    return back.select("Search_input", "Feedback", "User_rating", "Recommended_course_number", "Show_score",
                       dt.feedback_time_text("Timestamp").alias("Timestamp"))

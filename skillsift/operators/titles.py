"""Job-title search: which postings count as "the searched job".

F3 ``contains_ci``        case-insensitive containment
F5 ``match_ratio_expr``   containment AND ratio >= threshold, in closed form
J6 ``match_titles``       many queries against many titles (batch F5)
F7 ``keyword_filter``     optional keyword filter on titles
F4 ``similar_titles``     general similarity ratio >= threshold (pandas UDF)

Closed form (F5). If the lower-cased query q is a substring of the lower-cased
title t, the longest matching block is q itself, so the similarity ratio is
2*len(q) / (len(q) + len(t)). This closed form *is* the semantics here at all
lengths (the stdlib matcher's "popular character" heuristic makes it differ
for titles of 200+ characters). Both empty gives ratio 1.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import similarity_ratio
from ..session import checked_broadcast, materialize

# Fixed value: a posting counts as the searched job at similarity >= 0.9.
DEFAULT_THRESHOLD = 0.9


def contains_ci(title, query) -> Column:
    """lower(title) contains lower(query)."""
    return F.contains(F.lower(title), F.lower(query))


def contained_ratio(title, query) -> Column:
    """2*len(q)/(len(q)+len(t)) on lower-cased text; 1.0 when both are empty."""
    lq = F.length(F.lower(query))
    lt = F.length(F.lower(title))
    return F.when(lq + lt == 0, F.lit(1.0)).otherwise(F.lit(2.0) * lq / (lq + lt))


def match_ratio_expr(title, query, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """the posting counts for the query (containment and ratio)."""
    return contains_ci(title, query) & (contained_ratio(title, query) >= F.lit(threshold))


def keyword_filter(df: DataFrame, keyword: str | None, title_col: str = "title") -> DataFrame:
    """rows whose title contains ``keyword`` (case-insensitive); empty keyword keeps all."""
    if not keyword:
        return df
    return df.filter(contains_ci(F.col(title_col), F.lit(keyword)))


# Titles longer than this are not cut into substrings (their number grows with the square of the length); only
# requests of nearly that length can match them, and those go by trigram.
LONG_TITLE = 256
Q = 3  # q-gram length of that filter


def _qgrams(text: Column) -> Column:
    """Distinct character q-grams of a (lower-cased) text; none for texts shorter than Q."""
    return F.when(F.length(text) >= Q, F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(text) - Q + 1), lambda i: F.substring(text, i, Q)))
    ).otherwise(F.array().cast("array<string>"))


def shortest_match(title_length: Column, threshold: float) -> Column:
    """Least length of a contained query with ratio 2q/(q+t) >= threshold: ceil(t * threshold / (2 - threshold)).

    Taken a hair lower against float rounding; every hit is verified by the ratio itself."""
    return F.greatest(F.ceil(title_length * F.lit(threshold / (2.0 - threshold)) - F.lit(1e-9)), F.lit(0)).cast("int")


def title_substrings(titles: DataFrame, lengths: list[int], threshold: float) -> DataFrame:
    """``(title, lq)``: every distinct substring of a lower-cased title that is long enough to match it, of the
    lengths that requests have."""
    x = titles.withColumn("_lt", F.lower("title"))
    wanted = F.filter(F.lit(lengths).cast("array<int>"), lambda n: (n >= shortest_match(F.length("_lt"), threshold)) & (n <= F.length("_lt")))
    cut = F.transform(wanted, lambda n: F.transform(F.sequence(F.lit(1), F.length("_lt") - n + 1),
                                                    lambda i: F.substring(F.col("_lt"), i, n)))
    return x.select("title", F.explode(F.array_distinct(F.flatten(cut))).alias("lq"))


def match_titles(requests: DataFrame, titles: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                 broadcast_rows: int = 1_000_000) -> DataFrame:
    """``(query_id, query, title)`` for every distinct request and every distinct title it matches.

    ``requests``: ``(query_id, query)``; ``titles``: a ``title`` column; repeats of either
    are folded first. One path for any number of requests: a title of length l is matched only by its own substrings
    of length >= l * t / (2 - t) (21 of them at l = 30, t = 0.9), so those meet the requests in an equi-join on
    the text. Every meeting is a match, no key is hotter than its matches, and requests proven few are broadcast.

    Titles over ``LONG_TITLE`` characters meet the requests long enough to match them through the rarest trigram of
    the request instead (an exact filter, verified); requests shorter than a trigram, which only a threshold near 0
    lets match such titles, through the titles' distinct substrings of their length.
    """
    t = titles.select("title").where(F.col("title").isNotNull()).distinct()
    r = requests.select("query_id", "query").where(F.col("query").isNotNull()).distinct()
    if threshold > 1:
        return r.join(t.where(F.lit(False)), r["query"] == t["title"]).select("query_id", "query", "title")
    rq = materialize(r.withColumn("lq", F.lower("query")), requests.sparkSession, "title-requests")
    length = F.length("lq")                               # at most LONG_TITLE + 1 distinct values come back
    asked = rq.agg(F.sort_array(F.collect_set(F.when(length <= LONG_TITLE, length))).alias("ls"),
                   F.max(length).alias("longest")).first()
    rb, _ = checked_broadcast(rq, broadcast_rows)
    short = title_substrings(t.where(F.length(F.lower("title")) <= LONG_TITLE), asked["ls"], threshold).join(rb, "lq") \
        .where(match_ratio_expr(F.col("title"), F.col("query"), threshold)).select("query_id", "query", "title")
    if (asked["longest"] or 0) < int(LONG_TITLE * threshold / (2.0 - threshold)):
        return short
    long = t.where(F.length(F.lower("title")) > LONG_TITLE)
    tiny = [n for n in asked["ls"] if n < Q]
    if tiny:
        short = short.unionByName(title_substrings(long, tiny, threshold).join(rb, "lq").where(
            match_ratio_expr(F.col("title"), F.col("query"), threshold)).select("query_id", "query", "title"))
    return short.unionByName(_match_long(rq.where(length >= Q), long, threshold))


def _match_long(asked: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """Long titles: each request (of a trigram at least) probes them through its rarest; candidates are verified."""
    tg = materialize(titles.select("title", F.explode(_qgrams(F.lower("title"))).alias("g")), asked.sparkSession,
                     "title-qgrams")
    freq = tg.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    rarest = (asked.withColumn("g", F.explode(_qgrams(F.col("lq")))).join(freq, "g")
                   .groupBy("query_id", "query").agg(F.min_by("g", F.struct("f", "g")).alias("g")))
    return (rarest.join(tg, "g").where(match_ratio_expr(F.col("title"), F.col("query"), threshold))
                  .select("query_id", "query", "title"))


def match_jobs(requests: DataFrame, jobs: DataFrame, threshold: float = DEFAULT_THRESHOLD,
               broadcast_rows: int = 1_000_000) -> DataFrame:
    """F5 + J6: every posting of ``jobs`` (needs ``title``) that matches a request.

    Matching runs on distinct titles; the ``(query_id, title)`` matches are
    joined back to all postings by title -- broadcast when their count is
    checked, else a shuffle join where AQE splits a hot title.
    """
    m = materialize(match_titles(requests, jobs, threshold), jobs.sparkSession, "title-matches")
    mb, small = checked_broadcast(m, broadcast_rows)      # rows and bytes, from the written files
    if not small:
        return jobs.join(mb, "title")
    # Semi-join first: Catalyst pushes it below joins inside ``jobs`` (e.g. a
    # postings-with-text view), so only matched postings carry their text on.
    titles = F.broadcast(m.select("title").distinct())
    return jobs.join(titles, "title", "left_semi").join(mb, "title")


def _items(text: Column) -> Column:
    """A text's characters as distinct items: the n-th time a character occurs is item (character, n)."""
    chars = F.filter(F.split(text, ""), lambda c: F.length(c) > 0)
    return F.transform(chars, lambda c, i: F.struct(
        c.alias("c"), F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c)).alias("n")))


def similar_titles(requests: DataFrame, titles: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``(query_id, query, title, ratio)`` with stdlib similarity ratio >= threshold (> 0).

    The ratio is not symmetric; the query is the first argument. It never exceeds twice the
    shared characters (counted as a multiset) over both lengths, which gives an exact filter
    without comparing all pairs: as (character, occurrence) items, a text of length l shares at
    least ``ceil(l * t / (2 - t))`` items with any partner that reaches t, so two partners share one of
    their ``l - that + 1`` rarest items. Texts meet on those items only, the multiset bound is
    verified natively, and each surviving pair's ratio is computed once.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive: every pair would qualify")
    r = requests.select("query_id", "query").where(F.col("query").isNotNull()).distinct()
    t = titles.select("title").where(F.col("title").isNotNull()).distinct()
    spark = requests.sparkSession
    texts = materialize(r.select(F.lower("query").alias("x")).unionByName(t.select(F.lower("title").alias("x")))
                         .distinct().withColumn("items", _items(F.col("x"))), spark, "title-items")
    freq = texts.select(F.explode("items").alias("it")).groupBy("it").agg(F.count(F.lit(1)).alias("f"))
    length = F.length("x")
    need = F.ceil(length * F.lit(threshold / (2.0 - threshold)) - F.lit(1e-9))
    ranked = (texts.select("x", F.explode("items").alias("it")).join(freq, "it")
                   .withColumn("rn", F.row_number().over(Window.partitionBy("x").orderBy("f", "it")))
                   .where(F.col("rn") <= length - need + 1).select("x", "it"))
    prefix = materialize(ranked, spark, "title-prefixes")
    lq, lt = prefix.toDF("lq", "it"), prefix.toDF("lt", "it")
    asked = r.select(F.lower("query").alias("lq")).distinct()
    offered = t.select(F.lower("title").alias("lt")).distinct()
    met = (lq.join(asked, "lq", "left_semi").join(lt.join(offered, "lt", "left_semi"), "it")
             .select("lq", "lt").distinct())
    empty = asked.where("lq = ''").join(offered.where("lt = ''").withColumnRenamed("lt", "e"),
                                        F.col("lq") == F.col("e")).select("lq", F.col("e").alias("lt"))
    both = F.length("lq") + F.length("lt")
    shared = F.size(F.array_intersect(_items(F.col("lq")), _items(F.col("lt"))))
    close = met.where(2.0 * shared / both >= F.lit(threshold) - F.lit(1e-9)).unionByName(empty)
    scored = materialize(close.withColumn("ratio", similarity_ratio(F.col("lq"), F.col("lt"))), spark, "title-ratios")
    hits = scored.where(F.col("ratio") >= F.lit(threshold))
    return (hits.join(r.withColumn("lq", F.lower("query")), "lq").join(t.withColumn("lt", F.lower("title")), "lt")
                .select("query_id", "query", "title", "ratio"))

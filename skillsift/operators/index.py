"""Term statistics, the course TF-IDF index and cosine scoring.

A4 ``term_counts``      n-gram occurrence counts, optionally per group
T1 ``top_terms``        k most frequent terms per group (count desc, term asc)
A5 ``fit_vocabulary``   document frequency and smoothed idf
M2 ``fit_course_index`` L2-normalised tf*idf postings (A6, X14)
M3 ``score_courses``    cosine of query vectors against all courses (J5, X15)
T2 ``top_courses``      k best courses per query, zero-score padding (§4.3)
J4 ``attach_courses``   course attributes for the ranked ids

The index is a *long* table ``(course_id, term, tf, weight)`` instead of a
sparse matrix: scoring is an equi-join on ``term`` followed by a grouped sum,
so it distributes over courses and queries alike.

Weights follow the usual smoothed TF-IDF: ``tf`` = raw count,
``idf = ln((1 + N) / (1 + df)) + 1``, then L2 normalisation per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import join_terms, ngrams, tokens
from ..session import checked_broadcast, drop_scratch, materialize
from .delta import dedupe

# Scores are rounded before ranking so that summation order cannot reorder ties.
RANK_DIGITS = 9
# No token holds it, nor does an n-gram: it parts the terms of a packed document.
TERM_END = "\n"
# Postings of a task that sorts them by document.
SORTED_POSTINGS = 1_000_000


def analyzed_terms(tok, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """All terms for an n-gram range from a token-array column: n-grams for n in range."""
    lo, hi = ngram_range
    parts = [ngrams(tok, n) for n in range(lo, hi + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def term_counts(df: DataFrame, text_col: str, n: int, group_cols: list[str] | tuple = ()) -> DataFrame:
    """A4: occurrences of each n-gram over all rows (per group): ``(*group, term, cnt)``.

    N-grams never cross rows. The explode happens where the row lives and the
    partial aggregation folds repeats before the shuffle, so only distinct
    (group, term) pairs per task travel.
    """
    g = list(group_cols)
    return (df.select(*g, tokens(text_col).alias("_tok"))
              .select(*g, F.explode(ngrams(F.col("_tok"), n)).alias("term"))
              .groupBy(*g, "term").agg(F.count(F.lit(1)).alias("cnt")))


def top_terms(counts: DataFrame, k: int = 10, group_cols: list[str] | tuple = ()) -> DataFrame:
    """The k most frequent terms per group, count desc then term asc, with a 1-based rank.

    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the
    shuffle, so a hot group never sends more than k rows per task.
    """
    g = list(group_cols)
    w = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy(F.desc("cnt"), F.asc("term"))
    return (counts.withColumn("_rn", F.row_number().over(w))
                  .filter(F.col("_rn") <= k)
                  .withColumn("rank", F.col("_rn").cast("bigint")).drop("_rn"))


def terms_text(top: DataFrame, group_cols: list[str] | tuple = (), sep: str = ", ") -> DataFrame:
    """X12 after T1: the ranked terms of each group joined into one query text."""
    g = list(group_cols)
    return (top.groupBy(*g)
               .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_r"))
               .select(*g, join_terms(F.transform("_r", lambda x: x["term"]), sep).alias("skills_query")))


@dataclass
class CourseIndex:
    """Fitted course index: postings ``(course_id, term, tf, weight)`` and
    vocabulary ``(term, df, idf)``; ``ngram_range`` is the analyzer setting. With blocks
    (``operators.blocks``) also ``blocked`` ``(block, course_id, term, weight)`` and ``maxima``
    ``(term, block, most)``."""
    postings: DataFrame
    vocab: DataFrame
    ngram_range: tuple[int, int] = (1, 1)
    blocked: DataFrame | None = None
    maxima: DataFrame | None = None


def doc_term_tf(docs: DataFrame, id_col: str, text_col: str,
                ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """``(doc_id, term, tf)``: raw term counts per document (text stays out of the shuffle)."""
    return (docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("_tok"))
                .select("doc_id", F.explode(analyzed_terms(F.col("_tok"), ngram_range)).alias("term"))
                .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))


def fit_vocabulary(tf: DataFrame, n_docs: Column) -> DataFrame:
    """A5: ``(term, df, idf)`` with ``idf = ln((1 + N) / (1 + df)) + 1``.

    ``df`` is a grouped count with map-side partial aggregation: a term present
    in every document costs one row per task, not one per document.
    """
    return (tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
              .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)))


def split_hot_join(big: DataFrame, dim: DataFrame, key: str, freq_col: str, cols: list[str],
                   max_rows: int) -> DataFrame:
    """Inner join ``big`` with ``dim`` on ``key`` where ``dim[freq_col]`` counts
    the rows of ``big`` per key, without a skewed shuffle partition.

    Keys with ``freq >= D`` (D = rows of big / max_rows) are few -- at most
    ``max_rows`` of them, since their frequencies sum to at most the rows of
    ``big`` -- so they are broadcast and their rows joined in place. The other
    keys go through an ordinary shuffle join in which no key has more than D
    rows. Exact: each row of ``big`` meets exactly one branch.
    """
    total = dim.agg(F.sum(freq_col)).first()[0] or 0
    d = max(1, -(-total // max_rows))
    hot = dim.where(F.col(freq_col) >= d).select(key, *cols)
    cold = dim.where(F.col(freq_col) < d).select(key, *cols)
    hot_b, _ = checked_broadcast(hot, max_rows)
    # The rows of hot keys leave before the shuffle: only those of rare keys travel.
    rare = big.join(hot_b.select(key), key, "left_anti")
    return big.join(hot_b, key).unionByName(rare.join(cold, key))


def doc_runs(docs: DataFrame, id_col: str, text_col: str, ngram_range: tuple[int, int] = (1, 1),
             unique: bool = False) -> DataFrame:
    """``(doc_id, runs)``: a document's distinct terms with their counts, ``array<struct<term, tf>>``, one row per id.

    Counted inside the row: the sorted terms of a text fall into runs, and a run's length is the count. Nothing is
    exploded, so nothing is grouped, sorted or spilled but the texts of ids that repeat (none where ``unique``)."""
    t = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("_tok"))
    t = t.select("doc_id", analyzed_terms(F.col("_tok"), ngram_range).alias("_t"))
    if not unique:
        t = t.where(F.col("_t").isNotNull()).groupBy("doc_id").agg(F.flatten(F.collect_list("_t")).alias("_t"))
    t = t.where(F.size("_t") > 0).select("doc_id", F.sort_array("_t").alias("_t"))
    # Where a run starts, from 1; the next start, or the end, closes it.
    pos = F.sequence(F.lit(1), F.size("_t"))
    starts = F.filter(pos, lambda i: (i == 1) | (F.get("_t", i - 1) != F.get("_t", i - 2)))
    t = t.select("doc_id", "_t", starts.alias("_s"))
    run = F.zip_with("_s", F.concat(F.slice("_s", 2, F.size("_s")), F.array(F.size("_t") + 1)), lambda a, b: F.struct(
        F.get("_t", a - 1).alias("term"), (b - a).cast("bigint").alias("tf")))
    return t.select("doc_id", run.alias("runs"))


def fit_idf(courses: DataFrame, id_col: str, text_col: str, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """A5 alone: ``(term, df, idf)`` from one pass over the texts, no postings.

    Rows of one id are one document: a term counts once per id, N counts distinct ids. Where the ids are
    unique (one aggregate over the id column), each row's distinct terms are counted as they are."""
    st = _rows_and_ids(courses, id_col)
    if st["rows"] == st["ids"]:
        tok = courses.select(tokens(text_col).alias("_tok"))
        tf = tok.select(F.explode(F.array_distinct(analyzed_terms(F.col("_tok"), ngram_range))).alias("term"))
    else:
        tf = doc_term_tf(courses, id_col, text_col, ngram_range)
    return fit_vocabulary(tf, F.lit(st["ids"]))


def _rows_and_ids(courses: DataFrame, id_col: str):
    return courses.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(id_col).alias("ids")).first()


def fit_course_index(courses: DataFrame, id_col: str, text_col: str, ngram_range: tuple[int, int] = (1, 1),
                     vocab_broadcast_rows: int = 2_000_000, out_root: str | None = None) -> CourseIndex:
    """M2: fit the TF-IDF index over ``courses``; rows of one id are one document.

    Vocabulary and postings are written once to the shared checkpoint folder (or to
    ``out_root``/vocab and ``out_root``/postings, the serving layout) and read back, so scoring
    never re-tokenises the corpus and a lost executor re-reads files instead of recomputing the fit.

    The texts are read once: each document's distinct terms and counts are written as one row (``doc_runs``), about as
    large as its text. The vocabulary and the norms come from that table, and it is deleted after the fit. Documents
    travel once, as one packed row each. With a vocabulary that is broadcast a document's postings are then cut and
    normed where it lies; with a larger one a norm joins its document's row before the row is cut, so the postings, many
    times the texts, are shuffled only where their term is rare.
    """
    spark = courses.sparkSession
    st = _rows_and_ids(courses, id_col)
    runs = materialize(doc_runs(courses, id_col, text_col, ngram_range, st["rows"] == st["ids"]), spark, "course-runs")
    vocab = materialize(fit_vocabulary(runs.select(F.explode("runs.term").alias("term")), F.lit(st["ids"])), spark,
                        "course-vocab", f"{out_root.rstrip('/')}/vocab" if out_root else None)
    # Weight join on term. A vocabulary under the bound (rows and bytes read from the written
    # files) is broadcast; a larger one is split by frequency (split_hot_join), so no shuffle
    # partition holds a stopword's postings.
    v, small = checked_broadcast(vocab.select("term", "idf"), vocab_broadcast_rows)

    def weighted(docs: DataFrame) -> DataFrame:
        rest = [c for c in docs.columns if c != "runs"]
        tf = docs.select(*rest, F.explode("runs").alias("r")).select(*rest, "r.term", "r.tf")
        w = tf.join(v, "term") if small else split_hot_join(tf, vocab, "term", "df", ["idf"], vocab_broadcast_rows)
        return w.withColumn("w", F.col("tf") * F.col("idf"))

    packed = runs.select("doc_id", F.array_join("runs.term", TERM_END).alias("_t"), F.col("runs.tf").alias("_f"))
    squares = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    if small:
        total = vocab.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        parts = max(spark.sparkContext.defaultParallelism, -(-total // SORTED_POSTINGS))
        w = weighted(_unpacked(packed.repartition(parts, "doc_id"))).withColumn("norm", squares)
    else:
        norms = weighted(runs).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        # Null-safe: rows without an id are one document too.
        n = norms.withColumnRenamed("doc_id", "_id")
        w = weighted(_unpacked(packed.join(n, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")))
    postings = w.select(F.col("doc_id").alias("course_id"), "term", "tf", (F.col("w") / F.col("norm")).alias("weight"))
    postings = materialize(postings, spark, "course-postings",
                           f"{out_root.rstrip('/')}/postings" if out_root else None)
    drop_scratch(spark, runs)
    return CourseIndex(postings=postings, vocab=vocab, ngram_range=ngram_range)


def _unpacked(docs: DataFrame) -> DataFrame:
    """Packed documents with their ``runs`` again."""
    rest = [c for c in docs.columns if c not in ("_t", "_f")]
    return docs.select(*rest, F.zip_with(F.split("_t", TERM_END), "_f", lambda t, f: F.struct(t.alias("term"), f.alias("tf")))
                       .alias("runs"))


def load_index(spark: SparkSession, root: str, ngram_range: tuple[int, int] = (1, 1)) -> CourseIndex:
    """The index a serving export left under ``root``, ready to answer requests without a fit."""
    r = root.rstrip("/")
    return CourseIndex(spark.read.parquet(f"{r}/postings"), spark.read.parquet(f"{r}/vocab"), ngram_range)


def vectorize(queries: DataFrame, key_cols: list[str], text_col: str, index: CourseIndex) -> DataFrame:
    """Query texts -> ``(*key, term, qweight)`` with the index's analyzer and idf.

    Out-of-vocabulary terms vanish; the vector is L2-normalised over the rest.
    A query without any known term yields no rows (its cosine is 0 everywhere).
    """
    k = list(key_cols)
    qtf = (queries.select(*k, tokens(text_col).alias("_tok"))
                  .select(*k, F.explode(analyzed_terms(F.col("_tok"), index.ngram_range)).alias("term"))
                  .groupBy(*k, "term").agg(F.count(F.lit(1)).alias("tf")))
    w = qtf.join(index.vocab.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*k)))
    return w.select(*k, "term", (F.col("w") / norm).alias("qweight"))


def salted_term_join(qvec: DataFrame, postings: DataFrame, vocab: DataFrame, max_rows: int,
                     target_rows: int = 1_000_000) -> DataFrame:
    """Shuffle join of query terms with postings on ``term`` without hot partitions.

    Terms with ``df >= D`` (D = max(target_rows, #postings / max_rows)) are at
    most ``max_rows`` -- their ``(term, salts)`` table is broadcast behind that
    proof. Their postings are spread over ``ceil(df / D)`` salts by course
    hash and each query row of such a term is repeated once per salt; all
    other terms join on salt 0. Exact: every (query term, posting) pair meets
    in exactly one salt. The repetition is bounded by the join's own output.
    """
    total = vocab.agg(F.sum("df")).first()[0] or 0
    d = max(int(target_rows), -(-total // max(max_rows, 1)), 1)
    hot = vocab.where(F.col("df") >= d).select("term", F.ceil(F.col("df") / F.lit(d)).cast("int").alias("_s"))
    hot_b, _ = checked_broadcast(hot, max_rows)
    p = (postings.join(hot_b, "term", "left")
                 .withColumn("_salt", F.when(F.col("_s").isNull(), F.lit(0))
                             .otherwise(F.pmod(F.xxhash64("course_id"), F.col("_s")).cast("int")))
                 .drop("_s"))
    q = (qvec.join(hot_b, "term", "left")
             .withColumn("_salt", F.explode(F.when(F.col("_s").isNull(), F.array(F.lit(0)))
                                            .otherwise(F.sequence(F.lit(0), F.col("_s") - 1))))
             .drop("_s"))
    return q.join(p, ["term", "_salt"]).drop("_salt")


def score_courses(qvec: DataFrame, key_cols: list[str], index: CourseIndex,
                  broadcast_rows: int = 2_000_000, known_rows: int | None = None,
                  salt_target_rows: int = 1_000_000) -> DataFrame:
    """M3: cosine similarity ``(*key, course_id, score)`` for every course sharing a term.

    The query vectors (at most a few dozen terms per query) are broadcast when
    their row count is checked, so the postings are only scanned, never
    shuffled, for the join. Above the bound the join shuffles on (term, salt)
    with frequent terms salted (``salted_term_join``). The sum per
    (query, course) is partially aggregated.
    """
    k = list(key_cols)
    post = index.postings.select("term", "course_id", "weight")
    qb, small = checked_broadcast(qvec, broadcast_rows, known_rows)
    joined = (qb.join(post, "term") if small
              else salted_term_join(qvec, post, index.vocab, broadcast_rows, salt_target_rows))
    return (joined.groupBy(*k, "course_id")
                  .agg(F.sum(F.col("qweight") * F.col("weight")).alias("score")))


def top_courses(scores: DataFrame, key_cols: list[str], keys: DataFrame, courses: DataFrame,
                course_id: str, k: int = 5) -> DataFrame:
    """Exactly ``min(k, #distinct course ids)`` courses per query key, score desc then course id asc.

    ``keys`` lists every query key that must get a ranking (also those whose
    vector is empty). Courses without a shared term score 0; instead of a
    queries x courses product, the first k courses in tie order (smallest ids)
    are added to every key with score 0 -- enough because at most the positive
    ones among them can be displaced (§4.3). Output ``(*key, rank, course_id, score)``.
    """
    kc = list(key_cols)
    first_k = (courses.select(F.col(course_id).alias("course_id")).distinct()
                      .orderBy("course_id").limit(k)
                      .agg(F.collect_list("course_id").alias("ids")))
    pad = (keys.select(*kc).distinct()
               .withColumn("course_id", F.explode(first_k.scalar()))
               .withColumn("score", F.lit(0.0)))
    allc = (scores.select(*kc, "course_id", "score").unionByName(pad)
                  .groupBy(*kc, "course_id").agg(F.max("score").alias("score")))
    w = Window.partitionBy(*kc).orderBy(F.desc(F.round("score", RANK_DIGITS)), F.asc("course_id"))
    return (allc.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
                .withColumn("rank", F.col("_rn").cast("bigint")).drop("_rn"))


def attach_courses(ranked: DataFrame, courses: DataFrame, course_id: str, cols: list[str]) -> DataFrame:
    """Equi-join ranked ids to course attributes (the ranked side is k rows per query).

    Of several rows of one course id the smallest in the order of ``cols`` counts (NULL last), so a
    ranking never grows; the choice is made among the rows of ranked ids only."""
    c = courses.select(F.col(course_id).alias("course_id"), *cols)
    ids = ranked.select("course_id").distinct()
    one = dedupe(c.join(ids, "course_id", "left_semi"), "course_id", [F.asc_nulls_last(x) for x in cols])
    return ranked.join(one, "course_id")

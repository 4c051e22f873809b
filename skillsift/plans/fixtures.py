"""Logical inputs of the library bound to the driver's test tables.

| Logical input          | Built from                                                      |
| jobs                   | part (p_partkey id, p_name title, p_type category, p_brand level,
|                        |  p_retailprice salary) + documents.text as skills text on
|                        |  doc_id = p_partkey mod count(documents)                         |
| job description HTML   | pages.html on page_id = p_partkey mod count(pages)              |
| courses                | documents (doc_id reference number, text features, source title)|
| skills dictionary      | distinct bigrams of benchmark.text                              |
| requests               | distinct p_name, id = smallest p_partkey of that name           |

Every binding is a lazy DataFrame over the whole tables; counts used for the
modulo keys are scalar subqueries, not driver round trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens
from ..session import balance

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Key of each table, used when an under-split scan is spread (session.balance).
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
        "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
        "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
        "labels": "doc_id", "conversations": "conv_id"}
# Tables small enough that spreading them would cost more than it saves.
SMALL = {"region", "nation", "supplier", "labels", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df if name in SMALL else balance(df, KEYS.get(name))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, title, category, level, salary, skills_extracts)``."""
    part = table(spark, sf_dir, "part")
    docs = table(spark, sf_dir, "documents")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    p = part.select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"),
                    F.col("p_type").alias("category"), F.col("p_brand").alias("level"),
                    F.col("p_retailprice").alias("salary"),
                    F.pmod(F.col("p_partkey"), n_docs).alias("_doc"))
    d = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("skills_extracts"))
    return p.join(d, "_doc").drop("_doc")


def job_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, uuid, html)``: the landed detail document of each posting."""
    part = table(spark, sf_dir, "part")
    pages = table(spark, sf_dir, "pages")
    n_pages = pages.select(F.count(F.lit(1))).scalar()
    p = part.select(F.col("p_partkey").alias("job_id"), F.pmod(F.col("p_partkey"), n_pages).alias("page_id"))
    return (p.join(pages.select("page_id", "html"), "page_id")
             .select("job_id", F.concat(F.lit("u"), F.col("job_id").cast("string")).alias("uuid"), "html"))


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(referenceNumber, title, combined_features)``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("referenceNumber"), F.col("source").alias("title"),
        F.col("text").alias("combined_features"))


def title_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, query)``: every distinct job title once."""
    return (table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("query"))
            .agg(F.min("p_partkey").alias("query_id")).select("query_id", "query"))


def single_request(spark: SparkSession, query: str, query_id: int = 1) -> DataFrame:
    """A one-row request frame from a literal."""
    return spark.createDataFrame([(query_id, query)], "query_id bigint, query string")


def skill_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(skill_id, phrase)``: distinct token bigrams of ``benchmark.text``.

    ``skill_id`` = smallest ``item_id * 1_000_000 + position`` of the phrase.
    """
    b = table(spark, sf_dir, "benchmark")
    g = (b.select("item_id", tokens("text").alias("_tok"))
          .select("item_id", F.posexplode(ngrams(F.col("_tok"), 2)).alias("pos", "phrase")))
    return (g.groupBy("phrase").agg(F.min(F.col("item_id") * 1_000_000 + F.col("pos")).alias("skill_id"))
             .select("skill_id", "phrase"))


def short_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(skill_id, phrase)``: one-letter and symbol phrases from the distinct tokens of ``benchmark.text``.

    For a token t with first letter c: ``c``, ``c++``, ``t###``, ``c t``, ``.t``, ``c&t`` and ``c-t``, ids by hash."""
    t = table(spark, sf_dir, "benchmark").select(F.explode(tokens("text")).alias("t")).distinct()
    c = F.substring("t", 1, 1)
    p = t.select(F.explode(F.array(c, F.concat(c, F.lit("++")), F.concat("t", F.lit("###")),
                                   F.concat(c, F.lit(" "), F.col("t")), F.concat(F.lit("."), F.col("t")),
                                   F.concat(c, F.lit("&"), F.col("t")), F.concat(c, F.lit("-"), F.col("t"))))
                 .alias("phrase")).distinct()
    return p.select(F.xxhash64("phrase").alias("skill_id"), "phrase")

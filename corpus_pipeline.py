"""A training-data pipeline over ``documents``: quality, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
``docs``. All but the last return the columns of documents. Every stage works on all rows it is given.
"""

from __future__ import annotations

import functools
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from skillsift.llm import mixing, packing, quality, secrets, simhash  # noqa: E402
from skillsift.llm.common import id_remainder, in_file_order  # noqa: E402
from skillsift.llm.queries import table, tokenizer_path  # noqa: E402
from skillsift.session import ensure_checkpoint_dir, materialize, ship_package  # noqa: E402


def stage(fn):
    """A stage that first makes the package importable in the executors' Python workers."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality classifier accepts (learned from the labels of four fifths)."""
    ranker = quality.learn(docs, table(spark, sf_dir, "labels"), id_remainder() != 0)
    return quality.keep_good(docs, ranker)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash near-duplicate component: that with the smallest doc_id."""
    return simhash.keep_one(docs)


@stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every reported secret replaced."""
    return secrets.redact(docs, gaps=True)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mixture of sources: documents as often as they are taken, in the order of the queue."""
    return mixing.mixed(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids, in the order the mixture wrote them."""
    rows, order = in_file_order(docs)
    return packing.pack_documents(rows, tokenizer_path(), order=order)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("secrets", without_secrets),
          ("mixture", mixture), ("packing", packed)]

# Fingerprints, learned scores and encodings have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir), spark, f"pipeline-{name}")
    return docs

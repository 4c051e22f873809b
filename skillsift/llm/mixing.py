"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

A document's size is its number of words. Sources in code point order (null last) have the weights
``weights`` in turn and share the total size of all documents; a source's target stops at ``repeats`` times
its own size, and what it leaves is shared again by weight until no target is above that (closed form: in
ascending order of limit / weight a source is capped if its share of what the sources before it leave reaches
its limit).

Each source's documents are shuffled by a hash of (seed, doc_id). A document's copy number e has the virtual
finish time

    ((e - 1) * source size + sizes of the source up to the document) / target

All copies are range-sorted by virtual finish time over the whole cluster and taken, whole, while the running
total stays within the total budget; so at any moment every source has been served in proportion to its
target. The result does not depend on partitions, and reruns agree.

Cases: null text = empty text, size 0, taken 0; a null source is a source of its own, last in order; a null
doc_id hashes as the empty text; repeated rows are queued one by one; a total of 0 gives targets 0; an empty
table gives no rows; other columns are not read by ``mix``, and ``mixed`` returns them unchanged.

Plan: sizes are written once, narrow. Running sums are two-level: sums per (source, leading hash digits) are
prefix-summed, then documents only inside their (source, digits) cell; so a source with a third of all rows is
spread over all cells. The global order is a range sort, its running total again partition sums plus sums
inside a partition. No step collects a source, and rows of a cell stay near ``cell`` at every size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """_row, doc_id, source, tie (text hash), size, h (shuffle order), written once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.xxhash64(text_or_empty()).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.size(F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"))
    return materialize(rows, docs.sparkSession, "mix-sizes")


def targets(per_source: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """``per_source`` (source, source_size) with weight and target."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    turn = F.get(F.array(*[F.lit(w) for w in weights]), (rank - 1) % len(weights)).cast("long")
    limit = F.col("source_size") * repeats
    order = Window.orderBy((F.col("limit") / F.col("weight")), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = per_source.withColumn("weight", turn).withColumn("limit", limit)
    s = s.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))) \
         .withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("limit") * F.col("rest_weight") <= F.col("rest") * F.col("weight"))
    open_ = F.col("rest") * F.when(~F.col("capped"), 1)
    share = s.withColumn("left_", F.max(open_).over(whole)) \
             .withColumn("left_weight", F.max(F.when(~F.col("capped"), F.col("rest_weight"))).over(whole))
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(
        (F.col("weight") * F.col("left_")).cast("double") / F.col("left_weight").cast("double"))
    return share.select("source", "source_size", target.alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "mix-1-",
        cell: int = 500) -> DataFrame:
    """One row per document: doc_id, source, tie, size, source_size, target, copies, taken (= copies * size), served
    (its source's words up to and with it, in shuffle order)."""
    spark = docs.sparkSession
    own = sized(docs, seed)
    n = own.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / cell, 16))) if n > cell else 1
    own = own.withColumn("digits", F.substring("h", 1, digits))
    cells = materialize(own.groupBy("source", "digits").agg(F.sum("size").alias("cell_size")), spark, "mix-cells")
    goal = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, repeats)
    upto = Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(
        cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(upto), F.lit(0))).alias("c")
             .join(goal.alias("g"), _same_source("c", "g"))
             .select("c.source", "c.digits", "c.cell_start", "g.source_size", "g.target"), spark, "mix-starts")
    inside = Window.partitionBy("o.source", "o.digits").orderBy("h", "doc_id", "_row") \
                   .rowsBetween(Window.unboundedPreceding, 0)
    queued = (own.alias("o").join(cells.alias("c"), _same_source("o", "c") & (F.col("o.digits") == F.col("c.digits")))
                 .select("_row", "doc_id", "o.source", "tie", "size", "h", "source_size", "target",
                         (F.col("cell_start") + F.sum("size").over(inside)).alias("served")))
    queued = materialize(queued, spark, "mix-queued")
    copies = (queued.where("size > 0").withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
                    .withColumn("finish", ((F.col("e") - 1) * F.col("source_size") + F.col("served")).cast("double")
                                / F.col("target")))
    order = ["finish", "h", "doc_id", "_row", "e"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(copies.select(*order, "size").repartitionByRange(parts, *order)
                               .withColumn("part", F.spark_partition_id()), spark, "mix-ranged")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("part_size"))
    parts_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("part_size").over(parts_before), F.lit(0)).alias("part_start"))
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).scalar()
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken = (ranged.join(F.broadcast(starts), "part")           # one row a range partition
                   .withColumn("total", F.col("part_start") + F.sum("size").over(run))
                   .where(F.col("total") <= budget).groupBy("_row").agg(F.count(F.lit(1)).alias("copies")))
    return queued.join(taken, "_row", "left").select(
        "doc_id", "source", "tie", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"),
        (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"), "served")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of ``docs`` that are taken, once per copy, all columns unchanged, in the order of
    their virtual finish times (range partitions, each sorted: the order of the files they are written to).

    Rows meet their copies by (doc_id, source, text hash), in one shuffle of ``docs``; rows that agree in all
    three share the sum of their copies evenly, the first ones one more where it does not divide, and finish as the
    first of them does."""
    key = ["_id", "_source", "_tie"]

    def text(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    taken = (mix(docs, **options).groupBy(text("doc_id").alias("_id"), text("source").alias("_source"),
                                          F.col("tie").alias("_tie"))
             .agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"), F.min("served").alias("_served"),
                  F.first("source_size").alias("_size"), F.first("target").alias("_target")).where("_copies > 0"))
    finish = ((F.col("_copy") - 1) * F.col("_size") + F.col("_served")).cast("double") / F.col("_target")
    order = ["_finish", "_id", "_tie", "_number", "_copy"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("*", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("long").cast("string")), F.lit(""))
                        .alias("_id"), text("source").alias("_source"), F.xxhash64(text_or_empty()).alias("_tie"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("_tie"))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_number") <= F.col("_copies") % F.col("_rows")).cast("int")
    return (keyed.join(taken, key).withColumn("_number", number)
                 .withColumn("_copy", F.explode(F.when(share > 0, F.sequence(F.lit(1).cast("long"), share))))
                 .withColumn("_finish", finish).repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .select(*docs.columns))

"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

Fingerprint: over the 3-word shingles of the lower-cased (A-Z) text, repeats included, a bit is 1 if it is set
in more than half of the shingles' XXH64 values (seed 42). A text of one or two words has its whole sequence
as its only shingle; a text without words has fingerprint 0.

Tables: every bit position gets a vector of ``radius + 1`` bits (a balanced seeded deal); for each non-zero
vector v one table keeps the positions whose vector has an even product with v's bits masked out, odd ones
kept. Up to ``radius`` differing positions span at most ``radius`` dimensions, so some v is orthogonal to all of
them and in that table the pair's masked fingerprints are equal: every pair within the radius collides in at
least one of the 2^(radius+1) - 1 tables.

Links between distinct fingerprints: a bucket (table, masked value) of at most ``bucket`` members is joined with
itself and its pairs are verified by counting differing bits. A larger bucket is resolved exactly without
forming its pairs: two fingerprints differ in at most 2r bits exactly if some value is within r bits of both,
so each member names all values within r = radius // 2 bits of itself, and all members that name the same value
are linked through the smallest of them (``_by_middles``, which also treats odd radii).

Components come from rounds of hooking every fingerprint to its smallest neighbour, two pointer jumps and
contraction, until no edge is left; every round is written to the shared folder. ``component_id`` is the
smallest doc_id reachable.

Cases: null text = empty text; a null doc_id is kept (its component may have an id through other documents, else
null); equal texts always share a component; repeated rows stay repeated; an empty table gives no rows; other
columns are not read by ``near_duplicates``, and ``keep_one`` returns them unchanged.

Plan: one pass in Python for the fingerprints (bounded by one text), written as (doc_id, fingerprint); all
else is DataFrame work on distinct fingerprints, so a group of copies is one row; only the last join meets
the documents again, a join side that adaptive execution splits if one fingerprint is hot.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import byte_words, slices, text_or_empty, value_views

BITS = 64


def shingle_hashes(words: list[bytes], n: int = 3, seed: int = 42) -> list[int]:
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [h(b" ".join(words), seed)] if words else []
    join = b" ".join
    return [h(join(s), seed) for s in zip(*(words[i:] for i in range(n)))]


def fingerprint(hashes: list[int]) -> int:
    """Majority bits of the hashes as an unsigned number (no hash: 0)."""
    if not hashes:
        return 0
    ones = np.zeros(BITS, np.int64)
    rows = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[i:i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = [fingerprint(shingle_hashes(byte_words(v), shingle)) for v in value_views(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tie"), pa.array(np.array(fp, np.uint64).view(np.int64))],
                ["doc_id", "tie", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tie, fp): tie is a hash of the text, fp a signed long of the fingerprint's 64 bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"),
                       text_or_empty().alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id bigint, tie bigint, fp bigint")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """Masks (unsigned, 64 bits) such that any ``radius`` positions are all cleared in some mask.

    Positions are dealt evenly to the non-zero vectors of radius + 1 bits."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << p for p, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_values(fp: Column, radius: int) -> Column:
    """All values within ``radius`` bits of ``fp`` (itself included)."""
    flips = [signed(sum(1 << p for p in c)) for r in range(radius + 1) for c in itertools.combinations(range(BITS), r)]
    return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: x.bitwiseXOR(fp))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fps`` (column fp).

    Their connected components are those of all pairs within ``radius`` bits; every link is such a pair."""
    spark = fps.sparkSession
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                       for t, m in enumerate(covering_masks(radius))])
    keys = materialize(fps.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key"), spark, "covering")
    sizes = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = materialize(keys.join(sizes, ["t", "key"]), spark, "covering-shared")
    small = shared.where(F.col("n") <= bucket).drop("n")
    other = small.select("t", "key", F.col("fp").alias("b"))
    pairs = (small.withColumnRenamed("fp", "a").join(other, ["t", "key"])
                  .where((F.col("a") < F.col("b")) & (_differ(F.col("a"), F.col("b")) <= radius)).select("a", "b"))
    large = shared.where(F.col("n") > bucket).select("fp").distinct()
    return pairs.unionByName(_by_middles(large, radius)).distinct()


def _by_middles(fps: DataFrame, radius: int) -> DataFrame:
    """Links that connect ``fps`` exactly as all pairs within ``radius`` bits do, in a row count linear in fps.

    Even radius 2r: members naming the same value within r bits of themselves are all within 2r of each
    other; each links to the smallest of them. Odd radius: one more name at distance r + 1 on one side,
    which only meets names at distance r on the other, so that a group's members at distance r + 1 link to
    its smallest member at distance r (and those at distance r among themselves)."""
    r, odd = divmod(radius, 2)
    near = fps.select("fp", F.explode(near_values(F.col("fp"), r + odd)).alias("z"))
    near = near.withColumn("d", _differ(F.col("fp"), F.col("z")))
    core = near.where(F.col("d") <= r).groupBy("z").agg(F.min("fp").alias("a"))
    named = near.join(core, "z").where(F.col("fp") != F.col("a"))
    return named.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) and the smallest node of its component."""
    spark = edges.sparkSession
    e = materialize(edges.where("a != b").select("a", "b").distinct(), spark, "edges")
    roots = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")) \
                   .select("node", F.least("node", "m").alias("up"))
        hook = materialize(hook, spark, "hook")
        for _ in range(2):
            higher = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            hook = hook.join(higher, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        hook = materialize(hook, spark, "jumped")
        to = hook.select(F.col("node").alias("root"), F.col("up").alias("next"))
        if roots is None:
            roots = hook.withColumnRenamed("up", "root")
        else:
            roots = roots.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = materialize(roots, spark, "roots")
        left, right = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        e = materialize(e.join(left, "a").join(right, "b").where("ra != rb")
                         .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
                        spark, "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def _classes(docs: DataFrame, radius: int, shingle: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tie, fp), and per distinct fingerprint (fp, root, first id, first row), both written."""
    spark = docs.sparkSession
    own = materialize(fingerprints(docs, shingle), spark, "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")
    firsts = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(row).alias("row")), spark,
                         "distinct-fingerprints")
    roots = components(links(firsts.select("fp"), radius, bucket)).toDF("fp", "root")
    return own, materialize(firsts.join(roots, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first", "row"), spark, "classes")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, bucket: int = 64) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    own, classed = _classes(docs, radius, shingle, bucket)
    whole = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    per_fp = classed.join(whole, "root").select("fp", "component_id")
    return own.join(per_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3, bucket: int = 64) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id (then text hash).

    A document without an id stays only if no document of its component has one."""
    _, classed = _classes(docs, radius, shingle, bucket)
    best = classed.groupBy("root").agg(F.min("row").alias("r"))

    def key(c: str):
        return F.coalesce(F.col(c).cast("long").cast("string"), F.lit("")).alias("_id")

    keep = best.select("r.doc_id", F.col("r.tie").alias("_tie")).select(key("doc_id"), "_tie")
    rows = docs.withColumn("_tie", F.xxhash64(text_or_empty())).withColumn("_id", key("doc_id"))
    one = Window.partitionBy("_id", "_tie").orderBy("_tie")
    return (rows.join(keep, ["_id", "_tie"], "left_semi").withColumn("_rn", F.row_number().over(one))
                .where("_rn = 1").select(*docs.columns))

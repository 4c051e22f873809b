"""Filter interaction audit: what every filter removes, keeps and hides in every order of application.

A document's failures are a mask, one bit per filter. Documents are folded to one count per (part, mask): at most
2 ** filters cells a part, whatever the corpus. Per part a Gray-code walk visits all subsets of filters, toggling one
filter at a time: every cell has a counter of its active failures; a cell whose counter leaves zero takes its
documents out of the running survivors, one that returns to zero puts them back. The survivors of the 32 states
(documents, good ones, toxic ones) are stored, and a step of any order is the difference of two states.

Filters of the registered query, over whole texts: A few words, B few distinct words, C many capitals, D symbols,
E a copy: identical to the text of a smaller doc_id anywhere in the table. Texts are identical if their SHA-256 and
their length are.

Cases: null text = empty text; null source = empty string (one part with it); a null doc_id has no label, is no copy
and makes no copies; repeated rows count each, and none of the rows with the smallest doc_id of a text is a copy; of
several labels of one document any 1 counts; an empty table gives no rows; other columns are not read.

Plan: one pass over the texts, written as small rows. Repeated rows are folded before every shuffle; the copies are
found by an aggregate per text and a join on (text, doc_id), so a group of copies is spread by its ids; null ids
are spread by their text. Only cells reach the walk, a batch of parts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

FILTERS = "ABCDE"
AUDIT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
         "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")
WHITE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column, min_words: int = 50, distinct_percent: int = 65, capitals_percent: int = 5,
                  symbols: str = "[#$%&*|]") -> dict[str, Column]:
    """The filters that a text fails by itself."""
    words = F.array_remove(F.split(text, WHITE), "")
    n = F.size(words)
    return {"A": n < min_words,
            "B": F.size(F.array_distinct(words)) * 100 < n * distinct_percent,
            "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * capitals_percent,
            "D": text.rlike(symbols)}


def failure_cells(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None) -> DataFrame:
    """Documents per (part, mask): part, mask (bit i for filter i of ``FILTERS``), docs, good, toxic."""
    tests = failures or text_failures(F.col("text"))
    bits = [F.when(tests[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS[:-1])]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").alias("len"),
                       sum(bits[1:], bits[0]).alias("mask"))
    rows = materialize(rows, name="audit-rows")
    folded = rows.groupBy("doc_id", "sha", "len", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("sha", "len").agg(F.min("doc_id").alias("doc_id")) \
        .withColumn("is_first", F.lit(True))
    copy = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    # A null id meets no first row and no label; its key there is its text's hash, so null ids spread out.
    no_id = F.col("doc_id").isNull()
    folded = folded.join(first, ["sha", "len", "doc_id"], "left") \
        .withColumn("key", F.coalesce(F.col("doc_id"), F.xxhash64("sha"))).withColumn("no_id", no_id)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")) \
        .withColumn("no_id", F.lit(False))
    n = F.col("n")
    return folded.join(marks, ["key", "no_id"], "left").groupBy(
        "part", (F.col("mask") + F.when(copy, 1 << (len(FILTERS) - 1)).otherwise(0)).alias("mask")).agg(
        F.sum(n).alias("docs"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def survivors(cells: np.ndarray) -> np.ndarray:
    """States [parts, subsets, 3] from cells [parts, masks, 3]: what no filter of a subset removes.

    Subsets follow a Gray code, so that each differs from the one before in one filter."""
    parts, masks, width = cells.shape
    cell = np.arange(masks)
    active_failures = np.zeros(masks, np.int64)
    running = cells.sum(1)
    states = np.zeros((parts, masks, width), np.int64)
    states[:, 0] = running
    active = 0
    for step in range(1, masks):
        bit = (step & -step).bit_length() - 1          # the bit in which Gray codes step - 1 and step differ
        active ^= 1 << bit
        fails = (cell >> bit & 1).astype(bool)
        if active >> bit & 1:
            leaves = fails & (active_failures == 0)
            active_failures[fails] += 1
            running = running - cells[:, leaves].sum(1)
        else:
            active_failures[fails] -= 1
            returns = fails & (active_failures == 0)
            running = running + cells[:, returns].sum(1)
        states[:, active] = running
    return states


def audit_steps(cells: np.ndarray, filters: str = FILTERS) -> tuple[list[tuple[str, int]], np.ndarray]:
    """(order, step) keys and figures [parts, keys, 7] in the order of ``AUDIT``, from the cells of some parts."""
    k = len(filters)
    states = survivors(cells)
    every = (1 << k) - 1
    failing = np.stack([cells[:, (np.arange(1 << k) >> f & 1).astype(bool), 0].sum(1) for f in range(k)], 1)
    unique = np.stack([cells[:, 1 << f, 0] for f in range(k)], 1)
    share = np.zeros_like(failing)
    for s in range(1 << k):
        for f in range(k):
            if not s >> f & 1:                         # f comes next after exactly the filters of s
                orders = factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())
                share[:, f] += orders * (states[:, s, 0] - states[:, s | 1 << f, 0])
    keys, out = [], []
    for order in permutations(range(k)):
        s = 0
        for step, f in enumerate(order, 1):
            before, after = states[:, s], states[:, s | 1 << f]
            gone = before - after
            out.append(np.stack([after[:, 0], gone[:, 0], failing[:, f] - gone[:, 0], unique[:, f], gone[:, 1],
                                 gone[:, 2], share[:, f]], 1))
            keys.append(("".join(filters[i] for i in order), step))
            s |= 1 << f
        assert s == every
    return keys, np.stack(out, 1)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in AUDIT.split(", ")]
    for b in batches:
        for at in range(0, b.num_rows, 64):
            rows = b.slice(at, 64).to_pylist()
            cells = np.zeros((len(rows), 1 << len(FILTERS), 3), np.int64)
            for i, r in enumerate(rows):
                for c in r["cells"]:
                    cells[i, c["mask"]] = c["docs"], c["good"], c["toxic"]
            keys, figures = audit_steps(cells)
            flat = figures.reshape(-1, figures.shape[2])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([r["part"] for r in rows for _ in keys]),
                "filter_order": pa.array([o for o, _ in keys] * len(rows)),
                "step": pa.array([s for _, s in keys] * len(rows), pa.int32()),
                **{name: pa.array(flat[:, i]) for i, name in enumerate(names[3:])}})


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None) -> DataFrame:
    """One row per part, order and step (columns of ``AUDIT``): 600 rows a part.

    ``failures`` replaces the tests of filters A to D (boolean columns over ``text``); E is always the copy test."""
    cells = failure_cells(docs, labels, failures)
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells")) \
        .mapInArrow(_walk, AUDIT)

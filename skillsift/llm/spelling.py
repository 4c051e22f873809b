"""Spelling variant grouping: words one edit apart, found by dense prefix-suffix tiles.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. With m the longer
length, p the common prefix and q the common suffix, that is p + q >= m - 1. Tiles find such pairs: the words of a
bucket are padded code-point matrices, left- and right-aligned; comparing every row of a tile with every other
gives p and q at once. Buckets of equal shape are compared together, in blocks of bounded size.

Buckets: the edited place of a pair lies in one of ``segments`` parts of the longer word, and all code points outside
that part agree. So a word of length l enters, for m = l and m = l + 1 and each part, the bucket of its code points
outside the part; every near pair meets in the bucket of the part where its edit lies. A bucket of more than
``most`` words is not compared but divided: its part is cut in two and each word enters both halves' buckets, again
until small. A part of one place holds one word of length m - 1 and at most one of length m per letter, so the
division ends; nothing is dropped. A pair is counted only in the bucket whose part holds place p, so once.

Cases: null text = empty text = no words; a null doc_id is the empty text in the checksum; repeated rows count each; a
word of any length takes part; ties between forms go to the smallest word in code-point order; an empty table gives no
rows; other columns are not read.

Plan: one pass counts words per task, one shuffle of (word, count); bucket keys are hashes, so a bucket row is a word
and its key. Oversized buckets are known before any task meets them (counts per key, folded map-side). Pairs
stay in their task: a bucket returns per word the number of its near words and the best of them. Roots follow forms by
pointer jumping; counts grow at least tenfold along forms, so few rounds do.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast, materialize
from .common import text_or_empty, value_views

LETTERS = "a-zÀ-ÿ"                 # after A-Z are lower-cased
FOUND = "word string, n_near bigint, best_n bigint, best string"


def _counter(shortest: int, drop_every: int, most_held: int = 200_000):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{shortest},}}")
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()),
                                              "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for doc_id, view in zip(b.column("doc_id").to_pylist(), value_views(b.column("text"))):
                crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs.findall(bytes(view).lower().decode("utf-8"))).items():
                    h = zlib.crc32(run.encode("utf-8"), crc)
                    if drop_every and h % drop_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < shortest:
                            continue
                    held[run] += n
                if len(held) > most_held:
                    yield flush()
        if held:
            yield flush()
    return count


def corpus_words(docs: DataFrame, shortest: int = 7, least: int = 2, drop_every: int = 31) -> DataFrame:
    """Words of all texts with at least ``shortest`` code points and ``least`` occurrences: word, n.

    A letter run whose checksum with its document's id ``drop_every`` divides loses one code point (0: none)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_counter(shortest, drop_every), "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least)


def _bucket_rows(rows: DataFrame, parts) -> DataFrame:
    """Rows (word, n, m) once per part [lo, hi) of ``parts``, with the key of what lies outside the part."""
    return rows.withColumn("p", F.explode(parts)).select(
        "word", "n", "m", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi")) \
        .withColumn("key", F.expr("xxhash64(m, lo, hi, left(word, lo), right(word, m - hi))"))


def first_buckets(words: DataFrame, segments: int = 3) -> DataFrame:
    """Every word in the buckets of its ``segments`` parts, as the longer and as the shorter of a pair."""
    both = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    cut = [(F.col("m") * i / segments).cast("int") for i in range(segments + 1)]
    parts = F.array(*[F.struct(a.alias("lo"), b.alias("hi")) for a, b in zip(cut, cut[1:])])
    return _bucket_rows(both, F.filter(parts, lambda p: p["lo"] < p["hi"]))


def halved(rows: DataFrame) -> DataFrame:
    """The rows of oversized buckets in the buckets of both halves of their part."""
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    return _bucket_rows(rows, F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi")))


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading equal columns of every row of ``a`` with every row of ``b``: [k, n, w] x 2 -> [k, n, n]."""
    differ = a[:, :, None, :] != b[:, None, :, :]
    return np.where(differ.any(-1), differ.argmax(-1), a.shape[-1])


def near_in_tiles(left: np.ndarray, right: np.ndarray, length: np.ndarray, m: np.ndarray, lo: np.ndarray,
                  hi: np.ndarray) -> np.ndarray:
    """[k, n, n] truth of "near, and edited in this part" for k tiles of n words: left- and right-aligned matrices
    [k, n, w] padded with 0, lengths [k, n], and per tile the longer length and the part."""
    longer = np.maximum(length[:, :, None], length[:, None, :])
    shorter = np.minimum(length[:, :, None], length[:, None, :])
    p = np.minimum(common_ends(left, left), shorter)
    q = np.minimum(common_ends(right, right), shorter)
    m, lo, hi = m[:, None, None], lo[:, None, None], hi[:, None, None]
    return (longer == m) & (p < m) & (p + q >= m - 1) & (p >= lo) & (p < hi)


def padded(data: np.ndarray, starts: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Left-aligned rows, and rows reversed (so that suffixes are prefixes), padded with 0 to ``width``."""
    column = np.arange(width)
    inside = column < length[:, None]
    at = np.where(inside, starts[:, None] + column, 0)
    back = np.where(inside, (starts + length - 1)[:, None] - column, 0)
    return np.where(inside, data[at], 0), np.where(inside, data[back], 0)


def _tiles(block: int = 16 << 20):
    """Buckets arrive whole and in a row, their words by falling count, then by word; ``size`` is a bucket's rows."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            # Whole buckets only: the last one may go on in the next batch.
            size, nth = np.asarray(t.column("size")), np.asarray(t.column("nth"))
            open_rows = int(nth[-1]) if nth[-1] < size[-1] else 0
            rest = t.slice(t.num_rows - open_rows) if open_rows else None
            if t.num_rows > open_rows:
                yield from compare(t.slice(0, t.num_rows - open_rows))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        word, points = t.column("word").chunk(0), t.column("points").chunk(0)
        m, lo, hi, n, size = (np.asarray(t.column(c)).astype(np.int64) for c in ("m", "lo", "hi", "n", "size"))
        off = np.frombuffer(points.buffers()[1], np.int32, len(points) + 1, points.offset * 4).astype(np.int64)
        data = np.frombuffer(points.buffers()[2], ">u4", off[-1] // 4)
        starts, length = off[:-1] // 4, np.diff(off) // 4
        if not len(data) or data.max() < 256:
            data = data.astype(np.uint8)               # letters of most alphabets here: a byte a code point
        n_near = np.zeros(len(size), np.int64)
        best = np.full(len(size), -1, np.int64)
        first = np.flatnonzero(np.asarray(t.column("nth")) == 1)
        # Tiles of equal size and similar width go together.
        shape = size[first] << 32 | m[first]
        order = np.argsort(shape, kind="stable")
        i = 0
        while i < len(order):
            s = int(size[first[order[i]]])
            e = int(np.searchsorted(shape[order], (s + 1) << 32))
            while i < e:
                width = int(m[first[order[i]]])
                k = max(1, block // (s * s * width * 2))
                chosen = first[order[i:min(e, i + k)]]
                width = int(m[chosen].max())
                if len(chosen) > 1 and s * s * width * len(chosen) > 2 * block:
                    chosen = chosen[:max(1, 2 * block // (s * s * width))]
                i += len(chosen)
                rows = (chosen[:, None] + np.arange(s)).ravel()
                a, z = padded(data, starts[rows], length[rows], width)
                yes = near_in_tiles(a.reshape(-1, s, width), z.reshape(-1, s, width), length[rows].reshape(-1, s),
                                    m[chosen], lo[chosen], hi[chosen])
                n_near[rows] = yes.sum(-1).ravel()
                best[rows] = np.where(yes.any(-1), chosen[:, None] + yes.argmax(-1), -1).ravel()
        hit = np.flatnonzero(n_near)
        if len(hit):
            yield pa.RecordBatch.from_pydict({
                "word": word.take(pa.array(hit)), "n_near": pa.array(n_near[hit]),
                "best_n": pa.array(n[best[hit]]), "best": word.take(pa.array(best[hit]))})
    return near


def compare_buckets(rows: DataFrame) -> DataFrame:
    """Per bucket and word with near words there: their number, and the best (largest n, then smallest word)."""
    bucket = Window.partitionBy("m", "lo", "hi", "key")
    ranked = rows.withColumn("nth", F.row_number().over(bucket.orderBy(F.col("n").desc(), "word"))) \
        .withColumn("size", F.count(F.lit(1)).over(bucket)).where(F.col("size") > 1)
    return ranked.select("word", F.encode("word", "UTF-32").alias("points"), "n", "m", "lo", "hi", "nth", "size") \
        .mapInArrow(_tiles(), FOUND)


def near_words(words: DataFrame, segments: int = 3, most: int = 256) -> DataFrame:
    """Per word of ``words`` (word, n; written) with near words: n_near, best_n, best."""
    bucket = ["m", "lo", "hi", "key"]
    found, rows = None, first_buckets(words, segments)
    while True:
        over = rows.where(F.col("hi") - F.col("lo") > 1).groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")) \
            .where(F.col("size") > most).select(*bucket)
        over = materialize(over, name="spelling-oversized")
        none = over.isEmpty()
        small = rows if none else rows.join(checked_broadcast(over)[0], bucket, "left_anti")
        here = materialize(compare_buckets(small), name="spelling-near")
        found = here if found is None else found.unionByName(here)
        if none:
            break
        rows = materialize(halved(rows.join(checked_broadcast(over)[0], bucket, "left_semi")), name="spelling-halves")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")) \
        .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form; at most one per word, without cycles): where the forms end."""
    now = materialize(forms.select("word", F.col("form").alias("root")), name="spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(now.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            name="spelling-roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variant_groups(docs: DataFrame, shortest: int = 7, least: int = 2, drop_every: int = 31,
                   factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text); see the contract above.

    A word's form is its near word of largest n if that is at least ``factor`` times the word's own n."""
    words = materialize(corpus_words(docs, shortest, least, drop_every), name="spelling-words")
    near = near_words(words)
    is_form = F.col("best_n") >= F.col("n") * factor
    rows = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), name="spelling-forms")
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

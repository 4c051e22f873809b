"""Quality classifier learned from preference pairs (Bradley-Terry).

A text's features are those of its characters' kinds (space, line break, lower, upper, digit, stops, brackets,
symbols, other scripts, control): the square roots of the shares of all neighbouring kinds, and a few
ratios (distinct words, distinct lines, most frequent word, word length, size). A text labelled good is
preferred to one labelled bad; weights maximise sum log sigmoid(w . (x_good - x_bad)) - ``ridge`` |w|^2 / 2 over
``pairs`` random preference pairs, by Newton steps. The learned score is w . x; the threshold is the quantile
of the scores of all usable labelled texts at their share of bad labels, and the reported score is the logistic of the distance
to it, placed so that the quantile itself scores ``cut``: predicted is 1 exactly if the score is ``cut`` or more.

The weights are fitted on at most ``max_rows`` labelled texts, the first in the order of a hash of doc_id (a
documented bound: ``max_rows`` rows of about 150 numbers reach the driver); the threshold and the scoring cover
every row. Labels, lang, source and
doc_id are no features.

Cases: null text = empty text (its features are 0, it is scored); a null doc_id has no label and hashes as the empty
text; several labels of one doc_id count as their smallest, null labels as none; without good or without bad
labels all weights are 0 and every text scores above ``cut``; an empty table gives no rows; other columns are
not read by ``score_quality`` and returned unchanged by ``keep_good``.

Plan: the labelled sample is broadcast (at most ``max_rows`` ids), so no text is shuffled; the threshold takes one
pass that scores the usable texts and joins the labels by doc_id; scoring is one pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import byte_words, slices, text_or_empty, value_views

KINDS = 12
RANKS = 100_000


def _kinds() -> np.ndarray:
    out = np.full(256, 11, np.uint8)
    for kind, chars in enumerate((b" ", b"\t\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".",
                                  b",", b"!?;:", b"\"'()[]{}`", b"#$%&*@^~|\\/+=<>_-", bytes(range(128, 256)))):
        out[list(chars)] = kind
    return out


KIND = _kinds()


def features(view) -> np.ndarray:
    raw = bytes(view)
    out = np.zeros(KINDS * KINDS + 6, np.float32)
    words = byte_words(raw)
    if not words:
        return out
    k = KIND[np.frombuffer(raw, np.uint8)]
    if len(k) > 1:
        pairs = np.bincount(k[:-1] * np.uint8(KINDS) + k[1:], minlength=KINDS * KINDS)
        out[:KINDS * KINDS] = np.sqrt(pairs / (len(k) - 1))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    out[-6] = len(seen) / len(words)
    out[-5] = len(set(lines)) / len(lines)
    out[-4] = max(seen.values()) / len(words)
    out[-3] = math.log1p(len(raw) / len(words))
    out[-2] = math.log1p(len(words)) / 10
    out[-1] = math.log1p(len(words) / len(lines)) / 5
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        x = [features(v).tobytes() for v in value_views(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.binary())],
                                         ["doc_id", "label", "x"])


class Ranker:
    """Weights over standardised features and the threshold score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, quantile: float, cut: float) -> None:
        self.weights = weights / scale
        self.shift = float(mean @ self.weights) + quantile          # the raw score that is reported as ``cut``
        self.cut, self.offset = cut, math.log(cut / (1 - cut))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """w . x, summed row by row: the same for a text whatever batch it is in."""
        return (x.astype(np.float64) * self.weights).sum(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(x) - self.shift + self.offset, -36, 36)
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 40_000, ridge: float = 1.0, cut: float = 0.3,
              seed: int = 5, steps: int = 12) -> Ranker:
    """Bradley-Terry weights from rows ``x`` of which ``good`` are preferred to the others."""
    width = x.shape[1] if x.ndim == 2 else KINDS * KINDS + 6
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0, cut)
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)]
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -36, 36)))               # chance of the pair being the other way round
        grad = d.T @ p - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    quantile = float(np.quantile(z @ w, len(down) / len(x)))
    return Ranker(mean, scale, w, quantile, cut)


def _raw(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = np.array([features(v) for v in value_views(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ranker.raw(x))], ["doc_id", "raw"])
    return run


def threshold(docs: DataFrame, known: DataFrame, usable: Column, ranker: Ranker) -> float | None:
    """Raw score below which the share of bad labels of all labelled texts lies; None without labelled texts.

    ``known``: one label per usable doc_id. The quantile's rank is exact to one in ``RANKS`` of the labelled texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
               .where(F.col("doc_id").isNotNull() & usable)
    raw = rows.mapInArrow(_raw(ranker), "doc_id bigint, raw double").join(known, "doc_id").select("label", "raw")
    raw = materialize(raw, docs.sparkSession, "labelled-scores")
    bad = raw.agg(F.avg((F.col("label") != 1).cast("double"))).first()[0]
    return None if bad is None else raw.agg(F.percentile_approx("raw", F.lit(bad), F.lit(RANKS))).first()[0]


def learn(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = 12_000, **options) -> Ranker:
    """Ranker from the labelled rows of ``docs`` for which ``usable`` (a condition on doc_id) holds."""
    h = F.xxhash64(F.lit("label"), "doc_id")
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
                   .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
                   .groupBy("doc_id").agg(F.min("label").alias("label")))
    sample = known.orderBy(h, "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    got = (rows.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")      # max_rows rows at most
               .mapInArrow(_extract, "doc_id bigint, label int, x binary")
               .orderBy(h, "doc_id", "x").limit(max_rows).toArrow())
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, KINDS * KINDS + 6)
    ranker = fit_pairs(x, got.column("label").to_numpy() == 1, **options)
    if ranker.weights.any():
        ranker.shift = threshold(docs, known, usable, ranker)
    return ranker


def _apply(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = np.array([features(v) for v in value_views(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(ranker(x))],
                                             ["doc_id", "held_out", "score"])
    return run


def score_quality(docs: DataFrame, ranker: Ranker, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(_apply(ranker), "doc_id bigint, held_out boolean, score double") \
               .withColumn("predicted", (F.col("score") >= ranker.cut).cast("int"))


def _keep(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = np.array([features(v) for v in value_views(b.column("text"))])
            yield b.filter(pa.array(ranker(x) >= ranker.cut))
    return run


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs`` the ranker accepts, all columns unchanged."""
    return docs.mapInArrow(_keep(ranker), docs.schema)

"""Best-fit packing with exact complements: whole documents into as few sequences of ``size`` ids as can be.

What fits together depends on lengths alone, so the plan is made on the histogram of piece lengths: at most
``size`` counts, whatever the corpus. Three indexes over the lengths still to be had tell which sums they reach,
with one, two or three pieces: the coefficients of A, A * A and A * A * A, where A has a term x ** l for every
available length l. A length that runs out is taken out of all three by shifts.

1. Every length, longest first, leaves a gap of size - length. While a single, pair or triple sums exactly to the
   gap under the availability counts, that combination is consumed as often as the counts allow.
2. Residuals, longest first, go best-fit: into the open sequences with the smallest gap that holds them, else into
   new ones; a gap that a single, pair or triple still fills exactly is closed with it at once.

Both steps work on multiplicities: equal sequences are one pattern with a count, so the plan has a few patterns per
distinct length, and each piece finds its place from its length and its rank among the pieces of that length.

Cases: null text = empty text = the end id alone; only documents longer than ``size`` are cut, into pieces of
``size`` ids and one shorter rest; each row is a document of its own, also with a null or repeated doc_id; an
empty table gives no rows; other columns are not read.

Plan: one pass encodes the texts and writes a small row per piece, with its rank within (task, length); the texts
are never shuffled. Counts per (task, length) give the first rank of each task by a running sum; pieces meet
it by an equi-join on (task, length). The driver holds the histogram (at most ``size`` rows) and the plan's runs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import encoder, slices, text_or_empty, value_views

CUT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
PLACED = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
          "offset bigint")


class LengthSums:
    """Available lengths with their counts, and which sums one, two or three of them reach."""

    def __init__(self, counts: np.ndarray) -> None:
        self.size = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.one = (self.left > 0).astype(np.int64)
        self.one[0] = 0
        self.two = self._times(self.one, self.one)
        self.three = self._times(self.two, self.one)

    def _times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size + 1, np.int64)
        for x in np.flatnonzero(b):
            out[x:] += b[x] * a[:self.size + 1 - x]
        return out

    def _shift(self, a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        if by <= self.size:
            out[by:] = a[:self.size + 1 - by]
        return out

    def take(self, lengths: dict[int, int], times: int) -> None:
        """Use ``lengths`` (length -> how many) ``times`` times; lengths that run out leave the indexes."""
        for x, many in lengths.items():
            self.left[x] -= many * times
            if self.left[x] == 0:
                once, square = self._shift(self.one, x), self._shift(self.two, x)
                self.three += 3 * self._shift(once, x) - 3 * square
                self.two -= 2 * once
                for a, k in ((self.one, 1), (self.two, 2), (self.three, 3)):
                    if k * x <= self.size:                 # (A - x)^2 = A^2 - 2xA + x^2, and so for the cube
                        a[k * x] += 1 if k == 2 else -1

    def exact(self, gap: int, held: dict[int, int]) -> dict[int, int] | None:
        """One, two or three available lengths that sum to ``gap``, beside the pieces ``held`` (not yet taken)."""
        if gap <= 0 or not (self.one[gap] or self.two[gap] or self.three[gap]):
            return None
        spare = self.left.copy()
        for x, many in held.items():
            spare[x] -= many
        if spare[gap] > 0:
            return {gap: 1}
        if self.two[gap]:
            found = self._pair(gap, spare)
            if found:
                return found
        if self.three[gap]:
            firsts = np.flatnonzero((spare[1:gap] > 0) & (self.two[gap - 1:0:-1] > 0)) + 1
            for a in firsts[::-1]:                         # the longest first: short pieces stay for later gaps
                spare[a] -= 1
                found = self._pair(gap - int(a), spare)
                spare[a] += 1
                if found:
                    found[int(a)] = found.get(int(a), 0) + 1
                    return found
        return None

    def _pair(self, total: int, spare: np.ndarray) -> dict[int, int] | None:
        low = np.arange(1, total // 2 + 1)
        ok = (spare[low] > 0) & (spare[total - low] > 0)
        if total % 2 == 0 and total:
            ok[-1] = spare[total // 2] > 1
        found = np.flatnonzero(ok)
        if not len(found):
            return None
        a = int(low[found[0]])
        return {a: 2} if 2 * a == total else {a: 1, total - a: 1}

    def times(self, lengths: dict[int, int]) -> int:
        return min(int(self.left[x]) // many for x, many in lengths.items())


def plan_patterns(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """(lengths of a sequence with how many of each, number of such sequences), using up ``counts`` exactly.

    Exact fills among short pieces can take what long ones would have needed. So step 1 goes down to the shortest
    pieces, to a third or to half of ``size``, or is left out, whichever plan needs the fewest sequences."""
    size = len(counts) - 1
    plans = [patterns_down_to(counts, shortest, closing) for shortest, closing in
             ((1, True), (size // 3 + 1, True), (size // 2 + 1, True), (size, False))]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def patterns_down_to(counts: np.ndarray, shortest: int, closing: bool = True) -> list[tuple[dict[int, int], int]]:
    """A plan whose exact complements are sought for lengths from ``shortest`` on; without ``closing`` the
    residuals' gaps are filled best-fit only."""
    size = len(counts) - 1
    sums = LengthSums(counts)
    done: list[tuple[dict[int, int], int]] = []

    for x in range(size, shortest - 1, -1):                # 1: exact complements of each length's gap
        while sums.left[x] > 0:
            fill = {} if x == size else sums.exact(size - x, {x: 1})
            if fill is None:
                break
            whole = {**fill, x: fill.get(x, 0) + 1}
            n = sums.times(whole)
            sums.take(whole, n)
            done.append((whole, n))

    opened: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)     # gap -> open patterns

    def put(pattern: dict[int, int], n: int) -> None:
        """Keep ``n`` sequences open, or close those whose gap can be filled exactly."""
        gap = size - sum(x * many for x, many in pattern.items())
        while closing and n and gap:
            fill = sums.exact(gap, {})
            if fill is None:
                break
            m = min(n, sums.times(fill))
            sums.take(fill, m)
            done.append(({x: pattern.get(x, 0) + fill.get(x, 0) for x in {*pattern, *fill}}, m))
            n -= m
        if n and gap:
            opened[gap].append((pattern, n))
        elif n:
            done.append((pattern, n))

    for x in range(size, 0, -1):                           # 2: residuals, best-fit
        while sums.left[x] > 0:
            gap = min((g for g, held in opened.items() if g >= x and held), default=None)
            if gap is None:
                each = min(size // x, int(sums.left[x]))   # equal pieces fill a new sequence as far as they can
                n = int(sums.left[x]) // each
                sums.take({x: each}, n)
                put({x: each}, n)
                continue
            pattern, n = opened[gap].pop()
            each = min(gap // x, int(sums.left[x]))
            m = min(n, int(sums.left[x]) // each)
            sums.take({x: each}, m)
            if n > m:
                opened[gap].append((pattern, n - m))
            put({**pattern, x: pattern.get(x, 0) + each}, m)
    return done + [p for held in opened.values() for p in held]


def plan_runs(counts: np.ndarray) -> np.ndarray:
    """Where the pieces of each length go, as rows (length, first rank, pieces per sequence, first sequence,
    offset of the first piece), by length and first rank."""
    used = np.zeros(len(counts), np.int64)
    rows, sequence = [], 0
    for pattern, n in plan_patterns(counts):
        offset = 0
        for x in sorted(pattern, reverse=True):
            rows.append((x, int(used[x]), pattern[x], sequence, offset))
            used[x] += pattern[x] * n
            offset += x * pattern[x]
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cutter(tokenizer: str, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in slices(batches, "text"):
            docs, pieces, starts, lengths, crcs = [], [], [], [], []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(value_views(b.column("text")))):
                view, n = memoryview(ids), len(ids) // 4
                for k, a in enumerate(range(0, n, size)):
                    e = min(a + size, n)
                    docs.append(doc_id)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(e - a)
                    crcs.append(zlib.crc32(view[4 * a:4 * e]))
            length = np.array(lengths, np.int64)
            by_length = np.argsort(length, kind="stable")
            ordered = length[by_length]
            first = np.searchsorted(ordered, ordered, "left")
            nth = np.empty_like(length)
            nth[by_length] = np.arange(len(length)) - first + seen[ordered]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(docs, pa.int64()), "piece": pa.array(pieces, pa.int32()),
                "start": pa.array(starts, pa.int64()), "length": pa.array(length),
                "ids_crc32": pa.array(crcs, pa.int64()), "part": pa.array(np.full(len(length), part, np.int32)),
                "nth": pa.array(nth)})
    return cut


def _placer(runs: np.ndarray):
    span = np.int64(1) << 50                               # more pieces of one length than any corpus has

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] * span + runs[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            _, first, each, sequence, offset = runs[at].T
            i = rank - first
            yield pa.RecordBatch.from_pydict({
                **{c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": pa.array(sequence + i // each), "offset": pa.array(offset + i % each * length)})
    return place


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = 4096) -> DataFrame:
    """One written row per piece: its place in its document, the crc of its ids, task and rank in (task, length)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(_cutter(tokenizer, size), CUT), name="pack-pieces")


def pack_whole(docs: DataFrame, tokenizer: str, size: int = 4096) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, tokenizer, size)
    per_task = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), name="pack-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():      # at most ``size`` rows
        counts[r["length"]] = r["n"]
    runs = plan_runs(counts)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")) \
        .drop("part", "base", "nth").mapInArrow(_placer(runs), PLACED)

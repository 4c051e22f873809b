"""Order-preserving packing of documents into sequences of at most ``size`` ids.

The ids of all documents (each ends with the end id), in doc_id order, are one stream. A sequence is a
window of the stream between two cuts. Cuts may lie at document ends (free), sentence ends (penalty
``mid_doc``) and, inside sentences longer than ``stride`` ids, every ``stride`` ids (penalty ``mid_sentence``).
Dynamic programming picks the cuts that minimise total padding plus penalties:

    best[j] = penalty[j] + min over i, pos[j] - pos[i] <= size, of best[i] + padding(pos[j] - pos[i])

where padding(len) = size - len, but 0 where len is a power of two (such sequences are stored as they are).
As size - len = size - pos[j] + pos[i], the minimum of best[i] + pos[i] over the sliding window comes from a
monotone queue in amortised constant time; every power of two up to size is looked up by itself.

The stream is cut into range partitions of doc_id, and each of those into blocks of about ``block`` ids (at
a document end), so a task holds one block; every block boundary costs at most one sequence's padding.

Cases: null text = empty text = the end id alone; null doc_ids come first; equal doc_ids keep all their rows,
in the order of a text hash; an empty table gives no rows; other columns are not read. ``sequence_id`` is
unique over the whole result (partition number and count inside it), ``offset`` has no gaps. ``place`` numbers the
document rows in their order (partition number and count inside it), so rows with one doc_id, as a mixture has
them, keep their pieces apart. ``order`` packs by other columns than doc_id: a mixture's own order.

Plan: one shuffle of (doc_id, text) into doc_id ranges; encoding, cutting and output in the same tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_range, byte_letters, encoder, slices, text_or_empty, value_views

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, place bigint")
SENTENCE_ENDS = (".", "!", "?", "。", "！", "？")


class SentenceEnds:
    """Where sentences close in a sequence of ids.

    The vocabulary spells texts in byte letters: a piece closes a sentence if it ends with a mark so spelled. A
    mark that the vocabulary writes in several pieces is met as that run of ids (at a word's end and inside)."""

    def __init__(self, tok) -> None:
        letters = byte_letters()
        spelled = tuple("".join(letters[b] for b in mark.encode("utf-8")) for mark in SENTENCE_ENDS)
        self.single = np.array(sorted(i for t, i in tok.get_vocab().items() if t.removesuffix("</w>").endswith(spelled)),
                               np.uint32)
        runs = set()
        for mark in SENTENCE_ENDS:
            closing = tok.encode(mark, add_special_tokens=False).ids
            inside = tok.encode(mark + "a", add_special_tokens=False)
            runs.add(tuple(closing))
            runs.add(tuple(i for i, (a, b) in zip(inside.ids, inside.offsets) if b <= len(mark) and a < b))
        self.runs = [r for r in sorted(runs) if len(r) > 1]

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Positions right after a sentence's end, ascending."""
        at = [np.flatnonzero(np.isin(ids, self.single)) + 1]
        for run in self.runs:
            if len(ids) >= len(run):
                hit = np.ones(len(ids) - len(run) + 1, bool)
                for k, i in enumerate(run):
                    hit &= ids[k:len(ids) - len(run) + 1 + k] == i
                at.append(np.flatnonzero(hit) + len(run))
        return np.unique(np.concatenate(at))


def candidate_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, stride: int, mid_doc: float,
                   mid_sentence: float) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (ascending, 0 first) and their penalties; no two neighbours further than ``stride``."""
    pos = np.union1d(doc_ends, sentence_ends).astype(np.int64)
    pos = np.concatenate([[0], pos[pos > 0]])
    gap = np.diff(pos)
    wide = np.flatnonzero(gap > stride)
    extra = [np.arange(pos[i] + stride, pos[i + 1], stride) for i in wide]
    more = np.concatenate(extra) if extra else np.zeros(0, np.int64)
    cuts = np.sort(np.concatenate([pos, more]))
    pen = np.full(len(cuts), mid_doc)
    pen[np.isin(cuts, more)] = mid_sentence
    pen[np.isin(cuts, doc_ends)] = 0.0
    pen[0] = 0.0
    return cuts, pen


def best_cuts(cuts: np.ndarray, pen: np.ndarray, size: int) -> list[int]:
    """Indexes into ``cuts`` of the chosen window ends (the last is the stream's end)."""
    pos, cost = cuts.tolist(), pen.tolist()
    n = len(pos)
    at = {p: i for i, p in enumerate(pos)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    best = [0.0] * n
    back = [0] * n
    key = [0.0] * n                                  # best[i] + pos[i]
    queue = [0] * n                                  # monotone: keys ascend from head to tail
    head, tail = 0, 1
    for j in range(1, n):
        p = pos[j]
        low = p - size
        while pos[queue[head]] < low:
            head += 1
        i = queue[head]
        v = key[i] + size - p
        for w in powers:
            k = at.get(p - w)
            if k is not None and best[k] < v:
                v, i = best[k], k
        v += cost[j]
        best[j], back[j] = v, i
        kj = v + p
        while tail > head and key[queue[tail - 1]] >= kj:
            tail -= 1
        key[j] = kj
        queue[tail] = j
        tail += 1
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def pack_block(texts: list[bytes], ends: SentenceEnds, size: int, stride: int, mid_doc: float,
               mid_sentence: float) -> dict[str, np.ndarray | list]:
    """Pieces of one block of documents: index of the document, start, length, crc, sequence, offset."""
    data = b"".join(texts)
    ids = np.frombuffer(data, "<u4")
    doc_ends = np.cumsum([len(t) // 4 for t in texts])
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    cuts, pen = candidate_cuts(doc_ends, ends.after(ids), stride, mid_doc, mid_sentence)
    chosen = cuts[best_cuts(cuts, pen, size)]
    marks = np.union1d(chosen, doc_ends)             # ends of pieces
    first = np.concatenate([[0], marks[:-1]])
    doc = np.searchsorted(doc_ends, first, "right")
    seq = np.searchsorted(chosen, first, "right")
    seq_start = np.concatenate([[0], chosen])[seq]
    view = memoryview(data)
    crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(first.tolist(), marks.tolist())]
    return {"doc": doc, "start": first - doc_starts[doc], "length": marks - first, "crc": crc,
            "sequence": seq, "offset": first - seq_start, "sequences": len(chosen)}


def _packer(tokenizer: str, size: int, block: int, stride: int, mid_doc: float, mid_sentence: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        ends = SentenceEnds(enc.tok)
        next_seq = next_place = TaskContext.get().partitionId() << 40
        doc_ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, texts, held, next_seq, next_place
            r = pack_block(texts, ends, size, stride, mid_doc, mid_sentence)
            lens = np.array([len(t) // 4 for t in texts], np.int64)
            out = pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, pa.int64()).take(pa.array(r["doc"])),
                "start": pa.array(r["start"], pa.int64()), "length": pa.array(r["length"], pa.int64()),
                "ids_crc32": pa.array(r["crc"], pa.int64()), "doc_tokens": pa.array(lens[r["doc"]]),
                "sequence_id": pa.array(r["sequence"] + next_seq, pa.int64()),
                "offset": pa.array(r["offset"], pa.int64()), "place": pa.array(r["doc"] + next_place, pa.int64())})
            next_seq += r["sequences"]
            next_place += len(texts)
            doc_ids, texts, held = [], [], 0
            return out

        for b in slices(batches, "text"):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(value_views(b.column("text")))):
                doc_ids.append(doc_id)
                texts.append(ids)
                held += len(ids) // 4
                if held >= block:
                    yield flush()
        if doc_ids:
            yield flush()
    return pack


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, block: int = 1_000_000, stride: int = 128,
                   mid_doc: float = 2.0, mid_sentence: float = 24.0, order: list[str] | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, place.

    Penalties are in ids of padding: a cut inside a document at a sentence end costs as much as ``mid_doc``
    padded ids, one inside a sentence as much as ``mid_sentence``."""
    if size & (size - 1) or stride > size:
        raise ValueError("size must be a power of two, stride at most size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                       *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order or [])]) \
               .withColumn("_tie", F.xxhash64("text"))
    if order:
        by = [*[f"_by{i}" for i in range(len(order))], "doc_id", "_tie"]
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    else:
        rows = by_range(rows, "doc_id")
    return rows.select("doc_id", "text") \
        .mapInArrow(_packer(tokenizer, size, block, stride, mid_doc, mid_sentence), PIECES)

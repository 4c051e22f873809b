"""Token-ID output: one wavelet matrix file per shard of documents.

``write_shards(docs, ...)`` encodes every whole text, appends the end id, and writes the ids in ascending
doc_id order. A shard file holds consecutive documents: their ids, where each document starts, and the id
sequence as a wavelet matrix. The shard's distinct ids are numbered by falling frequency; the matrix has one
bit-plane per bit of these numbers (highest first), each plane stably ordered by the planes above it, with a
count of ones before every 512-bit block. ``access``, ``rank``, ``count`` and ``select`` work on the memory-mapped
file; ``read_shards`` reads all files back into one row per document.

File format (little-endian): 8-byte magic, then seven int64: documents d, ids n, planes, bytes of one plane,
blocks of one plane, distinct ids a, documents with null doc_id (they come first); int64 doc_ids[d]; int64
starts[d + 1]; uint32 distinct[a + a % 2]; per plane: int64 zeros, uint32 ones before each block (padded to an
even number), the plane's bytes.

Cases: null text = empty text = the end id alone; null doc_ids come first; equal doc_ids keep both rows, in
the order of a text hash; an empty table gives no files and no rows; other columns are not read. A text is
encoded whole whatever its length; a shard is closed after ``shard_ids`` ids, so one task holds one shard.

Plan: one shuffle of (doc_id, text) into doc_id ranges, encoding and writing in the same tasks; the
manifest (one row per file) is written by Spark, so files of lost attempts are never read. A document's
global start is the sum of ids in the files before it, a prefix sum over manifest rows only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_range, encoder, open_fs, shared_folder, slices, text_or_empty, value_views

MAGIC = b"WAVMAT01"
BLOCK = 512
MANIFEST = "part int, seq int, path string, docs bigint, ids bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class WaveletMatrix:
    """Rank/select over a sequence of unsigned ids, from its bit-planes (arrays or memory-mapped)."""

    def __init__(self, n: int, distinct: np.ndarray, zeros: list[int], before: list[np.ndarray],
                 planes: list[np.ndarray]) -> None:
        self.n, self.distinct, self.zeros, self.before, self.planes = n, distinct, zeros, before, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        times = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        distinct = np.argsort(-times, kind="stable")[:np.count_nonzero(times)].astype(np.uint32)
        code = np.zeros(len(times), np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
        code[distinct] = np.arange(len(distinct))
        zeros, before, planes = [], [], []
        a = code[ids]
        for b in range(max(1, (max(1, len(distinct)) - 1).bit_length()) - 1, -1, -1):
            one = (a & a.dtype.type(1 << b)) != 0
            plane = np.packbits(one)
            plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
            before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(ones) else
                          np.zeros(0, np.uint32))
            planes.append(plane)
            z = len(a) - int(np.count_nonzero(one))
            zeros.append(z)
            down = np.empty_like(a)
            np.compress(one, a, out=down[z:])
            np.compress(~one, a, out=down[:z])
            a = down
        return cls(len(ids), distinct, zeros, before, planes)

    def ids(self) -> np.ndarray:
        """The whole sequence, rebuilt from the lowest plane up."""
        out = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(out)
            z = self.zeros[level]
            up[np.flatnonzero(~one)] = out[:z]
            up[np.flatnonzero(one)] = out[z:] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = up
        return self.distinct[out] if self.n else np.zeros(0, np.uint32)

    def _code(self, sym: int) -> int:
        """Number of an id among the shard's distinct ids; -1 if it does not occur."""
        at = np.flatnonzero(self.distinct == sym)
        return int(at[0]) if len(at) else -1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        k = i // BLOCK
        part = self.planes[level][k * (BLOCK // 8): i // 8 + 1]
        bits = np.unpackbits(part)[: i - k * BLOCK]
        return int(self.before[level][k]) + int(bits.sum())

    def access(self, i: int) -> int:
        out = 0
        for level in range(len(self.planes)):
            one = self.planes[level][i // 8] >> (7 - i % 8) & 1
            ones = self._ones(level, i)
            out = out << 1 | int(one)
            i = self.zeros[level] + ones if one else i - ones
        return int(self.distinct[out])

    def _range(self, code: int, i: int) -> tuple[int, int]:
        """Bounds, below the last plane, of the occurrences of a number among the first ``i`` ids."""
        lo, hi, bits = 0, i, len(self.planes)
        for level in range(bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if code >> (bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, sym: int, i: int) -> int:
        """Occurrences of ``sym`` among the first ``i`` ids."""
        code = self._code(sym)
        if code < 0:
            return 0
        lo, hi = self._range(code, min(i, self.n))
        return hi - lo

    def count(self, sym: int) -> int:
        return self.rank(sym, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane: block by binary search, then inside it."""
        before = self.before[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        blk = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][blk * (BLOCK // 8): (blk + 1) * (BLOCK // 8)])
        return blk * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[blk])])

    def select(self, sym: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``sym``; -1 if there are fewer."""
        bits, code = len(self.planes), self._code(sym)
        if code < 0 or k < 0:
            return -1
        lo, hi = self._range(code, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(bits - 1, -1, -1):
            bit = code >> (bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i


def shard_bytes(doc_ids: list[int | None], starts: np.ndarray, wm: WaveletMatrix) -> Iterator[bytes]:
    nulls = sum(x is None for x in doc_ids)
    plane = len(wm.planes[0])
    yield MAGIC + np.array([len(doc_ids), wm.n, len(wm.planes), plane, plane * 8 // BLOCK, len(wm.distinct), nulls],
                           "<i8").tobytes()
    yield np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes()
    yield starts.astype("<i8").tobytes()
    yield even(wm.distinct)
    for z, before, bits in zip(wm.zeros, wm.before, wm.planes):
        yield np.array([z], "<i8").tobytes()
        yield even(before)
        yield bits.tobytes()


def even(x: np.ndarray) -> bytes:
    """uint32 numbers, padded to a multiple of 8 bytes."""
    return x.astype("<u4").tobytes() + bytes(len(x) % 2 * 4)


def open_shard(buf) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, starts and the wavelet matrix of a shard file's buffer (nothing is copied)."""
    if bytes(buf[:8]) != MAGIC:
        raise ValueError("not a wavelet shard")
    d, n, bits, plane, blocks, a, nulls = np.frombuffer(buf, "<i8", 7, 8).tolist()
    at = 64
    doc_ids = np.frombuffer(buf, "<i8", d, at).tolist()
    at += 8 * d
    starts = np.frombuffer(buf, "<i8", d + 1, at)
    at += 8 * (d + 1)
    distinct = np.frombuffer(buf, "<u4", a, at)
    at += 4 * (a + a % 2)
    zeros, before, planes = [], [], []
    for _ in range(bits):
        zeros.append(int(np.frombuffer(buf, "<i8", 1, at)[0]))
        before.append(np.frombuffer(buf, "<u4", blocks, at + 8))
        at += 8 + 4 * (blocks + blocks % 2)
        planes.append(np.frombuffer(buf, np.uint8, plane, at))
        at += plane
    return [None] * nulls + doc_ids[nulls:], starts, WaveletMatrix(n, distinct, zeros, before, planes)


def _writer(folder: str, tokenizer: str, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        doc_ids: list[int | None] = []
        texts: list[bytes] = []
        held = seq = 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, texts, held, seq
            ids = np.frombuffer(b"".join(texts), "<u4")
            starts = np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts])])
            wm = WaveletMatrix.build(ids)
            path = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex[:8]}.wm"
            with fs.open_output_stream(path) as f:
                for piece in shard_bytes(doc_ids, starts, wm):
                    f.write(piece)
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path],
                 "docs": [len(doc_ids)], "ids": [len(ids)]})
            doc_ids, texts, held, seq = [], [], 0, seq + 1
            return row

        for b in slices(batches, "text"):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(value_views(b.column("text")))):
                doc_ids.append(doc_id)
                texts.append(ids)
                held += len(ids) // 4
                if held >= shard_ids:
                    yield close()
        if doc_ids:
            yield close()
    return write


def write_shards(docs: DataFrame, tokenizer: str, shard_ids: int = 2_000_000,
                 folder: str | None = None) -> DataFrame:
    """Write all of ``docs`` (doc_id, text) as shard files; the manifest: part, seq, path, docs, ids.

    Files in (part, seq) order hold the documents in ascending doc_id order."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
               .withColumn("_tie", F.xxhash64("text"))
    made = by_range(rows, "doc_id").select("doc_id", "text") \
        .mapInArrow(_writer(folder, tokenizer, shard_ids), MANIFEST)
    return materialize(made, spark, "shard-manifest").withColumn("folder", F.lit(folder))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            fs, _ = open_fs(r["folder"])
            with fs.open_input_file(r["path"]) as f:
                doc_ids, starts, wm = open_shard(f.read_buffer())
            data = memoryview(np.ascontiguousarray(wm.ids().astype("<u4"))).cast("B")
            at = (starts * 4).tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts[:-1] + r["base"]),
                "n_tokens": pa.array(np.diff(starts)),
                "ids_crc32": pa.array([zlib.crc32(data[x:y]) for x, y in zip(at, at[1:])], pa.int64())})


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32.

    Each file's start, the ids of all files before it, is added to the manifest (one row a file) before
    the files are read, so the documents' rows meet no join."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(parts, "part", "seq").mapInArrow(_reader, READ)

"""Shared pieces of the corpus operators: shared-folder files, byte words, row keys, cached encoding.

Text conventions used by every operator here: a null text is an empty text; words are the maximal runs of
bytes other than space and U+0009..U+000D, which is what ``bytes.split()`` yields; lower-casing touches
A-Z only, which is what ``bytes.lower()`` does.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, own_scratch

END_ID = 1                                   # id appended after every document
TOKENIZER = "word_bpe_49k.json"


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared checkpoint folder, for files that tasks write themselves."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base.startswith("file:") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    if "://" not in base:
        base = "file://" + base
    return own_scratch(spark, f"{base}/skillsift/{name}-{uuid.uuid4().hex[:12]}")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI (file, hdfs, s3, gs: whatever Arrow knows)."""
    return pafs.FileSystem.from_uri(uri)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def id_remainder(c: str = "doc_id", m: int = 5) -> Column:
    """crc32(id as text) mod m; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % m


def value_views(arr: pa.Array) -> Iterator[memoryview]:
    """Zero-copy views of a string or binary array's values; a null gives an empty view."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    n = len(arr)
    if bufs[1] is None:
        yield from (memoryview(b"") for _ in range(n))
        return
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32, n + 1, arr.offset * (8 if wide else 4)).tolist()
    data = memoryview(bufs[2]) if bufs[2] is not None else memoryview(b"")
    if not arr.null_count:
        for a, b in zip(off, off[1:]):
            yield data[a:b]
        return
    ok = arr.is_valid().to_pylist()
    for v, a, b in zip(ok, off, off[1:]):
        yield data[a:b] if v else memoryview(b"")


def byte_words(view) -> list[bytes]:
    """Lower-cased (A-Z) words of a UTF-8 text."""
    return bytes(view).lower().split()


# Texts the encoder may split itself: ASCII and the Latin-1 letters, which lower-case one by one and which no
# normaliser composes; what the tokenizer's splitting pattern finds in them is then a letter run, a digit, a
# run of punctuation or one of its English endings.
PLAIN_TEXT = re.compile("[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others follow in order from U+0100."""
    own = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


class Pieces(dict):
    """Piece -> ids; a missing piece is encoded by the BPE model and, if at most ``max_len`` long, kept."""

    def __init__(self, model, max_len: int) -> None:
        super().__init__()
        self.model, self.max_len, self.letters = model, max_len, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode("utf-8")))
        out = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(piece) <= self.max_len:
            self[piece] = out
        return out


class WordEncoder:
    """Whole-text encoding with the tokenizers library, one library call per distinct piece.

    A plain text (``PLAIN_TEXT``, no special token) is split by the tokenizer's own pattern and each
    distinct piece goes once to the library's BPE model. Any other text is cut at ASCII white space, which
    the pattern never crosses and which belongs to no combining sequence; its plain words go the same way
    and its other words through the library's whole pipeline. The ids are those of encoding the whole
    text (tested). The cache is emptied when it holds ``max_pieces`` and keeps nothing longer than
    ``max_len`` characters, so memory is bounded.
    """

    def __init__(self, path: str, max_pieces: int = 1_500_000, max_len: int = 64) -> None:
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.max_pieces = max_pieces
        self.cache = Pieces(self.tok.model, max_len)
        self.end = np.array([END_ID], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, PIECES.findall(text.lower())))

    def _other(self, text: str) -> bytes:
        out: list[bytes | None] = []
        strange = []
        for w in text.encode("utf-8").split():
            word = w.decode("utf-8")
            if PLAIN_TEXT.fullmatch(word) and "<|" not in word:
                out.append(self._plain(word))
            else:
                out.append(None)
                strange.append(word)
        found = iter(self.tok.encode_batch_fast(strange, add_special_tokens=False))
        return b"".join(array("I", next(found).ids).tobytes() if x is None else x for x in out)

    def encode(self, views) -> list[bytes]:
        """Per text: its ids, then the end id, as little-endian unsigned 32-bit integers."""
        out = []
        for v in views:
            if len(self.cache) > self.max_pieces:
                self.cache.clear()
            text = str(v, "utf-8")
            plain = "<|" not in text and PLAIN_TEXT.fullmatch(text)
            out.append((self._plain(text) if plain else self._other(text)) + self.end)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The Python worker's encoder for a tokenizer file (loaded once, its cache kept between tasks)."""
    if path not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], col: str, max_bytes: int = 8 << 20,
           max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``col`` holds at most ``max_bytes`` each (one row at least)."""
    for b in batches:
        size = b.column(col)
        lens = np.asarray(pc.fill_null(pc.binary_length(size), 0)).astype(np.int64)
        i, n = 0, b.num_rows
        while i < n:
            cum = np.cumsum(lens[i:i + max_rows])
            k = max(1, int(np.searchsorted(cum, max_bytes, "right")))
            yield b.slice(i, k)
            i += k


def in_file_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` as it lies in its Parquet files, with the columns that order it: a mixture keeps its order there.

    A frame that is not a plain read of files has no such order and is returned as it is, without columns."""
    place = ["_file_part", "_file", "_file_row"]
    try:
        return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long").alias(place[0]),
                         F.col("_metadata.file_path").alias(place[1]), F.col("_metadata.row_index").alias(place[2])), place
    except AnalysisException:
        return df, []


def by_range(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Globally ordered by ``key`` (nulls first): range partitions, each sorted; equal rows in a fixed order.

    ``key`` must be followed in the rows by ``_tie``, a hash that orders equal keys."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, key, "_tie").sortWithinPartitions(key, "_tie")

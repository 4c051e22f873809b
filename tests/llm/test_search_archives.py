"""Top-k search against brute force; WARC against a plain reader and the rules for revisits."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from skillsift.llm import topk, warc

from .conftest import SF


def brute(rows, k, is_query):
    """Every usable row against every other; rows that share an id are rows of their own."""
    seen = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(seen):
        if is_query(q):
            hits = sorted((-sum(a * b for a, b in zip(x, y)), c) for to, (c, y) in enumerate(seen)
                          if to != at and len(y) == len(x))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(hits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_top_k_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = topk.top_k(df, F.col("vec_id") % 10 == 0, k=7, block=64, query_block=8)
    assert got(found) == brute(rows, 7, lambda i: i % 10 == 0)


def test_top_k_odd_rows(spark):
    v = [0.5, -0.25, 0.125]
    rows = [(0, v), (0, v), (0, [1.0, 1.0, 1.0]), (1, [5.0, 5.0, 5.0]), (1, v), (2, v), (3, [-x for x in v]), (4, None), (None, v), (5, [0.1, None, 0.2]),
            (6, [float("nan"), 0.0, 1.0]), (7, [float("inf"), 0.0, 1.0]), (10, [1.0]), (20, [2.0]), (30, []), (40, []),
            (-10, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)) \
              .withColumn("rank", F.lit("x"))
    assert got(topk.top_k(df, F.col("vec_id") % 10 == 0, k=2)) == brute(
        [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, x in rows], 2,
        lambda i: i % 10 == 0)
    assert got(topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0)) == []


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 5), st.integers(0, 10_000))
def test_block_bounds_never_lose_a_hit(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (n, dim))
    ids = rng.permutation(n).astype(np.int64)
    q = rng.integers(-4, 5, (3, dim))
    qids = np.array([0, n + 5, n + 6])
    hits = topk.block_top_k(ids, x, qids, q, k, resolve=2, batch=2)
    for j, qid in enumerate(qids):
        want = sorted((-int(x[i] @ q[j]), int(ids[i])) for i in range(n) if ids[i] != qid)[:k]
        have = [(-int(s), int(c)) for a, b, d in hits for w, c, s in zip(a, b, d) if w == qid]
        assert sorted(have) == want


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    x, q = rng.integers(-50, 50, (200, 8)), rng.integers(-50, 50, (5, 8)).astype(float)
    lists, score = topk.SortedLists(x), q @ x.T
    for depth in (1, 10, 100, 200):
        lower, upper = lists.bounds(q, depth)
        assert (lower <= score + 1e-6).all() and (upper >= score - 1e-6).all()
    assert np.allclose(lower, score)


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain_records(manifest):
    """All archives parsed by a small reader of their own."""
    out = []
    for r in manifest.collect():
        fs, _ = pafs.FileSystem.from_uri(r.folder)
        raw = gzip.decompress(fs.open_input_file(r.path).read())
        while raw:
            head, raw = raw.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            body, raw = raw[:n], raw[n + 4:]
            out.append((fields, body.split(b"\r\n\r\n", 1)[1]))
    return out


PAGES = [(1, "http://a", "abc"), (2, "http://b", "abc"), (3, None, None), (4, "http://c", ""), (9, "http://d\r\nX: y", "é" * 5000),
         (2, "http://e", "abc"), (1, "http://f", "abc"), (None, "http://g", "abc"), (None, None, "only"), (None, None, "only"),
         (7, "u", "solo\r\n\r\nWARC/1.1\r\n")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("path", F.lit("p")) \
                .withColumn("refers_to", F.lit(5)).repartition(3)


def expected(pages):
    out = []
    for i, _, h in pages:
        ids = [p for p, _, x in pages if (x or "") == (h or "") and p is not None]
        first = min(ids) if ids else None
        revisit = first is not None and i != first
        out.append((i, len((h or "").encode()), b32(h), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, pages):
    manifest = warc.write_warc(pages, archive_bytes=300, chunk_bytes=64)
    rows = warc.records(warc.read_chunks(manifest, chunk_bytes=1000, with_data=False)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected(PAGES)
    parsed = plain_records(manifest)
    assert len(parsed) == len(PAGES)
    for fields, body in parsed:
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + b32(body.decode())
        else:
            assert body == b""


def test_chunks_rebuild_payloads(spark, pages):
    chunks = warc.read_chunks(warc.write_warc(pages), chunk_bytes=999).where("record_type = 'response'").collect()
    assert max(c.chunk_bytes for c in chunks) <= 999
    by = {}
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        by.setdefault((c.page_id, c.header_digest), []).append(c)
    long = by[9, b32("é" * 5000)]
    data = b""
    for c in long:
        data += c.data
        assert c.offset == len(data) - c.chunk_bytes
        assert c.digest_so_far == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert data == ("é" * 5000).encode() and long[-1].last and not any(c.last for c in long[:-1])


def test_warc_empty_and_threshold(spark, pages):
    assert warc.records(warc.read_chunks(warc.write_warc(pages.limit(0)))).count() == 0
    kinds = warc.records(warc.read_chunks(warc.write_warc(pages, min_revisit_bytes=4))).where("payload_bytes < 4")
    assert {r.record_type for r in kinds.collect()} == {"response"}


def test_damage_is_noticed():
    out = io.BytesIO()
    warc.put_record(out, 1, "u", memoryview(b"abc"), None, False, 2)
    raw = gzip.decompress(out.getvalue()).replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        list(warc.get_chunks(io.BufferedReader(io.BytesIO(raw)), 10, True))

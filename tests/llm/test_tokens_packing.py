"""Encoding against the library's whole-text encoding, wavelet files, packing against exhaustive search."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skillsift.llm import packing, token_files
from skillsift.llm.common import encoder
from skillsift.llm.queries import tokenizer_path

ENC = encoder(tokenizer_path())


def whole(text):
    return np.array(ENC.tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ '’s.,!?09éÉßÿ×÷ΣσςǺ  İ\x1c\x85\t\n<|>"), st.characters(
    codec="utf-8")), max_size=40))
def test_encoding_equals_whole_text_encoding(text):
    assert np.frombuffer(ENC.encode([text.encode()])[0], "<u4").tolist() == whole(text).tolist()


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|startoftext|>b 's don't", "x" * 5000, "it's IT'LL 12ab --> Ünï"])
def test_encoding_special_cases(text):
    assert np.frombuffer(ENC.encode([text.encode()])[0], "<u4").tolist() == whole(text).tolist()


def test_caches_are_emptied():
    small = type(ENC)(tokenizer_path(), max_pieces=5)
    for t in ("one two three four five six", "seven eight nine ten eleven twelve", "one two"):
        assert np.frombuffer(small.encode([t.encode()])[0], "<u4").tolist() == whole(t).tolist()
    assert len(small.cache) <= 5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=300), st.integers(0, 49_000))
def test_wavelet_matrix(ids, shift):
    a = np.array(ids, np.uint32) + np.uint32(shift)
    built = token_files.WaveletMatrix.build(a)
    buf = b"".join(token_files.shard_bytes([None, 3], np.array([0, 0, len(a)]), built))
    doc_ids, starts, wm = token_files.open_shard(buf)
    assert doc_ids == [None, 3] and starts.tolist() == [0, 0, len(a)] and wm.ids().tolist() == a.tolist()
    for i in range(0, len(a), 7):
        assert wm.access(i) == a[i]
    for sym in {*a[:5].tolist(), shift + 51}:
        at = np.flatnonzero(a == sym).tolist()
        assert wm.count(sym) == len(at)
        assert [wm.select(sym, k) for k in range(len(at))] == at and wm.select(sym, len(at)) == -1
        assert wm.rank(sym, len(a) // 2) == sum(p < len(a) // 2 for p in at)


def order(rows):
    return sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_shards_read_back(spark, documents):
    manifest = token_files.write_shards(documents, tokenizer_path(), shard_ids=20_000)
    assert manifest.count() > 4
    got = {r.doc_id: r for r in token_files.read_shards(manifest).collect()}
    at = 0
    for r in order(documents.collect()):
        ids, g = whole(r.text), got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards_odd_rows(spark, odd_docs, no_docs):
    got = sorted(token_files.read_shards(token_files.write_shards(odd_docs, tokenizer_path())).collect(),
                 key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(whole(r.text).tobytes()) for r in odd_docs.collect())
    assert token_files.read_shards(token_files.write_shards(no_docs, tokenizer_path())).count() == 0


def cost(cuts, pen, chosen, size):
    at, total = 0, 0.0
    for j in chosen:
        n = cuts[j] - at
        if n > size:
            return np.inf
        total += (0 if n & (n - 1) == 0 else size - n) + pen[j]
        at = cuts[j]
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=11), st.data())
def test_cuts_are_optimal(gaps, data):
    """Against all subsets of cuts, with every power of two searched."""
    size = 32
    cuts = np.concatenate([[0], np.cumsum(gaps)])
    pen = np.array([0.0] + [float(data.draw(st.integers(0, 6))) for _ in gaps])
    pen[-1] = 0.0
    got = packing.best_cuts(cuts, pen, size)
    assert got[-1] == len(cuts) - 1

    def padding(n):
        return 0 if n & (n - 1) == 0 else size - n

    best = [0.0] + [np.inf] * len(gaps)
    for j in range(1, len(cuts)):
        best[j] = min((best[i] + padding(cuts[j] - cuts[i]) for i in range(j) if cuts[j] - cuts[i] <= size)) + pen[j]
    at, total = 0, 0.0
    for j in got:
        total += padding(cuts[j] - at) + pen[j]
        at = cuts[j]
    assert total == pytest.approx(best[-1]) and cost(cuts, pen, got, size) <= best[-1] + 1e-9


def check_pieces(rows, texts, size=2048):
    """Every id in exactly one piece, offsets without gaps; the padding and the ids."""
    ids = {k: whole(t) for k, t in texts}
    cover, seqs = {}, {}
    for r in rows:
        have = ids[r.doc_id]
        assert r.doc_tokens == len(have) and zlib.crc32(have[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, have in ids.items():
        at = 0
        for s, n in sorted(cover[d]):
            assert s == at
            at += n
        assert at == len(have)
    padding = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(map(len, ids.values()))


def test_packing(spark, documents):
    rows = packing.pack_documents(documents, tokenizer_path()).collect()
    padding, total = check_pieces(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert padding < 0.05 * total                    # four ranges end in one short sequence each


@pytest.mark.parametrize("text,ends", [
    ("one two. three! four? five", ["one two.", "one two. three!", "one two. three! four?"]),
    ("日本。日本！日本？ab 。x ！y", ["日本。", "日本。日本！", "日本。日本！日本？", "日本。日本！日本？ab 。", "日本。日本！日本？ab 。x ！"]),
    ("no end", []), ("", [])])
def test_sentence_ends(text, ends):
    """Cuts lie where the ids of the text up to a mark end, whatever pieces spell the mark."""
    got = packing.SentenceEnds(ENC.tok).after(whole(text)[:-1]).tolist()
    offsets = ENC.tok.encode(text, add_special_tokens=False).offsets
    want = [max(k + 1 for k, (_, b) in enumerate(offsets) if b <= len(e)) for e in ends]
    assert got == want


def test_packing_blocks(spark, documents):
    rows = packing.pack_documents(documents, tokenizer_path(), size=256, block=5_000, stride=64).collect()
    padding, total = check_pieces(rows, [(r.doc_id, r.text) for r in documents.collect()], 256)
    assert padding < 0.1 * total


def test_packing_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs.dropDuplicates(["doc_id"]), tokenizer_path()).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in odd_docs.dropDuplicates(["doc_id"]).collect()])
    both = packing.pack_documents(odd_docs, tokenizer_path()).collect()
    assert sum(r.length for r in both) == sum(len(whole(r.text)) for r in odd_docs.collect())
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0

"""Filter audit, exact-complement packing and spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skillsift.llm import complement_packing, filter_audit, spelling
from skillsift.llm.common import encoder
from skillsift.llm.queries import tokenizer_path

LABELS = "doc_id long, quality int, toxic int, extra string"


# -- filter audit ---------------------------------------------------------------------------------------------------

def fails(text, doc_id, firsts):
    words = [w.decode() for w in text.encode().split()]
    return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(set(text) & set("#$%&*|")),
            "E": doc_id is not None and firsts.get(text, doc_id) < doc_id}


def brute_audit(docs, labels):
    """Every order applied document by document."""
    firsts = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            firsts[t] = min(firsts.get(t, d["doc_id"]), d["doc_id"])
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    parts = defaultdict(list)
    for d in docs:
        parts[d["source"] or ""].append((d["doc_id"], fails(d["text"] or "", d["doc_id"], firsts)))
    out = []
    for part, rows in parts.items():
        taken, lines = Counter(), []
        for order in permutations("ABCDE"):
            alive = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if r[1][f]]
                alive = [r for r in alive if not r[1][f]]
                taken[f] += len(gone)
                lines.append([part, "".join(order), step, len(alive), len(gone), sum(r[1][f] for r in rows) - len(gone),
                              sum(r[1][f] and sum(r[1].values()) == 1 for r in rows), sum(r[0] in good for r in gone),
                              sum(r[0] in toxic for r in gone), f])
        out += [tuple(x[:-1]) + (taken[x[-1]],) for x in lines]
    return sorted(out)


def test_audit_on_odd_rows(spark, odd_docs):
    more = spark.createDataFrame([(9, "UPPER CASE #1 " * 20, None, "a", 1, "x", "f", 1),
                                  (10, "UPPER CASE #1 " * 20, None, "b", 1, "x", "f", 1),
                                  (10, "UPPER CASE #1 " * 20, None, "b", 1, "x", "f", 1),
                                  (None, "UPPER CASE #1 " * 20, None, "b", 1, "x", "f", 1),
                                  (11, " ".join(f"word{i}" for i in range(60)), None, "b", 1, "x", "f", 1)], odd_docs.schema)
    docs = odd_docs.unionByName(more)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (5, 1, 1, "x"), (6, None, 1, "x"), (10, 1, None, "x"),
                                    (None, 1, 1, "x"), (77, 1, 1, "x"), (None, 1, 1, "y")], LABELS)
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())
    assert got == brute_audit([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])


def test_audit_of_the_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = sorted(tuple(r) for r in filter_audit.audit(documents, labels).collect())
    assert got == brute_audit([r.asDict() for r in documents.collect()], [r.asDict() for r in labels.collect()])


def test_audit_of_nothing(spark, no_docs):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(no_docs, labels).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=64, max_size=64))
def test_gray_code_states(counts):
    cells = np.array(counts, np.int64).reshape(2, 32, 1)
    states = filter_audit.survivors(cells)
    for s in range(32):
        assert states[:, s].tolist() == cells[:, [m for m in range(32) if not m & s]].sum(1).tolist()


# -- packing --------------------------------------------------------------------------------------------------------

def check_patterns(counts):
    size = len(counts) - 1
    used = np.zeros(size + 1, np.int64)
    sequences = 0
    for pattern, n in complement_packing.plan_patterns(counts):
        assert n > 0 and 0 < sum(x * k for x, k in pattern.items()) <= size
        for x, k in pattern.items():
            used[x] += k * n
        sequences += n
    assert used.tolist() == counts.tolist()
    return sequences


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=64))
def test_patterns_use_every_piece_once(counts):
    a = np.array([0] + counts, np.int64)
    total = int((a * np.arange(len(a))).sum())
    got = check_patterns(a)
    assert -(-total // (len(a) - 1)) <= got <= best_fit_decreasing(a)


def best_fit_decreasing(counts):
    """Piece by piece into the fullest open sequence that has room."""
    size, gaps = len(counts) - 1, []
    for x in range(size, 0, -1):
        for _ in range(counts[x]):
            room = [g for g in gaps if g >= x]
            if room:
                gaps.remove(min(room))
            gaps.append((min(room) if room else size) - x)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=2, max_size=40), st.randoms())
def test_sum_indexes(counts, rng):
    """The indexes stay the number of ordered singles, pairs and triples of available lengths."""
    sums = complement_packing.LengthSums(np.array([0] + counts, np.int64))
    for _ in range(4):
        have = np.flatnonzero(sums.left)
        for s in range(sums.size + 1):
            assert sums.one[s] == sum(a == s for a in have)
            assert sums.two[s] == sum(a + b == s for a in have for b in have)
            assert sums.three[s] == sum(a + b + c == s for a in have for b in have for c in have)
            fill = sums.exact(s, {})
            if fill is not None:
                assert sum(x * k for x, k in fill.items()) == s and sum(fill.values()) <= 3
                assert all(sums.left[x] >= k for x, k in fill.items())
        if len(have):
            x = int(rng.choice(have.tolist()))
            sums.take({x: 1}, int(rng.randint(1, int(sums.left[x]))))


def test_exact_complements_are_found():
    counts = np.zeros(101, np.int64)
    counts[[70, 20, 9, 1, 60, 40, 55, 45, 100]] = [5, 5, 5, 5, 7, 7, 3, 3, 2]       # 70+20+9+1 is no triple's gap fill
    assert check_patterns(counts) == 5 + 7 + 3 + 2
    counts = np.zeros(4097, np.int64)
    counts[[4096, 4000, 96, 2048, 1]] = [10 ** 12, 10 ** 12, 10 ** 12, 10 ** 12, 10 ** 12]
    assert check_patterns(counts) <= 10 ** 12 * 2 + 10 ** 12 // 2 + 10 ** 12 // 4096 + 2


def check_packing(df, docs, size):
    enc = encoder(tokenizer_path()).tok
    pieces, want = df.collect(), Counter()
    for d in docs.collect():
        ids = enc.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), size)):
            part = np.array(ids[a:a + size], "<u4")
            want[(d["doc_id"], k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.length))
    for rows in held.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= size
    total = sum(p.length for p in pieces)
    return len(held), -(-total // size)


def test_packing_of_the_documents(spark, documents):
    got, least = check_packing(complement_packing.pack_whole(documents, tokenizer_path()), documents, 4096)
    assert least <= got <= least + 1


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    for size in (64, 4096):
        check_packing(complement_packing.pack_whole(odd_docs, tokenizer_path(), size), odd_docs, size)
    assert complement_packing.pack_whole(no_docs, tokenizer_path()).collect() == []


# -- spelling variants ----------------------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs, shortest=7, least=2, factor=10):
    n = Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d['doc_id'] is None else d['doc_id']}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    return brute_groups(n, factor)


def brute_groups(n, factor=10):
    near = {w: [] for w in n}
    words = sorted(n, key=len)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if len(b) > len(a) + 1:
                break
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_variants_of_the_documents(spark, documents):
    got = [tuple(r) for r in spelling.variant_groups(documents).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants([r.asDict() for r in documents.collect()])


def test_variants_of_odd_rows(spark, odd_docs, no_docs):
    long_run = "abcdefghij" * 3000
    more = [(20, "Nächster naechster nächste nächsten ÀÉÎ×÷ÿabc " * 12, None, "a", 1, "x", "f", 1),
            (21, f"{long_run} {long_run}x {long_run} x{long_run} {long_run}x x{long_run}", None, "a", 1, "x", "f", 1),
            (22, "aaaaaaa aaaaaaaa aaaaaaaaa " * 3 + "İstanbul İÅngström", None, None, 1, "x", "f", 1),
            (22, "aaaaaaa aaaaaaaa aaaaaaaaa " * 3 + "İstanbul İÅngström", None, None, 1, "x", "f", 1)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    got = [tuple(r) for r in spelling.variant_groups(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants([r.asDict() for r in docs.collect()])
    assert spelling.variant_groups(no_docs).collect() == []


@pytest.mark.parametrize("most,segments", [(4, 3), (256, 3), (2, 1), (3, 2), (64, 5)])
def test_near_words_with_small_buckets(spark, most, segments):
    """Hot prefixes and suffixes: nearly all words share both ends, so buckets divide down to one place."""
    rng = random.Random(7)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + "suffix" for _ in range(400)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(100)}
    words |= {"日本語" + "".join(rng.choice("語学🙂") for _ in range(rng.randint(0, 4))) for _ in range(40)}
    n = {w: rng.choice([1, 2, 2, 20, 400]) for w in words}
    from skillsift.session import materialize
    frame = materialize(spark.createDataFrame(list(n.items()), "word string, n long"))
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(frame, segments, most).collect()}
    want = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), n[best], best)
    assert got == want


def test_roots_follow_chains(spark):
    pairs = [(f"w{i:02}", f"w{i + 1:02}") for i in range(19)] + [("v", "w05")]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(pairs, "word string, form string")).collect())
    assert got == {a: "w19" for a, _ in pairs}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).collect() == []

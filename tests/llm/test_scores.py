"""Class language model against a direct computation; exchange gains against recounting; quality on held-out labels."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skillsift.llm import class_lm, quality
from skillsift.llm.common import id_remainder

from .conftest import SF


def words(text):
    return (text or "").encode().lower().split()


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5


def likeliest(x):
    """Index of the highest value; of equal ones the first."""
    return int(np.argmax(np.round(np.array(x), 6)))


def spelled(word):
    text = word.decode()
    last = text[-1]
    closed = last.isascii() and not (last.islower() or last.isdigit())
    return 8 * any(c in "0123456789" for c in text) + 4 * (not text.isascii()) + 2 * closed + (len(word) > 9)


def direct(rows, free, rounds, grain, least, alpha=5.0):
    """The model from its definition: every table recounted over the tokens, every likelihood from a whole table."""
    learn = [words(t) for i, t in rows if remainder(i) != 1]
    counts = Counter(w for d in learn for w in d)
    ends = len(learn)
    total, types = sum(counts.values()) + ends, len(counts) + (ends > 0)
    head = sorted((w for w, n in counts.items() if n * grain >= total and len(w) <= 64 and n >= least),
                  key=lambda w: (-counts[w], w))
    count, end = free + 17, free + 16
    cls = {w: free + spelled(w) for w in counts}
    cls.update((w, i % free) for i, w in enumerate(head))
    pairs = Counter(p for d in learn for p in zip([None, *d], [*d, None]))

    def table(cls):
        t = np.zeros((count, count), np.int64)
        for (a, b), n in pairs.items():
            t[cls.get(a, end), cls.get(b, end)] += n
        return t

    def value(cls):
        return class_lm.log_likelihood(table(cls))
    best = value(cls), cls
    for r in range(rounds):
        moves = {}
        for i, w in enumerate(head):
            if zlib.crc32(i.to_bytes(4, "little")) % 8 == r % 8:
                v = [value({**cls, w: c}) for c in range(free)]
                if max(v) > v[cls[w]] + 1e-6:
                    moves[w] = likeliest(v)
        cls = {**cls, **moves}
        best = max(best, (value(cls), cls), key=lambda x: x[0])
    cls, base, final = best[1], table(best[1]), dict(best[1])
    for w in counts:
        if counts[w] >= least and w not in head:
            own = [(a, b, n) for (a, b), n in pairs.items() if w in (a, b)]
            v = []
            for c in range(free):
                t = base.copy()
                for a, b, n in own:
                    if a == w:
                        t[c, cls.get(b, end)] += n
                    if b == w:
                        t[cls.get(a, end), c] += n
                v.append(class_lm.log_likelihood(t))
            final[w] = likeliest(v)
    t = table(final).astype(float)
    share = (t.sum(0) + 0.5) / (t.sum() + 0.5 * count)
    step = np.log10((t + alpha * share) / (t.sum(1, keepdims=True) + alpha))
    tokens, members = Counter(), Counter(final.values())
    for w, n in counts.items():
        tokens[final[w]] += n

    def score(d):
        line = [end, *(final.get(w, free + spelled(w)) for w in d), end]
        return (sum(step[a, b] for a, b in zip(line, line[1:]))
                + sum(math.log10((counts[w] + 0.5) / (tokens[c] + 0.5 * (members[c] + 1))) for w, c in zip(d, line[1:])))
    return counts, ends, total, types, sum(n for c, n in tokens.items() if c < free), score


@pytest.mark.parametrize("head", [50, 10 ** 6])
def test_scores_equal_the_definition(spark, documents, head):
    """A third of the tables' documents, some words of over 64 bytes among them, few or all words carried."""
    some = documents.where("doc_id % 3 = 0").limit(40)
    rows = [(r.doc_id, r.text and r.text[:1500]) for r in some.orderBy("doc_id").collect()]
    rows += [(10 ** 6 + i, f"{'long' * 20} stands here, {'w' * 70} too {'long' * 20}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in class_lm.score_documents(
        df, id_remainder() == 1, free=4, rounds=9, grain=120, head=head, least=3).collect()}
    counts, ends, total, types, clustered, score = direct(rows, 4, 9, 120, 3)
    assert len(got) == len(rows) and 0 < clustered < total
    base_room = math.log10(total + 0.5 * (types + 1))
    for i, t in rows:
        g, w = got[i], words(t)
        assert (g.held_out, g.n_tokens, g.train_tokens) == (remainder(i) == 1, len(w) + 1, total)
        assert g.n_known == sum(counts[x] > 0 for x in w) + (ends > 0) and g.clustered_tokens == clustered
        base = sum(math.log10(counts[x] + 0.5) - base_room for x in w) + math.log10(ends + 0.5) - base_room
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert g.score == pytest.approx(score(w), rel=1e-9)
        assert g.perplexity == pytest.approx(10 ** (-g.score / g.n_tokens))


def test_clustered_words_grow_with_the_corpus(spark):
    def clustered(sf):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        return class_lm.score_documents(docs, id_remainder() == 1, rounds=1).first()
    small, large = clustered("sf0.001"), clustered("sf0.01")
    assert large.clustered_tokens / large.train_tokens > small.clustered_tokens / small.train_tokens


def test_score_does_not_depend_on_what_is_carried(spark, documents):
    def run(head):
        df = class_lm.score_documents(documents, id_remainder() == 1, free=8, rounds=2, grain=500, head=head)
        return {r.doc_id: r for r in df.collect()}
    few, many = run(3), run(10 ** 6)
    for i in few:
        assert few[i].score == pytest.approx(many[i].score, rel=1e-9) and few[i].n_known == many[i].n_known
        assert few[i].base_score == pytest.approx(many[i].base_score, rel=1e-9)


def test_score_from_model_parts(spark):
    """Two words always in turn: the model's transitions are nearly certain, and every token's share adds up."""
    docs = spark.createDataFrame([(i, "aa bb " * 20) for i in range(40)], "doc_id long, text string")
    rows = class_lm.score_documents(docs, F.lit(False), free=4, rounds=3, grain=1000).collect()
    r = rows[0]
    assert len({x.score for x in rows}) == 1 and r.n_known == r.n_tokens == 41
    assert r.score > r.base_score + 8               # about 40 tokens of 0.3 each are saved
    contexts = class_lm.contexts(class_lm.pair_rows(docs.select("text"), [b"aa", b"bb"]))
    classes, table = class_lm.cluster(contexts, 2, 4, 3)
    end = 4 + class_lm.SPELLINGS
    assert table.sum() == 40 * 41 and table[classes[0], classes[1]] == 800 and table[end, classes[0]] == 40


def test_held_out_beats_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = class_lm.score_documents(docs, id_remainder() == 1).where("held_out") \
                .agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_lm_odd_rows(spark, odd_docs, no_docs):
    rows = class_lm.score_documents(odd_docs, id_remainder() == 1, free=4, rounds=2).collect()
    assert len(rows) == odd_docs.count()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    empty = [r for r in rows if r.doc_id in (2, 3, 8)]
    assert {r.n_tokens for r in empty} == {1} and len({round(r.score, 9) for r in empty}) == 1
    assert class_lm.score_documents(no_docs, id_remainder() == 1).count() == 0
    untaught = class_lm.score_documents(odd_docs, F.lit(True)).collect()
    assert len(untaught) == odd_docs.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in untaught)


def likelihood(seq, cls, count):
    t = np.zeros((count, count), np.int64)
    np.add.at(t, (cls[seq[:-1]], cls[seq[1:]]), 1)
    return class_lm.log_likelihood(t), t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=4, max_size=60), st.integers(0, 5), st.integers(0, 999))
def test_gains_equal_recounting(seq, w, seed):
    """Moving a word: the difference of gains is the difference of the recounted likelihoods."""
    free, count = 4, 5
    cls = np.append(np.random.default_rng(seed).integers(0, free, 6), 4)      # symbol 6 is the end, class 4
    s = np.array([6, *seq, 6])
    now, table = likelihood(s, cls, count)
    nxt = np.bincount(cls[s[1:][s[:-1] == w]], minlength=count)
    bef = np.bincount(cls[s[:-1][s[1:] == w]], minlength=count)
    self_n = int(((s[:-1] == w) & (s[1:] == w)).sum())
    g = class_lm.gains(table, cls[w], nxt, bef, self_n, free)
    for c in range(free):
        moved = cls.copy()
        moved[w] = c
        assert g[c] - g[cls[w]] == pytest.approx(likelihood(s, moved, count)[0] - now, abs=1e-6)


def test_rounds_do_not_lower_the_likelihood(spark, documents):
    vocab = sorted({w for r in documents.collect() for w in words(r.text)})[:400]
    rows = class_lm.contexts(class_lm.pair_rows(documents.select("text"), vocab))
    first = class_lm.cluster(rows, len(vocab), 8, 0)[1]
    assert class_lm.log_likelihood(class_lm.cluster(rows, len(vocab), 8, 6)[1]) > class_lm.log_likelihood(first)


# ---- quality ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_quality(labelled):
    docs, labels = labelled
    ranker = quality.learn(docs, labels, id_remainder() != 0)
    got = quality.score_quality(docs, ranker, id_remainder() == 0)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_threshold_covers_all_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ranker = quality.learn(docs, labels, id_remainder() != 0, max_rows=60)
    label = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = [(r.text or "", label[r.doc_id]) for r in docs.collect() if label.get(r.doc_id) is not None]
    assert len(rows) > 200
    raw = np.sort(ranker.raw(np.array([quality.features(memoryview(t.encode())) for t, _ in rows])))
    bad = sum(q != 1 for _, q in rows)
    assert raw[max(0, bad - 2)] <= ranker.shift <= raw[min(bad + 1, len(raw) - 1)]


def test_quality_ignores_all_but_the_text(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ranker = quality.learn(documents, labels, id_remainder() != 0)
    other = documents.select((F.col("doc_id") + 10 ** 6).alias("doc_id"), "text", F.lit("q").alias("source"))
    a = {r.doc_id: r.score for r in quality.score_quality(documents, ranker, F.lit(True)).collect()}
    b = {r.doc_id - 10 ** 6: r.score for r in quality.score_quality(other, ranker, F.lit(True)).collect()}
    assert a == b


def test_pairs_rank_planted_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    good = x[:, 0] - 2 * x[:, 1] > 0.8
    ranker = quality.fit_pairs(x, good, pairs=4000, ridge=0.1)
    s = ranker(x)
    assert s[good].min() > s[~good].max() - 0.2
    assert np.mean((s >= 0.3) == good) > 0.97


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, None), (5, 0, 0), (5, 1, 0), (6, None, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    ranker = quality.learn(odd_docs, labels, F.lit(True))
    rows = quality.score_quality(odd_docs, ranker, id_remainder() == 0).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(odd_docs, ranker).columns == odd_docs.columns
    assert quality.score_quality(no_docs, ranker, F.lit(True)).count() == 0
    untaught = quality.learn(odd_docs, labels.limit(0), F.lit(True))
    assert quality.keep_good(odd_docs, untaught).count() == odd_docs.count()
    one_sided = quality.learn(odd_docs, labels.where("quality = 1"), F.lit(True))
    assert {r.predicted for r in quality.score_quality(odd_docs, one_sided, F.lit(True)).collect()} == {1}

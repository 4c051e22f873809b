"""Class-based n-gram language model: exchange clustering, then smoothed class-transition and word-emission scores.

Learning corpus: the documents ``learn`` selects. Tokens: lower-cased (A-Z) words, then one end token a text.

1. Word counts over the whole learning corpus (folded per task before the shuffle) give N, V and c(w).
2. Every word with ``least`` occurrences or more is clustered, so the clustered vocabulary grows with the corpus; a
   rarer or unseen word has a spelling class: digits, other scripts, closing punctuation and length decide.
3. Exchange among the head, the words of at most 64 bytes with at least one ``grain``-th of all tokens: from a start by
   frequency rank, a round looks at an eighth of them (by hash) and moves each to the class that raises the
   class-bigram log-likelihood most, given all other words' classes; words outside the head count by their spelling. A
   round is one pass over rows (word, neighbours' counts); larger shares moved at once undo each other. The best
   classes seen are kept.
4. Every other clustered word is then put, by the same likelihood, into the class that fits its neighbours best, given
   the head's classes and table (``place``). Their classes are a written table (sym, cls) at any size, met by joins;
   sym is a 59-bit hash of the word with its spelling class, and words of equal sym count as one here.
5. The class-bigram table is recounted with these classes: moved rows and columns where one neighbour is such a
   word, and a join of the adjacent pairs with the class table where both are.
6. score(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class); the text starts after an
   end token. P(class | before) is the bigram estimate with ``alpha`` counts of the class's overall share added;
   P(word | class) = (c + 0.5) / (class tokens + 0.5 * (class words + 1)), which leaves 0.5 for unseen words.

Through the driver pass the head's classes (at most ``grain``), tables of classes squared, and the words the scorer
carries: the most frequent ones, at most ``head`` and none over 64 bytes. Every other token goes with its place and its
neighbours' classes through a join with the vocabulary, which gives its count and class; a run of such tokens is put in
order again per text. The split changes only the plan, never a number.

Cases: null text = empty text = one end token; a null doc_id counts as the empty text for the hash; repeated rows are
scored one by one; with an empty learning corpus all counts are 0 and the scores fall back to uniform values;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import byte_words, slices, text_or_empty, value_views

END = b"\n"                                   # stands for the end token; no word contains white space
SPELLINGS = 16


def spelling_class(word: bytes) -> int:
    """Class 0..15 of a word that is not clustered: digits, other scripts, closing punctuation, length."""
    last = word[-1]
    digits = any(48 <= c <= 57 for c in word)
    wide = not word.isascii()
    closed = last < 128 and not (97 <= last <= 122 or 48 <= last <= 57)
    return digits * 8 + wide * 4 + closed * 2 + (len(word) > 9)


def symbol_of(word: bytes) -> int:
    """Negative 64-bit symbol of a word outside the head: a hash whose last four bits are its spelling class."""
    return ((xxhash.xxh64_intdigest(word) | 1 << 63) & ~15 | spelling_class(word)) - (1 << 64)


# ---- counting --------------------------------------------------------------------------------------------

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())],
                                          ["word", "n"])
    for b in slices(batches, "text"):
        for v in value_views(b.column("text")):
            held.update(byte_words(v))
            held[END] += 1
        if len(held) > 300_000:
            yield out()
            held = Counter()
    if held:
        yield out()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all of ``texts`` (column text); the end token is the word "\\n"."""
    return texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _list_rows(sym: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """One row per symbol with all its neighbours."""
    order = np.argsort(sym, kind="stable")
    sym, near = sym[order], near[order]
    first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    return _pair_batch(1, sym[first], near=pa.ListArray.from_arrays(
        pa.array(np.append(first, len(sym)).astype(np.int32)), pa.array(near)))


def _pair_batch(kind: int, a: np.ndarray, b=None, n=None, near=None) -> pa.RecordBatch:
    m = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, kind, np.int32)), pa.array(a, pa.int64()),
         pa.nulls(m, pa.int64()) if b is None else pa.array(b, pa.int64()),
         pa.nulls(m, pa.int64()) if n is None else pa.array(n, pa.int64()),
         pa.nulls(m, pa.list_(pa.int32())) if near is None else near], ["kind", "a", "b", "n", "near"])


def _pairs(words: dict[bytes, int], room: int = 2_000_000):
    """Neighbouring tokens, three kinds of rows.

    0: counts n of neighbouring symbols a, b: head words (0..k-1), spelling classes (k..k+15), the end token (k+16).
    1: a word outside the head (a: its symbol) with its neighbours: x follows, -x-1 goes before, x as in kind 0.
    2: two neighbouring words outside the head, a row each time."""
    k = len(words)
    end, base = k + SPELLINGS, k + SPELLINGS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def symbol(w: bytes) -> int:
            s = symbol_of(w)
            if len(seen) > 500_000:
                seen.clear()
            if len(w) <= 64:
                seen[w] = s
            return s

        def fold(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(n)).astype(np.int64)

        keys, ns, held = [], [], 0
        syms, nears, lists = [], [], 0
        for batch in slices(batches, "text"):
            line = [end]
            for v in value_views(batch.column("text")):
                for w in byte_words(v):
                    s = words.get(w)
                    if s is None:
                        s = seen.get(w)
                        if s is None:
                            s = symbol(w)
                    line.append(s)
                line.append(end)
            x = np.array(line, np.int64)
            plain = np.where(x < 0, k + (x & 15), x)
            a, b = x[:-1], x[1:]
            key, n = np.unique(plain[:-1] * base + plain[1:], return_counts=True)
            keys.append(key)
            ns.append(n)
            held += len(key)
            if held > 2 * room:
                key, n = fold(keys, ns)
                if len(key) > room:
                    yield _pair_batch(0, key // base, key % base, n)
                    keys, ns, held = [], [], 0
                else:
                    keys, ns, held = [key], [n], len(key)
            ahead, behind = a < 0, b < 0
            syms += [a[ahead], b[behind]]
            nears += [plain[1:][ahead].astype(np.int32), (-plain[:-1][behind] - 1).astype(np.int32)]
            lists += len(syms[-1]) + len(syms[-2])
            if lists > room:
                yield _list_rows(np.concatenate(syms), np.concatenate(nears))
                syms, nears, lists = [], [], 0
            both = ahead & behind
            if both.any():
                yield _pair_batch(2, a[both], b[both])
        if keys:
            key, n = fold(keys, ns)
            yield _pair_batch(0, key // base, key % base, n)
        if lists:
            yield _list_rows(np.concatenate(syms), np.concatenate(nears))
    return run


def pair_rows(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """The written rows of ``_pairs`` for the head ``words``."""
    index = {w: i for i, w in enumerate(words)}
    return materialize(texts.mapInArrow(_pairs(index), "kind int, a bigint, b bigint, n bigint, near array<int>"),
                       texts.sparkSession, "word-pairs")


def contexts(pairs: DataFrame) -> DataFrame:
    """One row per head word (and one per spelling class and the end token): its neighbours' counts.

    w, next / next_n, before / before_n, each at most as long as there are such symbols."""
    spark = pairs.sparkSession
    counts = materialize(pairs.where("kind = 0").groupBy(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
                              .agg(F.sum("n").alias("n")), spark, "symbol-pairs")

    def rows(me: str, other: str, name: str) -> DataFrame:
        both = F.collect_list(F.struct(F.col(other).alias("s"), "n"))
        return counts.groupBy(F.col(me).alias("w")).agg(both.alias("x")).select(
            "w", F.col("x.s").alias(name), F.col("x.n").alias(f"{name}_n"))
    return materialize(rows("a", "b", "next").join(rows("b", "a", "before"), "w", "full"), spark, "contexts")


# ---- exchange --------------------------------------------------------------------------------------------

def _rows(b: pa.RecordBatch):
    d = {c: b.column(c) for c in ("w", "next", "next_n", "before", "before_n")}
    for i in range(b.num_rows):
        yield d["w"][i].as_py(), *(np.asarray(d[c][i].values if d[c][i].is_valid else [], np.int64)
                                   for c in ("next", "next_n", "before", "before_n"))


def _class_table(classes: np.ndarray, count: int):
    """Class-bigram counts of one partition of word rows, from successors only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((count, count), np.int64)
        for b in batches:
            for w, nxt, n, _, _ in _rows(b):
                table[classes[w]] += np.bincount(classes[nxt], n, count).astype(np.int64)
        a, c = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32)),
                                          pa.array(table[a, c])], ["a", "b", "n"])
    return run


def class_table(rows: DataFrame, classes: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros((count, count), np.int64)
    got = rows.mapInArrow(_class_table(classes, count), "a int, b int, n bigint") \
              .groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()        # at most count * count rows
    out[got.column("a").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def log_likelihood(table: np.ndarray) -> float:
    """The part of the class-bigram log-likelihood that depends on the classes."""
    t = table.astype(np.float64)
    return float(_g(t).sum() - _g(t.sum(0)).sum() - _g(t.sum(1)).sum())


def gains(table: np.ndarray, own: int, nxt: np.ndarray, before: np.ndarray, self_n: int, free: int) -> np.ndarray:
    """Log-likelihood of the word in each of the ``free`` classes, up to a constant.

    ``nxt`` / ``before``: the word's neighbours per class, itself (``self_n`` times) included in class ``own``."""
    t = table.astype(np.float64)
    nx, bf = nxt.astype(np.float64), before.astype(np.float64)
    nx[own] -= self_n
    bf[own] -= self_n
    t[own, :] -= nx
    t[:, own] -= bf
    t[own, own] -= self_n
    c = np.arange(free)
    f_nx, f_bf = np.flatnonzero(nx), np.flatnonzero(bf)
    rows, cols = t[:free][:, f_nx], t[f_bf][:, :free]
    out = (_g(rows + nx[f_nx]) - _g(rows)).sum(1) + (_g(cols + bf[f_bf][:, None]) - _g(cols)).sum(0)
    diag = t[c, c]
    out -= _g(diag + nx[c]) - _g(diag) + _g(diag + bf[c]) - _g(diag)
    out += _g(diag + nx[c] + bf[c] + self_n) - _g(diag)
    after, ahead = (t.sum(1) + bf)[:free], (t.sum(0) + nx)[:free]       # occurrences left and right of a gap
    total_n, total_b = nx.sum() + self_n, bf.sum() + self_n
    return out - (_g(after + total_n) - _g(after)) - (_g(ahead + total_b) - _g(ahead))


def _exchange(classes: np.ndarray, table: np.ndarray, words: int, free: int, turn: int, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, to = [], []
        for b in batches:
            for w, nxt, nxt_n, bef, bef_n in _rows(b):
                if w >= words or zlib.crc32(int(w).to_bytes(4, "little")) % turns != turn:
                    continue
                own = classes[w]
                g = gains(table, own, np.bincount(classes[nxt], nxt_n, len(table)),
                          np.bincount(classes[bef], bef_n, len(table)), int(nxt_n[nxt == w].sum()), free)
                best = int(np.argmax(g))
                if g[best] > g[own] + 1e-9:
                    ws.append(w)
                    to.append(best)
        yield pa.RecordBatch.from_arrays([pa.array(ws, pa.int32()), pa.array(to, pa.int32())], ["w", "c"])
    return run


def cluster(rows: DataFrame, words: int, free: int, rounds: int, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols (words 0..free-1, spelling classes, end) and the class table."""
    count = free + SPELLINGS + 1
    classes = np.concatenate([np.arange(words) % free, free + np.arange(SPELLINGS + 1)]).astype(np.int32)
    table = class_table(rows, classes, count)
    best, still = (log_likelihood(table), classes, table), 0
    for r in range(rounds):
        moved = rows.mapInArrow(_exchange(classes, table, words, free, r % turns, turns), "w int, c int").toArrow()
        still = 0 if moved.num_rows else still + 1                      # at most ``words`` rows, one number each
        if still == turns:
            break
        if not moved.num_rows:
            continue
        classes = classes.copy()
        classes[moved.column("w").to_numpy()] = moved.column("c").to_numpy()
        table = class_table(rows, classes, count)
        value = log_likelihood(table)
        if value > best[0]:
            best = (value, classes, table)
    return best[1], best[2]


# ---- words outside the head --------------------------------------------------------------------------------

def _by_class(classes: np.ndarray, count: int):
    """(a, code, n): how often a word meets a class; code c: the class follows, count + c: it goes before."""
    code = np.concatenate([classes, count + classes[::-1]])              # at x, and at -x-1 from the end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = b.column("near")
            lens = np.diff(np.asarray(near.offsets).astype(np.int64))
            key, n = np.unique(np.repeat(np.arange(len(lens)), lens) * (2 * count)
                               + code[near.flatten().to_numpy()], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column("a").to_numpy()[key // (2 * count)]), pa.array((key % (2 * count)).astype(np.int32)),
                 pa.array(n, pa.int64())], ["a", "code", "n"])
    return run


def place(table: np.ndarray, free: int, first: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best of the ``free`` classes for each word: the one whose log-likelihood is highest when the word's
    occurrences are added to ``table`` in that class. Word i has the entries first[i]..first[i + 1] of code and n."""
    t, count, m = table.astype(np.float64), len(table), len(first) - 1
    row = np.repeat(np.arange(m), np.diff(first))
    dense = np.zeros((m, 2 * count))
    dense[row, code] = n
    nxt, bef = dense[:, :count], dense[:, count:]
    base = np.concatenate([t[:free].T, t[:, :free]])                     # cells a word in each class adds to, by code
    cells = _g(base[code] + n[:, None]) - _g(base)[code]
    out = np.add.reduceat(cells, first[:-1], axis=0)
    d, x, y = np.diag(t)[:free], nxt[:, :free], bef[:, :free]            # one cell takes both at the class itself
    out += _g(d + x + y) - _g(d + x) - _g(d + y) + _g(d)
    after, ahead = t.sum(1)[:free] + y, t.sum(0)[:free] + x
    out -= _g(after + nxt.sum(1, keepdims=True)) - _g(after) + _g(ahead + bef.sum(1, keepdims=True)) - _g(ahead)
    return np.argmax(np.round(out, 6), axis=1)                           # equal classes: the first


def _place(table: np.ndarray, free: int):
    """Rows (a, cls) of every word, and (spelling, cls, code, n): occurrences to move in the class table."""
    count = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sym, near = b.column("a").to_numpy(), b.column("near")
                first = np.asarray(near.offsets).astype(np.int64)
                first = first - first[0]
                flat = near.flatten()
                code, n = flat.field("code").to_numpy(), flat.field("n").to_numpy()
                cls = place(table, free, first, code, n)
                row = np.repeat(np.arange(len(sym)), np.diff(first))
                side = code % count
                known = (side < free) | (side == count - 1)              # neighbours outside the head: see kind 2
                key, at_key = np.unique(((sym[row] & 15) * free + cls[row])[known] * (2 * count) + code[known],
                                        return_inverse=True)
                moved = np.bincount(at_key, n[known], len(key)).astype(np.int64)
                pair, m = key // (2 * count), len(sym)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(sym, pair // free)), pa.array(np.append(cls, pair % free).astype(np.int32)),
                     pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array((key % (2 * count)).astype(np.int32))]),
                     pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(moved)])], ["a", "cls", "code", "n"])
    return run


def place_words(pairs: DataFrame, classes: np.ndarray, table: np.ndarray, free: int,
                least: int) -> tuple[DataFrame, np.ndarray]:
    """Written classes (sym, cls) of the words outside the head, and the class table recounted with them."""
    count = len(table)
    # By symbol alone: both groupings reuse that partitioning. A symbol has at most a grain-th of all tokens
    # (words over 64 bytes aside), folded per chunk to 2 * count rows.
    met = (pairs.where("kind = 1").select("a", "near").mapInArrow(_by_class(classes, count), "a bigint, code int, n bigint")
                .repartition("a").groupBy("a", "code").agg(F.sum("n").alias("n")))
    words = (met.groupBy("a").agg(F.collect_list(F.struct("code", "n")).alias("near"),
                                  F.sum(F.when(F.col("code") < count, F.col("n"))).alias("total"))
                .where(F.col("total") >= least).select("a", "near"))
    placed = materialize(words.mapInArrow(_place(table, free), "a bigint, cls int, code int, n bigint"),
                         pairs.sparkSession, "placed")
    cls = placed.where("code is null").select(F.col("a").alias("sym"), "cls")

    out = table.copy()
    moved = placed.where("code is not null").groupBy("a", "cls", "code").agg(F.sum("n").alias("n")).toArrow()
    s, c, k, n = (moved.column(x).to_numpy() for x in ("a", "cls", "code", "n"))       # 16 * free * 2 * count at most
    nxt, old = k < count, free + s
    np.subtract.at(out, (old[nxt], k[nxt]), n[nxt])
    np.add.at(out, (c[nxt], k[nxt]), n[nxt])
    np.subtract.at(out, (k[~nxt] - count, old[~nxt]), n[~nxt])
    np.add.at(out, (k[~nxt] - count, c[~nxt]), n[~nxt])

    def of(sym: str, name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(free) + F.col(sym).bitwiseAND(15)).cast("int").alias(name)

    # First what of b and the class of a, folded, then the class of b.
    both = (pairs.where("kind = 2").select("a", "b").join(cls.toDF("a", "ca"), "a", "left")
                 .select(F.col("a").bitwiseAND(15).alias("sa"), of("a", "ca"), "b")
                 .join(cls.toDF("b", "cb"), "b", "left")
                 .select("sa", "ca", F.col("b").bitwiseAND(15).alias("sb"), of("b", "cb"))
                 .groupBy("sa", "ca", "sb", "cb").agg(F.count(F.lit(1)).alias("n")))
    tables = materialize(both, pairs.sparkSession, "outer-pairs")
    for x, y, sign in (("ca", "cb", 1), ("sa", "sb", -1)):
        got = tables.groupBy(x, y).agg(F.sum("n").alias("n")).toArrow()                  # count * count at most
        i, j, n = (got.column(v).to_numpy().astype(np.int64) for v in (x, y, "n"))
        shift = 0 if sign > 0 else free
        np.add.at(out, (i + shift, j + shift), sign * n)
    return cls, out


# ---- model and scores ------------------------------------------------------------------------------------

class Model:
    """What the scorer needs: transitions between classes, sizes of classes, and the frequent words."""

    def __init__(self, head: list[tuple[bytes, int, int]], table: np.ndarray, class_tokens: np.ndarray,
                 class_words: np.ndarray, tokens: int, types: int, free: int, alpha: float = 5.0) -> None:
        self.index = {w: i for i, (w, _, _) in enumerate(head)}
        self.free, self.tokens, self.types = free, tokens, types
        self.cls = np.array([c for _, _, c in head], np.int32)
        self.n = np.array([n for _, n, _ in head], np.int64)
        t = table.astype(np.float64)
        share = (t.sum(0) + 0.5) / (t.sum() + 0.5 * len(t))
        self.step = np.log10((t + alpha * share) / (t.sum(1, keepdims=True) + alpha))
        self.class_room = np.log10(class_tokens + 0.5 * (class_words + 1))
        self.base_room = math.log10(tokens + 0.5 * (types + 1))
        self.end = len(t) - 1
        # The end token is the only member of its class.
        self.end_emission = 0.0

    def emission(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return np.log10(n + 0.5) - self.class_room[cls]


def _score(model, tokens_of_end: int):
    """Sums over the carried tokens, and every other token with its place and its neighbours' classes (-1: such a
    token itself). A transition counts where its later token is, or, after such a token, with that one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        get = m.index.get
        log_n = np.append(np.log10(m.n + 0.5), 0.0)
        emit = np.append(np.log10(m.n + 0.5) - m.class_room[m.cls], 0.0)
        classes = np.append(m.cls, -1).astype(np.int64)
        step = np.pad(m.step, (0, 1))                                    # no transition beside class -1
        base_end = math.log10(tokens_of_end + 0.5)
        for b in slices(batches, "text"):
            cols = {k: [] for k in ("n_tokens", "n_known", "base", "score", "tail", "spelling", "at", "left", "right")}
            for v in value_views(b.column("text")):
                words = byte_words(v)
                ids = np.array([get(w, -1) for w in words], np.int64)
                line = np.concatenate([[m.end], classes[ids], [m.end]])
                rare = np.flatnonzero(ids < 0)
                out = [words[i] for i in rare.tolist()]
                cols["n_tokens"].append(len(words) + 1)
                cols["n_known"].append(len(words) - len(rare) + (tokens_of_end > 0))
                cols["base"].append(float(log_n[ids].sum()) + base_end)
                cols["score"].append(float(step[line[:-1], line[1:]].sum() + emit[ids].sum()) + m.end_emission)
                cols["tail"].append(out)
                cols["spelling"].append([m.free + spelling_class(w) for w in out])
                cols["at"].append(rare)
                cols["left"].append(line[rare])
                cols["right"].append(line[rare + 2])
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), b.column("doc_id"), b.column("held_out"), pa.array(cols["n_tokens"], pa.int64()),
                 pa.array(cols["n_known"], pa.int64()), pa.array(cols["base"], pa.float64()),
                 pa.array(cols["score"], pa.float64()), pa.array(cols["tail"], pa.list_(pa.binary()))]
                + [pa.array(cols[c], pa.list_(pa.int32())) for c in ("spelling", "at", "left", "right")],
                ["_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "spelling", "at", "left",
                 "right"])
    return run


SCORED = ("_row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
          "tail array<binary>, spelling array<int>, at array<int>, left array<int>, right array<int>")


def _score_rest(step: np.ndarray, room: np.ndarray):
    """Sums over the tokens that went through the join, ``x`` in the order of their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = np.asarray(b.column("x").offsets).astype(np.int64)
            first = first - first[0]
            x = b.column("x").flatten()
            cls, left, right, n = (x.field(c).to_numpy() for c in ("cls", "left", "right", "n"))
            before = np.where(left < 0, np.roll(cls, 1), left)           # its neighbour is the row's one before
            log_n = np.log10(n + 0.5)
            score = step[before, cls] + np.where(right < 0, 0.0, step[cls, right]) + log_n - room[cls]
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), pa.array(np.add.reduceat((n > 0).astype(np.int64), first[:-1])),
                 pa.array(np.add.reduceat(log_n, first[:-1])), pa.array(np.add.reduceat(score, first[:-1]))],
                ["_row", "known", "t_base", "t_score"])
    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        syms = [0 if w == END else symbol_of(w) for w in b.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(syms, pa.int64())],
                                         ["word", "n", "sym"])


def score_documents(docs: DataFrame, held_out: Column, free: int = 64, rounds: int = 24, grain: int = 1 << 15,
                    head: int = 300_000, alpha: float = 5.0, least: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity,
    clustered_tokens (of the learning corpus, those of clustered words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = rows.where(~F.col("held_out")).select("text")
    counted = materialize(count_words(learn).mapInArrow(_spelled, "word binary, n bigint, sym bigint"), spark, "counts")
    st = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                     F.coalesce(F.sum(F.when(F.col("sym") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    total, types, ends = st["n"], st["v"], st["ends"]

    # Head: at least total / grain tokens, so at most ``grain`` words.
    in_head = (F.length("word") <= 64) & (F.col("n") * grain >= total) & (F.col("n") >= least)
    frequent = counted.where((F.col("sym") != 0) & in_head).orderBy(F.desc("n"), "word").toArrow()
    words = frequent.column("word").to_pylist()
    pairs = pair_rows(learn, words)
    classes, head_table = cluster(contexts(pairs), len(words), free, rounds)
    placed, table = place_words(pairs, classes, head_table, free, least)

    # Every word's class: the head's by its rank there, other words' from the class table, else by spelling.
    ranked = spark.createDataFrame([(bytearray(w), int(c)) for w, c in zip(words, classes)], "word binary, cls int")
    vocab = materialize(
        counted.where((F.col("sym") != 0) & ~in_head).join(placed, "sym", "left")
               .select("word", "n", F.coalesce("cls", F.lit(free) + F.col("sym").bitwiseAND(15)).cast("int").alias("cls"))
               .unionByName(counted.where((F.col("sym") != 0) & in_head).join(F.broadcast(ranked), "word")
                                   .select("word", "n", "cls")), spark, "vocab")
    count = free + SPELLINGS + 1
    class_tokens, class_words = np.zeros(count), np.zeros(count)
    for r in vocab.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row a class
        class_tokens[r["cls"]], class_words[r["cls"]] = r["n"], r["v"]

    # Carried: words of the smallest count that at most ``head`` words reach (from the histogram of counts, one row a
    # count and at most sqrt(2 * total) of them).
    enough = _least_count(vocab, head)
    carry = (F.length("word") <= 64) & (F.col("n") >= enough)
    top = vocab.where(carry).toArrow()
    model = Model(list(zip(*(top.column(c).to_pylist() for c in ("word", "n", "cls")))), table, class_tokens, class_words,
                  total, types, free, alpha)
    shared = spark.sparkContext.broadcast(model)

    scored = materialize(rows.withColumn("_row", F.monotonically_increasing_id())
                             .mapInArrow(_score(shared, ends), SCORED), spark, "scored")
    tail = scored.select("_row", F.explode(F.arrays_zip("tail", "spelling", "at", "left", "right")).alias("t")).select(
        "_row", F.col("t.tail").alias("word"), "t.spelling", "t.at", "t.left", "t.right")
    x = F.struct("at", F.coalesce("cls", "spelling").alias("cls"), "left", "right", F.coalesce("n", F.lit(0)).alias("n"))
    rest = (tail.join(vocab.where(~carry), "word", "left").groupBy("_row").agg(F.sort_array(F.collect_list(x)).alias("x"))
                .mapInArrow(_score_rest(model.step, model.class_room),
                            "_row bigint, known bigint, t_base double, t_score double"))
    out = scored.select("_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(rest, "_row", "left")
    score = F.col("score") + F.coalesce("t_score", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("t_base", F.lit(0.0)) - F.col("n_tokens") * model.base_room).alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
        F.lit(int(class_tokens[:free].sum())).cast("long").alias("clustered_tokens"))


def _least_count(vocab: DataFrame, head: int) -> int:
    hist = vocab.groupBy("n").agg(F.count(F.lit(1)).alias("m")).toArrow()
    n, m = hist.column("n").to_numpy(), hist.column("m").to_numpy()
    order = np.argsort(-n)
    upto = np.cumsum(m[order])
    fits = np.flatnonzero(upto <= head)
    return int(n[order][fits[-1]]) if len(fits) else (int(n.max()) + 1 if len(n) else 1)

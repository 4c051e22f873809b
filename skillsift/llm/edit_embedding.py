"""Document fingerprints by randomised edit embedding, bit-sampled, with banding and verification.

Embedding: a text is walked over by a pointer. At step j the character under the pointer is the embedding's
j-th symbol, and a random bit that depends only on j and that character (shared by all texts) says whether the
pointer moves on. Where two texts differ by k edits their walks meet again after a number of steps that
depends on k alone, so edit distance k becomes a Hamming distance of order k^2. A walk over n characters takes 2n
steps; one that has fallen behind moves at every step as soon as it could not reach the end otherwise, so every
character is met. A text is walked in blocks of ``BLOCK`` characters, each with a fresh pointer and the same random bits, all
blocks of a batch side by side; an edit then costs every later block at most two edits, at its two ends.

Fingerprint: ``SLOTS`` samples of the embedding. Slot m looks at one cell of the text (a block's stretch of
``CELL`` characters, walked in 2 * CELL steps) and one step in it, and keeps 4 bits of a hash of the symbol with
the two symbols 2 and 4 steps on. The cell is chosen by jump consistent hashing of m over the number of cells:
when a text grows by some cells only that share of the slots moves. Written as SLOTS hex digits. Likeness of
two fingerprints: the share of equal digits, less the 1/16 that agree by chance, rescaled to 0..1.

``near_groups`` joins alike texts to components: ``bands`` choices of ``band`` digits put the distinct fingerprints
into buckets. First every member of a bucket is verified against its smallest one; in a bucket where some member is
not linked to that, the members not linked to it are compared with each other and, unless the triangle inequality
excludes a link, with those linked to it. This is done in dense blocks of members (``_block_pairs``), whose links go on as
no more rows than members: a bucket of any size gives all its links, a group of close copies costs its members, and
only members not linked to the smallest cost comparisons in pairs. Two fingerprints whose digits agree at a share
s meet with chance about 1 - (1 - s ** band) ** bands: the query's 16 bands of 8 digits give 0.96 at likeness 0.8 and
0.99 at 0.85; 128 bands give 0.95 at 0.6. ``near_links`` returns the verified pairs themselves; there a band shared
by n distinct fingerprints costs n * (n - 1) / 2 comparisons.

Cases: null text = empty text, which has the fingerprint of no symbols; a null doc_id comes last in descending
order and is linked like any other (its component may have an id through others, else null); rows of equal doc_id
follow each other in the order of a text hash, equal rows any way round; equal texts always share a component; a
single document is its own next; an empty table gives no rows; other columns are not read.

Plan: one shuffle deals (doc_id, deflated text) to ranges of doc_id; each range also gets a copy of the first
document of the next one (one row a range), so that every document meets its neighbour inside one task. Grouping
works on (key, number of a distinct fingerprint) rows; every step's links and members are written tables.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty, value_views
from .simhash import components

BLOCK, CELL, SLOTS = 1024, 64, 128
STEPS = 2 * BLOCK
LETTERS = 256                                 # characters are folded to this many walk symbols
PAD = LETTERS                                 # symbol past a block's end
BUCKET, CELLS = 128, 1 << 16                  # members of a bucket's block, about; distances computed at once
OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def _bits() -> np.ndarray:
    """Move bits by (step, symbol); a pointer past the end stays."""
    at = np.arange(STEPS * LETTERS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((STEPS, LETTERS + 1), np.uint8)
    out[:, :LETTERS] = (mix64(at) >> np.uint64(40)).reshape(STEPS, LETTERS) & np.uint64(1)
    return out


MOVES = _bits()
SLOT_STEP = (mix64(np.arange(SLOTS, dtype=np.uint64) + np.uint64(17)) % np.uint64(2 * CELL)).astype(np.int64)
SLOT_SALT = mix64(np.arange(SLOTS, dtype=np.uint64) + np.uint64(101))


def jump_cell(cells: np.ndarray) -> np.ndarray:
    """Jump consistent hashing: (texts, slots) cell numbers below each text's number of cells."""
    key = np.broadcast_to(SLOT_SALT, (len(cells), SLOTS)).copy()
    n = np.broadcast_to(cells[:, None], key.shape)
    b, j = np.zeros(key.shape, np.int64), np.zeros(key.shape, np.int64)
    going = j < n
    while going.any():
        b = np.where(going, j, b)
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        j = np.where(going, ((b + 1) * (2.0 ** 31 / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64),
                     j)
        going = going & (j < n)
    return b


def embed(blocks: np.ndarray) -> np.ndarray:
    """Embedded symbols, (STEPS + 4, blocks), of walk symbols (blocks, BLOCK + 1) whose last column is PAD."""
    n = len(blocks)
    flat = blocks.ravel()
    size = (blocks != PAD).sum(1)
    at = np.arange(n, dtype=np.int64) * (BLOCK + 1)
    end = at + size
    behind = at - size + 1                    # + step: below this the end would be out of reach
    least = int(size.min()) if n else 0
    out = np.full((STEPS + 4, n), PAD, np.uint16)
    for j in range(STEPS):
        c = flat[at]
        out[j] = c
        at += MOVES[j][c]
        if j >= least:
            np.maximum(at, np.minimum(behind + j, end), out=at)
    return out


def fingerprints(texts: list[bytes], batch: int = 4096) -> list[bytes]:
    """SLOTS digit values (bytes 0..15) per UTF-8 text."""
    chars = [np.frombuffer(t.decode("utf-8").encode("utf-32-le"), "<u4") for t in texts]
    size = np.array([len(c) for c in chars], np.int64)
    blocks = np.maximum(1, -(-size // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    cells = np.maximum(1, -(-size // CELL))
    cell = jump_cell(cells)
    row = first[:-1][:, None] + cell // (BLOCK // CELL)
    step = (cell % (BLOCK // CELL)) * 2 * CELL + SLOT_STEP
    # A text shorter than a cell would leave most slots past its end: its steps are folded into its length.
    short = size < CELL
    step[short] = SLOT_STEP % np.maximum(1, 2 * size[short])[:, None]
    table = np.full((int(first[-1]), BLOCK + 1), PAD, np.uint16)
    for k, c in enumerate(chars):
        folded = (c ^ (c >> 8)) % LETTERS
        for i, a in enumerate(range(0, len(c), BLOCK)):
            part = folded[a:a + BLOCK]
            table[first[k] + i, :len(part)] = part
    got = np.empty((3, len(texts), SLOTS), np.uint16)
    for a in range(0, len(table), batch):
        e = embed(table[a:a + batch])
        mine = (row >= a) & (row < a + batch)
        r, s = row[mine] - a, step[mine]
        for k in range(3):
            got[k][mine] = e[s + 2 * k, r]
    x = got.astype(np.uint64)
    h = mix64(((x[0] * np.uint64(521) + x[1]) * np.uint64(521) + x[2]) ^ SLOT_SALT) & np.uint64(15)
    return [r.tobytes() for r in h.astype(np.uint8)]


def spell(fp: bytes) -> str:
    return "".join("0123456789abcdef"[x] for x in fp)


def likeness(a: bytes, b: bytes) -> float:
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def edited(text: bytes, nxt: bytes) -> bytes:
    """The last half of the characters (rounded down) replaced by as many first ones of the next text."""
    a, half = text.decode("utf-8"), len(text.decode("utf-8")) // 2
    return (a[:len(a) - half] + nxt.decode("utf-8")[:half]).encode("utf-8")


def _run(held: list[tuple]) -> pa.RecordBatch:
    """Rows of ``held`` but the last, whose text is only the next of the one before."""
    texts = [zlib.decompress(t) for _, t in held]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    fps = fingerprints(texts + changed)
    own, new = fps[:len(texts)], fps[len(texts):]
    n = len(changed)
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, _ in held[:n]], pa.int64()),
        pa.array([len(t.decode("utf-8")) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
        pa.array([spell(f) for f in own[:n]]), pa.array([spell(f) for f in new]),
        pa.array([likeness(a, b) for a, b in zip(own, new)]),
        pa.array([likeness(a, b) for a, b in zip(own, own[1:])])],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _walk(max_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            ids, plain = b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist()
            halo = b.column("halo").to_pylist()
            for doc_id, n, last, z in zip(ids, plain, halo, value_views(b.column("z"))):
                if last and held and held[-1] is None:
                    continue
                held.append((doc_id, bytes(z)))
                size += n
                if last:                                   # the neighbour across the range's end; nothing follows
                    yield _run(held)
                    held, size = [None], 0
                elif size >= max_chars and len(held) > 1:
                    yield _run(held)
                    held, size = held[-1:], n
        if held and held[-1] is not None:
            raise ValueError("a range without its neighbour")
    return run


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        views = list(value_views(b.column("text")))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("_tie"), pa.array([zlib.compress(v, 6) for v in views], pa.binary()),
             pa.array([len(v) for v in views], pa.int64())], ["doc_id", "_tie", "z", "n_bytes"])


def edit_fingerprints(docs: DataFrame, max_chars: int = 3_000_000) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and how alike they and the next document's are."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
               .withColumn("_tie", F.xxhash64("text"))
    # Order: descending doc_id (null last), then the text hash. Ranges: by quantiles of doc_id, one number a range.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc_id")) \
               .approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")

    def part_of(c: str):
        return F.when(F.col(c).isNull(), F.lit(len(cuts))).otherwise(
            F.size(F.filter(bounds, lambda x: x > F.col(c)))).cast("int")

    def place(doc: str, tie: str):
        """Ascending structs in the documents' order."""
        return F.struct(F.col(doc).isNull().alias("n"), (-F.col(doc)).alias("d"), F.col(tie).alias("t"))

    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("_tie"))
    firsts = (keys.withColumn("part", part_of("doc_id")).groupBy("part").agg(F.min(place("doc_id", "_tie")).alias("f"))
                  .orderBy("part").collect())                                  # one row a range
    if not firsts:
        return rows.limit(0).mapInArrow(lambda b: iter(()), OUT)
    # The first document of each range is also sent to the range before it (that of the first range to the last).
    to = [(firsts[i - 1]["part"], None if r["f"]["n"] else -r["f"]["d"], r["f"]["t"]) for i, r in enumerate(firsts)]
    halo = F.broadcast(spark.createDataFrame(to, "before int, h_id bigint, h_tie bigint"))
    packed = rows.mapInArrow(_deflate, "doc_id bigint, _tie bigint, z binary, n_bytes bigint")
    sent = packed.withColumn("part", part_of("doc_id")).join(
        halo, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("_tie") == F.col("h_tie")), "left")
    dealt = sent.withColumn("x", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(
        F.lit(False).alias("halo"), F.col("part").alias("to")))).otherwise(F.array(
            F.struct(F.lit(False).alias("halo"), F.col("part").alias("to")),
            F.struct(F.lit(True).alias("halo"), F.col("before").alias("to")))))) \
        .select("doc_id", "_tie", "z", "n_bytes", "x.halo", "x.to")
    local = dealt.repartitionById(len(cuts) + 1, F.col("to")).sortWithinPartitions(
        "halo", F.desc_nulls_last("doc_id"), "_tie")
    return local.select("doc_id", "n_bytes", "halo", "z").mapInArrow(_walk(max_chars), OUT)


def band_places(band: int, bands: int, seed: int = 11) -> list[list[int]]:
    """``bands`` lists of ``band`` digit places (from 1): the digits in order, then in random orders, cut up."""
    rng = np.random.default_rng(seed)
    out, order = [], np.arange(SLOTS)
    while len(out) < bands:
        out += [(order[i:i + band] + 1).tolist() for i in range(0, SLOTS - band + 1, band)]
        order = rng.permutation(SLOTS)
    return out[:bands]


def _alike(fps: DataFrame, fp_col: str, band: int, bands: int, least: float) -> DataFrame:
    """Pairs (fa, fb, likeness), fa < fb, of all distinct fingerprints that share a band and are alike."""
    def digits(places):
        return F.array_join(F.transform(places, lambda i: F.substring(F.col("fp"), i, F.lit(1))), "")

    keys = F.transform(F.lit(band_places(band, bands)), digits)
    banded = fps.select(F.col(fp_col).alias("fp")).distinct().select("fp", F.posexplode(keys).alias("band", "key"))
    left, right = banded.withColumnRenamed("fp", "fa"), banded.withColumnRenamed("fp", "fb")
    met = left.join(right, ["band", "key"]).where("fa < fb").select("fa", "fb").distinct()
    same = F.aggregate(F.sequence(F.lit(1), F.lit(SLOTS)), F.lit(0), lambda n, i: n + (
        F.substring(F.col("fa"), i, F.lit(1)) == F.substring(F.col("fb"), i, F.lit(1))).cast("int"))
    like = F.greatest(F.lit(0.0), (same / SLOTS - 1 / 16) / (1 - 1 / 16))
    return met.withColumn("likeness", like).where(F.col("likeness") >= least)


def near_links(fps: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", band: int = 8,
               least: float = 0.6, bands: int = 128) -> DataFrame:
    """Links (a, b, likeness) of texts that share a band of ``band`` digits and are alike by ``least`` or more.

    All pairs of distinct fingerprints; ``a`` and ``b`` are the smallest ids of the two, the smaller first (null
    last)."""
    ids = fps.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("id"))
    pairs = _alike(fps, fp_col, band, bands, least).join(ids.toDF("fa", "ia"), "fa").join(ids.toDF("fb", "ib"), "fb")
    both = F.array_sort(F.array("ia", "ib"))
    return pairs.select(both[0].alias("a"), both[1].alias("b"), "likeness")


def _words(c: str) -> list:
    """A fingerprint's digits as numbers of eight digits each."""
    return [F.conv(F.substring(F.col(c), i, 8), 16, 10).cast("long") for i in range(1, SLOTS, 8)]


def _differ():
    """In how many digits the fingerprints ``fa`` and ``fb`` differ."""
    out = F.lit(0)
    for x, y in zip(_words("fa"), _words("fb")):
        z = x.bitwiseXOR(y)
        for k in (2, 1):                       # a digit's four bits gathered in its lowest
            z = z.bitwiseOR(F.shiftright(z, k))
        out = out + F.bit_count(z.bitwiseAND(F.lit(0x11111111)))
    return out


def most_differing(least: float) -> int:
    """The largest number of differing digits at which two fingerprints are alike by ``least`` (-1: none)."""
    return max((d for d in range(SLOTS + 1)
                if max(0.0, ((SLOTS - d) / SLOTS - 1 / 16) / (1 - 1 / 16)) >= least), default=-1)


def _banded(fps: DataFrame, places: list[list[int]]) -> DataFrame:
    """(key, node) for every choice of digit places."""
    def key(choice, no):
        digits = F.array_join(F.transform(choice, lambda i: F.substring(F.col("fp"), i, F.lit(1))), "")
        return F.xxhash64(no, digits)

    return fps.select("node", F.explode(F.transform(F.lit(places), key)).alias("key"))


def digit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of differing digits, (rows of a, rows of b), of fingerprints as eight 64-bit words each."""
    x = a[:, None, :] ^ b[None, :, :]
    for k in (2, 1):
        x |= x >> np.uint64(k)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(2, dtype=np.int64)


def spanning(near: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Connected parts of a (rows, columns) table of links: its first row, its rows and its columns."""
    left = near.any(1)
    while left.any():
        first = int(left.argmax())
        rows = np.zeros(len(near), bool)
        rows[first] = True
        while True:
            cols = near[rows].any(0)
            more = near[:, cols].any(1)
            if (more == rows).all():
                break
            rows = more
        yield first, np.flatnonzero(rows), np.flatnonzero(cols)
        left &= ~rows


def _compare(most: int):
    """Links (a, b) that connect what pairs of a left and a right block connect, no more than their members."""
    def words(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.uint64).reshape(-1, SLOTS // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            cols = [batch.column(c) for c in ("head", "kin", "nodes", "bits", "other_nodes", "other_bits")]
            for i in range(batch.num_rows):
                head, kin, nodes, bits, others, other_bits = (c[i].as_py() for c in cols)
                a, b = words(b"".join(bits)), words(b"".join(other_bits))
                step = max(1, CELLS // len(b))
                near = np.concatenate([digit_distances(a[k:k + step], b) <= most for k in range(0, len(a), step)])
                if kin:                        # these are linked to the bucket's smallest already
                    for r in np.flatnonzero(near.any(1)):
                        left.append(head)
                        right.append(nodes[r])
                    continue
                for first, rows, found in spanning(near):
                    for other in [nodes[r] for r in rows] + [others[c] for c in found]:
                        if other != nodes[first]:
                            left.append(nodes[first])
                            right.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
    return run


def _block_pairs(flagged: DataFrame, live: DataFrame, most: int, block: int) -> DataFrame:
    """Pairs of blocks of a bucket's members whose links are not settled by its smallest.

    A member is kin if it is linked to the smallest, middling if it may be linked to kin, and far if by the triangle
    inequality it cannot be. Kin are connected already, so only middling members meet kin and far ones, and
    both meet their own. Each kind is dealt by a hash to blocks: of about ``block`` in small buckets, growing with the
    root of n to 16 times that, so that the number of pairs of blocks grows with n up to some 2000 * block members. A
    bucket of many blocks is dealt to several tasks, to each of which its right blocks are copied."""
    spark = flagged.sparkSession
    kind = F.when(F.col("d") <= most, 0).when(F.col("d") <= 2 * most, 1).otherwise(2)
    kinds = flagged.withColumn("kind", kind)
    number = [F.count(F.when(F.col("kind") == k, True)).alias(f"n{k}") for k in range(3)]
    # The smallest itself is kin; two members have been compared.
    unsettled = materialize(kinds.groupBy("key").agg(*number).where("n1 + n2 > 0 and n0 + n1 + n2 > 2"), spark, "open-buckets")
    size = F.when(F.col("kind") == 0, F.col("n0")).when(F.col("kind") == 1, F.col("n1")).otherwise(F.col("n2"))
    n = F.col("n0") + F.col("n1") + F.col("n2")
    fill = F.greatest(F.lit(float(block)), F.least(F.lit(16.0 * block), F.sqrt(n * block / 8)))
    blocks = (kinds.join(unsettled, "key").join(live.select("node", "bits"), "node")
              .withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(size / fill)))
              .withColumn("deals", F.least(F.lit(64), F.ceil(n / fill / 16)))
              .groupBy("key", "head", "kind", "block", "deals").agg(F.collect_list(F.struct("node", "bits")).alias("m"))
              .select("key", "head", "kind", "block", "deals", F.col("m.node").alias("nodes"), F.col("m.bits").alias("bits")))
    blocks = materialize(blocks, spark, "blocks")
    left = blocks.where("kind > 0").withColumn("deal", F.pmod("block", "deals")).drop("deals")
    right = blocks.select("key", F.col("kind").alias("other_kind"), F.col("block").alias("other_block"),
                          F.col("nodes").alias("other_nodes"), F.col("bits").alias("other_bits"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    meet = ((F.col("kind") == F.col("other_kind")) & (F.col("block") <= F.col("other_block"))) | (
        (F.col("kind") == 1) & (F.col("other_kind") != 1))
    return left.join(right, ["key", "deal"]).where(meet).select(
        "head", (F.col("other_kind") == 0).alias("kin"), "nodes", "bits", "other_nodes", "other_bits")


def near_groups(fps: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", band: int = 8,
                least: float = 0.6, bands: int = 128, bucket: int = BUCKET, singles: bool = True) -> DataFrame:
    """One row (fingerprint, component_id) per distinct fingerprint: the smallest id reachable over links.

    Without ``singles`` only fingerprints that have a link or come in several rows: any other's component is its id."""
    spark = fps.sparkSession
    most = most_differing(least)
    # Numbered once, in a written table: a doc_id may repeat with different texts and cannot stand for a fingerprint.
    nodes = materialize(fps.groupBy(F.unhex(fp_col).alias("bits")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("rows"))
                           .withColumn("node", F.monotonically_increasing_id()), spark, "distinct-fingerprints")
    # One shuffle by key serves both the buckets' sizes and their members.
    banded = _banded(nodes.select("node", F.lower(F.hex("bits")).alias("fp")), band_places(band, bands)).repartition("key")
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1")
    shared = materialize(banded.join(sizes, "key").select("key", "node", "head"), spark, "buckets")
    live = materialize(nodes.join(shared.select("node").distinct(), "node", "left_semi"), spark, "bucket-fingerprints")
    pairs = materialize(shared.where("node != head").select("head", "node").distinct(), spark, "star-pairs")
    own = live.select("node", F.hex("bits").alias("fb"))
    stars = materialize(pairs.join(own, "node").join(own.toDF("head", "fa"), "head")
                             .select("head", "node", _differ().alias("d")), spark, "star-distances")
    flagged = shared.join(stars, ["head", "node"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    cross = _block_pairs(materialize(flagged, spark, "flagged"), live, most, bucket).mapInArrow(_compare(most), "a bigint, b bigint")
    edges = stars.where(F.col("d") <= most).select(F.col("head").alias("a"), F.col("node").alias("b")).unionByName(cross)
    roots = components(edges).toDF("node", "root")
    linked = live.join(roots, "node")
    first = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = materialize(linked.join(first, "root").select("node", "bits", "component_id"), spark, "linked")
    others = (nodes if singles else nodes.where("rows > 1")).join(linked.select("node"), "node", "left_anti")
    every = linked.select("bits", "component_id").unionByName(others.select("bits", F.col("id").alias("component_id")))
    return every.select(F.lower(F.hex("bits")).alias(fp_col), "component_id")


def grouped_fingerprints(docs: DataFrame, least: float = 0.8, band: int = 8, bands: int = 16,
                         max_chars: int = 3_000_000) -> DataFrame:
    """``edit_fingerprints`` with component_id: the smallest doc_id reachable over texts alike by ``least`` or more."""
    def recoded(df: DataFrame, code) -> DataFrame:
        hexed = ("edited_sha256", "fingerprint", "edited_fingerprint")
        return df.select(*[code(c).alias(c) if c in hexed else c for c in df.columns])

    def spelt(c: str):
        return F.lower(F.hex(c))

    # Digits are kept and shuffled as bytes, half their text.
    fps = materialize(recoded(edit_fingerprints(docs, max_chars), F.unhex), docs.sparkSession, "edit-fingerprints")
    groups = near_groups(recoded(fps.select("doc_id", "fingerprint"), spelt), band=band, least=least, bands=bands,
                         singles=False)
    given = groups.select(F.unhex("fingerprint").alias("fingerprint"), F.struct("component_id").alias("group"))
    return recoded(fps.join(given, "fingerprint", "left").select(
        *fps.columns, F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("group.component_id"))
                       .alias("component_id")), spelt)

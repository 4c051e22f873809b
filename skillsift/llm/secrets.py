"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds are reported wherever they match (leftmost, not overlapping within a kind): ``assign`` (a password,
secret, token or api key given a value of 6+ characters), ``access`` (an AKIA identifier of 20+ characters)
and ``hex`` (a run of 24+ lower-case hex digits). Weak kinds mean nothing alone: ``key_id`` (a user, account,
client or access-key id given a value), ``opaque`` (a 32+ character run with both cases and digits) and
``endpoint`` (a service address). A weak span is reported only if complementary parts lie within ``scope`` code
points of it: a key_id needs a secret (assign, hex or opaque), an opaque needs an identifier (access or
key_id), an endpoint needs both a secret and an identifier. With ``gaps``, as in the registered query and the
pipeline, the distance is what lies between two spans, so long parts and long lines of a credentials block do not
count, and complementary parts are different places of the text: a partner never overlaps the span, nor an
endpoint's two partners each other. Without ``gaps`` the distance is that of the starts, overlapping or not. 200 code
points between two spans are two or three lines of other settings; parts further apart are left unlinked.

Linking is an interval join on positions. With ``gaps`` a weak span looks back over the parts that end at most
``scope`` before its start and ahead over those that start at most ``scope`` after its end: two running range
windows over each text's positions, cut into cells of ``CELL`` scopes (a part near a cell's border enters both), so a
task's window is as long as a cell however long the text. Smallest ends and largest starts per role decide
exactly whether a secret and an identifier are there that do not overlap. Without ``gaps``, bins of ``scope`` code
points with the smallest and largest start per role serve.

Spans are [start, end) in code points, written kind:start:end, by start and then in the order of KINDS.

Cases: null text = empty text; a null or repeated doc_id keeps its row (rows are told apart by a row key, not by
doc_id); a text without spans gives empty lists; an empty table gives no rows; other columns are not read by
``find_secrets`` and returned unchanged by ``redact``. Whole texts are searched, whatever their length.

Plan: one pass over the texts writes the lengths of matches and of the gaps between them (numbers only, no
secret leaves the text); all later work is on those narrow rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

# Fixed values of the base kinds.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
ASSIGN_MIN, ACCESS_MIN = 6, 20

KEY_ID = ("(?i)(?<![a-z0-9])(?:access_?key_?id|client_?id|account_?id|user_?id|user_?name|user|login)"
          "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{3,}")
# A run after "=" starts a new value: KEY=value, ?key=value.
OPAQUE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = ("(?i)(?:https?|ftp|ssh|amqps?|rediss?|mysql|postgres(?:ql)?|mongodb(?:\\+srv)?|jdbc:[a-z]+)"
            "://[^\\s\"'<>|,;]+")

KINDS = ("assign", "access", "hex", "key_id", "opaque", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, KEY_ID, OPAQUE, ENDPOINT)))
BASE = KINDS[:3]
SECRET, IDENTIFIER = ("assign", "hex", "opaque"), ("access", "key_id")
CELL = 64                                    # scopes in a cell of the linking windows

# What a text must hold, lower-cased, for a pattern to match at all; the pattern passes over no other text.
NEEDS = {"assign": ("pass", "secret", "token", "api"), "access": ("akia",),
         "key_id": ("id", "user", "login"), "endpoint": ("://",)}


def _valid(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, f"^{ASSIGN}$", 2)) >= ASSIGN_MIN
    if kind == "access":
        return F.length(match) >= ACCESS_MIN
    if kind == "opaque":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def scan(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and per kind array<struct<gap, len, ok>> of ``text``; written once.

    gap: code points since the match before; len, ok: length and validity of the match. Matches and gaps are
    columns of their own first: a pattern passes once over a text that may hold it, and again for the gaps of one
    that does."""
    text, none = F.col("text"), F.array().cast("array<string>")
    low = rows.select(*keys, "text", F.lower(text).alias("low"))

    def possible(kind: str) -> Column:
        held = [F.contains("low", F.lit(x)) for x in NEEDS.get(kind, ())]
        return reduce(Column.__or__, held) if held else F.lit(True)

    found = low.select(*keys, "text", *[
        F.when(possible(k), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}_found")
        for k, p in PATTERNS.items()])
    cut = found.select(*keys, *[f"{k}_found" for k in KINDS], *[
        F.when(F.size(f"{k}_found") > 0, F.split(text, p, -1)).otherwise(none).alias(f"{k}_gaps")
        for k, p in PATTERNS.items()])

    def parts(kind: str) -> Column:
        found = F.col(f"{kind}_found")
        return F.zip_with(F.slice(f"{kind}_gaps", F.lit(1), F.size(found)), found, lambda g, m: F.struct(
            F.length(g).alias("gap"), F.length(m).alias("len"), _valid(kind, m).alias("ok")))
    return materialize(cut.select(*keys, *[parts(k).alias(k) for k in KINDS]), rows.sparkSession, "secret-parts")


def part_rows(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, start, end of all valid matches: starts are running sums of gaps and matches."""
    def numbered(kind: int):
        return lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"),
                                     m["len"].alias("len"), m["ok"].alias("ok"))

    parts = F.flatten(F.array(*[F.transform(k, numbered(n)) for n, k in enumerate(KINDS)]))
    rows = scanned.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    upto = Window.partitionBy(*keys, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto))
    return ended.where("ok").select(*keys, "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _role(kinds: tuple[str, ...]) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def link(parts: DataFrame, keys: list[str], scope: int, gaps: bool = False) -> DataFrame:
    """Base spans, and weak spans with complementary parts in reach: keys, kind, start, end.

    Reach: starts at most ``scope`` apart or, with ``gaps``, at most ``scope`` code points between spans that do not
    overlap."""
    return link_apart(parts, keys, scope) if gaps else link_starts(parts, keys, scope)


def link_apart(parts: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """``link`` by what lies between the spans; partners do not overlap."""
    cell = CELL * scope
    start, end = F.col("start"), F.col("end")
    weak, partner = F.col("kind") >= len(BASE), F.col("kind") != KINDS.index("endpoint")

    def side(before: bool) -> DataFrame:
        """Weak spans with what lies in reach on one side: has a secret, an identifier, two that do not overlap."""
        at, own = (end, start) if before else (start, end)
        reach = (at, at + scope) if before else (at - scope, at)
        seen = parts.where(partner).select(*keys, "kind", "start", "end", at.alias("pos"), F.lit(False).alias("asks"),
                                           F.explode(F.sequence(*[F.floor(x / cell) for x in reach])).alias("cell"))
        asked = parts.where(weak).select(*keys, "kind", "start", "end", own.alias("pos"), F.lit(True).alias("asks"),
                                         F.floor(own / cell).alias("cell"))
        frame = Window.partitionBy(*keys, "cell").orderBy("pos").rangeBetween(*((-scope, 0) if before else (0, scope)))

        def over(pick, role, value):
            return pick(F.when(~F.col("asks") & _role(role), value)).over(frame)

        rows = asked.unionByName(seen).select(
            *keys, "kind", "start", "end", "asks", over(F.min, SECRET, end).alias("s_end"),
            over(F.max, SECRET, start).alias("s_start"), over(F.min, IDENTIFIER, end).alias("i_end"),
            over(F.max, IDENTIFIER, start).alias("i_start")).where("asks")
        apart = F.coalesce((F.col("s_end") <= F.col("i_start")) | (F.col("i_end") <= F.col("s_start")), F.lit(False))
        return rows.select(*keys, "kind", "start", "end", F.lit(before).alias("before"),
                           F.col("s_end").isNotNull().alias("s"), F.col("i_end").isNotNull().alias("i"), apart.alias("both"))

    def any_of(c: str, before: bool) -> Column:
        return F.max(F.col(c) & (F.col("before") == before))

    span = [*keys, "kind", "start", "end"]
    near = side(True).unionByName(side(False)).groupBy(*span).agg(
        F.max("s").alias("s"), F.max("i").alias("i"),
        (F.max("both") | (any_of("s", True) & any_of("i", False)) | (any_of("i", True) & any_of("s", False))).alias("both"))
    linked = near.where(F.when(F.col("kind") == KINDS.index("key_id"), F.col("s"))
                         .when(F.col("kind") == KINDS.index("opaque"), F.col("i")).otherwise(F.col("both")))
    return parts.where(~weak).unionByName(linked.select(*span))


def link_starts(parts: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """``link`` by the distance of starts, whether spans overlap or not."""
    def bins(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope))).alias("bin")

    start = F.col("start")
    ends = parts.where(F.col("kind") != KINDS.index("endpoint")).select("*", bins(start, start)) \
                .groupBy(*keys, "bin").agg(*[
                    f(F.when(_role(r), start)).alias(f"{n}_{m}") for n, r in (("s", SECRET), ("i", IDENTIFIER))
                    for m, f in (("min", F.min), ("max", F.max))])
    weak = parts.where(F.col("kind") >= len(BASE)).select("*", bins(start - scope, start + scope))

    def reach(n: str) -> Column:
        return F.max((F.col(f"{n}_min") <= start + scope) & (F.col(f"{n}_max") >= start - scope))

    span = [*keys, "kind", "start", "end"]
    near = weak.join(ends, [*keys, "bin"]).groupBy(*span).agg(reach("s").alias("s"), reach("i").alias("i"))
    has_s, has_i = F.coalesce("s", F.lit(False)), F.coalesce("i", F.lit(False))
    linked = near.where(F.when(F.col("kind") == KINDS.index("key_id"), has_s)
                         .when(F.col("kind") == KINDS.index("opaque"), has_i).otherwise(has_s & has_i))
    return parts.where(F.col("kind") < len(BASE)).unionByName(linked.select(*span))


def spelled(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = 200, gaps: bool = False) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text_or_empty().alias("text"))
    scanned = scan(rows, ["_row", "doc_id"])
    parts = part_rows(scanned, ["_row"])
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    per_row = link(parts, ["_row"], scope, gaps).groupBy("_row").agg(spans.alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    every = scanned.select("_row", "doc_id").join(per_row, "_row", "left") \
                   .withColumn("found", F.coalesce("found", none))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return every.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_linked"))


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]", gaps: bool = False) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark`` (overlapping spans by one).

    ``n_chars``, where the table has it, follows the new text; texts without spans stay as they are."""
    key = ["_id", "_hash"]
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) \
                .withColumn("_hash", F.md5(text_or_empty()))
    found = keyed.select(*key, text_or_empty().alias("text")).where(
        reduce(Column.__or__, [F.col("text").rlike(PATTERNS[k]) for k in KINDS]))
    parts = part_rows(scan(found, key).dropDuplicates(key), key)
    spans = link(parts, key, scope, gaps)
    order = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isle = spans.withColumn("new", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int")) \
                .withColumn("isle", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = isle.groupBy(*key, "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    joined = keyed.join(cuts, key, "left")
    n = F.size("_cuts")
    # Kept pieces: from the end of one cut (the text's start) to the start of the next (the text's end).
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        F.col("text"), F.when(i == 0, 1).otherwise(F.get("_cuts", i - 1)["end"] + 1).cast("int"),
        (F.when(i == n, F.length("text")).otherwise(F.get("_cuts", i)["start"])
         - F.when(i == 0, 0).otherwise(F.get("_cuts", i - 1)["end"])).cast("int")))
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, mark))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)

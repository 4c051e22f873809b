"""The corpus operators over the given tables, with production parameters: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOKENIZER, id_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op1_no_random_access_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors, by integer inner product, of every vector whose id 100 divides."""
    from .topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back in chunks: length, digest and kind of every record."""
    from .warc import read_chunks, records, write_warc
    return records(read_chunks(write_warc(table(spark, sf_dir, "pages")), with_data=False))


def op3_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based bigram scores of every document, learned from four fifths of them."""
    from .class_lm import score_documents
    return score_documents(table(spark, sf_dir, "documents"), id_remainder() == 1)


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document in wavelet matrix shards, read back from the files."""
    from .token_files import read_shards, write_shards
    return read_shards(write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base kinds, and weak candidates whose complementary parts are near."""
    from .secrets import find_secrets
    return find_secrets(table(spark, sf_dir, "documents"), gaps=True)


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of every document."""
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-embedding fingerprints of every document and of its edited text, and its group of near copies."""
    from .edit_embedding import grouped_fingerprints
    return grouped_fingerprints(table(spark, sf_dir, "documents"))


def op8_fair_queueing_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the weighted mixture takes."""
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 ids."""
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from preference pairs of four fifths of the labels."""
    from .quality import learn, score_quality
    docs = table(spark, sf_dir, "documents")
    ranker = learn(docs, table(spark, sf_dir, "labels"), id_remainder() != 0)
    return score_quality(docs, ranker, id_remainder() == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, keeps and hides, per source, in all 120 orders."""
    from .filter_audit import audit
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in as few sequences of at most 4096 ids as the plan finds."""
    from .complement_packing import pack_whole
    return pack_whole(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and the forms they are variants of."""
    from .spelling import variant_groups
    return variant_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_no_random_access_topk, op2_chunked_warc, op3_class_ngrams, op4_wavelet_tokens, op5_multipart_secrets,
    op6_covering_simhash, op7_edit_embedding, op8_fair_queueing_mix, op9_order_preserving_packing,
    op10_pairwise_quality, op11_filter_audit, op12_exact_complement_packing, op13_spelling_variants)}

# DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op1_no_random_access_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT a.r AS query_row, a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q)
            WHERE a.vec_id % 100 = 0),
        r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER)
                   AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op2_chunked_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, upper(sha1(html)) AS h FROM p),
        b AS (
            SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda i:
                     list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + ((CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31), 1)),
                       'string_agg', '')), 'string_agg', '') AS payload_digest
            FROM d),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM b)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM f""",
    "op8_fair_queueing_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('mix-1-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight,
                     3 * source_size AS lim FROM s),
        o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0) AS rest,
                     sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight
              FROM w WINDOW b AS (ORDER BY lim / weight, source ASC NULLS LAST
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, lim * rest_weight <= rest * weight AS capped FROM o),
        t AS (SELECT source, source_size,
                     CASE WHEN capped THEN CAST(lim AS DOUBLE)
                          ELSE CAST(weight * max(CASE WHEN NOT capped THEN rest END) OVER () AS DOUBLE)
                               / CAST(max(CASE WHEN NOT capped THEN rest_weight END) OVER () AS DOUBLE) END AS target
              FROM c),
        q AS (SELECT d.doc_id, d.size, d.h, t.source_size, t.target,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS served
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT q.*, e, CAST((e - 1) * source_size + served AS DOUBLE) / target AS finish
              FROM q, range(1, 4) r(e) WHERE size > 0),
        r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, h, doc_id, e ROWS UNBOUNDED PRECEDING) AS total
              FROM e),
        k AS (SELECT doc_id, count(*) AS copies FROM r WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.copies, 0) * q.size AS BIGINT) AS taken
        FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id""",
    "op11_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        f AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                     max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS (
            SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                   CASE WHEN len(d.w) < 50 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(d.w)) < 65 * len(d.w) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g')))
                               > 5 * length(d.text) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN d.doc_id > f.first_id THEN 16 ELSE 0 END AS mask
            FROM d JOIN f ON d.text = f.text LEFT JOIN l ON d.doc_id = l.doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        s AS (SELECT p.part, r.s, coalesce(sum(c.n), 0) AS n, coalesce(sum(c.good), 0) AS good,
                     coalesce(sum(c.toxic), 0) AS toxic
              FROM (SELECT DISTINCT part FROM c) p CROSS JOIN range(0, 32) r(s)
              LEFT JOIN c ON c.part = p.part AND (c.mask & r.s) = 0 GROUP BY p.part, r.s),
        b AS (SELECT * FROM (VALUES ('A', 1, 0), ('B', 2, 1), ('C', 4, 2), ('D', 8, 3), ('E', 16, 4)) v(letter, bit, i)),
        o AS (SELECT b1.letter || b2.letter || b3.letter || b4.letter || b5.letter AS filter_order
              FROM b b1, b b2, b b3, b b4, b b5
              WHERE b1.bit | b2.bit | b3.bit | b4.bit | b5.bit = 31),
        t AS (SELECT o.filter_order, k.step, b.bit,
                     (SELECT coalesce(sum(x.bit), 0) FROM b x
                      WHERE strpos(o.filter_order, x.letter) < k.step) AS before
              FROM o, range(1, 6) k(step), b WHERE b.letter = substr(o.filter_order, k.step, 1)),
        g AS (SELECT c.part, b.bit, coalesce(sum(CASE WHEN c.mask & b.bit <> 0 THEN c.n END), 0) AS failing,
                     coalesce(sum(CASE WHEN c.mask = b.bit THEN c.n END), 0) AS alone
              FROM c, b GROUP BY c.part, b.bit),
        r AS (SELECT u.part, t.filter_order, t.step, t.bit, v.n AS kept, u.n - v.n AS removed,
                     u.good - v.good AS good_lost, u.toxic - v.toxic AS toxic_lost
              FROM t JOIN s u ON u.s = t.before JOIN s v ON v.s = t.before + t.bit AND v.part = u.part)
        SELECT r.part, r.filter_order, CAST(r.step AS INTEGER) AS step, CAST(r.kept AS BIGINT) AS kept,
               CAST(r.removed AS BIGINT) AS removed, CAST(g.failing - r.removed AS BIGINT) AS redundant,
               CAST(g.alone AS BIGINT) AS unique_fails, CAST(r.good_lost AS BIGINT) AS good_lost,
               CAST(r.toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(r.removed) OVER (PARTITION BY r.part, r.bit) AS BIGINT) AS shapley
        FROM r JOIN g ON g.part = r.part AND g.bit = r.bit""",
}

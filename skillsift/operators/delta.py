"""De-duplication, null filtering, incremental (delta) selection and batch metrics.

F1 ``drop_null_keys``  rows whose key is NULL go
A1 ``row_count``       (DataFrame.count)
A2 ``distinct_keys``   number of distinct non-null keys
A3 ``dedupe``          one row per key; deterministic when an order is given
J1/J2 ``delta_rows``   batch rows whose key is not yet in the base table
J3 ``with_description`` attach one cleaned description by uuid
F6 ``has_rows``        is there anything at all (stops at the first row)
M9 ``batch_metrics``   rows in / unique keys / null keys / delta keys in one pass
A8 ``text_bytes``      bytes per column and in total
A9 ``reported_total``  total rows a source reports (max over its pages)
A2 ``key_sketches`` / ``estimated_keys``  distinct keys from mergeable sketches kept per load date, without a rescan
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_html
from ..session import checked_broadcast


def drop_null_keys(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """drop rows with a NULL in any key column (the text 'nan' is a value and stays)."""
    return df.dropna(subset=[keys] if isinstance(keys, str) else list(keys))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """A1 + A2 in one aggregate: ``(rows_in, unique_keys)``."""
    return df.agg(F.count(F.lit(1)).alias("rows_in"), F.countDistinct(key).alias("unique_keys"))


def dedupe(df: DataFrame, key: str | list[str], order_by: list[Column] | None = None) -> DataFrame:
    """A3: one row per key.

    Without ``order_by`` any row of the key survives (``dropDuplicates``, map-side
    partial de-duplication). With ``order_by`` the first row in that order wins;
    ``row_number() = 1`` is planned with a partial WindowGroupLimit, so a key
    holding a third of all rows sends one row per task through the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not order_by:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def delta_rows(batch: DataFrame, base: DataFrame, left_key: str, right_key: str | None = None,
               batch_broadcast_rows: int | None = None) -> DataFrame:
    """Rows of ``batch`` whose key does not occur in ``base``.

    Only the key column of ``base`` is read (column pruning reaches the scan).
    NULL keys never match, so they stay unless filtered before (F1).

    With ``batch_broadcast_rows``, a batch whose distinct keys are proven to be
    at most that many (the usual daily delta against a large gold table) is
    handled without shuffling ``base``: the batch keys are broadcast and
    ``base``'s key column is semi-joined against them in place; the batch is
    then anti-joined with that small set of known keys.
    """
    rk = right_key or left_key
    b = base.select(F.col(rk).alias("_bk")).where(F.col("_bk").isNotNull())
    if batch_broadcast_rows is not None:
        keys = batch.select(F.col(left_key).alias("_bk")).where(F.col("_bk").isNotNull()).distinct()
        kb, small = checked_broadcast(keys, batch_broadcast_rows)
        if small:
            known = b.join(kb, "_bk", "left_semi").distinct()
            kn, _ = checked_broadcast(known, batch_broadcast_rows, batch_broadcast_rows)
            return batch.join(kn, F.col(left_key) == F.col("_bk"), "left_anti")
    return batch.join(b.distinct(), F.col(left_key) == F.col("_bk"), "left_anti")


def has_rows(df: DataFrame) -> bool:
    """True when ``df`` has at least one row (runs until the first row only)."""
    return not df.isEmpty()


def batch_metrics(batch: DataFrame, base: DataFrame, key: str, base_key: str | None = None) -> DataFrame:
    """M9: ``(rows_in, unique_keys, null_keys, delta_keys)`` in one job.

    The batch is first folded to one row per key with partial aggregation
    (a hot key costs one row per task), then flagged against the distinct base
    keys, then summed -- no repeated actions over the batch.
    """
    per_key = batch.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    bk = base.select(F.col(base_key or key).alias("_k")).where(F.col("_k").isNotNull()) \
             .distinct().withColumn("_known", F.lit(True))
    j = per_key.join(bk, "_k", "left")
    return j.agg(
        F.sum("_n").cast("bigint").alias("rows_in"),
        F.count("_k").alias("unique_keys"),
        F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0)).cast("bigint").alias("null_keys"),
        F.count(F.when(F.col("_k").isNotNull() & F.col("_known").isNull(), F.lit(1))).alias("delta_keys"),
    )


def with_description(jobs: DataFrame, details: DataFrame, uuid_col: str = "job_uuid",
                     out_col: str = "job_description", broadcast_rows: int = 2_000_000) -> DataFrame:
    """J3 + X1: left join landed ``(uuid, description html)``, one description per uuid, cleaned natively.

    Only the details of ``jobs`` are cleaned: their uuids (broadcast when proven few) semi-join the
    landed details first. Of several details of one uuid the smallest text in string order counts
    (NULL last), so repeated landings never multiply a job.
    """
    wanted = jobs.select(F.col(uuid_col).alias("uuid")).where(F.col("uuid").isNotNull()).distinct()
    wanted, _ = checked_broadcast(wanted, broadcast_rows)
    own = details.select("uuid", "description").join(wanted, "uuid", "left_semi")
    one = dedupe(own, "uuid", [F.asc_nulls_last("description")])
    d = one.select(F.col("uuid").alias(uuid_col), clean_html("description").alias(out_col))
    # The texts lie by uuid already; sent to every task (their compressed files look small) they would be cleaned by few.
    return jobs.join(d.hint("merge"), uuid_col, "left")


def text_bytes(df: DataFrame) -> DataFrame:
    """One row: bytes of every column as text (``<column>_bytes``), their ``total_bytes`` and ``rows``.

    NULL counts 0 bytes; sums fold map-side."""
    sizes = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`").cast("string"))), F.lit(0)).cast("bigint")
             for c in df.columns]
    total = sizes[0] if sizes else F.lit(0).cast("bigint")
    for x in sizes[1:]:
        total = total + x
    return df.agg(*[x.alias(f"{c}_bytes") for c, x in zip(df.columns, sizes)],
                  total.alias("total_bytes"), F.count(F.lit(1)).alias("rows"))


# 2 ** 14 registers: a standard error of 0.8 % whatever the count.
SKETCH_LG_K = 14


def key_sketches(df: DataFrame, key: str, by: list[str], lg_k: int = SKETCH_LG_K) -> DataFrame:
    """A2, approximate: ``(*by, rows, sketch)``, a HyperLogLog sketch of the distinct non-null keys per group.

    Sketches fold map-side and merge: kept beside the rows, they answer for any set of groups later."""
    text = F.col(key).cast("string")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(text, F.lit(lg_k)).alias("sketch"))


def estimated_keys(sketches: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """``(*by, rows, keys)`` from written sketches: unions of a few KB each, the rows are not read again."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"),
                                     F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("keys"))


def reported_total(pages: DataFrame, group_cols: list[str] | tuple = (),
                   total_col: str = "countWithoutFilters") -> DataFrame:
    """The total a source reports, as the max over its landed pages."""
    return pages.groupBy(*group_cols).agg(F.max(total_col).alias("reported_total"))

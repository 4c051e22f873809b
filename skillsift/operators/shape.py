"""Column shaping and unions.

P1 ``flatten_jobs``     nested job posting -> the 12 bronze columns
P2 ``first_of``         field of the first array element, NULL when empty
P3 ``pluck``            one field of every array element
P4 ``flatten_struct``   nested structs -> dotted top-level columns
P5 ``select_existing``  whitelist of columns that exist (strict: missing -> NULL)
P8 ``with_load_date``   constant load-date column
P9 ``skills_text``      array -> text (plain or bracketed)
P10 ``cast_all_string`` every column as string, NULL kept
P12 ``combined_description``  null-skipping space join
P13 ``course_concat``   four texts without separator, NULL as ""
P16 ``preview``         first n rows in a given order
U1/U2 ``union_pages``   union by name, missing columns -> NULL
U3 ``merge_lists``      union of two string lists, distinct
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The bronze columns, in table order.
BRONZE_JOB_COLUMNS = ["job_id", "title", "company_name", "uen", "employment_type", "level", "category",
                      "salary_min", "salary_max", "salary_type", "skills", "job_uuid"]


def first_of(arr: str | Column, field: str) -> Column:
    """``arr[0].field``; NULL for an empty or NULL array (never raises)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.get(a, 0)[field]


def pluck(arr: str | Column, field: str) -> Column:
    """``[x.field for x in arr]``."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.transform(a, lambda x: x[field])


def flatten_jobs(postings: DataFrame) -> DataFrame:
    """One posting struct per row (``results`` element, column ``r``) -> bronze columns."""
    r = "r"
    return postings.select(
        F.col(f"{r}.metadata.jobPostId").alias("job_id"),
        F.col(f"{r}.title").alias("title"),
        F.col(f"{r}.postedCompany.name").alias("company_name"),
        F.col(f"{r}.postedCompany.uen").alias("uen"),
        first_of(f"{r}.employmentTypes", "employmentType").alias("employment_type"),
        first_of(f"{r}.positionLevels", "position").alias("level"),
        first_of(f"{r}.categories", "category").alias("category"),
        F.col(f"{r}.salary.minimum").alias("salary_min"),
        F.col(f"{r}.salary.maximum").alias("salary_max"),
        F.col(f"{r}.salary.type.salaryType").alias("salary_type"),
        pluck(f"{r}.skills", "skill").alias("skills"),
        F.col(f"{r}.uuid").alias("job_uuid"),
    )


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields become top-level columns named by their path; arrays stay whole."""
    cols: list[Column] = []

    def walk(prefix: list[str], dtype):
        for f in dtype.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, StructType):
                walk(path, f.dataType)
            else:
                ref = F.col(".".join(f"`{p}`" for p in path))
                cols.append(ref.alias(sep.join(path)))

    walk([], df.schema)
    return df.select(*cols)


def select_existing(df: DataFrame, cols: list[str], strict: bool = False) -> DataFrame:
    """P5: keep the whitelisted columns that exist, in whitelist order.

    ``strict`` keeps every whitelisted name and fills missing ones with NULL
    (string), so all batches share one schema."""
    have = set(df.columns)
    if strict:
        return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in cols])
    return df.select(*[F.col(f"`{c}`") for c in cols if c in have])


def with_load_date(df: DataFrame, load_date: str | Column) -> DataFrame:
    """Add ``load_date`` (text yyyyMMdd, or any column expression)."""
    v = load_date if isinstance(load_date, Column) else F.lit(load_date)
    return df.withColumn("load_date", v)


def skills_text(arr: str | Column, bracketed: bool = False, sep: str = ",") -> Column:
    """Array -> text. Plain: joined by ``sep``. Bracketed: Spark's array cast, ``[a, b]``."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return a.cast("string") if bracketed else F.concat_ws(sep, a)


def cast_all_string(df: DataFrame) -> DataFrame:
    """P10: every column cast to string; NULL stays NULL (not the text 'nan')."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def combined_description(*cols: str | Column) -> Column:
    """Space-joined texts, NULLs skipped."""
    return F.concat_ws(" ", *cols)


def course_concat(*cols: str | Column) -> Column:
    """Texts concatenated without separator, NULL read as ""."""
    return F.concat(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def preview(df: DataFrame, n: int = 5, order: list[Column] | None = None) -> DataFrame:
    """First ``n`` rows (in ``order`` when given: a top-n, not a full sort)."""
    return (df.orderBy(*order) if order else df).limit(n)


def union_pages(dfs: list[DataFrame]) -> DataFrame:
    """Union by column name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def merge_lists(a: str | Column, b: str | Column, sort: bool = True) -> Column:
    """Distinct union of two string arrays (sorted for a stable text)."""
    u = F.array_union(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
    return F.array_sort(u) if sort else u

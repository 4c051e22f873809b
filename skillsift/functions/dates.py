"""Date scalars: load-date text, display stamps, rolling cutoffs, page arithmetic.

X8  ``load_date_text`` / ``stamp_text`` / ``feedback_time_text``
X9  ``as_of_date`` / ``as_of_timestamp`` (current date/time unless pinned)
X10 ``days_before``
X11 ``pages_needed``
F2  ``effective_since``
    ``any_date`` dates written in one of several ways
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed text formats (Spark datetime patterns).
LOAD_DATE_FORMAT = "yyyyMMdd"               # partition value, e.g. 20240101
STAMP_FORMAT = "yyyy-MMM-dd_HH-mm-ss"       # run stamp, e.g. 2024-Jan-01_00-00-07
FEEDBACK_TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"  # feedback display, e.g. 01/01/2024 00:00:07
CUTOFF_DAYS = 365
# Ways a date may be written, tried in this order; then whatever casts to a timestamp (ISO date and time).
DATE_FORMATS = ("yyyyMMdd", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d MMM yyyy", "yyyy/MM/dd")
PAGE_SIZE = 100


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_date(as_of: str | None = None) -> Column:
    """``as_of`` (yyyy-MM-dd) as a date, else today's date."""
    return F.to_date(F.lit(as_of)) if as_of else F.current_date()


def as_of_timestamp(as_of: str | None = None) -> Column:
    """``as_of`` (yyyy-MM-dd HH:mm:ss) as a timestamp, else the current timestamp."""
    return F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()


def load_date_text(c) -> Column:
    """``yyyyMMdd`` text of a date or timestamp."""
    return F.date_format(_c(c), LOAD_DATE_FORMAT)


def stamp_text(c) -> Column:
    return F.date_format(_c(c), STAMP_FORMAT)


def feedback_time_text(c) -> Column:
    return F.date_format(_c(c), FEEDBACK_TIME_FORMAT)


def any_date(c) -> Column:
    """Date of a text in one of ``DATE_FORMATS`` or an ISO timestamp; NULL where none fits."""
    t = F.trim(_c(c))
    return F.coalesce(*[F.try_to_date(t, f) for f in DATE_FORMATS], F.try_to_timestamp(t).cast("date"))


def days_before(d: Column, days: int = CUTOFF_DAYS) -> Column:
    """X10."""
    return F.date_sub(d, days)


def effective_since(df: DataFrame, date_col: str, days: int = CUTOFF_DAYS, as_of: str | None = None) -> DataFrame:
    """rows dated on or after ``as_of - days`` (a plain comparison, pushed to the scan)."""
    return df.where(F.col(date_col) >= days_before(as_of_date(as_of), days))


def pages_needed(total, page_size: int = PAGE_SIZE) -> Column:
    """X11: ceil(total / page_size) as bigint."""
    return F.ceil(_c(total) / F.lit(page_size)).cast("bigint")

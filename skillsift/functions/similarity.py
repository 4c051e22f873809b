"""General string similarity ratio 2*M / (len(a) + len(b)).

M is the number of matched characters found by the standard library's
``difflib.SequenceMatcher`` (default junk heuristic). No Spark built-in computes
it, so this is the one Arrow-batched pandas UDF of the library; callers feed it
distinct, length-band-filtered pairs only (see ``operators.titles.similar_titles``).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str | None, b: str | None) -> float | None:
    """Plain-Python ratio (both empty -> 1.0); NULL in -> NULL out."""
    if a is None or b is None:
        return None
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")

"""Size checks in front of every broadcast.

A side is broadcast only after counting it (partial counts, no rows are moved);
a larger side goes to a shuffle join, where AQE's skew handling splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 2_000_000


def small_enough(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, what: str = "", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small_enough(df, max_rows) else df

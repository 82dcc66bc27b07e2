"""The strategy of joins with tables whose size is not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast side may have.
MOST = 200_000


def sized(df: DataFrame, rows: int = MOST) -> DataFrame:
    """df as a join side: broadcast if a count finds at most `rows` rows, else for a sort-merge join (a cross join then deals both sides out)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")

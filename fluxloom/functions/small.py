"""Broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers each: under a megabyte.
ROWS = 10_000


def small(df: DataFrame, rows: int = ROWS, merge: bool = False) -> DataFrame:
    """df, marked for broadcast if its rows, counted, are few enough; beyond that Spark shuffles.

    With merge the join is a merge beyond the count. Else Spark may still gather a side at the
    driver that it takes for small: what an explode makes of a file counts as the file's size.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df.hint("merge") if merge else df

"""Connected components of links, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut


def roots(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, root) of every id that the links (keys, a, b) name: root is the least id reachable.

    A round gives each id the least root of its neighbours and then its root's root; rounds
    end when nothing changes, after some logarithm of the longest chain. Links are summed
    up in each task before they meet, so an id with many of them is no hot key.
    """
    e = cut(links.select(*keys, "a", "b").union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(e.groupBy(*keys, F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    changed = label.head(1)
    while changed:
        near = e.join(label.select(*keys, F.col("id").alias("b"), "root"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("root").alias("least"))
        lower = label.join(near, [*keys, "id"]).select(*keys, "id", "root", F.least("root", "least").alias("new"))
        above = label.select(*keys, F.col("id").alias("new"), F.col("root").alias("higher"))
        after = cut(lower.join(above, [*keys, "new"]).select(*keys, "id", F.least("new", "higher").alias("new"), "root"))
        changed = after.where("new <> root").head(1)
        label = after.select(*keys, "id", F.col("new").alias("root"))
    return label

"""Connected components of an edge list, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, discard


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node that has an edge and isn't the least of its component, that least node.

    edges: columns a and b of one orderable type. Alternates the large-star and small-star steps of
    Kiveris et al. until nothing changes. Each step is one aggregation with partial sums and one join,
    which adaptive execution can split when a hub is hot; a step's result is a table in the shared folder, which goes after the next step.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before, state = None, _fingerprint(now)
    while state != before and state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        last, now = now, cut(small.filter("a != b").distinct())
        discard(last)
        before, state = state, _fingerprint(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

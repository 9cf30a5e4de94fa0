"""Connected components by alternating large and small stars (Kiveris et al., 2014), as joins and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import merged, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it. Links run down (b < a); some come repeatedly."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.where("b > a").join(merged(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these, once; the links given run down."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    out = edges.join(merged(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return out.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the smallest node reachable.

    Rounds run until the stars no longer change; each star is written to the shared folder, so that no plan holds
    more than one of them. A node with very many neighbours is spread by partial sums and skewed joins.
    """
    work = stored(edges.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        work = stored(_small_star(stored(_large_star(work))))
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    stars = work.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())

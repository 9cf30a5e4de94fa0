"""Overlap joins between box tables.

Boxes are spread over the grid cells they cover and joined on (keys, cell), so a
crowded image is worked on by many tasks. A pair is kept only in the cell of its
intersection's corner, which makes the pair unique without a distinct. Equal
boxes are collapsed by the callers before they get here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.functions import boxes as bx
from wayscore.operators.ordered import shared

GEOM = ["x1", "y1", "x2", "y2"]
#: Boxes of one key, both sides together, that are compared as a list in one row; keys with more meet in cells.
CROWDED = 2048
#: The same where each pair of boxes that meets is a row.
PAIRED = 512


def _cells(df: DataFrame, prefix: str, cell: float) -> DataFrame:
    span = lambda lo, hi: F.sequence(
        F.floor(F.col(f"{prefix}{lo}") / cell), F.greatest(F.floor(F.col(f"{prefix}{lo}") / cell), F.floor(F.col(f"{prefix}{hi}") / cell)))
    return df.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """Pairs with positive overlap. ``left`` has a_x1.., ``right`` has b_x1.. columns.

    Both sides are made here, from files that may be far smaller, so neither is sent whole to every task.
    """
    a, b = bx.box("a_"), bx.box("b_")
    d = _cells(left, "a_", cell).join(_cells(right, "b_", cell).hint("merge"), [*keys, "_cx", "_cy"])
    mine = (F.floor(F.greatest(a[0], b[0]) / cell) == F.col("_cx")) & (F.floor(F.greatest(a[1], b[1]) / cell) == F.col("_cy"))
    return d.where(mine & (bx.intersection(a, b) > 0)).drop("_cx", "_cy")


def distinct_boxes(df: DataFrame, keys: Sequence[str], prefix: str, *aggs) -> DataFrame:
    """One row per key and geometry, with box columns renamed under ``prefix``."""
    return df.groupBy(*keys, *GEOM).agg(*aggs).withColumnsRenamed({c: f"{prefix}{c}" for c in GEOM})


def crowded_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int = CROWDED) -> DataFrame:
    """Keys with more than ``limit`` rows of both sides together, at most one for each ``limit`` rows: a small table."""
    sizes = left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    return F.broadcast(shared(sizes.where(F.col("_cnt") > limit).drop("_cnt")))


def split_crowded(left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int = CROWDED) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both sides' rows of keys with at most ``limit`` rows together, then both sides' rows of the other keys.

    A key with nulls counts to the first.
    """
    keys = list(keys)
    many = crowded_keys(left, right, keys, limit)
    few = [d.join(many, keys, "left_anti") for d in (left, right)]
    return *few, *[d.join(many, keys, "left_semi") for d in (left, right)]


def same_class(a: Column, b: Column) -> Column:
    """Equality that a join on other keys checks after it has met its rows: as a key of the join it would have both sides hashed anew."""
    return (a >= b) & (a <= b)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, salt_on: Sequence[str], salts: int = 16) -> DataFrame:
    """First ``k`` rows per key in two passes, so that a hot key is sorted in pieces."""
    salt = F.pmod(F.xxhash64(*salt_on), F.lit(salts))
    first = F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))
    d = df.withColumn("_s", salt).withColumn("_r", first).where(F.col("_r") <= k)
    final = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return d.withColumn("_r", final).where(F.col("_r") <= k).drop("_s").withColumnRenamed("_r", "position")

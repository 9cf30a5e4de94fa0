"""Nearest points of clouds that one task holds: same rows as through the grid cells, without spreading any point."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayscore.operators import depthflow as df_


def _clouds(spark):
    rng = np.random.RandomState(8)
    rows = [(c, i, float(x), float(y)) for c in (1, 2) for i, (x, y) in enumerate(rng.randint(0, 12, (150, 2)))]
    rows += [(3, 1, 0.0, 0.0), (None, 1, 0.0, 0.0), (1, 900, None, 1.0)]
    d = spark.createDataFrame(rows, "cloud long, id long, x double, y double")
    return d.where("id % 3 = 0 OR cloud = 3"), d.where("id % 3 <> 0 AND (cloud <> 3 OR cloud IS NULL)")


@pytest.mark.parametrize("k", [1, 3, 6])
def test_blocks_and_cells_agree(spark, k):
    a, b = _clouds(spark)
    got = {small: sorted(map(tuple, df_.nearest_points(a, b, ["cloud"], ["x", "y"], k, small=small).select(
        "cloud", "x", "y", "copies", "rank", "d2", "ref").collect())) for small in (0, 120, df_.SMALL_CLOUD)}
    assert got[0] == got[120] == got[df_.SMALL_CLOUD] and len(got[0]) > 60 * k
    assert df_.nearest_points(a.where("cloud = 3"), b, ["cloud"], ["x", "y"], k).count() == 0


def test_small_clouds_spread_no_points(spark):
    a, b = _clouds(spark)
    n = df_.nearest_points(a, b, ["cloud"], ["x", "y"])
    assert "Generate" not in n._jdf.queryExecution().optimizedPlan().toString()
    far = b.withColumn("x", F.when(F.col("id") == 1, float("inf")).otherwise(F.col("x")))
    assert df_.nearest_points(a, far, ["cloud"], ["x", "y"]).where("d2 = 'Infinity'").count() == 0

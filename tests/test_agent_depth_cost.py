"""Depth of objects of few pixels: the values of the bucketed path, with far fewer steps."""

from __future__ import annotations

import numpy as np
import pytest

from wayscore.operators import depthflow as df_


@pytest.mark.parametrize("method", ["mean", "top_median", "median"])
def test_rows_and_buckets_agree(spark, method):
    rng = np.random.RandomState(9)
    rows = [(i, int(y), float(v)) for i in range(4) for y, v in zip(rng.randint(0, 9, 30 * i + 1), rng.rand(30 * i + 1))]
    d = spark.createDataFrame([*rows, (1, 3, None), (7, 1, None), (None, 1, 2.0)], "image long, y long, depth double")
    got = {limit: {r[0]: r[1] for r in df_.agent_depth(d, ["image"], method, limit=limit).collect() if r[0] in range(4)} for limit in (50, 1000)}
    assert got[50] == pytest.approx(got[1000]) and set(got[50]) == {0, 1, 2, 3}


def test_few_pixels_take_few_shuffles(spark):
    d = spark.range(3000).selectExpr("id % 50 AS image", "id % 9 AS y", "id * 0.5 AS depth")
    out = df_.agent_depth(d, ["image"], "top_median")
    out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 2

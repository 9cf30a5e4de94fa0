"""Small keys in one pass, hot keys in buckets: the same rows either way."""

import math

from pyspark.sql import functions as F

from wayscore.operators import depthflow as df_
from wayscore.operators.ordered import number_rows
from wayscore.plans import views as v


def rows(df):
    return sorted(df.collect(), key=str)


def test_numbering_keeps_null_keys_and_does_not_depend_on_the_limit(spark):
    df = spark.createDataFrame([(i % 3 or None, i * 7 % 50) for i in range(50)], "k long, x long")
    got = [rows(number_rows(df, ["k"], {"b": F.floor(F.col("x") / 8)}, ["x"], limit=n).where("k IS NOT NULL")) for n in (0, 17, 1000)]
    assert got[0] == got[1] == got[2]
    whole = number_rows(df, ["k"], {"b": F.floor(F.col("x") / 8)}, ["x"])
    assert whole.where("k IS NULL").count() == 17
    assert sorted(r.n for r in whole.where("k = 1").collect()) == list(range(17))


def test_depth_suite_of_small_and_hot_images(spark, sf):
    d = v.depth(spark, sf)
    whole = {r.image_id: r for r in df_.depth_errors(d, ["image_id"]).collect()}
    cut = {r.image_id: r for r in df_.depth_errors(d, ["image_id"], limit=25).collect()}
    assert whole.keys() == cut.keys()
    for i, r in whole.items():
        for name, x in r.asDict().items():
            assert math.isclose(x, cut[i][name], rel_tol=1e-9, abs_tol=1e-9), (i, name)


def test_area_under_inliers_does_not_round_on_the_way(spark):
    """Half steps are averaged before they are scaled, so equal images give equal bits in any order of rows."""
    ratios = [1.01 + 0.041 * i for i in range(13)]
    step = (5.0 - 0.01) / 99
    below = [math.floor((math.log(r, 1.25) - 0.01) / step) + 1 for r in ratios]
    want = sum(99.5 - b for b in below) / len(ratios) * step / 5
    df = spark.createDataFrame([(0, 1.0, r, 1) for r in ratios] + [(1, 1.0, r, 1) for r in reversed(ratios)], "image_id long, gt double, pred double, valid int")
    assert {r.d_auc for r in df_.depth_errors(df, ["image_id"]).collect()} == {want}

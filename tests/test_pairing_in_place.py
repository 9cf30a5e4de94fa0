"""Images of few boxes are matched where their rows lie; crowded ones by cells and ids, with the same result."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from wayscore.operators import detection as dt
from wayscore.operators import instances as ins
from wayscore.operators.ordered import shared

SIGMAS = (0.07, 0.09, 0.11, 0.13)


def _boxes(spark, seed):
    """Images 0 to 8 with boxes that repeat in part, some without a side; image 9 with detections only; one detection without an image."""
    rng = random.Random(seed)
    rows = [(i % 9, n, rng.choice(("pred", "label")), rng.randint(0, 2), rng.randint(0, 9) / 10, x, y, x + rng.randint(20, 60), y + rng.randint(20, 60))
            for n, i in enumerate(range(240)) for x, y in [(10.0 * rng.randint(0, 4), 10.0 * rng.randint(0, 4))]]
    rows += [(9, 900, "pred", 0, 0.5, 0.0, 0.0, 9.0, 9.0), (None, 901, "pred", 0, 0.5, 0.0, 0.0, 9.0, 9.0), (0, 902, "pred", None, 0.5, 0.0, 0.0, 40.0, 40.0)]
    d = spark.createDataFrame([(*r[:5], *map(float, r[5:])) for r in rows], "image_id long, det_id long, role string, cls long, conf double, x1 double, y1 double, x2 double, y2 double")
    d = d.withColumns({"x2": F.when(F.col("det_id") % 11 != 3, F.col("x2")), "y1": F.when(F.col("det_id") % 13 != 5, F.col("y1"))})
    d = shared(d.repartition(8, "image_id"))
    labels = d.where("role = 'label'").drop("role", "conf").withColumnRenamed("det_id", "label_id")
    return d.where("role = 'pred'").drop("role"), labels


def _families(dets, labels, limit):
    place = [((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")]
    turned = lambda df, a, *c: df.select("image_id", *c, "cls", *place, a.alias("angle"))
    rd, rl = turned(dets, 0.3 + (F.col("det_id") % 5).cast("double") / 20, "det_id", "conf"), turned(labels, F.lit(0.3), "label_id")
    points = lambda *more: F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), *more) for x in ("x1", "x2") for y in ("y1", "y2")]).alias("points")
    kd = dets.select("image_id", "det_id", "cls", "conf", points())
    kl = labels.select("image_id", "label_id", "cls", points(F.lit(1).alias("visible")), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    return {"box": dt.match_detections(dets, labels, limit=limit),
            "rotated": dt.match_detections(rd, rl, overlaps=ins.rotated_pairs(rd, rl, limit=limit), limit=limit),
            "keypoints": dt.match_detections(kd, kl, overlaps=ins.keypoint_pairs(kd, kl, SIGMAS, limit=limit), limit=limit)}


def _flags(df):
    return sorted((str(r["image_id"]), r["det_id"], [r[f"t{i}"] for i in range(10)]) for r in df.collect())


def test_crowded_and_other_images_match_alike(spark):
    dets, labels = _boxes(spark, 5)
    few, some, all_ = (_families(dets, labels, limit) for limit in (10_000, 26, 0))
    for kind in few:
        want = _flags(all_[kind])
        assert len(want) == dets.count() and sum(w[2][0] for w in want) >= 5 and len({tuple(w[2]) for w in want}) > 2
        assert _flags(few[kind]) == want and _flags(some[kind]) == want


def test_ids_that_repeat_keep_the_flags_of_their_id(spark):
    box = "x1 double, y1 double, x2 double, y2 double"
    dets = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 0.8, 50.0, 50.0, 60.0, 60.0), (1, 2, 0, 0.7, 0.0, 0.0, 10.0, 10.0)],
                                 f"image_id long, det_id long, cls int, conf double, {box}")
    labels = spark.createDataFrame([(1, 7, 0, 0.0, 0.0, 10.0, 10.0)], f"image_id long, label_id long, cls long, {box}")
    for limit in (0, 512):
        found = dt.match_detections(dets, labels, limit=limit)
        assert sorted((r["det_id"], r["conf"], r["t0"]) for r in found.collect()) == [(1, 0.8, 1), (1, 0.9, 1), (2, 0.7, 0)]


def test_rows_that_lie_by_image_are_hashed_on_nothing_else(spark):
    dets, labels = _boxes(spark, 6)
    for kind, found in _families(dets, labels, 512).items():
        found.collect()
        final = found._jdf.queryExecution().executedPlan().executedPlan().toString()
        hashed = re.findall(r"hashpartitioning\((.*?), \d+\)", final)
        assert all(re.fullmatch(r"image_id#\w+", h) for h in hashed) and not re.search(r"\b_cx#", final), (kind, hashed)

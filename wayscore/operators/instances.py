"""Overlap tables of masks, rotated boxes and keypoints, for matching detections to labels.

Each function gives (keys, image_id, det_id, label_id, iou) for the pairs of one image and class that can reach the least
level of matching, 0.5; those of rotated boxes and keypoints also name the class and whether the image is crowded. Candidates meet in cells that a bound on
the measure allows, so that far pairs are never formed; the measure itself decides. Rotated boxes and keypoints of images
of up to ``limit`` shapes meet by image alone, where the rows of an image lie together, without cells. Equal shapes of one image and class become one row of their lowest id before they meet: only
that one can win a label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.functions import boxes as bx
from wayscore.operators.boxjoin import PAIRED, overlap_pairs, same_class, split_crowded

LEAST = 0.5
#: exp(-distance) of rotated boxes at the least level is 3/4, so centres lie within 2 * sqrt(ln(4/3) * (s + t) / 12)
#: of each other, s and t the squares of the longer sides; rounded up, as the measure adds 1e-7 to its denominators.
REACH = 0.32
#: Column chunks that the runs of a mask are cut at.
CHUNK = 1024


def _lowest(df: DataFrame, keys: Sequence[str], shape: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys, *shape).agg(F.min(name).alias(name))


# ---- masks -------------------------------------------------------------------------------------------

def _runs(masks: DataFrame, keep: Sequence[str], chunk: int) -> DataFrame:
    """Foreground runs (_lo, _hi) of column-major run lengths, cut so that each lies in one chunk of pixels."""
    r = masks.select(*keep, F.posexplode("counts").alias("_i", "_n"))
    r = r.withColumn("_end", F.sum("_n").over(W.partitionBy(*keep).orderBy("_i").rowsBetween(W.unboundedPreceding, 0)))
    r = r.where("_i % 2 = 1 AND _n > 0").select(*keep, F.struct((F.col("_end") - F.col("_n")).alias("lo"), F.col("_end").alias("hi")).alias("_r"))
    first, last = F.floor(F.col("_r.lo") / chunk), F.floor((F.col("_r.hi") - 1) / chunk)
    r = r.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return r.select(*keep, "_chunk", F.greatest(F.col("_r.lo"), F.col("_chunk") * chunk).alias("_lo"), F.least(F.col("_r.hi"), (F.col("_chunk") + 1) * chunk).alias("_hi"))


def mask_pairs(dets: DataFrame, labels: DataFrame, keys: Sequence[str] = (), chunk: int = CHUNK, eps: float = 1e-7) -> DataFrame:
    """Overlaps of masks given as ``counts``, column-major run lengths with the background first.

    Runs are merged as intervals: two runs of one chunk share the difference of their inner ends. No pixel is formed.
    Empty masks meet nothing.
    """
    k = [*keys, "image_id", "cls"]
    area = F.aggregate(F.filter("counts", lambda n, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, n: a + n)
    counts = F.transform("counts", lambda n: n.cast("long"))
    d = _lowest(dets.withColumn("counts", counts), k, ["counts"], "det_id").withColumn("_a", area)
    t = _lowest(labels.withColumn("counts", counts), k, ["counts"], "label_id").withColumn("_b", area)
    left = _runs(d, [*k, "det_id", "_a"], chunk)
    right = _runs(t, [*k, "label_id", "_b"], chunk).withColumnsRenamed({"_lo": "_from", "_hi": "_to"})
    shared = F.least("_hi", "_to") - F.greatest("_lo", "_from")
    met = left.join(right, [*k, "_chunk"]).where(shared > 0).groupBy(*k, "det_id", "label_id", "_a", "_b").agg(F.sum(shared).alias("_i"))
    iou = F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i") + eps)
    return met.select(*keys, "image_id", "det_id", "label_id", iou.alias("iou")).where(F.col("iou") >= LEAST)


# ---- rotated boxes -------------------------------------------------------------------------------------------

ROTATED = ["cx", "cy", "w", "h", "angle"]
GAUSSIAN = ["cx", "cy", "var_x", "var_y", "cov"]


def _met_by_image(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shapes of one image and class, joined on the image alone so that rows hashed on it stay where they are."""
    met = left.join(right.withColumnRenamed("cls", "_lcls").hint("merge"), [*keys, "image_id"])
    return met.where(same_class(F.col("cls"), F.col("_lcls"))).drop("_lcls")


def _scored(few: DataFrame, many: DataFrame, k: Sequence[str], measure: Column) -> DataFrame:
    """Pairs at the least level; ``crowded`` tells those of crowded images, so that a reader of one kind makes no other."""
    pairs = lambda near, crowded: near.withColumn("iou", measure).where(F.col("iou") >= LEAST).select(
        *k, "det_id", "label_id", "iou", F.lit(crowded).alias("crowded"))
    return pairs(few, False).unionByName(pairs(many, True))


def rotated_pairs(dets: DataFrame, labels: DataFrame, keys: Sequence[str] = (), cell: float = 64.0, limit: int = PAIRED) -> DataFrame:
    """Probabilistic overlaps of rotated boxes (cx, cy, w, h, angle).

    The measure falls with the distance of the boxes' Gaussians, of which the centres' part is at least a quarter of the
    squared distance over the largest variance of both together, and the rest is not negative. So two boxes reach the
    least level only if the squares around their centres with half sides of ``REACH`` times the longer side touch. Boxes
    of less than 0.015 square pixels, where the measure's 1e-7 counts, are not covered by the bound.
    """
    k = [*keys, "image_id", "cls"]

    def around(df: DataFrame, prefix: str, name: str) -> DataFrame:
        d = _lowest(df, k, ROTATED, name)
        reach = REACH * F.greatest("w", "h")
        square = {"x1": F.col("cx") - reach, "y1": F.col("cy") - reach, "x2": F.col("cx") + reach, "y2": F.col("cy") + reach}
        own = dict(zip(GAUSSIAN, (F.col("cx"), F.col("cy"), *bx.rotated_covariance(F.col("w"), F.col("h"), F.col("angle")))))
        return d.select(*k, name, *[c.alias(f"{prefix}{n}") for n, c in (own | square).items()])

    few_d, few_l, many_d, many_l = split_crowded(dets, labels, [*keys, "image_id"], limit)
    # the least of a null and a number is the number: a square without a place would meet all others
    placed = lambda df, p: df.where(F.col(f"{p}x1").isNotNull() & F.col(f"{p}y1").isNotNull())
    few = _met_by_image(placed(around(few_d, "a_", "det_id"), "a_"), placed(around(few_l, "b_", "label_id"), "b_"), keys)
    few = few.where(bx.intersection(bx.box("a_"), bx.box("b_")) > 0)
    many = overlap_pairs(around(many_d, "a_", "det_id"), around(many_l, "b_", "label_id"), k, cell)
    shape = lambda p: tuple(F.col(f"{p}{c}") for c in GAUSSIAN)
    return _scored(few, many, k, bx.gaussian_iou(shape("a_"), shape("b_")))


# ---- keypoints -------------------------------------------------------------------------------------------

def object_keypoint_similarity(points: Column, truth: Column, area: Column, sigmas: Sequence[float], eps: float = 1e-7) -> Column:
    """Mean over the visible true points of exp(-e); ``points`` hold x, y and ``truth`` x, y, visible."""
    sigma = F.array(*[F.lit(float(s)) for s in sigmas])

    def one(p: Column, i: Column) -> Column:
        t, s = F.get(truth, i), F.get(sigma, i)
        e = ((p["x"] - t["x"]) * (p["x"] - t["x"]) + (p["y"] - t["y"]) * (p["y"] - t["y"])) / (4 * s * s) / (area + eps) / 2
        return F.when(t["visible"] != 0, F.exp(-e)).otherwise(0.0)

    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    seen = total(F.transform(truth, lambda t: (t["visible"] != 0).cast("double")))
    return total(F.transform(points, one)) / (seen + eps)


def keypoint_pairs(dets: DataFrame, labels: DataFrame, sigmas: Sequence[float], keys: Sequence[str] = (), cell: float = 64.0, eps: float = 1e-7,
                   limit: int = PAIRED) -> DataFrame:
    """Similarities of detected ``points`` and labels with ``points`` (x, y, visible) and ``area``.

    The similarity is a mean of exp(-e) over visible points, so at the least level one of them has e <= ln 2: its
    detected point lies within sigma * sqrt(8 ln 2 * area) of the true one. Pairs meet in the cells of such points.
    """
    k = [*keys, "image_id", "cls"]
    lowest = lambda dets, labels: (_lowest(dets, k, ["points"], "det_id"), _lowest(labels.withColumnsRenamed({"points": "truth"}), k, ["truth", "area"], "label_id"))
    few_d, few_l, many_d, many_l = split_crowded(dets, labels, [*keys, "image_id"], limit)
    few = _met_by_image(*lowest(few_d, few_l), keys)
    d, t = lowest(many_d, many_l)
    sigma = F.array(*[F.lit(float(s)) for s in sigmas])
    at = lambda c: F.floor(c / cell)
    left = d.select(*k, "det_id", F.posexplode("points").alias("_i", "_p")).select(
        *k, "det_id", "_i", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"), at(F.col("_p.x")).alias("_cx"), at(F.col("_p.y")).alias("_cy"))
    right = t.select(*k, "label_id", "area", F.posexplode("truth").alias("_i", "_t")).where("_t.visible != 0")
    right = right.withColumn("_r", F.get(sigma, F.col("_i")) * F.sqrt(8 * F.log(F.lit(2.0)) * (F.col("area") + eps)) * (1 + 1e-9))
    right = right.select(*k, "label_id", "_i", F.col("_t.x").alias("_u"), F.col("_t.y").alias("_v"), "_r")
    right = right.withColumn("_cx", F.explode(F.sequence(at(F.col("_u") - F.col("_r")), at(F.col("_u") + F.col("_r")))))
    right = right.withColumn("_cy", F.explode(F.sequence(at(F.col("_v") - F.col("_r")), at(F.col("_v") + F.col("_r")))))
    close = F.pow(F.col("_x") - F.col("_u"), 2) + F.pow(F.col("_y") - F.col("_v"), 2) <= F.col("_r") * F.col("_r")
    near = left.join(right, [*k, "_i", "_cx", "_cy"]).where(close).select(*k, "det_id", "label_id").distinct()
    many = near.join(d, [*k, "det_id"]).join(t, [*k, "label_id"])
    measure = object_keypoint_similarity(F.col("points"), F.col("truth"), F.col("area"), sigmas, eps)
    return _scored(few, many, k, measure)

"""Raster statistics over pixel rows (image_id, y, x, value) and masks.

An image has a fixed resolution, so a window or group of one image is bounded;
statistics over sets of images are plain aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayscore.functions.numeric import dist
from wayscore.operators.ordered import by_key

EPS = 1e-6


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def safe_div(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def with_size(px: DataFrame, key: Sequence[str] = ("image_id",)) -> DataFrame:
    """Image height and width on every pixel; the size table has one row per image."""
    w = W.partitionBy(*key)
    return px.withColumns({"_h": F.max("y").over(w) + 1, "_w": F.max("x").over(w) + 1})


def exposure_statistics(px: DataFrame, key: Sequence[str] = ("image_id",), under: float = 20, over: float = 235, gamma: float = 2.2) -> DataFrame:
    """Mean, deviation, percentile ranges and under/over exposure shares of the luminance."""
    lum = F.col("luma")
    pct = lambda c, p: F.percentile(c, F.lit(p))
    lin = F.pow(lum / 255.0, F.lit(gamma))
    return px.groupBy(*key).agg(
        F.avg(lum).alias("mean_luminance"), F.stddev_pop(lum).alias("std_luminance"), (pct(lum, 0.999) - pct(lum, 0.001)).alias("dynamic_range"),
        F.log2((pct(lin, 0.999) + EPS) / (pct(lin, 0.001) + EPS)).alias("dynamic_range_ev"),
        F.avg((lum < under).cast("double")).alias("under_exposure"), F.avg((lum > over).cast("double")).alias("over_saturation"))


def region_statistics(px: DataFrame, key: Sequence[str] = ("image_id",), inner: float = 0.1, band: tuple[float, float] = (0.4, 0.45)) -> DataFrame:
    """Veiling glare, lens shading and flare from means of image regions."""
    d = with_size(px, key)
    x, y, h, w, lum = F.col("x"), F.col("y"), F.col("_h"), F.col("_w"), F.col("luma")
    q = lambda c, n: F.floor(n * c / 4)
    core = (y >= q(h, 1)) & (y < q(h, 3)) & (x >= q(w, 1)) & (x < q(w, 3))
    top, bottom, left, right = y < q(h, 1), y >= q(h, 3), x < q(w, 1), x >= q(w, 3)
    diag, r = dist(h.cast("double"), w.cast("double")), dist(x - w * 0.5, y - h * 0.5)
    near, far = r < inner * diag, (r > band[0] * diag) & (r < band[1] * diag)
    mean = lambda c: F.avg(F.when(c, lum))
    g = d.groupBy(*key).agg(
        F.avg(lum).alias("_all"), mean(core).alias("_core"), mean(top & left).alias("_tl"), mean(top & right).alias("_tr"), mean(bottom & left).alias("_bl"),
        mean(bottom & right).alias("_br"), mean(near).alias("_in"), mean(far).alias("_out"), mean(~near).alias("_notin"))
    corners = (F.col("_tl") + F.col("_tr") + F.col("_bl") + F.col("_br")) / 4
    inner_mean = F.coalesce("_in", "_all")
    outer = F.coalesce("_out", F.when(F.col("_in").isNotNull(), F.col("_notin")))
    return g.select(*key, safe_div(F.col("_all") - F.col("_core"), F.col("_core")).alias("veiling_glare"), (F.col("_core") / (corners + EPS)).alias("lens_shading"),
                    (inner_mean / F.greatest(outer, F.lit(1e-6))).alias("flare_attenuation"))


def patch_statistics(px: DataFrame, size: int, key: Sequence[str] = ("image_id",), contrast: float = 0.05) -> DataFrame:
    """Local RMS contrast and detectable-contrast share over patches; the last row and column of patches stay out."""
    d = with_size(px, key).withColumns({"_py": F.floor(F.col("y") / size), "_px": F.floor(F.col("x") / size)})
    d = d.where((F.col("_py") * size < F.col("_h") - size) & (F.col("_px") * size < F.col("_w") - size))
    p = d.groupBy(*key, "_py", "_px").agg(F.stddev_pop("luma").alias("_s"), ((F.max("luma") - F.min("luma")) / 255 > contrast).cast("double").alias("_c"))
    return p.groupBy(*key).agg(F.avg("_s").alias("local_rms_contrast"), F.avg("_c").alias("contrast_detection"))


def shrink(px: DataFrame, factor: int, key: Sequence[str] = ("image_id",)) -> DataFrame:
    """Area average over factor x factor blocks."""
    return px.groupBy(*key, F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("luma").alias("luma"))


def contrast_transfer(px: DataFrame, size: int, key: Sequence[str] = ("image_id",), factor: int = 4, targets: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Mean Michelson contrast of quarter-size patches against target contrasts; no patches give 0."""
    s = with_size(shrink(px, factor, key), key).withColumns({"_py": F.floor(F.col("y") / size), "_px": F.floor(F.col("x") / size)})
    ok = (F.col("_py") * size < F.col("_h") - size) & (F.col("_px") * size < F.col("_w") - size)
    p = s.groupBy(*key, "_py", "_px").agg(F.max(ok).alias("_ok"), safe_div(F.max("luma") - F.min("luma"), F.max("luma") + F.min("luma")).alias("_c"))
    mean = F.avg(F.when(F.col("_ok"), F.col("_c")))
    slope = sum(1.0 / (t + EPS) for t in targets) / len(targets)
    return p.groupBy(*key).agg(F.coalesce(mean * slope, F.lit(0.0)).alias("contrast_transfer"))


def multi_scale_contrast(px: DataFrame, key: Sequence[str] = ("image_id",), levels: int = 6) -> DataFrame:
    """Deviation of the image at halved sizes, weighted by the size; scales below one pixel add nothing."""
    parts = None
    for level in range(levels):
        s = shrink(px, 2 ** level, key).groupBy(*key).agg((F.stddev_pop("luma") / 2 ** level).alias("c"), F.count(F.lit(1)).alias("n"))
        parts = s if parts is None else parts.unionByName(s)
    return parts.groupBy(*key).agg(F.sum("c").alias("global_contrast"))


def sensor_noise(px: DataFrame, key: Sequence[str] = ("image_id",), exposure_s: float = 1.0) -> DataFrame:
    """Row noise, dark signal non-uniformity, fixed-pattern noise and dark current."""
    rows = px.groupBy(*key, "y").agg(F.avg("luma").alias("_m"), F.sum("luma").alias("_s"), F.sum(F.col("luma") * F.col("luma")).alias("_ss"),
                                     F.count(F.lit(1)).alias("_n"), F.max("luma").alias("_hi"), F.min("luma").alias("_lo"))
    n = F.sum("_n")
    mean = F.sum("_s") / n
    return rows.groupBy(*key).agg(F.var_pop("_m").alias("row_noise"), (F.max("_hi") - F.min("_lo")).alias("dsnu"),
                                  F.sqrt(F.greatest(F.sum("_ss") / n - mean * mean, F.lit(0.0))).alias("fpn"), (mean / (exposure_s + EPS)).alias("dark_current"))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB to 8-bit scaled Lab (L to 0..255, a and b shifted by 128)."""
    lin = lambda c: F.when(c / 255 > 0.04045, F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255 / 12.92)
    r, g, b = lin(r), lin(g), lin(b)
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    lightness = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    rnd = lambda c: F.floor(F.greatest(F.least(c, F.lit(255.0)), F.lit(0.0)) + 0.5)
    return rnd(lightness * 255 / 100), rnd(500 * (f(x) - f(y)) + 128), rnd(200 * (f(y) - f(z)) + 128)


def colour_statistics(px: DataFrame, key: Sequence[str] = ("image_id",), separation: float = 15) -> DataFrame:
    """Grey-world error, saturation and colour separation over r, g, b columns.

    The separation measures both axes from the mean of the b axis, as the metric is defined.
    """
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    sat = F.when(hi > 0, F.floor(255 * (hi - lo) / hi + 0.5)).otherwise(0.0)
    _, a, b = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    d = px.withColumns({"_s": sat, "_a": a, "_b": b})
    g = d.groupBy(*key).agg(*[F.avg(c).alias(f"_{c}m") for c in ("r", "g", "b")], F.avg("_s").alias("saturation_mean"), F.stddev_pop("_s").alias("saturation_std"),
                            F.avg("_b").alias("_bmean"), F.collect_list(F.struct("_a", "_b")).alias("_ab"))
    mu = (F.col("_rm") + F.col("_gm") + F.col("_bm")) / 3
    far = F.filter("_ab", lambda p: dist(p["_a"] - F.col("_bmean"), p["_b"] - F.col("_bmean")) > separation)
    return g.select(*key, (F.abs(F.col("_rm") - mu) + F.abs(F.col("_gm") - mu) + F.abs(F.col("_bm") - mu)).alias("grey_world_error"),
                    "saturation_mean", "saturation_std", (F.size(far) / F.size("_ab")).alias("colour_separation"))


def chart_difference(px: DataFrame, reference: DataFrame, patch: Sequence[str], key: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mean Lab distance of chart patches to their reference (columns ref_l, ref_a, ref_b)."""
    lightness, a, b = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    d = px.withColumns({"_l": lightness, "_a": a, "_b": b}).join(reference, list(patch))
    dl, da, db = F.col("_l") - F.col("ref_l"), F.col("_a") - F.col("ref_a"), F.col("_b") - F.col("ref_b")
    return d.groupBy(*key).agg(F.avg(F.sqrt(dl * dl + da * da + db * db)).alias("delta_e"))


def texture_loss(px: DataFrame, ref: DataFrame, key: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mean absolute difference to a reference image over the reference's deviation."""
    d = px.join(ref.withColumnRenamed("luma", "_ref"), [*key, "y", "x"])
    return d.groupBy(*key).agg(safe_div(F.avg(F.abs(F.col("_ref") - F.col("luma"))), F.stddev_pop("_ref")).alias("texture_loss"))


def oecf_range(curve: DataFrame, key: Sequence[str], min_snr: float = 20) -> DataFrame:
    """Exposure range of the response curve where the signal-to-noise ratio is good enough."""
    e = F.when(F.col("snr") >= min_snr, F.col("exposure"))
    return curve.groupBy(*key).agg(F.when(F.count(e) > 1, safe_div(F.max(e), F.min(e))).otherwise(0.0).alias("oecf_range"))


def stencils(px: DataFrame, key: Sequence[str] = ("image_id",)) -> DataFrame:
    """Laplacian and Sobel gradients with mirrored borders, from two sorted passes."""
    wx, wy = W.partitionBy(*key, "y").orderBy("x"), W.partitionBy(*key, "x").orderBy("y")

    def both(c, w):
        lo, hi = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(lo, hi, F.col(c)), F.coalesce(hi, lo, F.col(c))

    left, right = both("luma", wx)
    d = px.withColumns({"_l": left, "_r": right})
    d = d.withColumns({"_dx": F.col("_r") - F.col("_l"), "_sx": F.col("_l") + 2 * F.col("luma") + F.col("_r")})
    (u, dn), (du, dd), (su, sd) = both("luma", wy), both("_dx", wy), both("_sx", wy)
    return d.select(*key, "y", "x", "luma", (F.col("_l") + F.col("_r") + u + dn - 4 * F.col("luma")).alias("laplacian"),
                    (du + 2 * F.col("_dx") + dd).alias("gx"), (sd - su).alias("gy"))


def sharpness(px: DataFrame, key: Sequence[str] = ("image_id",), bins: int = 256) -> DataFrame:
    """Laplacian variance and entropy of the gradient-magnitude histogram."""
    s = stencils(px, key).withColumn("_m", dist("gx", "gy"))
    top = F.max("_m").over(W.partitionBy(*key)) + EPS
    s = s.withColumns({"_top": top}).withColumn("_bin", F.least(F.floor(F.col("_m") / F.col("_top") * bins), F.lit(bins - 1)))
    h = s.groupBy(*key, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_top").alias("_top"), F.sum("laplacian").alias("_s"), F.sum(F.col("laplacian") * F.col("laplacian")).alias("_ss"))
    h = h.withColumn("_n", F.sum("_c").over(W.partitionBy(*key)))
    p = F.col("_c") / (F.col("_n") * F.col("_top") / bins) + EPS
    g = h.groupBy(*key).agg(F.sum(-p * F.log2(p)).alias("_e"), F.count(F.lit(1)).alias("_k"), F.sum("_s").alias("_s"), F.sum("_ss").alias("_ss"), F.max("_n").alias("_n"))
    mean = F.col("_s") / F.col("_n")
    return g.select(*key, (F.col("_ss") / F.col("_n") - mean * mean).alias("laplacian_var"), (F.col("_e") - (bins - F.col("_k")) * EPS * math.log2(EPS)).alias("gradient_entropy"))


def frame_pair_noise(px: DataFrame, video: Sequence[str], frame: str = "frame") -> DataFrame:
    """Deviation of the pixel difference of neighbouring frames."""
    a = px.select(*video, frame, "y", "x", "luma")
    b = a.select(*video, (F.col(frame) + 1).alias(frame), "y", "x", F.col("luma").alias("_before"))
    return a.join(b, [*video, frame, "y", "x"]).groupBy(*video, frame).agg(F.stddev_pop(F.col("luma") - F.col("_before")).alias("temporal_noise"))


def focus_changes(per_frame: DataFrame, video: Sequence[str], value: str, frame: str = "frame") -> DataFrame:
    """Absolute change of a sharpness value between neighbouring frames of one clip."""
    prev = per_frame.select(*video, (F.col(frame) + 1).alias(frame), F.col(value).alias("_before"))
    return per_frame.join(prev, [*video, frame]).withColumn("focus_change", F.abs(F.col(value) - F.col("_before"))).drop("_before")


# ---- masks -------------------------------------------------------------------------------------------

def run_lengths(px: DataFrame, key: Sequence[str], mask: Column) -> DataFrame:
    """Column-major run lengths, zeros first, and the mask area."""
    w = W.partitionBy(*key).orderBy("x", "y")
    d = px.withColumn("_m", mask.cast("int"))
    d = d.withColumn("_new", F.coalesce((F.col("_m") != F.lag("_m").over(w)).cast("int"), F.lit(0)))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = d.groupBy(*key, "_run").agg(F.count(F.lit(1)).alias("n"), F.max("_m").alias("m"))
    g = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_run", "n", "m"))).alias("_r"))
    lengths = F.transform("_r", lambda e: e["n"])
    return g.select(*key, F.when(F.col("_r")[0]["m"] == 1, F.concat(F.array(F.lit(0).cast("long")), lengths)).otherwise(lengths).alias("counts"))


def run_area(counts: str | Column) -> Column:
    """Foreground pixels of run lengths: the runs at odd places."""
    odd = F.filter(counts, lambda n, i: i % 2 == 1)
    return F.aggregate(odd, F.lit(0).cast("long"), lambda a, n: a + n)


def runs_to_pixels(df: DataFrame, key: Sequence[str], counts: str, height: int) -> DataFrame:
    """Foreground pixels (y, x) of column-major run lengths."""
    starts = F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    d = df.withColumn("_s", starts).select(*key, F.posexplode(counts).alias("_i", "_n"), "_s")
    d = d.where("_i % 2 = 1 AND _n > 0").withColumn("_p", F.explode(F.sequence(F.get("_s", F.col("_i")), F.get("_s", F.col("_i") + 1) - 1)))
    return d.select(*key, (F.col("_p") % height).alias("y"), F.floor(F.col("_p") / height).alias("x"))


def mask_overlap(a: DataFrame, b: DataFrame, key: Sequence[str], eps: float = 1e-7) -> DataFrame:
    """IoU of two masks given as pixel rows per key."""
    na = a.groupBy(*key).agg(F.count(F.lit(1)).alias("area_a"))
    nb = b.groupBy(*key).agg(F.count(F.lit(1)).alias("area_b"))
    ni = a.join(b, [*key, "y", "x"]).groupBy(*key).agg(F.count(F.lit(1)).alias("inter"))
    d = na.join(nb, list(key), "full").join(ni, list(key), "left").fillna(0, ["area_a", "area_b", "inter"])
    return d.withColumn("mask_iou", F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter") + eps))


def segmentation_overlap(frames: DataFrame, a: DataFrame, b: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Overlap per object and frame (empty against empty is 1), and its mean without the first and last frame (percent)."""
    fk = [*key, "frame"]
    o = frames.join(mask_overlap(a, b, fk, 0.0).select(*fk, "area_a", "area_b", "inter"), fk, "left").fillna(0, ["area_a", "area_b", "inter"])
    union = F.col("area_a") + F.col("area_b") - F.col("inter")
    o = o.withColumn("overlap", F.when(union == 0, 1.0).otherwise(F.col("inter") / union))
    return o, _inner_mean(o, key, "overlap")


def _inner_mean(o: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    w = W.partitionBy(*key)
    d = o.withColumns({"_a": F.min("frame").over(w), "_b": F.max("frame").over(w)}).where((F.col("frame") > F.col("_a")) & (F.col("frame") < F.col("_b")))
    return d.groupBy(*key).agg((100 * F.avg(value)).alias(value))


def boundary(px: DataFrame, key: Sequence[str]) -> DataFrame:
    """Boundary pixels of a mask: pixels that differ from the right, lower or lower-right neighbour.

    The last column compares only downward, the last row only to the right, and the
    corner never counts. ``px`` holds every pixel with ``m`` 0 or 1.
    """
    wx, wy = W.partitionBy(*key, "y").orderBy("x"), W.partitionBy(*key, "x").orderBy("y")
    d = px.withColumns({"_e": F.lead("m").over(wx), "_s": F.lead("m").over(wy)})
    d = d.withColumn("_se", F.lead("_e").over(wy))
    differs = lambda c: F.coalesce(F.col(c) != F.col("m"), F.lit(False))
    return d.where(differs("_e") | differs("_s") | differs("_se")).select(*key, "y", "x")


def boundary_score(a: DataFrame, b: DataFrame, key: Sequence[str], radius: int) -> DataFrame:
    """Boundary precision, recall and F within a pixel radius; ``a`` is the truth, ``b`` the prediction."""
    disk = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    spread = lambda d: d.select(*key, F.explode(F.array(*[F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x")) for i, j in disk])).alias("p")).select(
        *key, "p.y", "p.x").distinct()
    ba, bb = boundary(a, key), boundary(b, key)
    n = lambda d, name: d.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    d = a.select(*key).distinct()
    for part in (n(ba, "n_truth"), n(bb, "n_pred"), n(bb.join(spread(ba), [*key, "y", "x"], "left_semi"), "pred_hit"), n(ba.join(spread(bb), [*key, "y", "x"], "left_semi"), "truth_hit")):
        d = d.join(part, list(key), "left")
    d = d.fillna(0)
    p = F.when(F.col("n_pred") == 0, F.when(F.col("n_truth") == 0, 1.0).otherwise(1.0)).when(F.col("n_truth") == 0, 0.0).otherwise(F.col("pred_hit") / F.col("n_pred"))
    r = F.when(F.col("n_pred") == 0, F.when(F.col("n_truth") == 0, 1.0).otherwise(0.0)).when(F.col("n_truth") == 0, 1.0).otherwise(F.col("truth_hit") / F.col("n_truth"))
    d = d.withColumns({"precision": p, "recall": r})
    return d.withColumn("f", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def mask_boxes(px: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bounding box of foreground pixels."""
    return px.groupBy(*key).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


def mask_stability(px: DataFrame, key: Sequence[str], logit: str, threshold: float, offset: float) -> DataFrame:
    """Overlap of the masks cut at a high and a low threshold."""
    hi = F.sum((F.col(logit) > threshold + offset).cast("int"))
    lo = F.sum((F.col(logit) > threshold - offset).cast("int"))
    return px.groupBy(*key).agg((hi / F.nullif(lo, F.lit(0))).alias("stability"))


def keypoint_similarity(pairs: DataFrame, keys: Sequence[str], eps: float = 1e-7) -> DataFrame:
    """Object keypoint similarity; rows hold both points, the true visibility, the object area and the keypoint's sigma."""
    dx, dy = F.col("px") - F.col("gx"), F.col("py") - F.col("gy")
    e = (dx * dx + dy * dy) / (4 * F.col("sigma") * F.col("sigma")) / (F.col("area") + eps) / 2
    seen = (F.col("visible") != 0).cast("int")
    return pairs.groupBy(*keys).agg((F.sum(F.exp(-e) * seen) / (F.sum(seen) + eps)).alias("oks"))


def cycle_consistency(forward: DataFrame, backward: DataFrame, key: Sequence[str], height: int, width: int) -> DataFrame:
    """Share of pixels whose forward and backward flow (nearest pixel) cancel within a tenth of the shorter side."""
    f = forward.withColumns({"_y": F.bround(F.col("y") + F.col("v")).cast("long"), "_x": F.bround(F.col("x") + F.col("u")).cast("long")})
    b = backward.select(*key, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("u").alias("_u"), F.col("v").alias("_v"))
    d = f.join(b, [*key, "_y", "_x"], "left")
    err = dist(F.col("u") + F.coalesce("_u", F.lit(0.0)), F.col("v") + F.coalesce("_v", F.lit(0.0)))
    return d.groupBy(*key).agg(F.avg((err < 0.1 * min(height, width)).cast("double")).alias("consistent"))


# ---- luminance over time -------------------------------------------------------------------------------

def flicker(df: DataFrame, keys: Sequence[str], luma: str = "luma", near: float = 0.05) -> DataFrame:
    """Exposure jitter, share of frames near the mean, and the sequence range."""
    w = W.partitionBy(*keys)
    mean = F.avg(luma).over(w)
    d = df.withColumns({"_d": F.col(luma) - F.lag(luma).over(w.orderBy("frame")), "_dev": F.abs(F.col(luma) - mean) / (mean + EPS)})
    pct = lambda p: F.percentile(F.col(luma), F.lit(p))
    return d.groupBy(*keys).agg(F.stddev_pop("_d").alias("exposure_jitter"), F.avg((F.col("_dev") < near).cast("double")).alias("modulation_mitigation"),
                                (pct(0.999) - pct(0.001)).alias("sequence_range"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _power(x: pd.Series) -> pd.Series:
    """Power of the real Fourier bins of each array."""
    return x.map(lambda a: np.abs(np.fft.rfft(a)) ** 2)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _peak(spec: str) -> Column:
    """Bin of the strongest non-constant component (first on ties)."""
    body = F.slice(spec, 2, F.greatest(F.size(spec) - 1, F.lit(1)))
    return F.array_position(body, F.array_max(body)).cast("int")


def _band_share(spec: Column, n: Column, fps: float, lo: Column, hi: Column) -> Column:
    band = F.filter(F.transform(spec, lambda p, k: F.struct(p.alias("p"), (k * fps / n).alias("f"))), lambda e: (e["f"] > lo) & (e["f"] < hi))
    return F.aggregate(band, F.lit(0.0), lambda s, e: s + e["p"]) / (_sum(spec) + EPS)


def spectral_flicker(df: DataFrame, keys: Sequence[str], luma: str = "luma", fps: float = 10.0, band_hz: float = 0.5, thr: float = 0.05,
                     win_sec: float = 3.0, hop_ratio: float = 0.5, min_peak: float = 0.2) -> DataFrame:
    """Flicker power near the dominant frequency, its alias form, and the share of windows without alias energy.

    The spectrum is taken over the frames of one clip, whose number is fixed.
    """
    rows = by_key(df, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", F.col(luma).alias("l")))).alias("_r"))
    d = rows.select(*keys, F.transform("_r", lambda e: e["l"]).alias("_x")).withColumn("_n", F.size("_x"))
    d = d.withColumn("_p", _power("_x"))
    d = d.withColumn("_f", _peak("_p") * fps / F.col("_n"))
    width = F.greatest(F.lit(0.5), 0.2 * F.col("_f"))
    few = F.size("_p") < 3
    d = d.withColumns({
        "modulation_power": F.when(few, 0.0).otherwise(_band_share(F.col("_p"), F.col("_n"), fps, F.col("_f") - 2, F.col("_f") + 2)),
        "fmp_alias": F.when(few | (F.col("_f") < min_peak), 0.0).otherwise(_band_share(F.col("_p"), F.col("_n"), fps, F.col("_f") - width, F.col("_f") + width)),
    })
    full = max(8, round(win_sec * fps))
    hop_full = max(1, round(full * hop_ratio))
    short = F.col("_n") < full
    win = F.when(short, F.col("_n")).otherwise(full)
    hop = F.when(short, F.greatest(F.lit(1), F.floor(F.col("_n") / 2).cast("int"))).otherwise(hop_full)
    d = d.withColumns({"_win": win, "_hop": hop})
    starts = F.sequence(F.lit(0), F.col("_n") - F.col("_win"), F.col("_hop"))
    w = d.where("_n >= 4").select(*keys, "_f", F.explode(starts).alias("_s"), "_x", "_win")
    w = w.withColumn("_wx", F.slice("_x", F.col("_s") + 1, F.col("_win"))).withColumn("_wp", _power("_wx"))
    share = _band_share(F.col("_wp"), F.col("_win"), fps, F.col("_f") - band_hz, F.col("_f") + band_hz)
    hit = w.groupBy(*keys).agg(F.avg((share < thr).cast("double")).alias("_hit"))
    out = d.join(hit, list(keys), "left")
    mmp = F.when(F.col("_n") < 4, 0.0).when(F.col("_f") < 0.2, 1.0).otherwise(F.col("_hit"))
    return out.select(*keys, "modulation_power", "fmp_alias", mmp.alias("mmp_alias"))


def led_flicker_index(df: DataFrame, keys: Sequence[str], luma: str = "luma", fps: float = 10.0, freq_hz: float | None = None, band_hz: float = 2.0) -> DataFrame:
    """Share of the luminance power within ``band_hz`` of a known flicker frequency, or of the strongest one where none is given.

    The spectrum is taken over the frames of one clip. A clip without any frequency but the constant one has no flicker
    of its own; the share around a given frequency is taken from the bins there are.
    """
    rows = by_key(df, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", F.col(luma).alias("l")))).alias("_r"))
    d = rows.select(*keys, F.transform("_r", lambda e: e["l"]).alias("_x")).withColumn("_n", F.size("_x")).withColumn("_p", _power("_x"))
    peak = F.lit(float(freq_hz)) if freq_hz is not None else F.when(F.size("_p") > 1, _peak("_p") * fps / F.col("_n"))
    d = d.withColumn("_f", peak)
    share = _band_share(F.col("_p"), F.col("_n"), fps, F.col("_f") - band_hz, F.col("_f") + band_hz)
    return d.select(*keys, F.when(F.col("_f").isNull(), 0.0).otherwise(share).alias("led_flicker_index"))

"""Tracks: trimming, sampling, summaries, counters, and tracker result scoring.

A clip has a fixed maximum number of frames, so the windows and folds below run
over bounded groups whatever the number of tracks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.functions import boxes as bx
from wayscore.functions.numeric import dist
from wayscore.operators.boxjoin import top_rows


def trim_at_gap(df: DataFrame, keys: Sequence[str], frame: str = "frame", max_gap: int = 10) -> DataFrame:
    """Each track up to its first gap of more than ``max_gap`` frames."""
    w = W.partitionBy(*keys).orderBy(frame)
    gap = (F.col(frame) - F.lag(frame).over(w) > max_gap).cast("int")
    d = df.withColumn("_gap", F.coalesce(gap, F.lit(0)))
    d = d.withColumn("_seen", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.where("_seen = 0").drop("_gap", "_seen")


def disappearance_frames(df: DataFrame, keys: Sequence[str], frame: str = "frame", last_frame: int = 100, min_len: int = 2) -> DataFrame:
    """Frames to inspect around the end of a track that stops before the video does.

    Roles: the first two frames, the fifth frame from the end and the last one, and
    the two frames after the track (clamped to the video).
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(frame)).alias("f"))
    g = g.where((F.size("f") >= min_len) & (F.element_at("f", -1) != last_frame))
    n, last = F.size("f"), F.element_at("f", -1)
    picks = F.array(
        F.struct(F.lit("first").alias("role"), F.lit(0).alias("slot"), F.element_at("f", 1).alias("at")),
        F.struct(F.lit("first").alias("role"), F.lit(1).alias("slot"), F.element_at("f", 2).alias("at")),
        F.struct(F.lit("last").alias("role"), F.lit(0).alias("slot"), F.element_at("f", F.greatest(F.lit(1), n - 4)).alias("at")),
        F.struct(F.lit("last").alias("role"), F.lit(1).alias("slot"), last.alias("at")),
        F.struct(F.lit("next").alias("role"), F.lit(0).alias("slot"), (last + 1).alias("at")),
        F.struct(F.lit("next").alias("role"), F.lit(1).alias("slot"), F.when(last + 2 <= last_frame, last + 2).otherwise(last + 1).alias("at")))
    return g.select(*keys, F.explode(picks).alias("p")).select(*keys, "p.role", "p.slot", F.col("p.at").alias("frame"))


def sample_track(df: DataFrame, keys: Sequence[str], keep_last: int, total_keep: int | None = None, stride: int | None = None,
                 frame: str = "frame") -> DataFrame:
    """Thin a track: the last ``keep_last`` rows stay, the front is spread by budget or stride."""
    if (total_keep is None) == (stride is None):
        raise ValueError("give exactly one of total_keep and stride")
    w = W.partitionBy(*keys)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(frame)) - 1, "_n": F.count(F.lit(1)).over(w)})
    front = F.col("_n") - keep_last
    tail = F.col("_i") >= front
    if stride is not None:
        early = (F.col("_i") % stride == 0) & (F.col("_i") < front - 1)
    else:
        budget = max(total_keep - keep_last, 1)
        if budget == 1:
            early = F.col("_i") == 0
        else:
            picks = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)),
                                lambda i: F.bround(i * (front - 1) / (budget - 1)).cast("int"))
            early = F.array_contains(picks, F.col("_i").cast("int")) & (F.col("_i") < front - 1)
        early = F.when(F.lit(total_keep) >= F.col("_n"), F.lit(True)).otherwise(early)
    return d.where((F.col("_n") <= keep_last) | tail | early).drop("_i", "_n")


def direction(dx: Column, dy: Column, still: Column) -> Column:
    """Name of a displacement; ties between the axes go to the horizontal one."""
    return (
        F.when(dist(dx, dy) < still, "stationary")
        .when(F.abs(dx) >= F.abs(dy), F.when(dx > 0, "rightward").otherwise("leftward"))
        .otherwise(F.when(dy > 0, "downward").otherwise("upward")))


def summarize_tracks(df: DataFrame, video: Sequence[str], width: float, height: float) -> DataFrame:
    """One row per track: modal class, frames seen, end points, displacement, direction, mean confidence."""
    keys = [*video, "track_id"]
    diag = math.sqrt(width * width + height * height)
    by_class = df.groupBy(*keys, "class_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("f"), F.sum("conf").alias("c"),
        F.min_by(F.struct("cx", "cy"), "frame").alias("a"), F.max_by(F.struct("cx", "cy"), "frame").alias("b"), F.max("frame").alias("l"))
    g = by_class.groupBy(*keys).agg(
        F.max_by("class_name", F.struct("n", -F.col("f"))).alias("class_name"), F.sum("n").alias("frames_seen"),
        F.min("f").alias("first_frame"), F.max("l").alias("last_frame"), (F.sum("c") / F.sum("n")).alias("_conf"),
        F.min_by("a", "f").alias("a"), F.max_by("b", "l").alias("b"))
    dx, dy = F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy")
    d = dist(dx, dy)
    return g.select(
        *keys, "class_name", "frames_seen", "first_frame", "last_frame", F.bround("_conf", 3).alias("avg_conf"),
        F.bround("a.cx", 1).alias("start_x"), F.bround("a.cy", 1).alias("start_y"), F.bround("b.cx", 1).alias("end_x"),
        F.bround("b.cy", 1).alias("end_y"), F.bround(d, 2).alias("displacement_px"), F.bround(d / diag, 4).alias("displacement_norm"),
        direction(dx, dy, F.lit(0.04 * diag)).alias("direction"))


def video_track_counts(tracks: DataFrame, video: Sequence[str], vehicles: Sequence[str], persons: Sequence[str], lights: Sequence[str]) -> DataFrame:
    """Counts per video over track summaries."""
    name = F.lower("class_name")
    n = lambda cond: F.sum(cond.cast("int"))
    return tracks.groupBy(*video).agg(
        F.sum("frames_seen").alias("num_detections"), F.count(F.lit(1)).alias("num_unique_tracks"),
        n(name.isin(*vehicles)).alias("num_vehicle_tracks"),
        n(name.isin(*vehicles) & (F.col("direction") != "stationary")).alias("num_moving_vehicle_tracks"),
        n(name.isin(*persons)).alias("num_person_tracks"), n(name.isin(*lights)).alias("num_traffic_light_tracks"))


def top_tracks(tracks: DataFrame, video: Sequence[str], k: int = 50) -> DataFrame:
    """Longest-seen tracks per video, farther-moving first among equals."""
    return top_rows(tracks, video, [F.col("frames_seen").desc(), F.col("displacement_px").desc(), "track_id"], k, ["track_id"])


# ---- counters -------------------------------------------------------------------------

def in_polygon(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Strictly inside test by counting edge crossings of a ray to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
        if y1 == y2:
            continue
        at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
        crossings = crossings + (((y > y1) != (y > y2)) & (x < at)).cast("int")
    return crossings % 2 == 1


def region_transitions(df: DataFrame, keys: Sequence[str], region: Sequence[tuple[float, float]], order: str = "frame") -> DataFrame:
    """Rows where a track enters or leaves a polygon, or changes side of a line (two points).

    The first row of a track only sets its side. For a line the side needs a
    previous position, so the second row always counts.
    """
    w = W.partitionBy(*keys).orderBy(order)
    if len(region) >= 3:
        d = df.withColumn("_in", in_polygon(F.col("cx"), F.col("cy"), region))
        d = d.withColumn("_was", F.lag("_in").over(w))
        changed = F.col("_was").isNotNull() & (F.col("_was") != F.col("_in"))
    else:
        mid = (region[0][0] + region[1][0]) / 2
        px = F.lag("cx").over(w)
        d = df.withColumn("_in", (F.col("x1") - px) * (mid - px) > 0)
        d = d.withColumn("_was", F.lag("_in").over(w))
        changed = F.col("_in").isNotNull() & (F.col("_was").isNull() | (F.col("_was") != F.col("_in")))
    return d.where(changed).withColumn("move", F.when(F.col("_in"), "in").otherwise("out")).drop("_in", "_was")


def crossing_speed(df: DataFrame, keys: Sequence[str], x_range: tuple[float, float], lines: Sequence[float], near: float, time: Column,
                   order: str = "frame") -> DataFrame:
    """Speed of each track at its first line hit, from its previous point inside the zone (event time)."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.where((F.col("cx") > x_range[0]) & (F.col("cx") < x_range[1])).withColumn("_t", time)
    d = d.withColumns({"_pt": F.lag("_t").over(w), "_py": F.lag("cy").over(w)})
    hit = F.lit(False)
    for y in lines:
        hit = hit | ((F.col("cy") > y - near) & (F.col("cy") < y + near))
    first = d.where(hit & F.col("_pt").isNotNull()).groupBy(*keys).agg(F.min_by(F.struct("cy", "_py", "_t", "_pt"), F.col(order)).alias("h"))
    dtm = F.col("h._t") - F.col("h._pt")
    return first.where(dtm > 0).select(*keys, (F.abs(F.col("h.cy") - F.col("h._py")) / dtm).alias("speed"))


def heat_cells(df: DataFrame, keys: Sequence[str], last_frame: Column | int, decay: float = 0.99, circle: bool = False) -> DataFrame:
    """Decayed coverage per cell: every box adds 2 to its cells, and all cells decay each frame."""
    d = df.withColumns({"_y": F.explode(F.sequence(F.col("y1").cast("int"), F.col("y2").cast("int") - 1))})
    d = d.withColumn("_x", F.explode(F.sequence(F.col("x1").cast("int"), F.col("x2").cast("int") - 1)))
    if circle:
        cx, cy = F.floor((F.col("x1") + F.col("x2")) / 2), F.floor((F.col("y1") + F.col("y2")) / 2)
        r = F.floor(F.least(F.col("x2").cast("int") - F.col("x1").cast("int"), F.col("y2").cast("int") - F.col("y1").cast("int")) / 2)
        d = d.where((F.col("_x") - cx) * (F.col("_x") - cx) + (F.col("_y") - cy) * (F.col("_y") - cy) <= r * r)
    age = (F.lit(last_frame) if isinstance(last_frame, int) else last_frame) - F.col("frame")
    return d.groupBy(*keys, F.col("_y").alias("y"), F.col("_x").alias("x")).agg(F.sum(2 * F.pow(F.lit(decay), age)).alias("heat"))


def first_region_visits(df: DataFrame, keys: Sequence[str], region: Sequence[tuple[float, float]], order: str = "frame") -> DataFrame:
    """Each track once, when its centre is first inside: in when its box starts right of the centre, else out."""
    mid = sum(p[0] for p in region) / len(region)
    d = df.where(in_polygon(F.col("cx"), F.col("cy"), region))
    f = d.groupBy(*keys).agg(F.min_by("x1", order).alias("_x"), F.min(order).alias("frame"))
    return f.select(*keys, "frame", F.when(F.col("_x") < mid, "out").otherwise("in").alias("move"))


def pair_distance(df: DataFrame, chosen: DataFrame, frame_keys: Sequence[str], px_per_m: float) -> DataFrame:
    """Distance per frame of the chosen pairs (columns a, b) of tracks."""
    a = df.select(*frame_keys, F.col("track_id").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = df.select(*frame_keys, F.col("track_id").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    on = [c for c in chosen.columns if c not in ("a", "b")]
    d = a.join(chosen, [*on, "a"]).join(b, [*frame_keys, "b"])
    px = dist(F.floor("ax") - F.floor("bx"), F.floor("ay") - F.floor("by"))
    return d.select(*frame_keys, "a", "b", px.alias("pixels"), (px / px_per_m).alias("metres"))


def joint_angle(ax, ay, bx_, by, cx, cy) -> Column:
    """Angle at b between a and c in degrees, at most 180."""
    turn = F.abs(F.degrees(F.atan2(cy - by, cx - bx_) - F.atan2(ay - by, ax - bx_)))
    return F.when(turn > 180, 360 - turn).otherwise(turn)


def count_repetitions(df: DataFrame, keys: Sequence[str], angle: Column, up: float, down: float, order: str = "frame") -> DataFrame:
    """Repetitions by hysteresis: the angle passes above ``up`` and then falls below ``down``."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_z", F.when(angle > up, "up").when(angle < down, "down"))
    d = d.withColumn("_was", F.last("_z", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    rep = (F.col("_z") == "down") & (F.col("_was") == "up")
    return d.groupBy(*keys).agg(
        F.sum(F.coalesce(rep, F.lit(False)).cast("int")).alias("repetitions"),
        F.max_by("_z", F.when(F.col("_z").isNotNull(), F.col(order))).alias("stage"))


def track_history(df: DataFrame, keys: Sequence[str], size: int = 30, order: str = "frame") -> DataFrame:
    """The last ``size`` centres up to each row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(size - 1), 0)
    return df.withColumn("history", F.collect_list(F.struct("cx", "cy")).over(w))


def stable_streak(df: DataFrame, keys: Sequence[str], good: Column, order: str = "frame") -> DataFrame:
    """Length of the run of good frames that ends at each row; a bad frame resets it."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_good", good.cast("int"))
    d = d.withColumn("_run", F.sum(1 - F.col("_good")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    wr = W.partitionBy(*keys, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("stable_frames", F.sum("_good").over(wr)).drop("_good", "_run")


def memory_frames(df: DataFrame, keys: Sequence[str], passing: Column, size: int, order: str = "frame") -> DataFrame:
    """For each row the earlier frames a memory would use: the last passing ones plus the frame before it."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumn("_ok", F.when(passing & (F.col(order) > 1), F.col(order)))
    d = d.withColumns({"_all": F.collect_list("_ok").over(w), "_prev": F.lag(order).over(W.partitionBy(*keys).orderBy(order))})
    near = F.slice("_all", F.greatest(F.size("_all") - size + 1, F.lit(1)), size)
    out = F.when(F.col("_prev").isNull() | F.array_contains(near, F.col("_prev")), near).otherwise(F.array_append(near, F.col("_prev")))
    return d.withColumn("memory", out).drop("_ok", "_all", "_prev")


def occlusion(df: DataFrame, frame_keys: Sequence[str], width: float, height: float, iou_min: float = 0.5, margin: float = 0.05) -> DataFrame:
    """Per track: frames in which another track overlaps it while it is away from the edges."""
    from wayscore.operators.boxjoin import GEOM, overlap_pairs
    a = df.select(*frame_keys, "track_id", *[F.col(g).alias(f"a_{g}") for g in GEOM]).where(~bx.near_edge(bx.box("a_"), width, height, margin))
    b = df.select(*frame_keys, F.col("track_id").alias("other"), *[F.col(g).alias(f"b_{g}") for g in GEOM])
    hit = overlap_pairs(a, b, frame_keys).where(F.col("track_id") != F.col("other")).where(
        bx.iou(bx.box("a_"), bx.box("b_"), 1e-9) >= iou_min).select(*frame_keys, "track_id").distinct()
    flagged = df.join(hit.withColumn("_occ", F.lit(1)), [*frame_keys, "track_id"], "left")
    tk = [k for k in frame_keys if k != "frame"]
    return flagged.groupBy(*tk, "track_id").agg(
        F.coalesce(F.sum("_occ"), F.lit(0)).alias("n_occluded"), (F.coalesce(F.sum("_occ"), F.lit(0)) / F.count(F.lit(1))).alias("ratio"),
        F.array_sort(F.collect_list(F.when(F.col("_occ") == 1, F.col("frame")))).alias("frames"))


# ---- set operations on track lists ------------------------------------------------------

def join_tracks(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``first`` and those of ``second`` whose id is not in it."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def subtract_tracks(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first.join(second.select(*keys).distinct(), list(keys), "left_anti")


def drop_duplicate_tracks(a: DataFrame, b: DataFrame, keys: Sequence[str], max_distance: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Of overlapping tracks (IoU distance below the limit) the longer-lived one stays; equal lives keep ``b``."""
    from wayscore.operators.boxjoin import GEOM, overlap_pairs
    pa = a.select(*keys, F.col("track_id").alias("ta"), F.col("age").alias("age_a"), *[F.col(g).alias(f"a_{g}") for g in GEOM])
    pb = b.select(*keys, F.col("track_id").alias("tb"), F.col("age").alias("age_b"), *[F.col(g).alias(f"b_{g}") for g in GEOM])
    dup = overlap_pairs(pa, pb, keys).where(1 - bx.iou(bx.box("a_"), bx.box("b_")) < max_distance)
    drop_b = dup.where("age_a > age_b").select(*keys, F.col("tb").alias("track_id")).distinct()
    drop_a = dup.where("age_a <= age_b").select(*keys, F.col("ta").alias("track_id")).distinct()
    on = [*keys, "track_id"]
    return a.join(drop_a, on, "left_anti"), b.join(drop_b, on, "left_anti")


# ---- tracker result scoring ---------------------------------------------------------------

OVERLAP_LEVELS = tuple(round(0.05 * i, 2) for i in range(21))
CENTER_LEVELS = tuple(float(i) for i in range(51))
NORM_LEVELS = tuple(i / 100.0 for i in range(51))


def tracking_errors(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlap and centre errors per frame of predicted (px, py, pw, ph) against true (x, y, w, h) boxes.

    A zero-size prediction takes the last usable one, frame 0 takes the truth, and
    frames with an empty truth box are invalid: overlap and normalised error -1,
    centre error null.
    """
    w = W.partitionBy(*keys).orderBy("frame")
    box_ = F.struct("px", "py", "pw", "ph")
    usable = (F.row_number().over(w) == 1) | ((F.col("pw") != 0) & (F.col("ph") != 0))
    d = df.withColumns({"_use": usable, "_first": F.row_number().over(w) == 1})
    d = d.withColumn("_p", F.last(F.when(F.col("_use"), box_), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    take = lambda p, t: F.when(F.col("_first"), F.col(t)).otherwise(F.col(f"_p.{p}"))
    d = d.withColumns({"px": take("px", "x"), "py": take("py", "y"), "pw": take("pw", "w"), "ph": take("ph", "h")})
    valid = (F.col("w") > 0) & (F.col("h") > 0)
    cdx = (F.col("px") + 0.5 * (F.col("pw") - 1)) - (F.col("x") + 0.5 * (F.col("w") - 1))
    cdy = (F.col("py") + 0.5 * (F.col("ph") - 1)) - (F.col("y") + 0.5 * (F.col("h") - 1))
    iw = F.greatest(F.least(F.col("px") + F.col("pw"), F.col("x") + F.col("w")) - F.greatest("px", "x"), F.lit(0.0))
    ih = F.greatest(F.least(F.col("py") + F.col("ph"), F.col("y") + F.col("h")) - F.greatest("py", "y"), F.lit(0.0))
    union = F.col("pw") * F.col("ph") + F.col("w") * F.col("h") - iw * ih
    return d.withColumns({
        "valid": valid,
        "overlap": F.when(valid, iw * ih / F.nullif(union, F.lit(0.0))).otherwise(-1.0),
        "center_error": F.when(valid, dist(cdx, cdy)),
        "norm_error": F.when(valid, dist(cdx / F.nullif(F.col("w"), F.lit(0.0)), cdy / F.nullif(F.col("h"), F.lit(0.0)))).otherwise(-1.0),
    }).drop("_use", "_first", "_p")


def success_curves(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of frames above each overlap level and within each centre-error level, per sequence."""
    share = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("int")) / F.count(F.lit(1))
    return errors.groupBy(*keys).agg(
        F.array(*[share(F.col("overlap") > t) for t in OVERLAP_LEVELS]).alias("overlap_curve"),
        F.array(*[share(F.col("center_error") <= t) for t in CENTER_LEVELS]).alias("center_curve"),
        F.array(*[share(F.col("norm_error") <= t) for t in NORM_LEVELS]).alias("norm_curve"),
        F.avg(F.when(F.col("valid"), F.col("overlap"))).alias("mean_overlap"))


def merge_runs(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of repeated runs, point by point; ``keys`` leave the run out."""
    out = None
    parts = {}
    for c, n in (("overlap_curve", 21), ("center_curve", 51), ("norm_curve", 51)):
        parts[c] = F.array(*[F.avg(F.col(c)[i]) for i in range(n)]).alias(c)
    out = curves.groupBy(*keys).agg(*parts.values(), F.avg("mean_overlap").alias("mean_overlap"))
    return out


def tracking_summary(curves: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC, success at .5 and .75, precision at 20 px and normalised precision at .2, in percent."""
    auc = sum((F.col("overlap_curve")[i] for i in range(21)), F.lit(0.0)) / 21
    return curves.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sequences"), (F.avg(auc) * 100).alias("auc"),
        (F.avg(F.col("overlap_curve")[10]) * 100).alias("op50"), (F.avg(F.col("overlap_curve")[15]) * 100).alias("op75"),
        (F.avg(F.col("center_curve")[20]) * 100).alias("precision20"), (F.avg(F.col("norm_curve")[20]) * 100).alias("norm_precision"))

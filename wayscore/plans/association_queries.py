"""Filtering, assignment and tracking on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayscore.operators import association as ac
from wayscore.operators import trackfilter as tf
from wayscore.plans import views as v
from wayscore.plans.registry import query
from wayscore.plans.track_queries import TK, tbox

KEYS = "video_id:l clip:l track_id:l"


def filter_sql() -> str:
    """The filter frame by frame: every frame predicts, a frame with a box corrects."""
    xyah = "xyah"
    deviation = lambda i, weight, fixed, h: fixed if i == "a" else f"{weight}*{h}"
    start = ", ".join(
        f"{i} AS m{i}, 0.0::DOUBLE AS v{i}, pow(2*{deviation(i, '0.05::DOUBLE', '0.5e-2::DOUBLE', 'h')},2) AS p{i}, 0.0::DOUBLE AS c{i}, "
        f"pow(10*{deviation(i, '(1/160::DOUBLE)', '1e-6::DOUBLE', 'h')},2) AS s{i}" for i in xyah)
    predict = ", ".join(
        f"m{i}+v{i} AS m{i}, v{i}, p{i}+2*c{i}+s{i}+pow({deviation(i, '0.05::DOUBLE', '1e-2::DOUBLE', 'mh')},2) AS p{i}, c{i}+s{i} AS c{i}, "
        f"s{i}+pow({deviation(i, '(1/160::DOUBLE)', '1e-5::DOUBLE', 'mh')},2) AS s{i}" for i in xyah)
    total = ", ".join(f"p{i}+pow({deviation(i, '0.05::DOUBLE', '1e-1::DOUBLE', 'mh')},2) AS e{i}" for i in xyah)
    either = lambda n, value: f"CASE WHEN hit THEN {value} ELSE {n} END AS {n}"
    correct = ", ".join(
        ", ".join([either(f"m{i}", f"m{i}+p{i}/e{i}*({i}-m{i})"), either(f"v{i}", f"v{i}+c{i}/e{i}*({i}-m{i})"), either(f"p{i}", f"p{i}-p{i}*p{i}/e{i}"),
                   either(f"c{i}", f"c{i}-p{i}*c{i}/e{i}"), either(f"s{i}", f"s{i}-c{i}*c{i}/e{i}")]) for i in xyah)
    gate = "+".join(f"pow({i}-m{i},2)/e{i}" for i in xyah)
    return f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT video_id, clip, track_id, gframe AS frame, cx AS x, cy AS y, 0.5::DOUBLE+k%10/20::DOUBLE AS a, (30+k%20)::DOUBLE AS h,
 min(gframe) OVER w AS lo, max(gframe) OVER w AS hi FROM tracks WINDOW w AS (PARTITION BY video_id, clip, track_id)),
f AS (SELECT video_id, clip, track_id, frame, hi, true AS hit, 0.0::DOUBLE AS gate, {start} FROM o WHERE frame = lo
UNION ALL SELECT video_id, clip, track_id, frame, hi, hit, CASE WHEN hit THEN {gate} END AS gate, {correct}
 FROM (SELECT g.*, {total}, o.x, o.y, o.a, o.h, o.frame IS NOT NULL AS hit FROM (SELECT video_id, clip, track_id, frame+1 AS frame, hi, {predict} FROM f WHERE frame < hi) g
  LEFT JOIN o ON o.video_id=g.video_id AND o.clip=g.clip AND o.track_id=g.track_id AND o.frame=g.frame))
SELECT video_id, clip, track_id, frame, mx AS x, my AS y, ma AS a, mh AS h, round_even(gate, 3) AS gate FROM f WHERE hit"""


@query("filtered_track_states", "E18", f"{KEYS} frame:l x y a h gate", "tracks", filter_sql())
def _(spark, d):
    t = v.tracks(spark, d).select(*TK, F.col("gframe").alias("frame"), F.col("cx").alias("x"), F.col("cy").alias("y"), (0.5 + F.col("k") % 10 / 20).alias("a"),
                                  (30.0 + F.col("k") % 20).alias("h"))
    return tf.filter_tracks(t, TK).withColumn("gate", F.bround("gate", 3))


def _frame_sides(spark, d):
    """Tracks of one frame and, as detections, the boxes of the next; both with an embedding."""
    t = tbox(spark, d).withColumn("look", F.array("cx", "cy", F.lit(20.0)))
    dets = t.select("video_id", "clip", (F.col("frame") - 1).alias("frame"), F.col("track_id").alias("det_id"), "x1", "y1", "x2", "y2", "conf", "look")
    return t, dets


FRAME = ["video_id", "clip", "frame"]


@query("frame_assignments", "F10", "video_id:l clip:l frame:l track_id:l det_id:l cost")
def _(spark, d):
    return ac.assign_frames(*_frame_sides(spark, d), FRAME)


@query("frame_assignments_by_appearance", "F10", "video_id:l clip:l frame:l track_id:l det_id:l cost")
def _(spark, d):
    return ac.assign_frames(*_frame_sides(spark, d), FRAME, feature="look")


def totals_sql(cost: str) -> str:
    """The least total over all assignments of a frame, tried one by one."""
    over = "OVER (PARTITION BY video_id, clip, frame ORDER BY track_id)-1"
    wh = lambda c: f"greatest(least(t.{c}2,d.{c}2)-greatest(t.{c}1,d.{c}1),0)"
    return f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT *, sqrt(cx*cx+cy*cy+400) AS norm, row_number() {over} AS i, count(*) OVER (PARTITION BY video_id, clip, frame) AS n FROM tbox),
p AS (SELECT t.video_id, t.clip, t.frame, t.i, t.n, d.n AS m, d.i AS j, d.conf, {wh('x')}*{wh('y')} AS inter, (t.x2-t.x1)*(t.y2-t.y1)+(d.x2-d.x1)*(d.y2-d.y1) AS areas,
 greatest(0, 1-(t.cx*d.cx+t.cy*d.cy+400)/(t.norm*d.norm))/2 AS look FROM b t JOIN b d ON d.video_id=t.video_id AND d.clip=t.clip AND d.frame=t.frame+1),
o AS (SELECT *, inter/(areas-inter+1e-7) AS iou FROM p), c AS MATERIALIZED (SELECT video_id, clip, frame, n, m, i, j, {cost} AS cost FROM o),
x AS MATERIALIZED (SELECT video_id, clip, frame, i, j, cost FROM c WHERE cost <= 0.8::DOUBLE UNION ALL SELECT DISTINCT video_id, clip, frame, i, -1, 0 FROM c),
r AS (SELECT DISTINCT video_id, clip, frame, n, m, 0::BIGINT AS i, 0::BIGINT AS taken, 0::BIGINT AS pairs, 0.0::DOUBLE AS spent FROM c
 UNION ALL SELECT r.video_id, r.clip, r.frame, r.n, r.m, r.i+1, CASE WHEN j < 0 THEN taken ELSE taken | (1::BIGINT << j) END, CASE WHEN j < 0 THEN pairs ELSE pairs+1 END, spent+cost
 FROM r JOIN x ON x.video_id=r.video_id AND x.clip=r.clip AND x.frame=r.frame AND x.i=r.i AND (j < 0 OR taken & (1::BIGINT << j) = 0))
SELECT video_id, clip, frame, min(spent+(n+m-2*pairs)*0.8::DOUBLE/2) AS total FROM r WHERE i = n GROUP BY video_id, clip, frame"""


@query("frame_assignment_totals", "F10", "video_id:l clip:l frame:l total", "tbox", totals_sql("1-iou*conf"))
def _(spark, d):
    sides = _frame_sides(spark, d)
    return ac.assignment_totals(ac.assign_frames(*sides, FRAME), *sides, FRAME)


@query("frame_assignment_totals_by_appearance", "F10 E19", "video_id:l clip:l frame:l total", "tbox",
       totals_sql("least(1-iou*conf, CASE WHEN look > 0.25 OR 1-iou > 0.5 THEN 1.0 ELSE look END)"))
def _(spark, d):
    sides = _frame_sides(spark, d)
    return ac.assignment_totals(ac.assign_frames(*sides, FRAME, feature="look"), *sides, FRAME)


def smooth_boxes(spark, d):
    """Slow-moving boxes, so that tracks persist over frames."""
    t = v.tracks(spark, d)
    x, y = F.col("track_id") % 4 * 60.0 + F.col("frame") + F.col("k") % 3, F.col("frame") * 0.5 + F.col("k") % 2
    return t.select("video_id", "clip", "frame", F.col("track_id").alias("det_id"), "conf", x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 50).alias("y2"))


@query("tracked_objects", "H4 G2 G3 F10 E18", "video_id:l clip:l frame:l track:l det_id:l score x1 y1 x2 y2")
def _(spark, d):
    return ac.track_clips(smooth_boxes(spark, d), ["video_id", "clip"])


@query("tracked_objects_by_appearance", "H4 F10 E19", "video_id:l clip:l frame:l track:l det_id:l score x1 y1 x2 y2")
def _(spark, d):
    look = F.array(F.lit(1.0), (F.col("det_id") % 4).cast("double"), F.col("x1") / 100)
    return ac.track_clips(smooth_boxes(spark, d).withColumn("look", look), ["video_id", "clip"], "look")

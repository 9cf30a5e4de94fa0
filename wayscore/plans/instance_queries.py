"""Average precision of masks, rotated boxes and keypoints on the driver tables.

Each family has its own detections, labels and overlap table; matching and curves are those of the boxes.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wayscore.operators import detection as dt
from wayscore.operators import instances as ins
from wayscore.operators import raster as ra
from wayscore.plans import detection_queries as dq
from wayscore.plans import views as v
from wayscore.plans.registry import query

SIGMAS = tuple(0.05 + i * 0.02 for i in range(1, 5))


def _family(prefix: str, dets: str, labels: str, pairs: str) -> None:
    """Check views of one family: those of the boxes on other detections, labels and overlaps."""
    v._sql(f"{prefix}dets", *dets)
    v._sql(f"{prefix}lbls", *labels)
    v._sql(f"{prefix}pairs", *pairs)
    v._sql(f"{prefix}claims_", f"""SELECT image_id, cls, det_id, label_id, iou FROM {prefix}pairs WHERE iou >= 0.5
 QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, label_id) = 1""", f"{prefix}pairs")
    for name, deps in (("wins_", ("claims_",)), ("flags_", ("wins_", "dets")), ("prc_", ("flags_",)), ("ap_", ("prc_", "lbls"))):
        v._sql(prefix + name, re.sub(r"\b(claims_|wins_|flags_|prc_|dets|lbls)(?=[\s).])", lambda m: prefix + m[1], v.SQL_VIEWS[name] + " ").strip(), *[prefix + x for x in deps])


def _precision(dets, labels, overlaps):
    rounded = overlaps.withColumn("iou", F.round("iou", 9))  # engines differ in the last digits of exp and ln
    return dt.average_precision(dt.match_detections(dets, labels, overlaps=rounded), labels)


# ---- masks -------------------------------------------------------------------------------------------

_family(
    "m",
    ("SELECT DISTINCT image_id//8 AS image_id, image_id%3 AS cls, 2*image_id+t AS det_id, ((image_id*37+t*11)%100)::DOUBLE/100 AS conf FROM pixels, (VALUES (0),(1)) x(t)", "pixels"),
    ("SELECT DISTINCT image_id//8 AS image_id, image_id%3 AS cls, image_id AS label_id FROM pixels", "pixels"),
    ("""
SELECT i.*, n::DOUBLE/(a+b-n+1e-7) AS iou FROM (
 WITH p AS (SELECT image_id//8 AS image_id, image_id%3 AS cls, 2*image_id+t AS det_id, y, x FROM pixels, (VALUES (0),(1)) x(t) WHERE luma > 100+(image_id*7+t*13)%60),
 l AS (SELECT image_id//8 AS image_id, image_id%3 AS cls, image_id AS label_id, y, x FROM pixels WHERE luma > 130),
 pa AS (SELECT det_id, count(*) AS a FROM p GROUP BY det_id), la AS (SELECT label_id, count(*) AS b FROM l GROUP BY label_id)
 SELECT image_id, cls, det_id, label_id, a, b, count(*) AS n FROM p JOIN l USING (image_id, cls, y, x) JOIN pa USING (det_id) JOIN la USING (label_id) GROUP BY ALL) i""", "pixels"),
)


def _mask_tables(spark, d):
    p = v.pixels(spark, d)
    image, cls = v.div("image_id", 8).alias("image_id"), (F.col("image_id") % 3).alias("cls")
    labels = ra.run_lengths(p, ["image_id"], F.col("luma") > 130).select(F.col("image_id").alias("label_id"), image, cls, "counts")
    each = p.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1))))
    cut = ra.run_lengths(each, ["image_id", "t"], F.col("luma") > 100 + (F.col("image_id") * 7 + F.col("t") * 13) % 60)
    conf = ((F.col("image_id") * 37 + F.col("t") * 11) % 100).cast("double") / 100
    dets = cut.select((2 * F.col("image_id") + F.col("t")).alias("det_id"), conf.alias("conf"), image, cls, "counts")
    return dets, labels


@query("average_precision_masks", "D22 C9 B29", "cls:l lvl:l ap", "map_", "SELECT * FROM map_")
def masks(spark, d):
    dets, labels = _mask_tables(spark, d)
    return _precision(dets, labels, ins.mask_pairs(dets, labels, chunk=16))


# ---- rotated boxes -------------------------------------------------------------------------------------------

_PROB = """
WITH p AS (SELECT d.image_id, d.cls, d.det_id, l.label_id, (d.x1+d.x2)/2 AS xa, (d.y1+d.y2)/2 AS ya, (l.x1+l.x2)/2 AS xb, (l.y1+l.y2)/2 AS yb,
  (d.x2-d.x1)*(d.x2-d.x1)/12 AS pa, (d.y2-d.y1)*(d.y2-d.y1)/12 AS pb, 0.3::DOUBLE+(d.det_id%5-2)::DOUBLE/20 AS ra, (l.x2-l.x1)*(l.x2-l.x1)/12 AS qa, (l.y2-l.y1)*(l.y2-l.y1)/12 AS qb, 0.3::DOUBLE AS rb
  FROM rdets d JOIN rlbls l ON d.image_id=l.image_id AND d.cls=l.cls),
c AS (SELECT *, pa*cos(ra)*cos(ra)+pb*sin(ra)*sin(ra) AS a1, pa*sin(ra)*sin(ra)+pb*cos(ra)*cos(ra) AS b1, (pa-pb)*cos(ra)*sin(ra) AS c1,
  qa*cos(rb)*cos(rb)+qb*sin(rb)*sin(rb) AS a2, qa*sin(rb)*sin(rb)+qb*cos(rb)*cos(rb) AS b2, (qa-qb)*cos(rb)*sin(rb) AS c2 FROM p),
e AS (SELECT *, (a1+a2)*(b1+b2)-(c1+c2)*(c1+c2) AS det FROM c),
f AS (SELECT *, ((a1+a2)*(ya-yb)*(ya-yb)+(b1+b2)*(xa-xb)*(xa-xb))/(det+1e-7)*0.25 + (c1+c2)*(xb-xa)*(ya-yb)/(det+1e-7)*0.5
  + 0.5*ln(det/(4*sqrt(greatest(a1*b1-c1*c1,0)*greatest(a2*b2-c2*c2,0))+1e-7)+1e-7) AS bd FROM e),
g AS (SELECT image_id, cls, det_id, label_id, 1-sqrt(1-exp(-least(greatest(bd,1e-7),100))+1e-7) AS iou FROM f)
SELECT image_id, cls, det_id, label_id, round(iou, 9) AS iou FROM g WHERE iou >= 0.5"""
_family("r", ("SELECT * FROM dets", "dets"), ("SELECT * FROM lbls", "lbls"), (_PROB, "rdets", "rlbls"))


def _rotated_tables(spark, d):
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    size = [(F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")]
    shape = lambda angle: [x.alias("cx"), y.alias("cy"), *size, angle.alias("angle")]
    dets = v.dets(spark, d).select("image_id", "det_id", "cls", "conf", *shape(0.3 + (F.col("det_id") % 5 - 2).cast("double") / 20))
    return dets, v.lbls(spark, d).select("image_id", "label_id", "cls", *shape(F.lit(0.3)))


@query("average_precision_rotated", "D22 C7", "cls:l lvl:l ap", "rap_", "SELECT * FROM rap_")
def rotated(spark, d):
    dets, labels = _rotated_tables(spark, d)
    return _precision(dets, labels, ins.rotated_pairs(dets, labels))


# ---- keypoints -------------------------------------------------------------------------------------------

_family("k", ("SELECT * FROM dets", "dets"), ("SELECT * FROM lbls", "lbls"), ("""
SELECT image_id, cls, det_id, label_id, round(oks, 9) AS iou FROM (
 SELECT d.image_id, d.cls, d.det_id, l.label_id,
  list_sum(list_transform([1,2,3,4], lambda i: CASE WHEN i = 1+(l.image_id+l.label_id)%4 THEN 0.0 ELSE
   exp(-(pow([d.x1,d.x2,d.x1,d.x2][i]-[l.x1,l.x2,l.x1,l.x2][i],2)+pow([d.y1,d.y1,d.y2,d.y2][i]-[l.y1,l.y1,l.y2,l.y2][i],2))/(4*pow(0.05::DOUBLE+i*0.02::DOUBLE,2))/((l.x2-l.x1)*(l.y2-l.y1)*0.53::DOUBLE+1e-7)/2) END))/(3+1e-7) AS oks
 FROM kdets d JOIN klbls l ON d.image_id=l.image_id AND d.cls=l.cls) WHERE oks >= 0.5""", "kdets", "klbls"))


def _keypoint_tables(spark, d):
    corners = (("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2"))
    point = lambda i, *more: F.struct(F.col(corners[i][0]).alias("x"), F.col(corners[i][1]).alias("y"), *more)
    shown = lambda i: F.when((F.col("image_id") + F.col("label_id")) % 4 == i, 0).otherwise(1).alias("visible")
    dets = v.dets(spark, d).select("image_id", "det_id", "cls", "conf", F.array(*[point(i) for i in range(4)]).alias("points"))
    area = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * 0.53).alias("area")
    return dets, v.lbls(spark, d).select("image_id", "label_id", "cls", F.array(*[point(i, shown(i)) for i in range(4)]).alias("points"), area)


@query("average_precision_keypoints", "D22 C8", "cls:l lvl:l ap", "kap_", "SELECT * FROM kap_")
def keypoints(spark, d):
    dets, labels = _keypoint_tables(spark, d)
    return _precision(dets, labels, ins.keypoint_pairs(dets, labels, SIGMAS))


# ---- all families -------------------------------------------------------------------------------------------

_MEANS = "SELECT '{0}' AS kind, avg(CASE WHEN lvl=0 THEN ap END) AS map50, avg(CASE WHEN lvl=5 THEN ap END) AS map75, avg(ap) AS map FROM {1}"


@query("average_precision_by_kind", "D22", "kind:s map50 map75 map fitness", "ap_ map_ rap_ kap_",
       "SELECT *, 0.1*map50+0.9*map AS fitness FROM (" + " UNION ALL ".join(_MEANS.format(k, t) for k, t in (("box", "ap_"), ("mask", "map_"), ("rotated", "rap_"), ("keypoints", "kap_"))) + ")")
def _(spark, d):
    """Box, mask, rotated and keypoint families side by side."""
    mean = lambda i: F.avg(F.when(F.col("lvl") == i, F.col("ap")))
    rows = None
    for kind, ap in (("box", dt.average_precision(*dq._matched(spark, d))), ("mask", masks(spark, d)), ("rotated", rotated(spark, d)), ("keypoints", keypoints(spark, d))):
        one = ap.agg(mean(0).alias("map50"), mean(5).alias("map75"), F.avg("ap").alias("map")).select(F.lit(kind).alias("kind"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map"))

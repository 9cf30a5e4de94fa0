"""Boxes, matching, average precision, confusion, suppression and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayscore.functions import boxes as bx
from wayscore.operators import detection as dt
from wayscore.operators import ranking as rk  # noqa: F401
from wayscore.operators.ordered import shared
from wayscore.plans import views as v
from wayscore.plans.registry import query

def inter_sql(a: str, b: str) -> str:
    return (f"greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0.0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0.0)")


def area_sql(a: str) -> str:
    return f"({a}.x2-{a}.x1)*({a}.y2-{a}.y1)"


def iou_sql(a: str, b: str, eps: str = "1e-7") -> str:
    i = inter_sql(a, b)
    return f"({i})/({area_sql(a)}+{area_sql(b)}-({i})+{eps})"


@query("box_conversions", "B11", "image_id:l det_id:l cx cy w h nx ny nw nh lx ly bx1 by1 bx2 by2 p1x p1y p3x p3y kx1 ky1 kx2 ky2", "dets", """
SELECT image_id, det_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h,
  (x1+x2)/2/640 AS nx, (y1+y2)/2/480 AS ny, (x2-x1)/640 AS nw, (y2-y1)/480 AS nh, x1 AS lx, y1 AS ly,
  (x1+x2)/2-(x2-x1)/2 AS bx1, (y1+y2)/2-(y2-y1)/2 AS by1, (x1+x2)/2+(x2-x1)/2 AS bx2, (y1+y2)/2+(y2-y1)/2 AS by2,
  (x1+x2)/2+(x2-x1)/2*cos(conf)-(y2-y1)/2*sin(conf) AS p1x, (y1+y2)/2+(x2-x1)/2*sin(conf)+(y2-y1)/2*cos(conf) AS p1y,
  (x1+x2)/2-(x2-x1)/2*cos(conf)+(y2-y1)/2*sin(conf) AS p3x, (y1+y2)/2-(x2-x1)/2*sin(conf)-(y2-y1)/2*cos(conf) AS p3y,
  least(x1,60) AS kx1, least(y1,50) AS ky1, least(x2,60) AS kx2, least(y2,50) AS ky2 FROM dets""")
def _(spark, d):
    x = bx.xyxy_to_xywh(bx.box())
    n = bx.xyxy_to_xywhn(bx.box(), 640, 480)
    lt = bx.xywh_to_ltwh(x)
    back = bx.ltwh_to_xyxy(bx.xyxy_to_ltwh(bx.xywhn_to_xyxy(n, 640, 480)))
    corners = bx.xywhr_corners(*x, F.col("conf"))
    clip = bx.clip_box(bx.xywh_to_xyxy(bx.ltwh_to_xywh(lt)), 60, 50)
    cols = dict(zip(("cx", "cy", "w", "h"), x)) | dict(zip(("nx", "ny", "nw", "nh"), n)) | {"lx": lt[0], "ly": lt[1]}
    cols |= bx.named(back, "b") | {"p1x": corners[0][0], "p1y": corners[0][1], "p3x": corners[2][0], "p3y": corners[2][1]} | bx.named(clip, "k")
    return v.dets(spark, d).select("image_id", "det_id", *[c.alias(k) for k, c in cols.items()])


@query("crop_box_expansion", "B12 B13", "image_id:l det_id:l gx1:l gy1:l gx2:l gy2:l edge:b", "dets", """
WITH c AS (SELECT *, least(x1,79)::BIGINT AS a1, least(x2,80)::BIGINT AS a2, least(y1,63)::BIGINT AS b1, least(y2,64)::BIGINT AS b2 FROM dets),
n AS (SELECT *, greatest(48-(a2-a1),0) AS nx, greatest(48-(b2-b1),0) AS ny FROM c),
s AS (SELECT *, least(nx//2+nx%2, a1) AS sx, least(ny//2+ny%2, b1) AS sy FROM n)
SELECT image_id, det_id, least(a1-sx,79) AS gx1, least(b1-sy,63) AS gy1,
  least(greatest(a2+nx-sx, least(a1-sx,79)+1), 80) AS gx2, least(greatest(b2+ny-sy, least(b1-sy,63)+1), 64) AS gy2,
  x1 <= 80*0.05 OR 80-x2 <= 80*0.05 OR 64-y2 <= 64*0.05 AS edge FROM s""")
def _(spark, d):
    ints = tuple(c.cast("int") for c in bx.box())
    g = bx.grow_to_min(ints, 80, 64, 48)
    return v.dets(spark, d).select("image_id", "det_id", *[c.alias(n) for n, c in bx.named(g, "g").items()],
                                   bx.near_edge(bx.box(), 80, 64, 0.05).alias("edge"))


@query("relative_boxes", "B34", "image_id:l det_id:l rx ry rw rh sx sy sw sh vx vy", "dets", """
SELECT image_id, det_id, (x1+0.5*(x2-x1))/(x2-x1) AS rx, (y1+0.5*(y2-y1))/(y2-y1) AS ry, ln(x2-x1) AS rw, ln(y2-y1) AS rh,
  x1 AS sx, y1 AS sy, x2-x1 AS sw, y2-y1 AS sh, x2 AS vx, y2 AS vy FROM dets""")
def _(spark, d):
    lt = bx.xyxy_to_ltwh(bx.box())
    r = bx.rect_to_relative(lt)
    s = bx.relative_to_rect(r)
    corner = bx.ltwh_to_xyxy(lt)
    return v.dets(spark, d).select("image_id", "det_id", *[c.alias(n) for n, c in zip(("rx", "ry", "rw", "rh", "sx", "sy", "sw", "sh"), r + s)],
                                   corner[2].alias("vx"), corner[3].alias("vy"))


@query("target_image_sizes", "B33", "p_partkey:l new_h:l new_w:l area_h:l area_w:l divisible:l", "", """
WITH s AS (SELECT p_partkey, CAST(100+p_size*17 AS BIGINT) AS h, CAST(120+p_partkey%1700 AS BIGINT) AS w FROM part),
r AS (SELECT *, round_even(h*(448.0::DOUBLE/greatest(h,w)),0) AS rh, round_even(w*(448.0::DOUBLE/greatest(h,w)),0) AS rw FROM s)
SELECT p_partkey, greatest(28, round_even(rh/28,0)*28) AS new_h, greatest(28, round_even(rw/28,0)*28) AS new_w,
  floor(round_even(sqrt(589824*(h::DOUBLE/w)),0)/16)*16 AS area_h, floor(round_even(sqrt(589824/(h::DOUBLE/w)),0)/16)*16 AS area_w,
  ceil(w/32.0)*32 AS divisible FROM r""")
def _(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", (100 + F.col("p_size") * 17).alias("h"), (120 + F.col("p_partkey") % 1700).alias("w"))
    h, w = F.col("h"), F.col("w")
    a, b = bx.resized_hw(h, w, 448)
    c, e = bx.area_limited_hw(h, w, 576 * 1024, 16)
    return p.select("p_partkey", a.alias("new_h"), b.alias("new_w"), c.alias("area_h"), e.alias("area_w"), bx.make_divisible(w, 32).alias("divisible"))


@query("best_overlap_box", "C5", "image_id:l query_id:l copies:l cand_id:l best_iou", "dets lbls", f"""
WITH q AS (SELECT image_id, x1, y1, x2, y2, min(label_id) AS query_id, count(*) AS copies FROM lbls GROUP BY ALL),
p AS (SELECT q.image_id, q.query_id, q.copies, d.det_id, {iou_sql('q', 'd', '1e-8')} AS iou FROM q JOIN dets d USING (image_id))
SELECT image_id, query_id, copies, det_id AS cand_id, iou AS best_iou FROM p
QUALIFY row_number() OVER (PARTITION BY image_id, query_id ORDER BY iou DESC, det_id) = 1""")
def _(spark, d):
    b = shared(v.boxes(spark, d))
    return dt.best_overlap(b.where("role = 'label'").withColumnRenamed("det_id", "query_id"),
                           b.where("role = 'pred'").withColumnRenamed("det_id", "cand_id"), ["image_id"])


@query("pairwise_overlap", "C6", "image_id:l pairs:l iou giou diou ciou ioa", "dets lbls", f"""
WITH p AS (SELECT image_id, d.x1 AS a1, d.y1 AS a2, d.x2-d.x1 AS w1, d.y2-d.y1+1e-7 AS h1, l.x2-l.x1 AS w2, l.y2-l.y1+1e-7 AS h2,
  {inter_sql('d', 'l')} AS i, {area_sql('l')} AS la, greatest(d.x2,l.x2)-least(d.x1,l.x1) AS cw, greatest(d.y2,l.y2)-least(d.y1,l.y1) AS ch,
  (pow(l.x1+l.x2-d.x1-d.x2,2)+pow(l.y1+l.y2-d.y1-d.y2,2))/4 AS rho FROM dets d JOIN lbls l USING (image_id)),
u AS (SELECT *, w1*h1+w2*h2-i+1e-7 AS un, cw*cw+ch*ch+1e-7 AS c2, cw*ch+1e-7 AS hull, 4/(pi()*pi())*pow(atan(w2/h2)-atan(w1/h1),2) AS vv FROM p WHERE i > 0)
SELECT image_id, count(*) AS pairs, sum(i/un) AS iou, sum(i/un-(hull-un)/hull) AS giou, sum(i/un-rho/c2) AS diou,
  sum(i/un-(rho/c2+vv*(vv/(vv-i/un+1+1e-7)))) AS ciou, sum(i/(la+1e-7)) AS ioa FROM u GROUP BY image_id""")
def _(spark, d):
    b = v.boxes(spark, d)
    p = dt.pair_similarity(b.where("role = 'pred'"), b.where("role = 'label'"), ["image_id"])
    tot = lambda c: F.sum(F.col(c) * F.col("copies")).alias(c)
    return p.groupBy("image_id").agg(F.sum("copies").alias("pairs"), *[tot(c) for c in ("iou", "giou", "diou", "ciou", "ioa")])


@query("rotated_box_overlap", "C7", "image_id:l det_id:l prob_iou", "dets lbls", """
WITH dm AS MATERIALIZED (SELECT * FROM dets), lm AS MATERIALIZED (SELECT *, label_id-1 AS det_id FROM lbls),
p AS (SELECT d.image_id, d.det_id, (d.x1+d.x2)/2 AS xa, (d.y1+d.y2)/2 AS ya, (l.x1+l.x2)/2 AS xb, (l.y1+l.y2)/2 AS yb,
  pow(d.x2-d.x1,2)/12 AS pa, pow(d.y2-d.y1,2)/12 AS pb, d.conf AS ra, pow(l.x2-l.x1,2)/12 AS qa, pow(l.y2-l.y1,2)/12 AS qb, 0.3 AS rb
  FROM dm d JOIN lm l ON d.image_id=l.image_id AND d.det_id=l.det_id),
c AS (SELECT *, pa*cos(ra)*cos(ra)+pb*sin(ra)*sin(ra) AS a1, pa*sin(ra)*sin(ra)+pb*cos(ra)*cos(ra) AS b1, (pa-pb)*cos(ra)*sin(ra) AS c1,
  qa*cos(rb)*cos(rb)+qb*sin(rb)*sin(rb) AS a2, qa*sin(rb)*sin(rb)+qb*cos(rb)*cos(rb) AS b2, (qa-qb)*cos(rb)*sin(rb) AS c2 FROM p),
e AS (SELECT *, (a1+a2)*(b1+b2)-pow(c1+c2,2) AS det FROM c),
f AS (SELECT *, ((a1+a2)*pow(ya-yb,2)+(b1+b2)*pow(xa-xb,2))/(det+1e-7)*0.25 + (c1+c2)*(xb-xa)*(ya-yb)/(det+1e-7)*0.5
  + 0.5*ln(det/(4*sqrt(greatest(a1*b1-c1*c1,0)*greatest(a2*b2-c2*c2,0))+1e-7)+1e-7) AS bd FROM e)
SELECT image_id, det_id, 1-sqrt(1-exp(-least(greatest(bd,1e-7),100))+1e-7) AS prob_iou FROM f""")
def _(spark, d):
    b = v.boxes(spark, d)
    p = b.where("role = 'pred'").withColumnsRenamed({g: f"a_{g}" for g in dt.GEOM}).select("image_id", "det_id", "conf", *[f"a_{g}" for g in dt.GEOM])
    q = b.where("role = 'label'").select("image_id", (F.col("det_id") - 1).alias("det_id"), *[F.col(g).alias(f"b_{g}") for g in dt.GEOM])
    return p.join(q, ["image_id", "det_id"]).select("image_id", "det_id", bx.rotated_iou(
        (*bx.xyxy_to_xywh(bx.box("a_")), F.col("conf")), (*bx.xyxy_to_xywh(bx.box("b_")), F.lit(0.3))).alias("prob_iou"))


LV = "(VALUES " + ",".join(f"({i},{t}::DOUBLE)" for i, t in enumerate(dt.IOU_LEVELS)) + ") lv(lvl,t)"
v._sql("claims_", f"""
SELECT d.image_id, d.cls, d.det_id, l.label_id, {iou_sql('d', 'l')} AS iou FROM dets d JOIN lbls l USING (image_id, cls)
WHERE {iou_sql('d', 'l')} >= 0.5
QUALIFY row_number() OVER (PARTITION BY d.image_id, d.det_id ORDER BY {iou_sql('d', 'l')} DESC, l.label_id) = 1
""", "dets", "lbls")
v._sql("wins_", f"SELECT image_id, label_id, lvl, min(det_id) AS det_id FROM claims_ JOIN {LV} ON iou >= t GROUP BY ALL", "claims_")
v._sql("flags_", f"""
SELECT d.image_id, d.det_id, d.cls, d.conf, lv.lvl, CASE WHEN w.det_id IS NULL THEN 0 ELSE 1 END AS hit
FROM dets d CROSS JOIN {LV} LEFT JOIN wins_ w ON w.image_id=d.image_id AND w.det_id=d.det_id AND w.lvl=lv.lvl
""", "wins_", "dets")


def _matched(spark, d):
    b = v.boxes(spark, d, kept=True)
    labels = b.where("role = 'label'").withColumnRenamed("det_id", "label_id")
    return dt.match_detections(b.where("role = 'pred'"), labels), labels


@query("match_detections", "C10", "image_id:l det_id:l cls:l levels:l at50:l at75:l", "flags_", """
SELECT image_id, det_id, cls, sum(hit) AS levels, max(CASE WHEN lvl=0 THEN hit END) AS at50, max(CASE WHEN lvl=5 THEN hit END) AS at75
FROM flags_ GROUP BY ALL""")
def _(spark, d):
    m, _ = _matched(spark, d)
    return m.select("image_id", "det_id", "cls", sum(F.col(f"t{i}") for i in range(10)).alias("levels"),
                    F.col("t0").alias("at50"), F.col("t5").alias("at75"))


v._sql("prc_", """
SELECT cls, lvl, conf, row_number() OVER w AS n, sum(hit) OVER w AS j FROM flags_
WINDOW w AS (PARTITION BY cls, lvl ORDER BY conf DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)
""", "flags_")
v._sql("ap_", """
SELECT cls, lvl, sum(y * CASE WHEN i IN (0,100) THEN 0.5 ELSE 1 END) * 0.01 AS ap FROM (
 SELECT g.cls, g.lvl, g.i, CASE WHEN g.i*0.01::DOUBLE >= 1 THEN 0 ELSE r.le + coalesce((r.e1-r.le)*(g.i*0.01::DOUBLE-r.r)/(r.r1-r.r), 0) END AS y
 FROM (SELECT cls, lvl, i, i*0.01::DOUBLE AS x FROM (SELECT DISTINCT cls, lvl FROM prc_), generate_series(0,100) s(i)) g
 ASOF JOIN (SELECT *, lead(r) OVER w AS r1, lead(fe) OVER w AS e1 FROM (
   SELECT cls, lvl, r, arg_max(env, n) AS le, arg_min(env, n) AS fe FROM (
     SELECT *, max(p) OVER (PARTITION BY cls, lvl ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS env FROM (
       SELECT cls, lvl, n, j::DOUBLE/nl AS r, j::DOUBLE/n AS p FROM prc_ JOIN (SELECT cls, count(*) AS nl FROM lbls GROUP BY cls) USING (cls)
       UNION ALL SELECT DISTINCT cls, lvl, 0, 0.0, 1.0 FROM prc_ UNION ALL SELECT cls, lvl, max(n)+1, 1.0, 0.0 FROM prc_ GROUP BY cls, lvl))
   GROUP BY cls, lvl, r) WINDOW w AS (PARTITION BY cls, lvl ORDER BY r)) r
 ON g.cls = r.cls AND g.lvl = r.lvl AND g.x >= r.r) GROUP BY cls, lvl
""", "prc_", "lbls")


@query("average_precision", "D20", "cls:l lvl:l ap", "ap_", "SELECT * FROM ap_")
def _(spark, d):
    return dt.average_precision(*_matched(spark, d))


v._sql("curve_", """
WITH c AS (SELECT cls, conf, max(n) AS n1, arg_max(j, n) AS j1, min(n) AS n0, arg_min(j, n) AS j0 FROM prc_ WHERE lvl = 0 GROUP BY cls, conf),
l AS (SELECT *, lead(conf) OVER w AS c1, lead(n0) OVER w AS nn, lead(j0) OVER w AS jn FROM c WINDOW w AS (PARTITION BY cls ORDER BY conf DESC)),
g AS (SELECT cls, nl, i AS point, i*(1.0::DOUBLE/999) AS x FROM (SELECT cls, count(*) AS nl FROM lbls GROUP BY cls), generate_series(0,999) s(i)),
a AS (SELECT g.cls, g.nl, g.point, g.x, l.conf, l.n1, l.j1, l.c1, l.nn, l.jn FROM g ASOF LEFT JOIN l ON g.cls = l.cls AND g.x <= l.conf)
SELECT cls, nl AS n_labels, point, x AS conf,
 CASE WHEN conf IS NULL THEN 1 ELSE j1::DOUBLE/n1 + CASE WHEN conf = x OR c1 IS NULL THEN 0 ELSE (jn::DOUBLE/nn - j1::DOUBLE/n1)*(conf-x)/(conf-c1) END END AS p,
 CASE WHEN conf IS NULL THEN 0 ELSE j1::DOUBLE/nl + CASE WHEN conf = x OR c1 IS NULL THEN 0 ELSE (jn::DOUBLE/nl - j1::DOUBLE/nl)*(conf-x)/(conf-c1) END END AS r FROM a
""", "prc_", "lbls")


@query("precision_recall_curves", "D20", "cls:l point:l conf precision recall f1", "curve_",
       "SELECT cls, point, conf, p AS precision, r AS recall, 2*p*r/(p+r+1e-16) AS f1 FROM curve_")
def _(spark, d):
    return dt.confidence_curves(*_matched(spark, d))


v._sql("bestpt_", """
WITH m AS (SELECT point, avg(2*p*r/(p+r+1e-16)) AS m FROM curve_ GROUP BY point),
s AS (SELECT a.point, avg(b.m) AS s FROM m a, generate_series(-50,50) o(o) JOIN m b ON b.point = greatest(0, least(999, a.point+o.o)) GROUP BY a.point)
SELECT point FROM s ORDER BY round_even(s,12) DESC, point LIMIT 1
""", "curve_")


@query("best_f1_operating_point", "D20", "cls:l point:l precision recall f1 tp:l fp:l", "curve_ bestpt_", """
SELECT cls, point, p AS precision, r AS recall, 2*p*r/(p+r+1e-16) AS f1, round_even(r*n_labels,0) AS tp,
 round_even(round_even(r*n_labels,0)/(p+1e-16)-round_even(r*n_labels,0),0) AS fp FROM curve_ JOIN bestpt_ USING (point)""")
def _(spark, d):
    return dt.best_f1(dt.confidence_curves(*_matched(spark, d)))


@query("detection_summary", "D21", "map50 map75 map mean_precision mean_recall fitness", "ap_ curve_ bestpt_", """
SELECT *, 0.1*map50+0.9*map AS fitness FROM (SELECT avg(CASE WHEN lvl=0 THEN ap END) AS map50, avg(CASE WHEN lvl=5 THEN ap END) AS map75, avg(ap) AS map FROM ap_),
 (SELECT avg(p) AS mean_precision, avg(r) AS mean_recall FROM curve_ JOIN bestpt_ USING (point))""")
def _(spark, d):
    m, labels = _matched(spark, d)
    counts = dt.shared(dt.curve_counts(m))
    return dt.summary(dt.average_precision(m, labels, counts=counts), dt.best_f1(dt.confidence_curves(m, labels, counts=counts)))


v._sql("mutual_", f"""
WITH p AS (SELECT d.image_id, d.det_id, d.cls AS dcls, l.label_id, l.cls AS lcls, {iou_sql('d', 'l')} AS iou FROM dets d JOIN lbls l USING (image_id)
  WHERE d.conf > 0.25 AND {iou_sql('d', 'l')} > 0.45),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, label_id) = 1)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY image_id, label_id ORDER BY iou DESC, det_id) = 1
""", "dets", "lbls")


@query("confusion_matrix", "D24", "predicted:l actual:l n:l", "mutual_ dets lbls", """
SELECT dcls AS predicted, lcls AS actual, count(*) AS n FROM mutual_ GROUP BY ALL
UNION ALL SELECT 3, l.cls, count(*) FROM lbls l WHERE NOT EXISTS (SELECT 1 FROM mutual_ m WHERE m.image_id=l.image_id AND m.label_id=l.label_id) GROUP BY ALL
UNION ALL SELECT d.cls, 3, count(*) FROM dets d WHERE d.conf > 0.25 AND NOT EXISTS (SELECT 1 FROM mutual_ m WHERE m.image_id=d.image_id AND m.det_id=d.det_id)
 AND (d.image_id NOT IN (SELECT image_id FROM lbls) OR d.image_id IN (SELECT image_id FROM mutual_)) GROUP BY ALL""")
def _(spark, d):
    b = shared(v.boxes(spark, d))
    return dt.confusion_matrix(b.where("role = 'pred'"), b.where("role = 'label'").withColumnRenamed("det_id", "label_id"), 3)


v._sql("confusion_", """
SELECT dcls AS predicted, lcls AS actual, count(*) AS n FROM mutual_ GROUP BY ALL
UNION ALL SELECT 3, l.cls, count(*) FROM lbls l WHERE NOT EXISTS (SELECT 1 FROM mutual_ m WHERE m.image_id=l.image_id AND m.label_id=l.label_id) GROUP BY ALL
UNION ALL SELECT d.cls, 3, count(*) FROM dets d WHERE d.conf > 0.25 AND NOT EXISTS (SELECT 1 FROM mutual_ m WHERE m.image_id=d.image_id AND m.det_id=d.det_id)
 AND (d.image_id NOT IN (SELECT image_id FROM lbls) OR d.image_id IN (SELECT image_id FROM mutual_)) GROUP BY ALL
""", "mutual_", "dets", "lbls")


def _positives(matrix: str) -> str:
    return f"""SELECT cls, coalesce(sum(n) FILTER (WHERE predicted = actual), 0) AS tp, coalesce(sum(n) FILTER (WHERE predicted <> actual), 0) AS fp
 FROM (SELECT predicted AS cls FROM {matrix} UNION SELECT actual FROM {matrix}) c LEFT JOIN {matrix} m ON m.predicted = c.cls"""


@query("detection_true_false_positives", "D24", "cls:l tp:l fp:l", "confusion_", _positives("confusion_") + " WHERE cls <> 3 GROUP BY cls")
def _(spark, d):
    b = shared(v.boxes(spark, d))
    m = dt.confusion_matrix(b.where("role = 'pred'"), b.where("role = 'label'").withColumnRenamed("det_id", "label_id"), 3)
    return dt.true_false_positives(m, background=3)


v._sql("guess_", """
SELECT p.pos AS predicted, p.label AS actual, count(*) AS n FROM (SELECT vec_id, label, pos FROM features WHERE pos < 10
 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) = 1) p WHERE p.label IS NOT NULL GROUP BY ALL
""", "features")


def _guesses(spark, d):
    """The first ten components of an embedding as class scores."""
    f = v.features(spark, d).where("pos < 10").select("vec_id", F.col("pos").alias("cls"), F.col("v").alias("score"))
    truth = v.embeddings(spark, d).where("label IS NOT NULL").select("vec_id", F.col("label").alias("actual"))
    return dt.classification_confusion(f, truth, ["vec_id"])


@query("classification_confusion", "D24", "predicted:l actual:l n:l", "guess_", "SELECT * FROM guess_")
def _(spark, d):
    return _guesses(spark, d)


@query("classification_true_false_positives", "D24", "cls:l tp:l fp:l", "guess_", _positives("guess_") + " GROUP BY cls")
def _(spark, d):
    return dt.true_false_positives(_guesses(spark, d))


@query("non_maximum_suppression", "F6", "image_id:l det_id:l cls:l conf position:l", "dets", f"""
WITH RECURSIVE c AS (SELECT image_id, cls, x1, y1, x2, y2, max(conf) AS conf, arg_min(det_id, (-conf, det_id)) AS det_id FROM dets WHERE conf > 0.25 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det_id) AS r FROM c),
k AS (SELECT image_id, cls, 1::BIGINT AS r, [{{'d': det_id, 'c': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM o WHERE r = 1
 UNION ALL SELECT k.image_id, k.cls, o.r, CASE WHEN list_bool_or(list_transform(k.kept, lambda b: {iou_sql('b', 'o', '0')} > 0.45)) THEN k.kept
   ELSE list_append(k.kept, {{'d': o.det_id, 'c': o.conf, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END
 FROM k JOIN o ON o.image_id=k.image_id AND o.cls=k.cls AND o.r=k.r+1),
f AS (SELECT image_id, cls, unnest(kept) AS e FROM k QUALIFY row_number() OVER (PARTITION BY image_id, cls ORDER BY r DESC) = 1)
SELECT image_id, e.d AS det_id, cls, e.c AS conf, row_number() OVER (PARTITION BY image_id ORDER BY e.c DESC, e.d) AS position FROM f""")
def _(spark, d):
    return dt.suppress(v.dets(spark, d))


@query("top_k_box_class_scores", "F7", "image_id:l det_id:l cls:l score position:l", "dets", """
WITH s AS (SELECT image_id, det_id, c.c AS cls, ((conf*100+c.c*37+det_id*11) % 101)/101 AS score FROM dets, (VALUES (0),(1),(2)) c(c)),
b0 AS (SELECT image_id, det_id, max(score) AS m FROM s GROUP BY image_id, det_id), b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY m DESC, det_id) <= 5)
SELECT s.*, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id, cls) AS position FROM s SEMI JOIN b USING (image_id, det_id)
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id, cls) <= 5""")
def _(spark, d):
    s = v.dets(spark, d).select("image_id", "det_id", "conf", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cls"))
    s = s.withColumn("score", ((F.col("conf") * 100 + F.col("cls") * 37 + F.col("det_id") * 11) % 101) / 101)
    return dt.top_scores(s, 5)


def _annotations(spark, d):
    li = v.table(spark, d, "lineitem")
    ann = li.select(v.div("l_orderkey", 4).alias("image_id"), (1 + F.col("l_partkey") % 91).cast("int").alias("category_id"),
                    (F.col("l_suppkey") % 50).cast("double").alias("bx"), (F.col("l_linenumber") * 10).cast("double").alias("by"),
                    (F.floor(F.col("l_quantity") / 5) - 1).cast("double").alias("bw"), F.round(F.col("l_discount") * 100).alias("bh"),
                    (F.col("l_suppkey") % 17 == 0).cast("int").alias("iscrowd"))
    img = li.select(v.div("l_orderkey", 4).alias("image_id")).distinct().withColumns(
        {"width": 640 + F.col("image_id") % 3 * 100, "height": F.lit(480)})
    return ann, img


@query("annotations_to_labels", "A9", "image_id:l cls:l cx cy w h", "", """
WITH a AS (SELECT l_orderkey//4 AS image_id, 1+l_partkey%91 AS cat, (l_suppkey%50)::DOUBLE AS bx, (l_linenumber*10)::DOUBLE AS by_, floor(l_quantity/5)-1 AS bw, round(l_discount*100) AS bh, l_suppkey%17=0 AS crowd FROM lineitem)
SELECT DISTINCT image_id, CASE WHEN cat NOT IN (12,26,29,30,45,66,68,69,71,83,91) THEN cat-1-len(list_filter([12,26,29,30,45,66,68,69,71,83,91], lambda u: u < cat)) END AS cls,
 (bx+bw/2)/(640+image_id%3*100) AS cx, (by_+bh/2)/480 AS cy, bw/(640+image_id%3*100) AS w, bh/480 AS h FROM a WHERE NOT crowd AND bw > 0 AND bh > 0""")
def _(spark, d):
    return dt.annotations_to_labels(*_annotations(spark, d))


@query("audit_label_files", "A10", "image_id:l status:s corrupt:b duplicates:l labels:l", "", """
WITH i AS (SELECT o_orderkey AS image_id, o_orderkey % 13 <> 0 AS has_file FROM orders),
l AS (SELECT l_orderkey AS image_id, CASE WHEN l_partkey%997=0 THEN 6 ELSE 5 END AS nc, CASE WHEN l_suppkey%97=0 THEN 81 ELSE l_suppkey%3 END AS cls,
  CASE WHEN l_partkey%331=0 THEN 1.5 ELSE floor(l_quantity/25)/2 END AS x, CASE WHEN l_partkey%499=0 THEN -0.1 ELSE 0.5 END AS y FROM lineitem),
g AS (SELECT image_id, count(*) AS n, count(DISTINCT (nc, cls, x, y)) AS k, bool_or(nc<>5) AS bc, bool_or(greatest(x,y,0.25)>1) AS br, bool_or(least(cls,x,y)<0) AS bn, bool_or(cls>80) AS bl FROM l GROUP BY ALL),
s AS (SELECT i.image_id, CASE WHEN NOT has_file THEN 'missing' WHEN n IS NULL THEN 'empty' WHEN bc THEN 'columns' WHEN br THEN 'out of bounds' WHEN bn THEN 'negative' WHEN bl THEN 'class' ELSE 'ok' END AS status, n, k FROM i LEFT JOIN g USING (image_id))
SELECT image_id, status, status IN ('columns','out of bounds','negative','class') AS corrupt, CASE WHEN status='ok' THEN n-k ELSE 0 END AS duplicates, CASE WHEN status='ok' THEN k ELSE 0 END AS labels FROM s""")
def _(spark, d):
    img = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 13 != 0).alias("has_file"))
    lab = v.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.when(F.col("l_partkey") % 997 == 0, 6).otherwise(5).alias("n_columns"),
        F.when(F.col("l_suppkey") % 97 == 0, 81).otherwise(F.col("l_suppkey") % 3).alias("cls"),
        F.when(F.col("l_partkey") % 331 == 0, 1.5).otherwise(F.floor(F.col("l_quantity") / 25) / 2).alias("x"),
        F.when(F.col("l_partkey") % 499 == 0, -0.1).otherwise(0.5).alias("y"), F.lit(0.25).alias("w"), F.lit(0.25).alias("h"))
    return dt.audit_labels(img, lab, 80)


@query("detection_records", "A14", "image_id:l det_id:l box_left box_top box_width box_height score json:s", "dets", """
SELECT image_id, det_id, x1 AS box_left, y1 AS box_top, x2-x1 AS box_width, y2-y1 AS box_height, conf AS score,
 '{"image_id":'||image_id||',"category_id":'||cls||',"bbox":['||x1||','||y1||','||(x2-x1)||','||(y2-y1)||'],"score":'||conf||'}' AS json FROM dets""")
def _(spark, d):
    return dt.detections_to_json(v.dets(spark, d))


@query("detection_label_lines", "A14", "image_id:l det_id:l line:s", "dets", """
SELECT image_id, det_id, printf('%.6g %.6g %.6g %.6g %.6g %.6g', cls::DOUBLE, (x1+x2)/2/700, (y1+y2)/2/450, (x2-x1)/700, (y2-y1)/450, conf) AS line FROM dets""")
def _(spark, d):
    return dt.detections_to_lines(v.dets(spark, d), 700, 450)


@query("dataset_statistics", "D46", "split:s cls:l instances:l images:l unlabelled:l", "", """
WITH i AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey%10<7 THEN 'train' WHEN o_orderkey%10<9 THEN 'val' ELSE 'test' END AS split FROM orders),
l AS (SELECT i.split, i.image_id, l_suppkey%3 AS cls FROM lineitem JOIN i ON l_orderkey=image_id)
SELECT split, cls, count(*) AS instances, count(DISTINCT image_id) AS images, 0 AS unlabelled FROM l GROUP BY ALL
UNION ALL SELECT i.split, -1, (SELECT count(*) FROM l WHERE l.split=i.split), count(*), count(*) FILTER (WHERE i.image_id NOT IN (SELECT image_id FROM l)) FROM i GROUP BY i.split""")
def _(spark, d):
    k = F.col("o_orderkey") % 10
    img = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.when(k < 7, "train").when(k < 9, "val").otherwise("test").alias("split"))
    lab = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 3).alias("cls"))
    return dt.dataset_statistics(img, lab)


v._sql("imgs_", "SELECT p_partkey AS image_id, 40+p_partkey%90 AS width, 30+p_size AS height FROM part")


def _imgs(spark, d):
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (40 + F.col("p_partkey") % 90).alias("width"), (30 + F.col("p_size")).alias("height"))


v._sql("win_", """
WITH n AS (SELECT *, CASE WHEN width<=50 THEN 1 ELSE ceil((width-50)/40.0+1) END::BIGINT AS xn, CASE WHEN height<=50 THEN 1 ELSE ceil((height-50)/40.0+1) END::BIGINT AS yn FROM imgs_),
g AS (SELECT *, unnest(generate_series(0, xn-1)) AS i FROM n), h AS (SELECT *, unnest(generate_series(0, yn-1)) AS j FROM g),
w AS (SELECT image_id, width, height, CASE WHEN xn>1 AND i=xn-1 AND i*40+50>width THEN width-50 ELSE i*40 END AS wx1, CASE WHEN yn>1 AND j=yn-1 AND j*40+50>height THEN height-50 ELSE j*40 END AS wy1 FROM h),
r AS (SELECT *, (least(wx1+50,width)-wx1)*(least(wy1+50,height)-wy1)/2500.0 AS rate FROM w),
m AS (SELECT *, max(rate) OVER (PARTITION BY image_id) AS top FROM r)
SELECT image_id, wx1, wy1, wx1+50 AS wx2, wy1+50 AS wy2 FROM m WHERE CASE WHEN top > 0.6 THEN rate > 0.6 ELSE abs(rate-top) < 0.01 END
""", "imgs_")


@query("tile_windows", "E15", "image_id:l wx1:l wy1:l wx2:l wy2:l", "win_", "SELECT * FROM win_")
def _(spark, d):
    return dt.tile_windows(_imgs(spark, d), 50, 10)


@query("labels_in_windows", "C12", "image_id:l wx1:l wy1:l labels:l iof_sum", "win_ lbls", f"""
WITH w AS (SELECT image_id, wx1::DOUBLE AS x1, wy1::DOUBLE AS y1, wx2::DOUBLE AS x2, wy2::DOUBLE AS y2 FROM win_)
SELECT image_id, w.x1 AS wx1, w.y1 AS wy1, count(*) AS labels, sum({inter_sql('w', 'l')}/({area_sql('l')})) AS iof_sum
FROM w JOIN lbls l USING (image_id) WHERE {inter_sql('w', 'l')}/({area_sql('l')}) >= 0.7 GROUP BY ALL""")
def _(spark, d):
    p = dt.window_labels(dt.tile_windows(_imgs(spark, d), 50, 10), v.lbls(spark, d))
    return p.groupBy("image_id", F.col("a_x1").alias("wx1"), F.col("a_y1").alias("wy1")).agg(
        F.count(F.lit(1)).alias("labels"), F.sum("iof").alias("iof_sum"))

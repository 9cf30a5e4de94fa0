"""Trajectory geometry, alignment, quality and the displacement ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayscore.operators import trajectory as tr
from wayscore.operators import ranking as rk
from wayscore.operators.ordered import shared
from wayscore.plans import views as v
from wayscore.plans.registry import query

K, G = v.TRAJ_KEY, v.SCENE_KEY
KEYS = "model:s scene_id:l clip:l"
PW = "PARTITION BY model, scene_id, clip ORDER BY frame"
PA = "PARTITION BY model, scene_id, clip"

v._sql("ego_r", """
SELECT *, x - first_value(x) OVER w AS rx, y - first_value(y) OVER w AS ry, row_number() OVER w - 1 AS i
FROM gt WINDOW w AS (PARTITION BY scene_id, clip ORDER BY frame)
""", "gt")
v._sql("ego", """
SELECT r.scene_id, r.clip, r.frame, atan2(h.ry, h.rx) AS theta,
       r.rx * cos(atan2(h.ry, h.rx)) + r.ry * sin(atan2(h.ry, h.rx)) AS x,
       r.ry * cos(atan2(h.ry, h.rx)) - r.rx * sin(atan2(h.ry, h.rx)) AS y
FROM ego_r r
JOIN (SELECT scene_id, clip, coalesce(max(CASE WHEN i = 1 AND sqrt(rx*rx+ry*ry) >= 1 THEN frame END),
             min(CASE WHEN i >= 1 AND sqrt(rx*rx+ry*ry) >= 1 THEN frame END), max(frame)) AS hf
      FROM ego_r GROUP BY scene_id, clip) k USING (scene_id, clip)
JOIN ego_r h ON h.scene_id = r.scene_id AND h.clip = r.clip AND h.frame = k.hf
""", "ego_r")


@query("ego_frame", "B1", "scene_id:l clip:l frame:l theta x y", "ego", "SELECT * FROM ego")
def _(spark, d):
    return tr.to_ego_frame(v.gt(spark, d), G)


@query("camera_to_forward_lateral", "B2 B3", f"{KEYS} frame:l x y rx ry", "pred",
       """SELECT model, scene_id, clip, frame, y AS x, -x AS y,
                 1.5 * (cos(0.25) * y + sin(0.25) * x) AS rx, 1.5 * (sin(0.25) * y - cos(0.25) * x) AS ry FROM pred""")
def _(spark, d):
    f = tr.forward_lateral(v.pred(spark, d))
    f = f.withColumns({"fx": F.col("x"), "fy": F.col("y")})
    r = tr.apply_similarity(f, F.lit(1.5), F.cos(F.lit(0.25)), F.sin(F.lit(0.25)))
    return r.withColumnsRenamed({"x": "rx", "y": "ry", "fx": "x", "fy": "y"})


@query("heading_and_velocity", "B4 B5 B6", f"{KEYS} frame:l heading vx vy speed yaw", "pred", f"""
WITH s AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pred WINDOW w AS ({PW})),
c AS (SELECT *, coalesce(x2, x) - coalesce(x0, x) AS dx, coalesce(y2, y) - coalesce(y0, y) AS dy,
      CASE WHEN x0 IS NOT NULL AND x2 IS NOT NULL THEN 2.0 ELSE 1.0 END * 0.1 AS h,
      CASE WHEN x2 IS NOT NULL THEN atan2(y2 - y, x2 - x) END AS yw FROM s)
SELECT model, scene_id, clip, frame, atan2(dy, dx) AS heading, dx / h AS vx, dy / h AS vy,
       sqrt((dx / h) * (dx / h) + (dy / h) * (dy / h)) AS speed,
       coalesce(yw, lag(yw) OVER ({PW}), 0) AS yaw FROM c""")
def _(spark, d):
    return tr.step_yaw(tr.velocities(tr.headings(v.pred(spark, d), K), K), K)


@query("resample_fixed_length", "E4", f"{KEYS} frame:l x y", "pred", f"""
WITH p AS (SELECT *, row_number() OVER ({PW}) - 1 AS i, count(*) OVER ({PA}) AS t FROM pred),
g AS (SELECT model, scene_id, clip, t, unnest(generate_series(0, 49)) AS j FROM (SELECT DISTINCT model, scene_id, clip, t FROM p))
SELECT g.model, g.scene_id, g.clip, g.j AS frame,
       a.x + (coalesce(b.x, a.x) - a.x) * ((g.j * (g.t - 1)) % 49) / 49.0 AS x,
       a.y + (coalesce(b.y, a.y) - a.y) * ((g.j * (g.t - 1)) % 49) / 49.0 AS y
FROM g JOIN p a ON a.model = g.model AND a.scene_id = g.scene_id AND a.clip = g.clip AND a.i = (g.j * (g.t - 1)) // 49
LEFT JOIN p b ON b.model = g.model AND b.scene_id = g.scene_id AND b.clip = g.clip AND b.i = a.i + 1""")
def _(spark, d):
    return tr.resample(v.pred(spark, d).withColumn("n", F.lit(50)), K, "n")


def _sg_sql(c: str) -> str:
    five = [("69,4,-6,4,-1", 70, 0), ("2,27,12,-8,2", 35, 1), ("-3,12,17,12,-3", 35, 2), ("2,-8,12,27,2", 35, 3), ("-1,4,-6,4,69", 70, 4)]
    three = [("5,2,-1", 6, 0), ("1,1,1", 3, 1), ("-1,2,5", 6, 2)]

    def val(weights, den, r):
        terms = []
        for j, wgt in enumerate(weights.split(",")):
            o = j - r
            ref = c if o == 0 else f"lead({c}, {o}) OVER w" if o > 0 else f"lag({c}, {-o}) OVER w"
            terms.append(f"({wgt}) * {ref}")
        return f"({' + '.join(terms)}) / {den}.0"

    cases = [f"WHEN t >= 5 AND r5 = {r} THEN {val(w, den, r)}" for w, den, r in five]
    cases += [f"WHEN t BETWEEN 3 AND 4 AND r3 = {r} THEN {val(w, den, r)}" for w, den, r in three]
    return f"CASE {' '.join(cases)} ELSE {c} END AS {c}"


@query("smooth_polynomial", "E2", f"{KEYS} frame:l x y", "pred", f"""
WITH p AS (SELECT *, row_number() OVER ({PW}) - 1 AS i, count(*) OVER ({PA}) AS t FROM pred),
q AS (SELECT *, i - greatest(0, least(i - 2, t - 5)) AS r5, i - greatest(0, least(i - 1, t - 3)) AS r3 FROM p)
SELECT model, scene_id, clip, frame, {_sg_sql('x')}, {_sg_sql('y')} FROM q WINDOW w AS ({PW})""")
def _(spark, d):
    return tr.smooth_polynomial(v.pred(spark, d), K)


@query("smooth_moving_average", "E3", f"{KEYS} frame:l x y", "pred", f"""
WITH p AS (SELECT *, row_number() OVER ({PW}) - 1 AS i, count(*) OVER ({PA}) AS t FROM pred),
r AS (SELECT *, CASE WHEN t < 3 THEN 0 WHEN t < 5 THEN 1 ELSE 2 END AS rad FROM p),
o AS (SELECT *, unnest(generate_series(-rad, rad)) AS off FROM r)
SELECT o.model, o.scene_id, o.clip, o.frame, avg(b.x) AS x, avg(b.y) AS y
FROM o JOIN p b ON b.model = o.model AND b.scene_id = o.scene_id AND b.clip = o.clip AND b.i = greatest(0, least(o.t - 1, o.i + o.off))
GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return tr.smooth_mean(v.pred(spark, d), K, 5)


def _pair(spark, d):
    a = shared(v.traj_all(spark, d))
    return tr.pair_frames(a.where("model <> 'gt'"), a.where("model = 'gt'").drop("model"), G)


@query("pair_audit", "C1", f"{KEYS} pred_frames:l truth_frames:l matched:l same_shape:b", "pred gt", """
SELECT p.model, p.scene_id, p.clip, count(DISTINCT p.frame) AS pred_frames,
       coalesce(max(n.n), 0) AS truth_frames, count(g.frame) AS matched,
       count(DISTINCT p.frame) = coalesce(max(n.n), 0) AND count(g.frame) = count(DISTINCT p.frame) AS same_shape
FROM pred p LEFT JOIN gt g USING (scene_id, clip, frame)
LEFT JOIN (SELECT scene_id, clip, count(*) AS n FROM gt GROUP BY ALL) n ON n.scene_id = p.scene_id AND n.clip = p.clip
GROUP BY 1, 2, 3""")
def _(spark, d):
    return tr.audit_pairs(v.pred(spark, d), v.gt(spark, d), K, G)


ERR = "sqrt((px-gx)*(px-gx)+(py-gy)*(py-gy))"


@query("displacement_errors", "D1 D2 C1", f"{KEYS} ade fde success", "pair", f"""
SELECT model, scene_id, clip, avg({ERR}) AS ade, arg_max({ERR}, frame) AS fde,
       CASE WHEN arg_max({ERR}, frame) < 3 THEN 1 ELSE 0 END AS success FROM pair GROUP BY ALL""")
def _(spark, d):
    return tr.displacement_errors(_pair(spark, d), K)


@query("success_rate_by_model", "D1 D2 D3", "model:s clips:l ade fde success_rate", "pair", f"""
SELECT model, count(*) AS clips, avg(a) AS ade, avg(f) AS fde, avg(CASE WHEN f < 3 THEN 1.0 ELSE 0.0 END) AS success_rate
FROM (SELECT model, scene_id, clip, avg({ERR}) AS a, arg_max({ERR}, frame) AS f FROM pair GROUP BY ALL) GROUP BY model""")
def _(spark, d):
    e = tr.displacement_errors(_pair(spark, d), K)
    return e.groupBy("model").agg(F.count(F.lit(1)).alias("clips"), F.avg("ade").alias("ade"),
                                  F.avg("fde").alias("fde"), F.avg("success").alias("success_rate"))


@query("hausdorff_distance", "D4", f"{KEYS} hausdorff", "pair", """
WITH e AS (SELECT a.model, a.scene_id, a.clip, a.frame AS fa, b.frame AS fb,
           sqrt((a.px-b.gx)*(a.px-b.gx)+(a.py-b.gy)*(a.py-b.gy)) AS e
           FROM pair a JOIN pair b ON a.model=b.model AND a.scene_id=b.scene_id AND a.clip=b.clip),
l AS (SELECT model, scene_id, clip, max(m) AS h FROM (SELECT model, scene_id, clip, fa, min(e) AS m FROM e GROUP BY ALL) GROUP BY ALL),
r AS (SELECT model, scene_id, clip, max(m) AS h FROM (SELECT model, scene_id, clip, fb, min(e) AS m FROM e GROUP BY ALL) GROUP BY ALL)
SELECT model, scene_id, clip, greatest(l.h, r.h) AS hausdorff FROM l JOIN r USING (model, scene_id, clip)""")
def _(spark, d):
    return tr.hausdorff(_pair(spark, d), K)


@query("dynamic_time_warping", "D5 D7", f"{KEYS} dtw ndtw sdtw", "pair", f"""
WITH RECURSIVE q AS (SELECT *, row_number() OVER ({PW}) AS i, count(*) OVER ({PA}) AS t FROM pair),
c AS (SELECT a.model, a.scene_id, a.clip, a.t, a.i, b.i AS j, sqrt((a.px-b.gx)*(a.px-b.gx)+(a.py-b.gy)*(a.py-b.gy)) AS e
      FROM q a JOIN q b ON a.model=b.model AND a.scene_id=b.scene_id AND a.clip=b.clip),
s AS (SELECT *, sum(e) OVER (PARTITION BY model, scene_id, clip, i ORDER BY j) AS pre FROM c),
w AS (SELECT model, scene_id, clip, t, i, j, pre AS dcost FROM s WHERE i = 1
      UNION ALL
      SELECT model, scene_id, clip, t, i, j,
             pre + min(m - (pre - e)) OVER (PARTITION BY model, scene_id, clip ORDER BY j ROWS UNBOUNDED PRECEDING)
      FROM (SELECT n.*, least(w.dcost, coalesce(lag(w.dcost) OVER (PARTITION BY w.model, w.scene_id, w.clip ORDER BY w.j), w.dcost)) AS m
            FROM w JOIN s n ON n.model=w.model AND n.scene_id=w.scene_id AND n.clip=w.clip AND n.i=w.i+1 AND n.j=w.j) z),
f AS (SELECT model, scene_id, clip, arg_max({ERR}, frame) AS fde FROM pair GROUP BY ALL)
SELECT model, scene_id, clip, dcost AS dtw, exp(-dcost/(4.0*t)) AS ndtw,
       CASE WHEN fde < 2 THEN exp(-dcost/(4.0*t)) ELSE 0 END AS sdtw
FROM w JOIN f USING (model, scene_id, clip) WHERE i = t AND j = t""")
def _(spark, d):
    return tr.warping(_pair(spark, d), K)


@query("dynamic_similarity", "D6", f"{KEYS} dynamic_similarity", "pair", f"""
WITH s AS (SELECT *, sqrt(pow((px-lag(px) OVER w)/0.1,2)+pow((py-lag(py) OVER w)/0.1,2)) AS vp,
                     sqrt(pow((gx-lag(gx) OVER w)/0.1,2)+pow((gy-lag(gy) OVER w)/0.1,2)) AS vg FROM pair WINDOW w AS ({PW})),
a AS (SELECT *, vp - lag(vp) OVER w AS ap, vg - lag(vg) OVER w AS ag FROM s WINDOW w AS ({PW})),
r AS (SELECT model, scene_id, clip, vp, vg, ap, ag, row_number() OVER ({PA} ORDER BY vp NULLS LAST, frame) AS rvp, row_number() OVER ({PA} ORDER BY vg NULLS LAST, frame) AS rvg,
      row_number() OVER ({PA} ORDER BY ap NULLS LAST, frame) AS rap, row_number() OVER ({PA} ORDER BY ag NULLS LAST, frame) AS rag FROM a),
dv AS (SELECT a.model, a.scene_id, a.clip, avg(abs(a.vp-b.vg)) AS d FROM r a JOIN r b ON a.model=b.model AND a.scene_id=b.scene_id AND a.clip=b.clip AND a.rvp=b.rvg GROUP BY ALL),
da AS (SELECT a.model, a.scene_id, a.clip, avg(abs(a.ap-b.ag)) AS d FROM r a JOIN r b ON a.model=b.model AND a.scene_id=b.scene_id AND a.clip=b.clip AND a.rap=b.rag GROUP BY ALL)
SELECT model, scene_id, clip, exp(-dv.d)*exp(-da.d) AS dynamic_similarity FROM dv JOIN da USING (model, scene_id, clip) WHERE da.d IS NOT NULL""")
def _(spark, d):
    return tr.dynamic_similarity(_pair(spark, d), K)


v._sql("spd", f"""
SELECT *, sqrt(pow((x-lag(x) OVER w)/0.1,2)+pow((y-lag(y) OVER w)/0.1,2)) AS v FROM pred WINDOW w AS ({PW})
""", "pred")


@query("motion_consistency", "D8", f"{KEYS} consistency", "spd", f"""
SELECT model, scene_id, clip, CASE WHEN max(v) >= 0.1 THEN
  0.5*(exp(-stddev_pop(v)/(avg(v)+1e-9)) + exp(-stddev_pop(a)/(avg(abs(a))+1e-9))) END AS consistency
FROM (SELECT *, (v - lag(v) OVER ({PW}))/0.1 AS a FROM spd) GROUP BY ALL""")
def _(spark, d):
    return tr.smoothness(v.pred(spark, d), K)


v._sql("comfort_t", f"""
SELECT model, scene_id, clip,
  CASE WHEN ok THEN 1/(1+j/(len+1e-9)) END AS jerk_score, CASE WHEN ok THEN 1/(1+a/(len+1e-9)) END AS accel_score,
  CASE WHEN ok THEN 1/(1+yw/(len+1e-9)) END AS yaw_score
FROM (SELECT model, scene_id, clip, count(*) >= 5 AND max(sp) >= 0.1 AND sum(step) > 1 AS ok, sum(step) AS len,
        avg(jk) AS j, avg(CASE WHEN jk IS NOT NULL THEN am END) AS a, avg(abs(yr)) AS yw
      FROM (SELECT *, sqrt(pow((lead(ax) OVER w - lag(ax) OVER w)/0.2,2)+pow((lead(ay) OVER w - lag(ay) OVER w)/0.2,2)) AS jk,
              sqrt(ax*ax+ay*ay) AS am, sqrt(vx*vx+vy*vy) AS sp,
              ((lead(th) OVER w - lag(th) OVER w) - 2*pi()*floor((lead(th) OVER w - lag(th) OVER w + pi())/(2*pi())))/0.2 AS yr
            FROM (SELECT *, atan2(vy, vx) AS th FROM (
              SELECT *, sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)) AS step,
                (lead(x) OVER w - lag(x) OVER w)/0.2 AS vx, (lead(y) OVER w - lag(y) OVER w)/0.2 AS vy,
                (lead(x) OVER w - 2*x + lag(x) OVER w)/0.01 AS ax, (lead(y) OVER w - 2*y + lag(y) OVER w)/0.01 AS ay
              FROM pred WINDOW w AS ({PW}))) WINDOW w AS ({PW})) GROUP BY ALL)
""", "pred")


@query("comfort_score", "D9", f"{KEYS} comfort jerk_score accel_score yaw_score", "comfort_t",
       "SELECT *, exp((ln(jerk_score)+ln(accel_score)+ln(yaw_score))/3) AS comfort FROM comfort_t")
def _(spark, d):
    return tr.comfort(v.pred(spark, d), K)


v._sql("curv_k", f"""
SELECT *, abs(vx*ay-vy*ax)/pow(vx*vx+vy*vy+1e-9, 1.5) AS k, sqrt(vx*vx+vy*vy) AS sp
FROM (SELECT *, (vx-lag(vx) OVER w)/0.1 AS ax, (vy-lag(vy) OVER w)/0.1 AS ay
      FROM (SELECT *, (x-lag(x) OVER w)/0.1 AS vx, (y-lag(y) OVER w)/0.1 AS vy FROM pred WINDOW w AS ({PW})) WINDOW w AS ({PW}))
""", "pred")


@query("curvature_score", "D10", f"{KEYS} curvature_score trimmed_score", "curv_k", f"""
WITH t AS (SELECT *, quantile_cont(k, 0.9) OVER ({PA}) AS thr FROM curv_k)
SELECT model, scene_id, clip, CASE WHEN max(sp) >= 0.1 THEN 1/(1+sqrt(avg(k*k))) END AS curvature_score,
       CASE WHEN max(sp) >= 0.1 THEN 1/(1+sqrt(avg(CASE WHEN k <= thr+1e-9 THEN k*k END))) END AS trimmed_score FROM t GROUP BY ALL""")
def _(spark, d):
    p = v.pred(spark, d)
    return tr.curvature(p, K).join(tr.curvature(p, K, pct=90).withColumnRenamed("curvature_score", "trimmed_score"), K)


@query("speed_score", "D11", f"{KEYS} speed_score", "spd", """
SELECT model, scene_id, clip, CASE WHEN max(v) >= 0.1 THEN greatest(0, least(1, ln(1+avg(v))/ln(16))) WHEN max(v) IS NOT NULL THEN 0 END AS speed_score
FROM spd GROUP BY ALL""")
def _(spark, d):
    return tr.speed_score(v.pred(spark, d), K)


@query("trajectory_quality", "D12", "model:s clips:l quality", "comfort_t curv_k spd", """
WITH c AS (SELECT model, scene_id, clip, exp((ln(jerk_score)+ln(accel_score)+ln(yaw_score))/3) AS s FROM comfort_t),
k AS (SELECT model, scene_id, clip, CASE WHEN max(sp) >= 0.1 THEN 1/(1+sqrt(avg(k*k))) END AS s FROM curv_k GROUP BY ALL),
s AS (SELECT model, scene_id, clip, CASE WHEN max(v) >= 0.1 THEN greatest(0, least(1, ln(1+avg(v))/ln(16))) WHEN max(v) IS NOT NULL THEN 0 END AS s FROM spd GROUP BY ALL),
u AS (SELECT * FROM c UNION ALL SELECT * FROM k UNION ALL SELECT * FROM s),
q AS (SELECT model, scene_id, clip, avg(s) AS q FROM u GROUP BY ALL)
SELECT model, count(*) AS clips, avg(q) AS quality FROM q GROUP BY model""")
def _(spark, d):
    q = tr.quality(v.pred(spark, d), K)
    return q.groupBy("model").agg(F.count(F.lit(1)).alias("clips"), F.avg("quality").alias("quality"))


@query("alignment_fit", "F9", f"{KEYS} theta scale centred_theta centred_scale", "pair", f"""
WITH o AS (SELECT *, px-first_value(px) OVER w AS ax, py-first_value(py) OVER w AS ay,
   px-avg(px) OVER ({PA}) AS cx, py-avg(py) OVER ({PA}) AS cy, gx-avg(gx) OVER ({PA}) AS dx, gy-avg(gy) OVER ({PA}) AS dy FROM pair WINDOW w AS ({PW})),
s AS (SELECT model, scene_id, clip, count(*) AS n, sum(ax*gy-ay*gx) AS c, sum(ax*gx+ay*gy) AS d, sum(ax*ax+ay*ay) AS pp,
   sum(cx*dy-cy*dx) AS c2, sum(cx*dx+cy*dy) AS d2, sum(cx*cx+cy*cy) AS pp2 FROM o GROUP BY ALL)
SELECT model, scene_id, clip, CASE WHEN n >= 2 THEN atan2(c, d) ELSE 0 END AS theta,
  CASE WHEN n >= 2 AND pp/n > 1e-9 THEN sqrt(c*c+d*d)/pp ELSE 1 END AS scale,
  CASE WHEN n >= 2 THEN atan2(c2, d2) ELSE 0 END AS centred_theta,
  CASE WHEN n >= 2 AND pp2/n > 1e-9 THEN sqrt(c2*c2+d2*d2)/pp2 ELSE 1 END AS centred_scale FROM s""")
def _(spark, d):
    p = _pair(spark, d)
    a = tr.fit_alignment(p, K, with_scale=True).select(*K, "theta", "scale")
    b = tr.fit_alignment(p, K, with_scale=True, centred=True)
    return a.join(b.select(*K, F.col("theta").alias("centred_theta"), F.col("scale").alias("centred_scale")), K)


v._sql("jobs", """
SELECT p.model, p.scene_id, p.clip, greatest(p.n, g.n) AS target, p.n AS np, g.n AS ng
FROM (SELECT model, scene_id, clip, count(*) AS n FROM pred GROUP BY ALL) p JOIN (SELECT scene_id, clip, count(*) AS n FROM gt GROUP BY ALL) g USING (scene_id, clip)
""", "pred", "gt")
v._sql("rs", """
WITH g AS (SELECT *, unnest(generate_series(0, target - 1)) AS j FROM jobs),
p AS (SELECT model, scene_id, clip, y AS x, -x AS y, row_number() OVER (PARTITION BY model, scene_id, clip ORDER BY frame) - 1 AS i FROM pred),
t AS (SELECT scene_id, clip, x, y, row_number() OVER (PARTITION BY scene_id, clip ORDER BY frame) - 1 AS i FROM ego)
SELECT g.model, g.scene_id, g.clip, g.j AS frame,
  a.x + (coalesce(b.x, a.x) - a.x) * ((g.j*(np-1)) % greatest(target-1,1))::DOUBLE/greatest(target-1,1) AS px,
  a.y + (coalesce(b.y, a.y) - a.y) * ((g.j*(np-1)) % greatest(target-1,1))::DOUBLE/greatest(target-1,1) AS py,
  c.x + (coalesce(d.x, c.x) - c.x) * ((g.j*(ng-1)) % greatest(target-1,1))::DOUBLE/greatest(target-1,1) AS gx,
  c.y + (coalesce(d.y, c.y) - c.y) * ((g.j*(ng-1)) % greatest(target-1,1))::DOUBLE/greatest(target-1,1) AS gy
FROM g
JOIN p a ON a.model=g.model AND a.scene_id=g.scene_id AND a.clip=g.clip AND a.i = (g.j*(np-1)) // greatest(target-1,1)
LEFT JOIN p b ON b.model=g.model AND b.scene_id=g.scene_id AND b.clip=g.clip AND b.i = a.i+1
JOIN t c ON c.scene_id=g.scene_id AND c.clip=g.clip AND c.i = (g.j*(ng-1)) // greatest(target-1,1)
LEFT JOIN t d ON d.scene_id=g.scene_id AND d.clip=g.clip AND d.i = c.i+1
""", "jobs", "ego", "pred")
v._sql("aligned", f"""
WITH o AS (SELECT *, px-first_value(px) OVER ({PW}) AS ax, py-first_value(py) OVER ({PW}) AS ay FROM rs),
s AS (SELECT model, scene_id, clip, CASE WHEN count(*) >= 2 THEN atan2(sum(ax*gy-ay*gx), sum(ax*gx+ay*gy)) ELSE 0 END AS th FROM o GROUP BY ALL)
SELECT o.model, o.scene_id, o.clip, o.frame, gx, gy, cos(th)*ax - sin(th)*ay AS x, sin(th)*ax + cos(th)*ay AS y
FROM o JOIN s USING (model, scene_id, clip)
""", "rs")
v._sql("scene_m", f"""
SELECT *, abs(pred_distance_m-gt_distance_m) AS distance_abs_error_m, pred_distance_m-gt_distance_m AS distance_signed_error_m,
  abs(pred_distance_m-gt_distance_m)/greatest(abs(gt_distance_m),5,1e-9) AS distance_abs_rel_error,
  (pred_distance_m-gt_distance_m)/greatest(abs(gt_distance_m),5,1e-9) AS distance_signed_rel_error,
  abs(pred_displacement_m-gt_displacement_m) AS displacement_abs_error_m, pred_displacement_m-gt_displacement_m AS displacement_signed_error_m,
  abs(pred_displacement_m-gt_displacement_m)/greatest(abs(gt_displacement_m),5,1e-9) AS displacement_abs_rel_error,
  (pred_displacement_m-gt_displacement_m)/greatest(abs(gt_displacement_m),5,1e-9) AS displacement_signed_rel_error,
  endpoint_error_m/greatest(abs(gt_displacement_m),5,1e-9) AS endpoint_rel_error,
  0.5*(abs(pred_distance_m-gt_distance_m)/greatest(abs(gt_distance_m),5,1e-9)+abs(pred_displacement_m-gt_displacement_m)/greatest(abs(gt_displacement_m),5,1e-9)) AS combined_abs_rel_error,
  0.5*(abs(pred_distance_m-gt_distance_m)/greatest(abs(gt_distance_m),5,1e-9)+endpoint_error_m/greatest(abs(gt_displacement_m),5,1e-9)) AS combined_endpoint_distance_rel_error,
  0.5*(abs(pred_distance_m-gt_distance_m)+endpoint_error_m) AS combined_endpoint_distance_error_m
FROM (SELECT *, sqrt(gt_forward_m*gt_forward_m+gt_lateral_left_m*gt_lateral_left_m) AS gt_displacement_m,
  sqrt(pred_forward_m*pred_forward_m+pred_lateral_left_m*pred_lateral_left_m) AS pred_displacement_m,
  pred_forward_m-gt_forward_m AS forward_error_m, pred_lateral_left_m-gt_lateral_left_m AS lateral_left_error_m,
  sqrt(pow(pred_forward_m-gt_forward_m,2)+pow(pred_lateral_left_m-gt_lateral_left_m,2)) AS endpoint_error_m
 FROM (SELECT model, scene_id, clip, count(*) AS gt_frames, 1.0 AS alignment_scale, coalesce(sum(sg),0) AS gt_distance_m, coalesce(sum(sp),0) AS pred_distance_m,
   arg_max(gx,frame)-arg_min(gx,frame) AS gt_forward_m, arg_max(gy,frame)-arg_min(gy,frame) AS gt_lateral_left_m,
   arg_max(x,frame)-arg_min(x,frame) AS pred_forward_m, arg_max(y,frame)-arg_min(y,frame) AS pred_lateral_left_m,
   avg(sqrt((x-gx)*(x-gx)+(y-gy)*(y-gy))) AS ade_m
  FROM (SELECT *, sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)) AS sp, sqrt(pow(gx-lag(gx) OVER w,2)+pow(gy-lag(gy) OVER w,2)) AS sg
        FROM aligned WINDOW w AS ({PW})) GROUP BY ALL))
""", "aligned")
SCENE_COLS = ("gt_distance_m pred_distance_m distance_abs_error_m distance_signed_error_m distance_abs_rel_error distance_signed_rel_error "
              "gt_displacement_m pred_displacement_m displacement_abs_error_m displacement_signed_error_m displacement_abs_rel_error "
              "displacement_signed_rel_error endpoint_error_m endpoint_rel_error ade_m gt_forward_m pred_forward_m forward_error_m "
              "gt_lateral_left_m pred_lateral_left_m lateral_left_error_m combined_abs_rel_error combined_endpoint_distance_rel_error "
              "combined_endpoint_distance_error_m")


def _scenes(spark, d):
    a = shared(v.traj_all(spark, d))
    return tr.scene_metrics(a.where("model <> 'gt'"), a.where("model = 'gt'").drop("model"), K, G)


@query("scene_metrics", "D13 B28 F9 E4 B1 B2", f"{KEYS} gt_frames:l alignment_scale {SCENE_COLS}", "scene_m", "SELECT * FROM scene_m")
def _(spark, d):
    return _scenes(spark, d)


_MEANS = ", ".join(f"avg({c}) AS mean_{c}" for c in tr.MODEL_MEANS)


@query("model_means", "D14", "model:s num_scenes:l " + " ".join(f"mean_{c}" for c in tr.MODEL_MEANS), "scene_m",
       f"SELECT model, count(*) AS num_scenes, {_MEANS} FROM scene_m GROUP BY model")
def _(spark, d):
    return tr.model_means(_scenes(spark, d))


@query("model_ranking", "F1 D14 C2 A2", "rank:l model:s num_scenes:l mean_ade_m mean_endpoint_error_m mean_combined_abs_rel_error", "scene_m", """
WITH m AS (SELECT model, count(*) AS num_scenes, avg(ade_m) AS mean_ade_m, avg(endpoint_error_m) AS mean_endpoint_error_m,
           avg(combined_abs_rel_error) AS mean_combined_abs_rel_error FROM scene_m GROUP BY model)
SELECT *, rank() OVER (ORDER BY mean_combined_abs_rel_error) AS rank FROM m""")
def _(spark, d):
    return tr.rank_models(tr.model_means(_scenes(spark, d)), "mean_combined_abs_rel_error")


@query("displacement_rank_tolerance", "F1", "rank:l model:s coarse_score", "pair", f"""
WITH m AS (SELECT model, floor(avg({ERR}) / 2) AS coarse_score FROM pair GROUP BY model)
SELECT *, rank() OVER (ORDER BY coarse_score) AS rank FROM m""")
def _(spark, d):
    m = _pair(spark, d).groupBy("model").agg(
        F.floor(F.avg(tr.dist(F.col("px") - F.col("gx"), F.col("py") - F.col("gy"))) / 2).cast("double").alias("coarse_score"))
    return tr.rank_models(m, "coarse_score")


v._sql("inventory", """
SELECT model || '-samples-outputs' AS folder, scene_id, 'scene' || scene_id || '/' || clip || '/traj.parquet' AS path
FROM pred GROUP BY model, scene_id, clip
""", "pred")


@query("discover_predictions", "A2", "model:s scene_id:l path:s", "inventory", """
SELECT replace(folder, '-samples-outputs', '') AS model, scene_id, min(path) AS path FROM inventory GROUP BY ALL""")
def _(spark, d):
    return rk.discover_predictions(_inventory(spark, d), "-samples-outputs")


def _inventory(spark, d):
    p = v.pred(spark, d).select("model", "scene_id", "clip").distinct()
    return p.select(F.concat("model", F.lit("-samples-outputs")).alias("folder"), "scene_id",
                    F.concat(F.lit("scene"), "scene_id", F.lit("/"), "clip", F.lit("/traj.parquet")).alias("path"))


@query("select_models_and_scenes", "A3 F11", "model:s scene_id:l path:s", "inventory", """
SELECT replace(folder, '-samples-outputs', '') AS model, scene_id, min(path) AS path FROM inventory
WHERE replace(folder, '-samples-outputs', '') IN ('m1', 'm3', 'm6') AND scene_id IN (SELECT DISTINCT scene_id FROM inventory ORDER BY 1 LIMIT 12)
GROUP BY ALL""")
def _(spark, d):
    found = rk.discover_predictions(_inventory(spark, d), "-samples-outputs")
    wanted = rk.parse_selection(spark.range(1).select(F.lit("m1, m3,,m6 ").alias("arg")), "arg", "model")
    return rk.limit_dimension(found.join(wanted, "model", "left_semi"), "scene_id", 12)


@query("scoring_jobs", "C2 G1", "model:s scene_id:l common:b runnable:b", "pred gt", """
WITH m AS (SELECT DISTINCT model FROM pred), s AS (SELECT DISTINCT scene_id FROM traj_all),
h AS (SELECT m.model, s.scene_id, EXISTS (SELECT 1 FROM pred p WHERE p.model=m.model AND p.scene_id=s.scene_id)
        AND EXISTS (SELECT 1 FROM gt g WHERE g.scene_id=s.scene_id) AS runnable FROM m, s)
SELECT model, scene_id, runnable, bool_and(runnable) OVER (PARTITION BY scene_id) AS common FROM h""")
def _(spark, d):
    a = v.traj_all(spark, d).select("model", "scene_id").distinct()
    return rk.build_jobs(a.where("model <> 'gt'"), a.where("model = 'gt'").select("scene_id"))


@query("common_scene_ids", "G1", "scene_id:l", "pred gt", """
SELECT scene_id FROM pred WHERE scene_id IN (SELECT scene_id FROM gt) GROUP BY scene_id HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM pred)""")
def _(spark, d):
    a = v.traj_all(spark, d).select("model", "scene_id").distinct()
    jobs = rk.build_jobs(a.where("model <> 'gt'"), a.where("model = 'gt'").select("scene_id"))
    return jobs.where("common").select("scene_id").distinct()


@query("validate_trajectories", "A4", f"{KEYS} frames:l channels:l valid:b reason:s", "traj_all", """
SELECT model, scene_id, clip, count(*) AS frames, 2 AS channels, count(*) >= 2 AS valid,
       CASE WHEN count(*) < 2 THEN 'too short' ELSE 'ok' END AS reason FROM traj_all GROUP BY ALL""")
def _(spark, d):
    a = v.traj_all(spark, d).withColumn("point", F.array("x", "y"))
    return rk.validate_points(a, K, "point", min_frames=2)

"""Depth, flow, point clouds, cameras, forecasts, polylines, grids and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayscore.operators import depthflow as df_
from wayscore.operators import motion as mo
from wayscore.operators import trajectory as tr
from wayscore.plans import views as v
from wayscore.plans.registry import query

K = v.TRAJ_KEY
TK = ["video_id", "clip", "track_id"]
TKEYS = "video_id:l clip:l track_id:l"

_E = [0.01 + (5.0 - 0.01) / 99 * i for i in range(100)]
v._sql("dval", "SELECT image_id, gt AS g, pred AS p, ln(pred)-ln(gt) AS lr FROM depth WHERE valid = 1", "depth")
v._sql("dalign", """
SELECT image_id, ((count(*)+1e-9)*sum(p*g)-sum(p)*sum(g))/((sum(p*p)+1e-9)*(count(*)+1e-9)-sum(p)*sum(p)) AS sc,
 ((sum(p*p)+1e-9)*sum(g)-sum(p)*sum(p*g))/((sum(p*p)+1e-9)*(count(*)+1e-9)-sum(p)*sum(p)) AS sh, quantile_disc(g,0.5)/quantile_disc(p,0.5) AS rt,
 100*abs(quantile_disc(lr,0.5)) AS medianlog FROM dval GROUP BY image_id
""", "dval")
BASE = ("d1", "d2", "d3", "rmse", "rmselog", "arel", "sqrel", "log10", "silog", "d_auc", "tau", "medianlog")
ALN = tuple(f"{n}_{t}" for t in ("ssi", "si") for n in ("tau", "d1", "arel"))


def _al(t: str, q: str) -> str:
    r = f"greatest(g/({q}), ({q})/g)"
    return (f"avg(CASE WHEN {r} < 1.03 THEN 1.0 ELSE 0 END) AS tau_{t}, avg(CASE WHEN {r} < 1.25 THEN 1.0 ELSE 0 END) AS d1_{t}, avg(abs(g-({q}))/g) AS arel_{t}")


v._sql("dsuite", f"""
WITH r AS (SELECT *, greatest(g/p, p/g) AS r FROM dval),
u AS (SELECT image_id, avg(list_sum(list_transform(range(0,100), lambda i: CASE WHEN r < pow(1.25::DOUBLE, 0.01::DOUBLE + (4.99::DOUBLE/99)*i) THEN (CASE WHEN i IN (0,99) THEN 0.5 ELSE 1.0 END) ELSE 0 END)))*(4.99::DOUBLE/99)/5 AS d_auc FROM r GROUP BY image_id),
b AS (SELECT image_id, avg(CASE WHEN r<1.25 THEN 1.0 ELSE 0 END) AS d1, avg(CASE WHEN r<1.25*1.25 THEN 1.0 ELSE 0 END) AS d2, avg(CASE WHEN r<1.25*1.25*1.25 THEN 1.0 ELSE 0 END) AS d3,
 sqrt(avg((g-p)*(g-p))) AS rmse, sqrt(avg(lr*lr)) AS rmselog, avg(abs(g-p)/g) AS arel, avg((g-p)*(g-p)/g) AS sqrel, avg(abs(log10(p)-log10(g))) AS log10, 100*stddev_samp(lr) AS silog,
 avg(CASE WHEN r<1.03 THEN 1.0 ELSE 0 END) AS tau FROM r GROUP BY image_id),
a AS (SELECT image_id, {_al('ssi', 'p*sc+sh')}, {_al('si', 'p*rt')} FROM dval JOIN dalign USING (image_id) GROUP BY image_id)
SELECT * FROM b JOIN u USING (image_id) JOIN a USING (image_id) JOIN (SELECT image_id, medianlog FROM dalign) USING (image_id)
""", "dval", "dalign")


@query("depth_error_suite", "D39", "image_id:l " + " ".join(BASE + ALN), "dsuite", "SELECT * FROM dsuite")
def _(spark, d):
    return df_.depth_errors(v.depth(spark, d), ["image_id"])


@query("depth_metric_store", "D41 D51", "kind:s metric:s value", "dsuite", """
WITH k AS (SELECT CASE WHEN image_id % 2 = 0 THEN 'indoor' ELSE 'outdoor' END AS kind, * FROM dsuite),
m AS (SELECT kind, round_even(avg(d1),5) AS d1, round_even(avg(arel),5) AS arel, round_even(avg(silog),5) AS silog FROM k GROUP BY kind)
SELECT kind, 'd1' AS metric, d1 AS value FROM m UNION ALL SELECT kind, 'arel', arel FROM m UNION ALL SELECT kind, 'silog', silog FROM m""")
def _(spark, d):
    s = df_.depth_errors(v.depth(spark, d), ["image_id"], measures=("d1", "arel", "silog"))
    s = s.withColumn("kind", F.when(F.col("image_id") % 2 == 0, "indoor").otherwise("outdoor"))
    return df_.metric_store(s, ["kind"], ["d1", "arel", "silog"])


@query("masked_depth_statistics", "D51", "image_id:l masked_mean masked_var scale shift", "depth", """
SELECT image_id, avg(pred) FILTER (WHERE valid=1) AS masked_mean, var_pop(pred) FILTER (WHERE valid=1) AS masked_var, regr_slope(gt, pred) AS scale, regr_intercept(gt, pred) AS shift FROM depth GROUP BY image_id""")
def _(spark, d):
    t = v.depth(spark, d)
    return df_.masked_statistics(t, ["image_id"], "pred", "valid").join(df_.scale_shift(t, ["image_id"], "gt", "pred"), "image_id")


v._sql("flow", """
SELECT image_id, gt AS u_gt, gt/3 AS v_gt, gt + (pred-gt)*2 AS u, gt/3 + (pred-gt)/2 AS v, valid FROM depth
""", "depth")


def _flow(spark, d):
    t = v.depth(spark, d)
    g, e = F.col("gt"), F.col("pred") - F.col("gt")
    return t.select("image_id", g.alias("u_gt"), (g / 3).alias("v_gt"), (g + e * 2).alias("u"), (g / 3 + e / 2).alias("v"), "valid")


@query("flow_errors_per_image", "D42", "image_id:l epe px1 px3 px5 outliers:l pixels:l", "flow", """
WITH e AS (SELECT *, sqrt((u-u_gt)*(u-u_gt)+(v-v_gt)*(v-v_gt)) AS e, sqrt(u_gt*u_gt+v_gt*v_gt) AS m FROM flow WHERE valid=1)
SELECT image_id, avg(e) AS epe, avg(CASE WHEN e<1 THEN 1.0 ELSE 0 END) AS px1, avg(CASE WHEN e<3 THEN 1.0 ELSE 0 END) AS px3, avg(CASE WHEN e<5 THEN 1.0 ELSE 0 END) AS px5,
 count(*) FILTER (WHERE e>3 AND e/m>0.05) AS outliers, count(*) AS pixels FROM e GROUP BY image_id""")
def _(spark, d):
    return df_.flow_errors(_flow(spark, d), ["image_id"])


@query("flow_error_summary", "D42", "epe outlier_1px outlier_3px outlier_5px fl", "flow", """
WITH e AS (SELECT *, sqrt((u-u_gt)*(u-u_gt)+(v-v_gt)*(v-v_gt)) AS e, sqrt(u_gt*u_gt+v_gt*v_gt) AS m FROM flow WHERE valid=1),
i AS (SELECT image_id, avg(e) AS epe, avg(CASE WHEN e<1 THEN 1.0 ELSE 0 END) AS px1, avg(CASE WHEN e<3 THEN 1.0 ELSE 0 END) AS px3, avg(CASE WHEN e<5 THEN 1.0 ELSE 0 END) AS px5,
 count(*) FILTER (WHERE e>3 AND e/m>0.05) AS o, count(*) AS n FROM e GROUP BY image_id)
SELECT avg(epe) AS epe, 100*(1-avg(px1)) AS outlier_1px, 100*(1-avg(px3)) AS outlier_3px, 100*(1-avg(px5)) AS outlier_5px, 100.0*sum(o)/sum(n) AS fl FROM i""")
def _(spark, d):
    return df_.flow_summary(df_.flow_errors(_flow(spark, d), ["image_id"]))


def _clip_sql(n: int) -> str:
    out = "r0 AS (SELECT image_id, pred AS x FROM depth)"
    for i in range(n):
        out += f", r{i+1} AS (SELECT image_id, x FROM (SELECT *, avg(x) OVER (PARTITION BY image_id) AS m, stddev_pop(x) OVER (PARTITION BY image_id) AS s FROM r{i}) WHERE x > m-2*s AND x < m+2*s)"
    return out


@query("sigma_clipped_statistics", "D47", "image_id:l mean std n:l", "depth", f"WITH {_clip_sql(3)} SELECT image_id, avg(x) AS mean, stddev_pop(x) AS std, count(*) AS n FROM r3 GROUP BY image_id")
def _(spark, d):
    return df_.clip_sigma(v.depth(spark, d), ["image_id"], "pred")


@query("agent_mask_depth", "D49", "image_id:l mean_depth top_median", "depth", """
WITH m AS (SELECT image_id, l_linenumber AS y, pred AS depth FROM depth WHERE valid=1),
a AS (SELECT image_id, quantile_cont(depth,0.02) AS lo, quantile_cont(depth,0.98) AS hi, min(y) AS y0, max(y) AS y1 FROM m GROUP BY image_id),
x AS (SELECT m.image_id, avg(depth) AS mean_depth FROM m JOIN a USING (image_id) WHERE depth >= lo-1e-9 AND depth <= hi+1e-9 GROUP BY m.image_id),
y AS (SELECT m.image_id, quantile_cont(depth,0.5) AS top_median FROM m JOIN a USING (image_id) WHERE y < y0+(y1-y0+1)*0.5 GROUP BY m.image_id)
SELECT * FROM x JOIN y USING (image_id)""")
def _(spark, d):
    m = v.depth(spark, d).where("valid = 1").select("image_id", F.col("l_linenumber").alias("y"), F.col("pred").alias("depth"))
    a = df_.agent_depth(m, ["image_id"]).withColumnRenamed("agent_depth", "mean_depth")
    b = df_.agent_depth(m, ["image_id"], "top_median", False).withColumnRenamed("agent_depth", "top_median")
    return a.join(b, "image_id")


# ---- points ---------------------------------------------------------------------------------------

v._sql("cloud", """
SELECT l_orderkey // 256 AS cloud, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS side, l_orderkey * 8 + l_linenumber AS id,
 (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 89)::DOUBLE + l_quantity/100 AS y FROM lineitem
""")


def _cloud(spark, d):
    li = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.select(v.div("l_orderkey", 256).alias("cloud"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("side"),
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 97).cast("double").alias("x"),
                     ((F.col("l_suppkey") % 89).cast("double") + F.col("l_quantity") / 100).alias("y"))


def _sides(spark, d):
    c = _cloud(spark, d)
    return c.where("side = 'a'").drop("side"), c.where("side = 'b'").drop("side")


v._sql("qpt", "SELECT cloud, x, y, count(*) AS copies FROM cloud WHERE side='a' GROUP BY ALL", "cloud")
v._sql("nn1", "SELECT q.cloud, q.x, q.y, q.copies, min((q.x-r.x)*(q.x-r.x)+(q.y-r.y)*(q.y-r.y)) AS d2 FROM qpt q JOIN cloud r ON r.cloud=q.cloud AND r.side='b' GROUP BY ALL", "qpt", "cloud")
v._sql("nn2", """SELECT q.cloud, q.x, q.y, q.copies, min((q.x-r.x)*(q.x-r.x)+(q.y-r.y)*(q.y-r.y)) AS d2 FROM (SELECT cloud, x, y, count(*) AS copies FROM cloud WHERE side='b' GROUP BY ALL) q
 JOIN cloud r ON r.cloud=q.cloud AND r.side='a' GROUP BY ALL""", "cloud")


@query("nearest_points_k3", "C13", "cloud:l x y copies:l rank:l d2 ref:l", "qpt cloud", """
WITH p AS (SELECT q.*, (q.x-r.x)*(q.x-r.x)+(q.y-r.y)*(q.y-r.y) AS d2, r.id AS ref FROM qpt q JOIN (SELECT DISTINCT cloud, x, y, id FROM cloud WHERE side='b') r USING (cloud))
SELECT cloud, x, y, copies, ref, d2, row_number() OVER (PARTITION BY cloud, x, y ORDER BY d2, ref) AS rank FROM p QUALIFY rank <= 3""")
def _(spark, d):
    a, b = _sides(spark, d)
    return df_.nearest_points(a, b.distinct(), ["cloud"], ["x", "y"], 3)


@query("chamfer_distance", "C13 D40", "cloud:l a_to_b b_to_a chamfer", "nn1 nn2", """
WITH a AS (SELECT cloud, sum(sqrt(d2)*copies)/sum(copies) AS a_to_b FROM nn1 GROUP BY cloud), b AS (SELECT cloud, sum(sqrt(d2)*copies)/sum(copies) AS b_to_a FROM nn2 GROUP BY cloud)
SELECT *, (a_to_b+b_to_a)/2 AS chamfer FROM a JOIN b USING (cloud)""")
def _(spark, d):
    a, b = _sides(spark, d)
    return df_.chamfer(a, b, ["cloud"], ["x", "y"])


THR = tuple(round(0.05 * 1.06 ** i, 6) for i in range(100))
_T = "[" + ",".join(f"{t}::DOUBLE" for t in THR) + "]"


@query("point_cloud_f1", "D40", "cloud:l f1 pr_auc", "nn1 nn2", f"""
WITH t AS (SELECT i, {_T}[i] AS t FROM generate_series(1,100) s(i)),
p AS (SELECT cloud, i, sum(CASE WHEN d2 < t THEN copies ELSE 0 END)::DOUBLE/sum(copies) AS p FROM nn1, t GROUP BY ALL), r AS (SELECT cloud, i, sum(CASE WHEN d2 < t THEN copies ELSE 0 END)::DOUBLE/sum(copies) AS r FROM nn2, t GROUP BY ALL),
f AS (SELECT cloud, i, p, r, CASE WHEN p+r > 0 THEN 2*p*r/(p+r) ELSE 0 END AS f, lag(p) OVER (PARTITION BY cloud ORDER BY i) AS p0, lag(r) OVER (PARTITION BY cloud ORDER BY i) AS r0 FROM p JOIN r USING (cloud, i))
SELECT cloud, sum(CASE WHEN i IN (1,100) THEN f/2 ELSE f END)/100 AS f1, sum((p+p0)/2*(r-r0)) AS pr_auc FROM f GROUP BY cloud""")
def _(spark, d):
    a, b = _sides(spark, d)
    return df_.point_f1(a, b, ["cloud"], ["x", "y"], THR)


@query("matched_point_error", "D40", "model:s scene_id:l clip:l mse_3d", "pair", "SELECT model, scene_id, clip, avg(sqrt((px-gx)*(px-gx)+(py-gy)*(py-gy))) AS mse_3d FROM pair GROUP BY ALL")
def _(spark, d):
    a = v.traj_all(spark, d)
    p = tr.pair_frames(a.where("model <> 'gt'"), a.where("model = 'gt'").drop("model"), v.SCENE_KEY)
    return df_.point_error(p, K, {"gx": "px", "gy": "py"})


# ---- cameras ------------------------------------------------------------------------------------------

@query("world_positions", "B9", f"{TKEYS} frame:l x z", "tracks", """
WITH c AS (SELECT *, 500.0+frame AS fx, 480.0+frame AS fy, 245.0 AS x0, 50.0 AS y0, 5+k/10.0 AS z, 0.01*frame AS a FROM tracks),
r AS (SELECT *, (cx-x0)/fx*z AS xc, (cy-y0)/fy*z AS yc FROM c)
SELECT video_id, clip, track_id, frame, cos(a)*xc + sin(a)*z + 0.1*frame AS x, -sin(a)*xc + cos(a)*z + 0.5*frame AS z FROM r""")
def _(spark, d):
    f = F.col("frame").cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    k = [500.0 + f, zero, F.lit(245.0), zero, 480.0 + f, F.lit(50.0), zero, zero, one]
    a = 0.01 * f
    rot = [F.cos(a), zero, F.sin(a), zero, one, zero, -F.sin(a), zero, F.cos(a)]
    x, z = df_.back_project(F.col("cx"), F.col("cy"), 5 + F.col("k") / 10.0, k, rot, [0.1 * f, zero, 0.5 * f])
    return v.tracks(spark, d).select(*TK, "frame", x.alias("x"), z.alias("z"))


@query("chained_poses", "B10", f"{TKEYS} frame:l x y z", "tracks", """
WITH RECURSIVE s AS (SELECT video_id, clip, track_id, frame, row_number() OVER w AS r, CASE WHEN k % 17 = 3 THEN NULL ELSE (k-50)*0.001 END AS a, k*0.01 AS tx, 1.0+k*0.001 AS tz FROM tracks WINDOW w AS (PARTITION BY video_id, clip, track_id ORDER BY frame)),
p AS (SELECT video_id, clip, track_id, 0::BIGINT AS r, 0::BIGINT AS frame, 1.0::DOUBLE AS c, 0.0::DOUBLE AS s, 0.0::DOUBLE AS x, 0.0::DOUBLE AS z FROM s WHERE r = 1
 UNION ALL SELECT p.video_id, p.clip, p.track_id, s.r, s.frame, CASE WHEN s.a IS NULL THEN p.c ELSE p.c*cos(s.a)+p.s*sin(s.a) END, CASE WHEN s.a IS NULL THEN p.s ELSE p.s*cos(s.a)-p.c*sin(s.a) END,
  CASE WHEN s.a IS NULL THEN p.x ELSE p.x + p.c*(-(cos(s.a)*s.tx - sin(s.a)*s.tz)) + p.s*(-(sin(s.a)*s.tx + cos(s.a)*s.tz)) END,
  CASE WHEN s.a IS NULL THEN p.z ELSE p.z - p.s*(-(cos(s.a)*s.tx - sin(s.a)*s.tz)) + p.c*(-(sin(s.a)*s.tx + cos(s.a)*s.tz)) END
 FROM p JOIN s ON s.video_id=p.video_id AND s.clip=p.clip AND s.track_id=p.track_id AND s.r=p.r+1)
SELECT video_id, clip, track_id, frame, x, 0.0 AS y, z FROM p WHERE r > 0""")
def _(spark, d):
    a = (F.col("k") - 50) * 0.001
    zero, one = F.lit(0.0), F.lit(1.0)
    scale = F.when(F.col("k") % 17 == 3, 2.0).otherwise(1.0)
    rot = F.array(F.cos(a) * scale, zero, F.sin(a), zero, one, zero, -F.sin(a), zero, F.cos(a))
    t = F.array(F.col("k") * 0.01, zero, 1.0 + F.col("k") * 0.001)
    return df_.chain_poses(v.tracks(spark, d).withColumns({"rot": rot, "t": t}), TK)


@query("spherical_round_trip", "B31", f"{TKEYS} frame:l theta phi r x y z", "tracks", """
WITH p AS (SELECT *, cx-100 AS px, cy-50 AS py, 10.0+k AS pz FROM tracks), s AS (SELECT *, sqrt(px*px+py*py+pz*pz) AS r FROM p)
SELECT video_id, clip, track_id, frame, atan2(px/r, pz/r) AS theta, acos(py/r) AS phi, r, px AS x, py AS y, pz AS z FROM s""")
def _(spark, d):
    t = v.tracks(spark, d).withColumns({"px": F.col("cx") - 100, "py": F.col("cy") - 50, "pz": 10.0 + F.col("k")})
    th, ph, r = df_.euclidean_to_spherical(F.col("px"), F.col("py"), F.col("pz"))
    t = t.withColumns({"theta": th, "phi": ph, "r": r})
    x, y, z = df_.spherical_to_euclidean(F.col("theta"), F.col("phi"), F.col("r"))
    return t.select(*TK, "frame", "theta", "phi", "r", x.alias("x"), y.alias("y"), z.alias("z"))


@query("projected_depth_map", "B31", "video_id:l clip:l py:l px:l depth points:l", "tracks", """
WITH p AS (SELECT video_id, clip, cx-200 AS x, cy-40 AS y, 20.0+k AS z FROM tracks), q AS (SELECT *, trunc((30*x+16*z)/z)::BIGINT AS px, trunc((30*y+12*z)/z)::BIGINT AS py FROM p)
SELECT video_id, clip, py, px, avg(z) AS depth, count(*) AS points FROM q WHERE px >= 0 AND px < 32 AND py >= 0 AND py < 24 GROUP BY ALL""")
def _(spark, d):
    t = v.tracks(spark, d).select("video_id", "clip", (F.col("cx") - 200).alias("x"), (F.col("cy") - 40).alias("y"), (20.0 + F.col("k")).alias("z"))
    return df_.project_depth(t, ["video_id", "clip"], [30, 0, 16, 0, 30, 12, 0, 0, 1], 24, 32)


# ---- forecasts ---------------------------------------------------------------------------------------------

v._sql("fc", """
SELECT scene_id, clip, model AS mode, frame, px, py, gx, gy, CASE WHEN frame % 7 = 3 THEN 0 ELSE 1 END AS valid,
 CASE scene_id % 3 WHEN 0 THEN 'TYPE_VEHICLE' WHEN 1 THEN 'TYPE_PEDESTRIAN' ELSE 'TYPE_CYCLIST' END AS kind, (scene_id * 7 + clip * 3 + CAST(substr(model, 2) AS BIGINT) * 5) % 11 + 1.0 AS score FROM pair
""", "pair")


def _fc(spark, d):
    a = v.traj_all(spark, d)
    p = tr.pair_frames(a.where("model <> 'gt'"), a.where("model = 'gt'").drop("model"), v.SCENE_KEY)
    s = F.col("scene_id")
    m = F.substring("model", 2, 5).cast("long")
    return p.select("scene_id", "clip", F.col("model").alias("mode"), "frame", "px", "py", "gx", "gy", F.when(F.col("frame") % 7 == 3, 0).otherwise(1).alias("valid"),
                    F.when(s % 3 == 0, "TYPE_VEHICLE").when(s % 3 == 1, "TYPE_PEDESTRIAN").otherwise("TYPE_CYCLIST").alias("kind"),
                    ((s * 7 + F.col("clip") * 3 + m * 5) % 11 + 1.0).alias("score"))


v._sql("made", """
WITH s AS (SELECT *, frame // 5 AS f, sqrt((px-gx)*(px-gx)+(py-gy)*(py-gy))*valid AS e FROM fc WHERE (frame-4) % 5 = 0),
m AS (SELECT scene_id, clip, kind, mode, sum(e) FILTER (WHERE f<=5)/greatest(sum(valid) FILTER (WHERE f<=5),1) AS a, sum(e) FILTER (WHERE f<=9)/greatest(sum(valid) FILTER (WHERE f<=9),1) AS b,
 sum(e) FILTER (WHERE f<=15)/greatest(sum(valid) FILTER (WHERE f<=15),1) AS c FROM s GROUP BY ALL)
SELECT scene_id, clip, kind, min(a) AS a, min(b) AS b, min(c) AS c FROM m GROUP BY ALL
""", "fc")


@query("min_displacement_by_kind", "D43", "kind:s objects:l min_ade", "made", "SELECT kind, count(*) AS objects, (avg(a)+avg(b)+avg(c))/3 AS min_ade FROM made GROUP BY kind")
def _(spark, d):
    return mo.min_ade(_fc(spark, d), ["scene_id", "clip"], ["kind"])


@query("min_displacement_overall", "D43", "objects:l min_ade", "made", "SELECT count(*) AS objects, (avg(a)+avg(b)+avg(c))/3 AS min_ade FROM made")
def _(spark, d):
    return mo.min_ade(_fc(spark, d), ["scene_id", "clip"])


@query("shaped_forecasts", "D44", "scene_id:l clip:l mode:s rank:l step:l score px", "fc", """
WITH m AS (SELECT DISTINCT scene_id, clip, mode, score FROM fc), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, clip ORDER BY score DESC, mode) AS rank, score/sum(score) OVER (PARTITION BY scene_id, clip) AS ns FROM m)
SELECT f.scene_id, f.clip, f.mode, r.rank, frame // 5 AS step, r.ns AS score, f.px FROM fc f JOIN r USING (scene_id, clip, mode) WHERE r.rank <= 3 AND (frame-4) % 5 = 0 AND frame // 5 < 6""")
def _(spark, d):
    return mo.shape_forecasts(_fc(spark, d), ["scene_id", "clip"], 3, 6)


@query("metric_breakdown_means", "D44", "kind:s score", "fc", """
WITH k AS (SELECT kind, avg(score) AS score FROM fc GROUP BY kind) SELECT * FROM k UNION ALL SELECT 'AVERAGE', avg(score) FROM k""")
def _(spark, d):
    return mo.breakdown_means(_fc(spark, d), "kind", "score")


v._sql("goals", "SELECT scene_id, clip, mode, max(score) AS score, arg_max(px, frame) AS gx, arg_max(py, frame) AS gy FROM fc GROUP BY scene_id, clip, mode", "fc")


@query("suppressed_forecast_goals", "F8", "scene_id:l clip:l place:l mode:s score", "goals", """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, clip ORDER BY score DESC, mode) AS r, count(*) OVER (PARTITION BY scene_id, clip) AS n FROM goals),
k AS (SELECT scene_id, clip, 1::BIGINT AS r, [{'m': mode, 'x': gx, 'y': gy}] AS kept, []::VARCHAR[] AS rest FROM o WHERE r = 1
 UNION ALL SELECT k.scene_id, k.clip, o.r, CASE WHEN near THEN kept ELSE list_append(kept, {'m': o.mode, 'x': o.gx, 'y': o.gy}) END, CASE WHEN near THEN list_append(rest, o.mode) ELSE rest END
 FROM (SELECT k.*, o2.mode, o2.gx, o2.gy, o2.r AS nr, list_bool_or(list_transform(k.kept, lambda b: sqrt(pow(b.x-o2.gx,2)+pow(b.y-o2.gy,2)) < 6.0)) AS near FROM k JOIN o o2 ON o2.scene_id=k.scene_id AND o2.clip=k.clip AND o2.r=k.r+1) k
 JOIN o ON o.scene_id=k.scene_id AND o.clip=k.clip AND o.r=k.nr),
f AS (SELECT scene_id, clip, list_concat(list_transform(kept, lambda b: b.m), rest)[1:4] AS l FROM k QUALIFY row_number() OVER (PARTITION BY scene_id, clip ORDER BY r DESC) = 1),
e AS (SELECT scene_id, clip, l, unnest(generate_series(1, len(l))) AS i FROM f)
SELECT e.scene_id, e.clip, e.i-1 AS place, e.l[e.i] AS mode, g.score FROM e JOIN goals g ON g.scene_id=e.scene_id AND g.clip=e.clip AND g.mode=e.l[e.i]""")
def _(spark, d):
    g = _fc(spark, d).groupBy("scene_id", "clip", "mode").agg(F.max("score").alias("score"), F.max_by("px", "frame").alias("gx"), F.max_by("py", "frame").alias("gy"))
    return mo.suppress_goals(g, ["scene_id", "clip"], 6.0, 4)


@query("scenes_with_kinds", "G7", "image_id:l kept:l", "", """
SELECT o_custkey // 8 AS image_id, count(*) AS kept FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL""")
def _(spark, d):
    o = v.table(spark, d, "orders")
    scenes = o.select(v.div("o_custkey", 8).alias("image_id"), F.array(F.struct(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"))).alias("objects"))
    k = mo.keep_kinds(scenes, "objects", ["1-URGENT", "5-LOW"])
    return k.groupBy("image_id").agg(F.sum(F.size("objects")).alias("kept"))


# ---- polylines ------------------------------------------------------------------------------------------------

PW = "PARTITION BY model, scene_id, clip ORDER BY frame"
v._sql("poly", f"""
WITH s AS (SELECT *, coalesce(x-lag(x) OVER w, 0) AS dx, coalesce(y-lag(y) OVER w, 0) AS dy FROM traj_all WINDOW w AS ({PW})),
b AS (SELECT *, sum(CASE WHEN sqrt(dx*dx+dy*dy) > 1 THEN 1 ELSE 0 END) OVER ({PW}) AS part FROM s)
SELECT model, scene_id, clip, frame, x, y, dx/greatest(sqrt(dx*dx+dy*dy),1e-6) AS dir_x, dy/greatest(sqrt(dx*dx+dy*dy),1e-6) AS dir_y, part,
 (row_number() OVER (PARTITION BY model, scene_id, clip, part ORDER BY frame)-1)//4 AS chunk FROM b
""", "traj_all")


def _poly(spark, d):
    return mo.polyline_parts(v.traj_all(spark, d), K, 1.0, 4)


@query("polyline_chunks", "E13", "model:s scene_id:l clip:l frame:l dir_x dir_y part:l chunk:l", "poly", "SELECT * FROM poly")
def _(spark, d):
    return _poly(spark, d)


v._sql("pline", """
SELECT scene_id, clip, (CASE WHEN model='gt' THEN 0 ELSE substr(model,2)::BIGINT END)*1000000+part*1000+chunk AS line, avg(x) AS cx, avg(y) AS cy FROM poly GROUP BY ALL
""", "poly")
v._sql("agt", """
SELECT scene_id, clip, model AS agent, arg_max(x,frame)+2*cos(0.3) AS ax, arg_max(y,frame)+2*sin(0.3) AS ay FROM traj_all WHERE model <> 'gt' GROUP BY ALL
""", "traj_all")


@query("nearest_map_polylines", "C14", "scene_id:l clip:l agent:s rank:l line:l distance", "pline agt", """
SELECT a.scene_id, a.clip, agent, line, sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)) AS distance, row_number() OVER (PARTITION BY a.scene_id, a.clip, agent ORDER BY (ax-cx)*(ax-cx)+(ay-cy)*(ay-cy), line) AS rank
FROM agt a JOIN pline USING (scene_id, clip) QUALIFY rank <= 3""")
def _(spark, d):
    m = F.when(F.col("model") == "gt", 0).otherwise(F.substring("model", 2, 5).try_cast("long"))
    parts = _poly(spark, d).withColumn("line", m * 1000000 + F.col("part") * 1000 + F.col("chunk"))
    a = v.traj_all(spark, d).where("model <> 'gt'").groupBy("scene_id", "clip", F.col("model").alias("agent")).agg(
        F.max_by("x", "frame").alias("x"), F.max_by("y", "frame").alias("y")).withColumn("heading", F.lit(0.3))
    return mo.nearest_polylines(a, parts, ["scene_id", "clip"], 3, (2.0, 0.0))


@query("closed_polygon_resample", "E14", "scene_id:l clip:l frame:l x y", "gt", """
WITH r AS (SELECT scene_id, clip, frame, x, y FROM gt UNION ALL SELECT scene_id, clip, max(frame)+1, arg_min(x,frame), arg_min(y,frame) FROM gt GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY scene_id, clip ORDER BY frame)-1 AS i, count(*) OVER (PARTITION BY scene_id, clip) AS t FROM r),
g AS (SELECT scene_id, clip, t, unnest(generate_series(0,59)) AS j FROM (SELECT DISTINCT scene_id, clip, t FROM p))
SELECT g.scene_id, g.clip, g.j AS frame, a.x+(coalesce(b.x,a.x)-a.x)*((g.j*(g.t-1))%59)/59.0 AS x, a.y+(coalesce(b.y,a.y)-a.y)*((g.j*(g.t-1))%59)/59.0 AS y
FROM g JOIN p a ON a.scene_id=g.scene_id AND a.clip=g.clip AND a.i=(g.j*(g.t-1))//59 LEFT JOIN p b ON b.scene_id=g.scene_id AND b.clip=g.clip AND b.i=a.i+1""")
def _(spark, d):
    ring = mo.close_ring(v.gt(spark, d), v.SCENE_KEY)
    return tr.resample(ring.withColumn("n", F.lit(60)), v.SCENE_KEY, "n")


# ---- frames, grids, splits -------------------------------------------------------------------------------------------

@query("spread_frame_numbers", "E17", "p_partkey:l frames:s by_rate:s shown:l", "", """
WITH p AS (SELECT p_partkey, 20+p_partkey%300 AS total FROM part), n AS (SELECT *, greatest(1, round_even(total/24.0*2.0, 0))::BIGINT AS m FROM p)
SELECT p_partkey, array_to_string(list_transform(range(0,8), lambda i: floor(i*((total-1)/7.0::DOUBLE))::BIGINT), ',') AS frames,
 CASE WHEN m <= 1 THEN '0' ELSE array_to_string(list_transform(range(0,m), lambda i: floor(i*((total-1)::DOUBLE/(m-1)))::BIGINT), ',') END AS by_rate, round_even(3*(total-1)/(9.0::DOUBLE), 0)::BIGINT AS shown FROM n""")
def _(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", (20 + F.col("p_partkey") % 300).alias("total"))
    s = lambda c: F.array_join(c.cast("array<string>"), ",")
    return p.select("p_partkey", s(mo.spread_frames(F.col("total"), F.lit(8))).alias("frames"), s(mo.frames_by_rate(F.col("total"), F.lit(24.0), 2.0)).alias("by_rate"),
                    mo.sample_index(F.lit(3), F.lit(10), F.col("total")).alias("shown"))


@query("consecutive_clip_frames", "E17", "video_id:l clip:l frame:l luma", "luma", """
SELECT video_id, clip, frame, luma FROM luma l WHERE (SELECT count(*) FROM luma m WHERE m.video_id=l.video_id AND m.clip=l.clip) >= 16 AND frame >= 2 AND frame < 18 AND (frame-2) % 2 = 0""")
def _(spark, d):
    return mo.clip_frames(v.luma(spark, d), ["video_id", "clip"], 8, 2, 2)


v._sql("crops", """
WITH i AS (SELECT p_partkey AS image_id, 200+p_partkey%90 AS w, 150+p_size AS h FROM part), l AS (SELECT *, unnest([1,2]) AS layer FROM i),
n AS (SELECT *, (2**layer)::BIGINT AS n FROM l), o AS (SELECT *, floor(0.25*least(w,h)*(2.0::DOUBLE/n))::BIGINT AS lap FROM n),
c AS (SELECT *, ceil((lap*(n-1)+w)/n::DOUBLE)::BIGINT AS cw, ceil((lap*(n-1)+h)/n::DOUBLE)::BIGINT AS ch FROM o),
g AS (SELECT *, unnest(generate_series(0,n-1)) AS a FROM c), k AS (SELECT *, unnest(generate_series(0,n-1)) AS b FROM g)
SELECT image_id, 0 AS layer, 0 AS x0, 0 AS y0, w AS x1, h AS y1 FROM i UNION ALL SELECT image_id, layer, (cw-lap)*a, (ch-lap)*b, least((cw-lap)*a+cw, w), least((ch-lap)*b+ch, h) FROM k
""")


def _crops(spark, d):
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (200 + F.col("p_partkey") % 90).alias("width"), (150 + F.col("p_size")).alias("height"))
    return mo.crop_pyramid(p, 2, 0.25)


@query("crop_pyramid", "E16", "image_id:l layer:l x0:l y0:l x1:l y1:l", "crops", "SELECT * FROM crops")
def _(spark, d):
    return _crops(spark, d)


@query("crop_point_grids", "E16", "image_id:l layer:l points:l sum_x sum_y", "crops", """
WITH n AS (SELECT *, floor(4/pow(2,layer))::BIGINT AS n FROM crops), g AS (SELECT *, unnest(generate_series(0,n-1)) AS i FROM n WHERE n > 0), h AS (SELECT *, unnest(generate_series(0,n-1)) AS j FROM g)
SELECT image_id, layer, count(*) AS points, sum(x0+(2*i+1)/(2.0*n)*(x1-x0)) AS sum_x, sum(y0+(2*j+1)/(2.0*n)*(y1-y0)) AS sum_y FROM h GROUP BY ALL""")
def _(spark, d):
    g = mo.point_grids(_crops(spark, d), 4, 2)
    return g.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("points"), F.sum("px").alias("sum_x"), F.sum("py").alias("sum_y"))


def seeded_sql(*parts, seed=0):
    return f"('0x' || substr(sha256(concat_ws(':', {', '.join(map(str, parts))}, '{seed}')), 1, 12))::BIGINT"


SPLIT = f"CASE WHEN {seeded_sql('o_orderkey')} % 1000000 / 1e6 < 0.9 THEN 'train' WHEN {seeded_sql('o_orderkey')} % 1000000 / 1e6 < 1.0 THEN 'val' ELSE 'test' END AS split"


@query("dataset_split", "G4", "o_orderkey:l split:s", "", f"SELECT o_orderkey, {SPLIT} FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey")
    labelled = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return mo.autosplit(o.join(labelled, "o_orderkey", "left_semi"), "o_orderkey")


@query("dataset_split_all", "G4", "o_orderkey:l split:s", "", f"SELECT o_orderkey, {SPLIT} FROM orders")
def _(spark, d):
    return mo.autosplit(v.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("scene_shards", "G5", "scene_id:l node:l worker:l", "traj_all", f"""
WITH p AS (SELECT scene_id, row_number() OVER (ORDER BY {seeded_sql('scene_id', seed=2026)}, scene_id) - 1 AS p FROM (SELECT DISTINCT scene_id FROM traj_all))
SELECT scene_id, p % 4 AS node, p // 4 % 8 AS worker FROM p""")
def _(spark, d):
    return mo.shard(v.traj_all(spark, d).select("scene_id").distinct(), "scene_id", 4, 8)


KEYS_SQL = "video_id, clip, track_id"
v._sql("seen_", f"""
SELECT {KEYS_SQL}, array_agg(frame ORDER BY frame) FILTER (WHERE conf > 0.3) AS fs, max(frame) + 1 AS en FROM tracks GROUP BY {KEYS_SQL} HAVING count(*) FILTER (WHERE conf > 0.3) > 0
""", "tracks")


def pick_sql(frames, tag, other):
    return f"CASE WHEN len({frames}) > 0 THEN ({frames})[1 + {seeded_sql(KEYS_SQL, tag)} % len({frames})] ELSE {other} END"


def _visible(spark, d):
    return v.tracks(spark, d).withColumn("vis", F.col("conf") > 0.3)


@query("sequential_frame_sample", "E20", f"{TKEYS} template_frame:l position:l frame:l", "seen_", f"""
WITH t AS (SELECT *, {pick_sql("list_filter(fs, lambda f: f < en - 6)", "'template'", "fs[1]")} AS template_frame FROM seen_),
s AS (SELECT *, {pick_sql("list_filter(fs, lambda f: f >= template_frame AND f < en - 6 AND f < template_frame + 8)", "'search'", "template_frame")} AS st FROM t),
r AS (SELECT {KEYS_SQL}, template_frame, en, list_filter(fs, lambda f: f >= st) AS got FROM s)
SELECT {KEYS_SQL}, template_frame, p.p AS position, coalesce(got[p.p + 1], en - 1) AS frame FROM r, generate_series(0, 5) p(p)""")
def _(spark, d):
    return mo.sequential_sample(_visible(spark, d), TK, 6, "vis", max_gap=8)


@query("interval_frame_sample", "E20", f"{TKEYS} template_frame:l position:l frame:l", "seen_", f"""
WITH a AS (SELECT *, greatest(1, least(5, en // 3)) AS widest FROM seen_), b AS (SELECT *, least(widest, ceil((en - fs[1]) / 3.0) - 1) AS wide FROM a),
t AS (SELECT *, {pick_sql("list_filter(fs, lambda f: wide >= 1 AND f < en - wide * 3)", "'template'", "fs[1]")} AS template_frame FROM b),
s0 AS (SELECT *, {pick_sql("list_filter(fs, lambda f: f >= template_frame AND f < least(greatest(en - widest * 3, template_frame + 1), template_frame + 8))", "'search'", "template_frame")} AS f0 FROM t),
""" + ",\n".join(f"s{i} AS (SELECT *, {pick_sql(f'list_filter(fs, lambda f: f >= f{i - 1} AND f <= f{i - 1} + 5)', i, f'f{i - 1}')} AS f{i} FROM s{i - 1})" for i in (1, 2, 3)) + f"""
SELECT {KEYS_SQL}, template_frame, p.p AS position, [f0, f1, f2, f3][p.p + 1] AS frame FROM s3, generate_series(0, 3) p(p)""")
def _(spark, d):
    return mo.interval_sample(_visible(spark, d), TK, 4, 5, "vis", max_gap=8)


@query("template_gap_sample", "G8", f"{TKEYS} template_frame:l frame:l", "tracks", f"""
WITH s AS (SELECT {KEYS_SQL}, min(frame) AS template_frame FROM tracks GROUP BY ALL)
SELECT {KEYS_SQL}, template_frame, frame FROM tracks JOIN s USING ({KEYS_SQL}) WHERE conf > 0.3 AND frame > template_frame AND frame <= template_frame + 10
QUALIFY row_number() OVER (PARTITION BY {KEYS_SQL} ORDER BY {seeded_sql(KEYS_SQL, 'frame')}, frame) <= 3""")
def _(spark, d):
    t = _visible(spark, d)
    first = t.groupBy(*TK).agg(F.min("frame").alias("frame"))
    return mo.near_template(t, TK, first, 10, 3, "vis")


@query("file_set_fingerprint", "G9", "folder:s total_size:l files:l fingerprint:s", "", """
SELECT o_orderpriority AS folder, sum(o_orderkey) AS total_size, count(*) AS files, sha256(sum(o_orderkey)::BIGINT::VARCHAR || ':' || sum(('0x' || substr(sha256('f/' || o_orderkey), 1, 12))::BIGINT)::VARCHAR) AS fingerprint FROM orders GROUP BY ALL""")
def _(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderpriority").alias("folder"), F.concat(F.lit("f/"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("length"))
    return mo.fingerprint(o, ["folder"])


@query("manifest_scenes", "A1", "doc_id:l scene_id:s image_path:s prompt:s", "", """
SELECT doc_id, 's' || doc_id AS scene_id, 'img/s' || doc_id || '.png' AS image_path, lang AS prompt FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def _(spark, d):
    from wayscore.sources import readers as rd
    docs = v.table(spark, d, "documents")
    sid = F.concat(F.lit("s"), "doc_id")
    scenes = rd.manifest_ids(docs.select("doc_id", F.to_json(F.array(sid)).alias("body")), "body")
    img = docs.where("doc_id % 5 <> 0").select(sid.alias("scene_id"), F.concat(F.lit("img/"), sid, F.lit(".png")).alias("image_path"))
    cap = docs.where("doc_id % 7 <> 0").select(sid.alias("scene_id"), F.col("lang").alias("prompt"))
    return rd.resolve_scenes(scenes, img, cap)[0]


@query("answer_tree_items", "A8", "role:s samples:l correct:l", "", """
SELECT role, count(*) AS samples, count(*) FILTER (WHERE turn % 2 = 0) AS correct FROM conversations WHERE conv_id % 3 <> 0 AND turn % 5 <> 4 GROUP BY role""")
def _(spark, d):
    from wayscore.sources import readers as rd
    c = v.table(spark, d, "conversations")
    item = F.when(F.col("turn") % 5 == 4, F.to_json(F.struct(F.lit("x").alias("note")))).otherwise(F.to_json(F.struct((F.col("turn") % 2 == 0).alias("is_correct"))))
    body = F.when(F.col("conv_id") % 3 == 0, item).otherwise(F.concat(F.lit("["), item, F.lit(", 7]")))
    i = rd.answer_items(c.select("role", body.alias("body")), "body")
    return i.groupBy("role").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("is_correct").cast("int")).alias("correct"))


@query("tracker_result_lines", "A11", f"{TKEYS} frame:l x y w h", "tracks", """
SELECT video_id, clip, track_id, frame, CASE WHEN frame < m THEN cx ELSE 0 END AS x, CASE WHEN frame < m THEN cy ELSE 0 END AS y, CASE WHEN frame < m THEN 10.0 ELSE 0 END AS w, CASE WHEN frame < m THEN 20.5 ELSE 0 END AS h
FROM (SELECT *, max(frame) OVER (PARTITION BY video_id, clip, track_id) AS m FROM tracks)""")
def _(spark, d):
    from wayscore.sources import readers as rd
    t = v.tracks(spark, d)
    sep = F.when(F.col("track_id") % 2 == 0, "\t").otherwise(", ")
    line = F.concat(F.col("cx"), sep, F.col("cy"), sep, F.lit("10"), sep, F.lit("20.5"))
    files = t.groupBy(*TK).agg(F.array_sort(F.collect_list(F.struct("frame", line.alias("l")))).alias("r"))
    files = files.select(*TK, F.array_join(F.transform(F.slice("r", 1, F.size("r") - 1), lambda e: e["l"]), "\n").alias("value"))
    boxes = rd.parse_tracker_boxes(files.where("value <> ''"), "value")
    return rd.pad_to_truth(boxes, t.select(*TK, "frame"), TK)

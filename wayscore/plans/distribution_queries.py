"""Feature statistics, distribution distances, consistency and embedding search."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayscore.operators import distribution as ds
from wayscore.operators import similarity as sm
from wayscore.operators.ordered import grouped_quantiles
from wayscore.plans import views as v
from wayscore.plans.registry import query

TK = ["video_id", "clip", "track_id"]
K = v.TRAJ_KEY
DIM = 64


@query("feature_covariance", "D15", "set_name:s i:l j:l n:l mean_i cov", "features", """
SELECT a.set_name, a.pos AS i, b.pos AS j, count(*) AS n, avg(a.v) AS mean_i, covar_samp(a.v, b.v) AS cov
FROM features a JOIN features b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY ALL""")
def _(spark, d):
    return ds.covariance(v.embeddings(spark, d), "set_name", "embedding", DIM)


@query("frechet_feature_distance", "D16", "frechet_unbiased frechet_biased")
def _(spark, d):
    e = v.embeddings(spark, d)
    a = ds.frechet_distance(e, "set_name", "real", "gen", "embedding", DIM, 1, 1e-6).withColumnRenamed("frechet", "frechet_unbiased")
    return a.join(ds.frechet_distance(e, "set_name", "real", "gen", "embedding", DIM, 0, 0.0).withColumnRenamed("frechet", "frechet_biased"))


@query("frechet_end_points", "D16", "frechet_end_points", "traj_all", """
WITH e AS (SELECT model = 'gt' AS truth, arg_max(x, frame) - arg_min(x, frame) AS x, arg_max(y, frame) - arg_min(y, frame) AS y FROM traj_all GROUP BY model, scene_id, clip),
s AS (SELECT truth, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM e GROUP BY truth)
SELECT pow(p.mx - q.mx, 2) + pow(p.my - q.my, 2) + p.a + p.d + q.a + q.d
  - 2 * sqrt(p.a*q.a + 2*p.b*q.b + p.d*q.d + 2*sqrt((p.a*p.d - p.b*p.b) * (q.a*q.d - q.b*q.b))) AS frechet_end_points
FROM s p, s q WHERE p.truth AND NOT q.truth""")
def _(spark, d):
    """Displacements of clips as features of two dimensions, for which the root of the covariances' product has a closed form."""
    ends = v.traj_all(spark, d).groupBy(*K).agg(*[(F.max_by(c, "frame") - F.min_by(c, "frame")).alias(c) for c in ("x", "y")])
    f = ends.select(F.when(F.col("model") == "gt", "gt").otherwise("pred").alias("side"), F.array("x", "y").alias("vector"))
    return ds.frechet_distance(f, "side", "gt", "pred", "vector", 2, 1, 0.0).withColumnRenamed("frechet", "frechet_end_points")


@query("frechet_trajectory_handcrafted", "D16 B7 B8 E1", "ftd_handcrafted")
def _(spark, d):
    a = v.traj_all(spark, d)
    f = ds.window_features(a, K).withColumn("side", F.when(F.col("model") == "gt", "gt").otherwise("pred"))
    return ds.frechet_distance(f, "side", "gt", "pred", "vector", len(ds.FEATURE_COLUMNS)).withColumnRenamed("frechet", "ftd_handcrafted")


@query("kernel_feature_distance", "D17", "subset:l m:l kernel_distance", "features", """
WITH r AS (SELECT vec_id // 100 AS subset, set_name, vec_id, row_number() OVER (PARTITION BY vec_id // 100, set_name ORDER BY vec_id) AS r,
  least(count(*) FILTER (WHERE set_name='real') OVER (PARTITION BY vec_id//100), count(*) FILTER (WHERE set_name='gen') OVER (PARTITION BY vec_id//100)) AS m
  FROM (SELECT DISTINCT vec_id, set_name FROM features)),
k AS (SELECT subset, set_name, vec_id, m FROM r WHERE r <= m AND m > 1),
p AS (SELECT a.subset, a.m, a.set_name AS sa, b.set_name AS sb, a.vec_id = b.vec_id AS self, pow(sum(x.v*y.v)/64+1, 3) AS kv
  FROM k a JOIN k b USING (subset) JOIN features x ON x.vec_id=a.vec_id JOIN features y ON y.vec_id=b.vec_id AND y.pos=x.pos GROUP BY a.subset, a.m, a.set_name, b.set_name, a.vec_id, b.vec_id)
SELECT subset, m, (sum(CASE WHEN sa=sb AND NOT self THEN kv ELSE 0 END)/(m-1) - sum(CASE WHEN sa<>sb THEN kv ELSE 0 END)/m)/m*1000 AS kernel_distance FROM p GROUP BY subset, m""")
def _(spark, d):
    e = v.embeddings(spark, d).withColumn("subset", v.div("vec_id", 100))
    return ds.kernel_distance(e, ["subset"], "set_name", "real", "gen", "embedding", "vec_id")


@query("inception_score_splits", "D18", "split:l score", "features", """
WITH e AS (SELECT vec_id, pos, exp(v*4) AS e FROM features), p AS (SELECT vec_id, pos, e/sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id FROM features)),
s AS (SELECT vec_id, (SELECT max(g.g) FROM generate_series(0,9) g(g) WHERE g.g*n//10 <= i) AS split FROM n),
m AS (SELECT split, pos, avg(p) AS m FROM p JOIN s USING (vec_id) GROUP BY ALL),
k AS (SELECT s.split, p.vec_id, sum(p*(ln(p)-ln(m))) AS kl FROM p JOIN s USING (vec_id) JOIN m ON m.split=s.split AND m.pos=p.pos GROUP BY ALL)
SELECT split, exp(avg(kl)) AS score FROM k GROUP BY split""")
def _(spark, d):
    e = v.embeddings(spark, d)
    p = e.select("vec_id", ds.softmax(F.transform("embedding", lambda x: x.cast("double") * 4)).alias("p"))
    return ds.inception_score(p, "p", "vec_id", v.div("vec_id", 4096), 10)


@query("inception_score", "D18 D19", "splits:l mean std", "features", """
WITH e AS (SELECT vec_id, pos, exp(v*4) AS e FROM features), p AS (SELECT vec_id, pos, e/sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id FROM features)),
s AS (SELECT vec_id, (SELECT max(g.g) FROM generate_series(0,9) g(g) WHERE g.g*n//10 <= i) AS split FROM n),
m AS (SELECT split, pos, avg(p) AS m FROM p JOIN s USING (vec_id) GROUP BY ALL),
k AS (SELECT s.split, p.vec_id, sum(p*(ln(p)-ln(m))) AS kl FROM p JOIN s USING (vec_id) JOIN m ON m.split=s.split AND m.pos=p.pos GROUP BY ALL)
SELECT count(*) AS splits, avg(score) AS mean, stddev_pop(score) AS std FROM (SELECT split, exp(avg(kl)) AS score FROM k GROUP BY split)""")
def _(spark, d):
    e = v.embeddings(spark, d)
    p = e.select("vec_id", ds.softmax(F.transform("embedding", lambda x: x.cast("double") * 4)).alias("p"))
    s = ds.inception_score(p, "p", "vec_id", v.div("vec_id", 4096), 10)
    return ds.repeat_statistics(s, [], "score").withColumnRenamed("runs", "splits")


@query("metric_repeat_statistics", "D19", "model:s category:s runs:l mean std", "scores", """
SELECT model, category, count(*) AS runs, avg(score) AS mean, stddev_pop(score) AS std FROM scores GROUP BY ALL""")
def _(spark, d):
    return ds.repeat_statistics(v.scores(spark, d), ["model", "category"], "score")


@query("top_k_accuracy", "D23", "top1 top5", "features", """
WITH r AS (SELECT vec_id, label, pos, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS r FROM features)
SELECT avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END) AS top1, avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END) AS top5 FROM r WHERE pos = label""")
def _(spark, d):
    e = v.embeddings(spark, d).withColumn("s", F.transform("embedding", lambda x: x.cast("double")))
    return ds.top_accuracy(e, "s", "label")


v._sql("state_", """
WITH s AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pred WINDOW w AS (PARTITION BY model, scene_id, clip ORDER BY frame)),
c AS (SELECT *, coalesce(x2,x)-coalesce(x0,x) AS dx, coalesce(y2,y)-coalesce(y0,y) AS dy, CASE WHEN x0 IS NOT NULL AND x2 IS NOT NULL THEN 0.2 ELSE 0.1 END AS h FROM s)
SELECT model, scene_id, clip, frame, x, y, atan2(dy,dx) AS heading, dx/h AS vx, dy/h AS vy FROM c
""", "pred")


@query("agent_state_from_path", "B8", "model:s scene_id:l clip:l frame:l x y z l w h heading vx vy valid:b", "state_",
       "SELECT *, 0 AS z, 4.5 AS l, 2.0 AS w, 1.8 AS h, true AS valid FROM state_")
def _(spark, d):
    return ds.path_to_state(v.pred(spark, d), K)


@query("agent_centred_features", "B7", "model:s scene_id:l clip:l frame:l fx fy fl kind_0 kind_1 time sin_h cos_h fvx fvy fax fay", "state_", """
WITH c AS (SELECT model, scene_id, clip, arg_max(x,frame) AS cx, arg_max(y,frame) AS cy, arg_max(heading,frame) AS ch FROM state_ GROUP BY ALL),
f AS (SELECT s.*, (x-cx)*cos(ch)+(y-cy)*sin(ch) AS fx, (y-cy)*cos(ch)-(x-cx)*sin(ch) AS fy, heading-ch AS fh, vx*cos(ch)+vy*sin(ch) AS fvx, vy*cos(ch)-vx*sin(ch) AS fvy FROM state_ s JOIN c USING (model, scene_id, clip)),
a AS (SELECT *, (fvx-lag(fvx) OVER w)/0.1 AS ax, (fvy-lag(fvy) OVER w)/0.1 AS ay, row_number() OVER w - 1 AS t FROM f WINDOW w AS (PARTITION BY model, scene_id, clip ORDER BY frame))
SELECT model, scene_id, clip, frame, fx, fy, 4.5 AS fl, 1 AS kind_0, 0 AS kind_1, t*0.1 AS time, sin(fh) AS sin_h, cos(fh) AS cos_h, fvx, fvy,
 coalesce(ax, lead(ax) OVER w, 0) AS fax, coalesce(ay, lead(ay) OVER w, 0) AS fay FROM a WINDOW w AS (PARTITION BY model, scene_id, clip ORDER BY frame)""")
def _(spark, d):
    return ds.centred_features(ds.path_to_state(v.pred(spark, d), K), K)


@query("window_mean_features", "E1 B7 B8", "model:s scene_id:l clip:l windows:l fx fy sin_h cos_h fvx fvy fax fay", "pred", """
WITH i AS (SELECT p.*, s.s AS win FROM pred p JOIN generate_series(0,10) s(s) ON frame BETWEEN s.s*10 AND s.s*10+10 QUALIFY count(*) OVER (PARTITION BY model, scene_id, clip, s.s) = 11),
s AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM i WINDOW w AS (PARTITION BY model, scene_id, clip, win ORDER BY frame)),
g AS (SELECT *, coalesce(x2,x)-coalesce(x0,x) AS dx, coalesce(y2,y)-coalesce(y0,y) AS dy, CASE WHEN x0 IS NOT NULL AND x2 IS NOT NULL THEN 0.2 ELSE 0.1 END AS h FROM s),
t AS (SELECT model, scene_id, clip, win, frame, x, y, atan2(dy,dx) AS heading, dx/h AS vx, dy/h AS vy FROM g),
c AS (SELECT model, scene_id, clip, win, arg_max(x,frame) AS cx, arg_max(y,frame) AS cy, arg_max(heading,frame) AS ch FROM t GROUP BY ALL),
f AS (SELECT t.*, (x-cx)*cos(ch)+(y-cy)*sin(ch) AS fx, (y-cy)*cos(ch)-(x-cx)*sin(ch) AS fy, heading-ch AS fh, vx*cos(ch)+vy*sin(ch) AS fvx, vy*cos(ch)-vx*sin(ch) AS fvy FROM t JOIN c USING (model, scene_id, clip, win)),
a AS (SELECT *, (fvx-lag(fvx) OVER w)/0.1 AS ax, (fvy-lag(fvy) OVER w)/0.1 AS ay FROM f WINDOW w AS (PARTITION BY model, scene_id, clip, win ORDER BY frame)),
b AS (SELECT *, coalesce(ax, lead(ax) OVER w, 0) AS fax, coalesce(ay, lead(ay) OVER w, 0) AS fay FROM a WINDOW w AS (PARTITION BY model, scene_id, clip, win ORDER BY frame)),
m AS (SELECT model, scene_id, clip, win, avg(fx) AS fx, avg(fy) AS fy, avg(sin(fh)) AS sin_h, avg(cos(fh)) AS cos_h, avg(fvx) AS fvx, avg(fvy) AS fvy, avg(fax) AS fax, avg(fay) AS fay FROM b GROUP BY ALL)
SELECT model, scene_id, clip, count(*) AS windows, avg(fx) AS fx, avg(fy) AS fy, avg(sin_h) AS sin_h, avg(cos_h) AS cos_h, avg(fvx) AS fvx, avg(fvy) AS fvy, avg(fax) AS fax, avg(fay) AS fay FROM m GROUP BY ALL""")
def _(spark, d):
    return ds.window_features(v.pred(spark, d), K)


@query("motion_series_median", "E8", "group_id:l frame:l median_mag", "ev", """
SELECT user_id // 16 AS group_id, n AS frame, quantile_disc(value, 0.5) AS median_mag FROM ev GROUP BY ALL""")
def _(spark, d):
    e = v.ev(spark, d).select(v.div("user_id", 16).alias("group_id"), F.col("n").alias("frame"), "value")
    return grouped_quantiles(e, ["group_id", "frame"], "value", {"median_mag": 0.5}, "lower")


v._sql("kf_", """
WITH m AS (SELECT *, CASE WHEN frame > 0 THEN abs(luma - lag(luma) OVER w)/8 ELSE 0 END AS m FROM luma WINDOW w AS (PARTITION BY video_id, clip ORDER BY frame)),
s AS (SELECT *, sum(m) OVER (PARTITION BY video_id, clip ORDER BY frame) AS s, count(*) OVER (PARTITION BY video_id, clip) AS n FROM m),
t AS (SELECT *, least(n, least(greatest(round_even(3+least(greatest((tot/greatest(n-1,1)-1)/9.0,0),1)*17,0),3),20)) AS k FROM (SELECT video_id, clip, max(n) AS n, max(s) AS tot FROM s GROUP BY video_id, clip)),
j AS (SELECT *, unnest(generate_series(1, greatest(k::BIGINT-2, 1))) AS j FROM t WHERE n > 2 AND tot > 1e-6 AND k > 2),
p AS (SELECT video_id, clip, n, j, tt, greatest(count(*) FILTER (WHERE s < tt), 1) AS p FROM (SELECT j.video_id, j.clip, j.n, j.j, j.j*(j.tot/(j.k-1)) AS tt, s.s FROM j JOIN s USING (video_id, clip)) GROUP BY video_id, clip, n, j, tt),
q AS (SELECT p.video_id, p.clip, p.j, CASE WHEN p.p < p.n AND abs(a.s-tt) > abs(b.s-tt) THEN p.p-1 ELSE p.p END AS idx FROM p LEFT JOIN s a ON a.video_id=p.video_id AND a.clip=p.clip AND a.frame=p.p JOIN s b ON b.video_id=p.video_id AND b.clip=p.clip AND b.frame=p.p-1)
SELECT video_id, clip, j AS pos, idx FROM q
UNION ALL SELECT video_id, clip, 0, 0 FROM t UNION ALL SELECT video_id, clip, 99, n-1 FROM t WHERE n > 1
""", "luma")


def _keyframes(spark, d):
    from pyspark.sql import Window as W
    w = W.partitionBy("video_id", "clip").orderBy("frame")
    lum = v.luma(spark, d)
    m = lum.withColumns({"m": F.abs(F.col("luma") - F.lag("luma").over(w)) / 8, "e": F.array("luma", F.col("k").cast("double"), F.lit(50.0))})
    return ds.key_frames(m, ["video_id", "clip"], "m", extra=["e"])


@query("key_frame_selection", "E9", "video_id:l clip:l idx:s mids:s", "kf_", """
WITH o AS (SELECT *, lead(idx) OVER (PARTITION BY video_id, clip ORDER BY pos) AS nx FROM kf_)
SELECT video_id, clip, string_agg(idx::BIGINT::VARCHAR, ',' ORDER BY pos) AS idx, coalesce(string_agg(CASE WHEN nx-idx >= 2 THEN ((idx+nx)::BIGINT//2)::VARCHAR END, ',' ORDER BY pos), '') AS mids FROM o GROUP BY ALL""")
def _(spark, d):
    k = _keyframes(spark, d)
    mids = F.transform(ds.pairs_with_middle("idx"), lambda t: t["mid"].cast("string"))
    k = k.withColumn("mids", F.array_join(mids, ","))
    return k.withColumn("idx", F.array_join(F.col("idx").cast("array<string>"), ","))


@query("scene_consistency", "D25 E9", "video_id:l clip:l consistency", "kf_ luma", """
WITH o AS (SELECT k.video_id, k.clip, k.pos, l.luma AS a, l.k::DOUBLE AS b FROM kf_ k JOIN luma l ON l.video_id=k.video_id AND l.clip=k.clip AND l.frame=k.idx),
p AS (SELECT *, lead(a) OVER w AS a2, lead(b) OVER w AS b2, count(*) OVER (PARTITION BY video_id, clip) AS n FROM o WINDOW w AS (PARTITION BY video_id, clip ORDER BY pos))
SELECT video_id, clip, CASE WHEN max(n) < 2 THEN 0 ELSE avg(CASE WHEN a2 IS NOT NULL THEN greatest((a*a2+b*b2+2500)/(sqrt(a*a+b*b+2500)*sqrt(a2*a2+b2*b2+2500)),0) END) END AS consistency FROM p GROUP BY video_id, clip""")
def _(spark, d):
    return ds.scene_consistency(_keyframes(spark, d), ["video_id", "clip"], "e")


v._sql("agc_", """
WITH f AS (SELECT *, first_value(cx) OVER w AS fx, first_value(cy) OVER w AS fy, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM tracks WINDOW w AS (PARTITION BY video_id, clip, track_id ORDER BY frame))
SELECT video_id, clip, track_id, avg(greatest((cx*fx+cy*fy+400)/(sqrt(cx*cx+cy*cy+400)*sqrt(fx*fx+fy*fy+400)),0)) AS to_first,
 avg(greatest((cx*px+cy*py+400)/(sqrt(cx*cx+cy*cy+400)*sqrt(px*px+py*py+400)),0)) AS to_previous FROM f WHERE px IS NOT NULL GROUP BY ALL
""", "tracks")


def _agc(spark, d):
    t = v.tracks(spark, d).withColumn("e", F.array("cx", "cy", F.lit(20.0)))
    return ds.agent_consistency(t, TK, "e")


@query("agent_consistency", "D26", "video_id:l clip:l track_id:l to_first to_previous score", "agc_", "SELECT *, 0.5*to_first+0.5*to_previous AS score FROM agc_")
def _(spark, d):
    return _agc(spark, d)


@query("agent_consistency_overall", "D26", "scenes:l score", "agc_", """
SELECT count(*) AS scenes, avg(s) AS score FROM (SELECT video_id, clip, avg(0.5*to_first+0.5*to_previous) AS s FROM agc_ GROUP BY ALL)""")
def _(spark, d):
    s = _agc(spark, d).groupBy("video_id", "clip").agg(F.avg("score").alias("s"))
    return s.agg(F.count(F.lit(1)).alias("scenes"), F.avg("s").alias("score"))


@query("smoothed_track_embedding", "E19", "video_id:l clip:l track_id:l e0 e1 e2", "tracks", """
WITH RECURSIVE u AS (SELECT video_id, clip, track_id, row_number() OVER (PARTITION BY video_id, clip, track_id ORDER BY frame) AS r, cx/sqrt(cx*cx+cy*cy+400) AS a, cy/sqrt(cx*cx+cy*cy+400) AS b, 20/sqrt(cx*cx+cy*cy+400) AS c FROM tracks),
f AS (SELECT * FROM u WHERE r = 1 UNION ALL SELECT video_id, clip, track_id, r, a/n, b/n, c/n FROM (
  SELECT u.video_id, u.clip, u.track_id, u.r, 0.9*f.a+0.1*u.a AS a, 0.9*f.b+0.1*u.b AS b, 0.9*f.c+0.1*u.c AS c,
   sqrt(pow(0.9*f.a+0.1*u.a,2)+pow(0.9*f.b+0.1*u.b,2)+pow(0.9*f.c+0.1*u.c,2)) AS n FROM f JOIN u ON u.video_id=f.video_id AND u.clip=f.clip AND u.track_id=f.track_id AND u.r=f.r+1))
SELECT video_id, clip, track_id, a AS e0, b AS e1, c AS e2 FROM f QUALIFY row_number() OVER (PARTITION BY video_id, clip, track_id ORDER BY r DESC) = 1""")
def _(spark, d):
    t = v.tracks(spark, d).withColumn("e", F.array("cx", "cy", F.lit(20.0)))
    s = ds.smoothed_embeddings(t, TK, "e")
    return s.select(*TK, *[F.col("smooth")[i].alias(f"e{i}") for i in range(3)])


@query("nearest_to_mean_query", "C16", "vec_id:l label:l distance", "features", """
WITH q AS (SELECT pos, avg(v) AS q FROM features WHERE label = 3 GROUP BY pos), d AS (SELECT vec_id, label, sum((v-q)*(v-q)) AS distance FROM features JOIN q USING (pos) GROUP BY ALL)
SELECT * FROM d ORDER BY distance, vec_id LIMIT 25""")
def _(spark, d):
    e = v.embeddings(spark, d)
    return sm.nearest(e, sm.mean_vector(e.where("label = 3"), "embedding"), "embedding", 25, "vec_id")


@query("similarity_index", "C17", "vec_id:l n_similar:l similar_ids:s", "features", """
WITH p AS (SELECT a.vec_id, b.vec_id AS o, sum((a.v-b.v)*(a.v-b.v)) AS d2 FROM features a JOIN features b USING (pos) GROUP BY ALL)
SELECT vec_id, count(*) AS n_similar, string_agg(o::VARCHAR, ',' ORDER BY o) AS similar_ids FROM p WHERE d2 <= 1.25 GROUP BY vec_id""")
def _(spark, d):
    s = sm.similarity_index(v.embeddings(spark, d), "vec_id", "embedding", 1.25)
    return s.withColumn("similar_ids", F.array_join(F.col("similar_ids").cast("array<string>"), ","))


@query("descriptor_ratio_matches", "C18", "image:l vec_id:l match_id:l distance", "features", """
WITH p AS (SELECT a.vec_id // 50 AS image, a.vec_id, b.vec_id AS o, sqrt(sum((a.v-b.v)*(a.v-b.v))) AS d FROM features a JOIN features b ON a.pos=b.pos AND b.vec_id // 50 = a.vec_id // 50 + 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS r, lead(d) OVER (PARTITION BY vec_id ORDER BY d, o) AS d2 FROM p)
SELECT image, vec_id, o AS match_id, d AS distance FROM r WHERE r = 1 AND d < 0.9*d2""")
def _(spark, d):
    e = v.embeddings(spark, d).withColumn("image", v.div("vec_id", 50))
    return sm.ratio_matches(e, "image", "vec_id", "embedding", 0.9)


@query("table_sql_filter", "G6", "vec_id:l label:l first_value", "", "SELECT vec_id, label, embedding[1] AS first_value FROM embeddings WHERE label IN (1, 4) AND embedding[1] > 0")
def _(spark, d):
    return sm.sql_over(v.table(spark, d, "embeddings"), "WHERE label IN (1, 4) AND embedding[0] > 0", "embedding_rows").withColumn("first_value", F.col("embedding")[0])

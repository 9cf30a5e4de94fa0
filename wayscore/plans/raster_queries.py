"""Raster, mask and luminance statistics on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayscore.operators import raster as ra
from wayscore.plans import views as v
from wayscore.plans.registry import query

VC = "video_id:l clip:l"


@query("exposure_statistics", "I1", "image_id:l mean_luminance std_luminance dynamic_range dynamic_range_ev under_exposure over_saturation", "pixels", """
SELECT image_id, avg(luma) AS mean_luminance, stddev_pop(luma) AS std_luminance, quantile_cont(luma,0.999)-quantile_cont(luma,0.001) AS dynamic_range,
 log2((quantile_cont(pow(luma/255,2.2),0.999)+1e-6)/(quantile_cont(pow(luma/255,2.2),0.001)+1e-6)) AS dynamic_range_ev,
 avg(CASE WHEN luma<100 THEN 1.0 ELSE 0 END) AS under_exposure, avg(CASE WHEN luma>150 THEN 1.0 ELSE 0 END) AS over_saturation FROM pixels GROUP BY image_id""")
def _(spark, d):
    return ra.exposure_statistics(v.pixels(spark, d), under=100, over=150)


@query("region_statistics", "I2", "image_id:l veiling_glare lens_shading flare_attenuation", "pixels", """
WITH p AS (SELECT *, sqrt(pow(x-4,2)+pow(y-4,2)) AS r, sqrt(128.0) AS dg FROM pixels),
g AS (SELECT image_id, avg(luma) AS a, avg(luma) FILTER (WHERE y>=2 AND y<6 AND x>=2 AND x<6) AS c, avg(luma) FILTER (WHERE y<2 AND x<2) AS tl, avg(luma) FILTER (WHERE y<2 AND x>=6) AS tr,
 avg(luma) FILTER (WHERE y>=6 AND x<2) AS bl, avg(luma) FILTER (WHERE y>=6 AND x>=6) AS br, avg(luma) FILTER (WHERE r < 0.1*dg) AS i, avg(luma) FILTER (WHERE r > 0.4*dg AND r < 0.45*dg) AS o FROM p GROUP BY image_id)
SELECT image_id, (a-c)/(c+1e-6) AS veiling_glare, c/((tl+tr+bl+br)/4+1e-6) AS lens_shading, i/greatest(o,1e-6) AS flare_attenuation FROM g""")
def _(spark, d):
    return ra.region_statistics(v.pixels(spark, d))


@query("patch_statistics", "I3", "image_id:l local_rms_contrast contrast_detection contrast_transfer", "pixels", """
WITH p AS (SELECT image_id, y//2 AS py, x//2 AS px, stddev_pop(luma) AS s, CASE WHEN (max(luma)-min(luma))/255 > 0.15 THEN 1.0 ELSE 0 END AS c FROM pixels WHERE y < 6 AND x < 6 GROUP BY ALL),
q AS (SELECT image_id, y//2 AS y, x//2 AS x, avg(luma) AS l FROM pixels GROUP BY ALL),
t AS (SELECT image_id, y//2 AS py, x//2 AS px, (max(l)-min(l))/(max(l)+min(l)+1e-6) AS c FROM q WHERE y < 2 AND x < 2 GROUP BY ALL)
SELECT image_id, p.s AS local_rms_contrast, p.c AS contrast_detection, t.c*(1/(0.1+1e-6)+1/(0.5+1e-6)+1/(0.9+1e-6))/3 AS contrast_transfer
FROM (SELECT image_id, avg(s) AS s, avg(c) AS c FROM p GROUP BY image_id) p JOIN (SELECT image_id, avg(c) AS c FROM t GROUP BY image_id) t USING (image_id)""")
def _(spark, d):
    px = v.pixels(spark, d)
    return ra.patch_statistics(px, 2, contrast=0.15).join(ra.contrast_transfer(px, 2, factor=2), "image_id")


@query("multi_scale_contrast", "I4", "image_id:l global_contrast", "pixels", """
WITH l AS (SELECT image_id, i, y//(2**i)::BIGINT AS y, x//(2**i)::BIGINT AS x, avg(luma) AS l FROM pixels, generate_series(0,5) s(i) GROUP BY ALL)
SELECT image_id, sum(s) AS global_contrast FROM (SELECT image_id, i, stddev_pop(l)/max(2**i) AS s FROM l GROUP BY image_id, i) GROUP BY image_id""")
def _(spark, d):
    return ra.multi_scale_contrast(v.pixels(spark, d))


@query("sensor_noise", "I5", "image_id:l row_noise dsnu fpn dark_current", "pixels", """
WITH pixels2 AS (SELECT image_id, y, x, luma/sqrt(sqrt(3.0)) AS luma FROM pixels), r AS (SELECT image_id, y, avg(luma) AS m FROM pixels2 GROUP BY ALL), a AS (SELECT image_id, var_pop(m) AS row_noise FROM r GROUP BY image_id)
SELECT * FROM a JOIN (SELECT image_id, max(luma)-min(luma) AS dsnu, stddev_pop(luma) AS fpn, avg(luma)/(1+1e-6) AS dark_current FROM pixels2 GROUP BY image_id) USING (image_id)""")
def _(spark, d):
    return ra.sensor_noise(v.pixels(spark, d).withColumn("luma", F.col("luma") / F.sqrt(F.sqrt(F.lit(3.0)))))


v._sql("rgb", """
SELECT image_id // 3 AS image_id, y, x, max(CASE WHEN image_id % 3 = 0 THEN luma END) AS r, max(CASE WHEN image_id % 3 = 1 THEN luma END) AS g, max(CASE WHEN image_id % 3 = 2 THEN luma END) AS b
FROM pixels GROUP BY ALL HAVING count(*) = 3
""", "pixels")


def _rgb(spark, d):
    p = v.pixels(spark, d)
    ch = F.col("image_id") % 3
    pick = lambda i, n: F.max(F.when(ch == i, F.col("luma"))).alias(n)
    g = p.groupBy(v.div("image_id", 3).alias("image_id"), "y", "x").agg(pick(0, "r"), pick(1, "g"), pick(2, "b"), F.count(F.lit(1)).alias("n"))
    return g.where("n = 3").drop("n")


v._sql("lab", """
WITH l AS (SELECT *, CASE WHEN r/255>0.04045 THEN pow((r/255+0.055)/1.055,2.4) ELSE r/255/12.92 END AS lr, CASE WHEN g/255>0.04045 THEN pow((g/255+0.055)/1.055,2.4) ELSE g/255/12.92 END AS lg,
 CASE WHEN b/255>0.04045 THEN pow((b/255+0.055)/1.055,2.4) ELSE b/255/12.92 END AS lb FROM rgb),
q AS (SELECT *, (0.412453::DOUBLE*lr+0.357580::DOUBLE*lg+0.180423::DOUBLE*lb)/0.950456 AS tx, 0.212671::DOUBLE*lr+0.715160::DOUBLE*lg+0.072169::DOUBLE*lb AS ty, (0.019334::DOUBLE*lr+0.119193::DOUBLE*lg+0.950227::DOUBLE*lb)/1.088754 AS tz FROM l),
f AS (SELECT *, CASE WHEN tx>0.008856 THEN pow(tx,1/3.0::DOUBLE) ELSE 7.787*tx+16/116.0::DOUBLE END AS fx, CASE WHEN ty>0.008856 THEN pow(ty,1/3.0::DOUBLE) ELSE 7.787*ty+16/116.0::DOUBLE END AS fy,
 CASE WHEN tz>0.008856 THEN pow(tz,1/3.0::DOUBLE) ELSE 7.787*tz+16/116.0::DOUBLE END AS fz FROM q)
SELECT image_id, y, x, r, g, b, floor(greatest(least((CASE WHEN ty>0.008856 THEN 116*pow(ty,1/3.0::DOUBLE)-16 ELSE 903.3*ty END)*255/100,255),0)+0.5) AS l8,
 floor(greatest(least(500*(fx-fy)+128,255),0)+0.5) AS a8, floor(greatest(least(200*(fy-fz)+128,255),0)+0.5) AS b8 FROM f
""", "rgb")


@query("colour_statistics", "I6", "image_id:l grey_world_error saturation_mean saturation_std colour_separation", "lab", """
WITH m AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(b8) AS bm FROM lab GROUP BY image_id),
s AS (SELECT l.image_id, CASE WHEN greatest(l.r,l.g,l.b)>0 THEN floor(255*(greatest(l.r,l.g,l.b)-least(l.r,l.g,l.b))/greatest(l.r,l.g,l.b)+0.5) ELSE 0 END AS s,
 CASE WHEN sqrt(pow(a8-bm,2)+pow(b8-bm,2)) > 15 THEN 1.0 ELSE 0 END AS far FROM lab l JOIN m USING (image_id)),
t AS (SELECT image_id, avg(s) AS saturation_mean, stddev_pop(s) AS saturation_std, avg(far) AS colour_separation FROM s GROUP BY image_id)
SELECT image_id, abs(r-(r+g+b)/3)+abs(g-(r+g+b)/3)+abs(b-(r+g+b)/3) AS grey_world_error, saturation_mean, saturation_std, colour_separation FROM m JOIN t USING (image_id)""")
def _(spark, d):
    return ra.colour_statistics(_rgb(spark, d))


@query("chart_colour_difference", "I6", "image_id:l delta_e", "lab", """
SELECT image_id, avg(sqrt(pow(l8-(100+10*y),2)+pow(a8-(120+x),2)+pow(b8-128,2))) AS delta_e FROM lab GROUP BY image_id""")
def _(spark, d):
    px = _rgb(spark, d)
    ref = px.select("y", "x").distinct().withColumns({"ref_l": 100.0 + 10 * F.col("y"), "ref_a": 120.0 + F.col("x"), "ref_b": F.lit(128.0)})
    return ra.chart_difference(px, ref, ["y", "x"])


@query("texture_loss", "I7", "image_id:l texture_loss", "pixels", """
SELECT a.image_id, avg(abs(b.luma-a.luma))/(stddev_pop(b.luma)+1e-6) AS texture_loss FROM pixels a JOIN pixels b ON b.image_id=a.image_id+1 AND b.y=a.y AND b.x=a.x GROUP BY a.image_id""")
def _(spark, d):
    px = v.pixels(spark, d)
    return ra.texture_loss(px, px.withColumn("image_id", F.col("image_id") - 1))


@query("response_curve_range", "I7", f"{VC} oecf_range", "luma", """
SELECT video_id, clip, CASE WHEN count(*) FILTER (WHERE k >= 60) > 1 THEN max(luma) FILTER (WHERE k >= 60)/(min(luma) FILTER (WHERE k >= 60)+1e-6) ELSE 0 END AS oecf_range FROM luma GROUP BY ALL""")
def _(spark, d):
    c = v.luma(spark, d).withColumnsRenamed({"luma": "exposure", "k": "snr"})
    return ra.oecf_range(c, ["video_id", "clip"], 60)


v._sql("sten", """
WITH n AS (SELECT p.image_id, p.y, p.x, p.luma AS c, sum(CASE WHEN q.dy=0 AND q.dx=-1 THEN r.luma END) AS l, sum(CASE WHEN q.dy=0 AND q.dx=1 THEN r.luma END) AS rr, sum(CASE WHEN q.dy=-1 AND q.dx=0 THEN r.luma END) AS u, sum(CASE WHEN q.dy=1 AND q.dx=0 THEN r.luma END) AS d,
  sum(q.dx*(2-abs(q.dy))*r.luma) AS gx, sum(q.dy*(2-abs(q.dx))*r.luma) AS gy
 FROM pixels p, (SELECT a.a AS dy, b.b AS dx FROM generate_series(-1,1) a(a), generate_series(-1,1) b(b)) q
 JOIN pixels r ON r.image_id=p.image_id AND r.y = CASE WHEN p.y+q.dy < 0 THEN 1 WHEN p.y+q.dy > 7 THEN 6 ELSE p.y+q.dy END AND r.x = CASE WHEN p.x+q.dx < 0 THEN 1 WHEN p.x+q.dx > 7 THEN 6 ELSE p.x+q.dx END
 GROUP BY p.image_id, p.y, p.x, p.luma)
SELECT image_id, y, x, l+rr+u+d-4*c AS lap, sqrt(gx*gx+gy*gy) AS m FROM n
""", "pixels")


@query("sharpness_and_gradient_entropy", "I8", "image_id:l laplacian_var gradient_entropy", "sten", """
WITH b AS (SELECT *, max(m) OVER (PARTITION BY image_id)+1e-6 AS top FROM sten), h AS (SELECT image_id, least(floor(m/top*256),255) AS bin, count(*) AS c, max(top) AS top FROM b GROUP BY ALL),
p AS (SELECT image_id, c/(64*top/256)+1e-6 AS p FROM h), e AS (SELECT image_id, sum(-p*log2(p)) - (256-count(*))*1e-6*log2(1e-6) AS gradient_entropy FROM p GROUP BY image_id)
SELECT e.image_id, v.laplacian_var, gradient_entropy FROM e JOIN (SELECT image_id, var_pop(lap) AS laplacian_var FROM sten GROUP BY image_id) v USING (image_id)""")
def _(spark, d):
    return ra.sharpness(v.pixels(spark, d))


def _frames(spark, d):
    p = v.pixels(spark, d)
    return p.select(v.div("image_id", 20).alias("video"), (F.col("image_id") % 20).alias("frame"), "y", "x", "luma")


@query("frame_pair_noise", "E12", "video:l frame:l temporal_noise", "pixels", """
SELECT a.image_id // 20 AS video, a.image_id % 20 AS frame, stddev_pop(a.luma-b.luma) AS temporal_noise FROM pixels a JOIN pixels b ON b.image_id=a.image_id-1 AND b.image_id//20=a.image_id//20 AND b.y=a.y AND b.x=a.x GROUP BY ALL""")
def _(spark, d):
    return ra.frame_pair_noise(_frames(spark, d), ["video"])


@query("focus_stability", "E12 I8", "video:l frame:l focus_change", "sten", """
WITH s AS (SELECT image_id//20 AS video, image_id%20 AS frame, var_pop(lap)/sqrt(2.0) AS s FROM sten GROUP BY ALL)
SELECT a.video, a.frame, abs(a.s-b.s) AS focus_change FROM s a JOIN s b ON b.video=a.video AND b.frame=a.frame-1""")
def _(spark, d):
    s = ra.sharpness(_frames(spark, d), ("video", "frame"))
    return ra.focus_changes(s.withColumn("laplacian_var", F.col("laplacian_var") / F.sqrt(F.lit(2.0))), ["video"], "laplacian_var")


@query("luminance_flicker", "E10", f"{VC} exposure_jitter modulation_mitigation sequence_range", "luma", """
WITH m AS (SELECT *, luma - lag(luma) OVER (PARTITION BY video_id, clip ORDER BY frame) AS d, avg(luma) OVER (PARTITION BY video_id, clip) AS m FROM luma)
SELECT video_id, clip, stddev_pop(d) AS exposure_jitter, avg(CASE WHEN abs(luma-m)/(m+1e-6) < 0.3 THEN 1.0 ELSE 0 END) AS modulation_mitigation,
 quantile_cont(luma,0.999)-quantile_cont(luma,0.001) AS sequence_range FROM m GROUP BY ALL""")
def _(spark, d):
    return ra.flicker(v.luma(spark, d), ["video_id", "clip"], near=0.3)


v._sql("dft", """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY video_id, clip) AS n FROM luma), k AS (SELECT *, unnest(generate_series(0, n//2)) AS q FROM n)
SELECT video_id, clip, n, q, pow(sum(luma*cos(2*pi()*q*frame/n)),2)+pow(sum(luma*sin(2*pi()*q*frame/n)),2) AS p, q*10.0::DOUBLE/n AS f FROM k GROUP BY video_id, clip, n, q
""", "luma")
v._sql("pk", "SELECT video_id, clip, n, max(q)+1 AS bins, arg_max(f, (p, -q)) FILTER (WHERE q > 0) AS pf FROM dft GROUP BY video_id, clip, n", "dft")


@query("spectral_flicker", "E11", f"{VC} modulation_power fmp_alias mmp_alias", "dft pk luma", """
WITH g AS (SELECT d.video_id, d.clip, sum(p) FILTER (WHERE f>pf-2 AND f<pf+2)/(sum(p)+1e-6) AS a, sum(p) FILTER (WHERE f>pf-greatest(0.5,0.2*pf) AND f<pf+greatest(0.5,0.2*pf))/(sum(p)+1e-6) AS b FROM dft d JOIN pk USING (video_id, clip) GROUP BY ALL),
w AS (SELECT video_id, clip, n, pf, CASE WHEN n<30 THEN n ELSE 30 END AS win, CASE WHEN n<30 THEN greatest(1,n//2) ELSE 15 END AS hop FROM pk WHERE n >= 4),
s AS (SELECT *, unnest(generate_series(0, n-win, hop)) AS s FROM w), q AS (SELECT *, unnest(generate_series(0, win//2)) AS q FROM s),
x AS (SELECT q.video_id, q.clip, q.s, q.q, q.win, q.pf, pow(sum(luma*cos(2*pi()*q.q*(frame-q.s)/q.win)),2)+pow(sum(luma*sin(2*pi()*q.q*(frame-q.s)/q.win)),2) AS p FROM q JOIN luma l ON l.video_id=q.video_id AND l.clip=q.clip AND l.frame >= q.s AND l.frame < q.s+q.win GROUP BY ALL),
h AS (SELECT video_id, clip, s, coalesce(sum(p) FILTER (WHERE q*10.0::DOUBLE/win > pf-0.5 AND q*10.0::DOUBLE/win < pf+0.5),0)/(sum(p)+1e-6) AS a FROM x GROUP BY video_id, clip, s),
m AS (SELECT video_id, clip, avg(CASE WHEN a < 0.05 THEN 1.0 ELSE 0 END) AS hit FROM h GROUP BY ALL)
SELECT pk.video_id, pk.clip, CASE WHEN bins < 3 THEN 0 ELSE g.a END AS modulation_power, CASE WHEN bins < 3 OR pf < 0.2 THEN 0 ELSE g.b END AS fmp_alias,
 CASE WHEN n < 4 THEN 0 WHEN pf < 0.2 THEN 1 ELSE hit END AS mmp_alias FROM pk JOIN g USING (video_id, clip) LEFT JOIN m USING (video_id, clip)""")
def _(spark, d):
    return ra.spectral_flicker(v.luma(spark, d), ["video_id", "clip"])


@query("led_flicker", "E11", f"{VC} given found", "dft pk", """
SELECT d.video_id, d.clip, coalesce(sum(p) FILTER (WHERE f > 1.0 AND f < 5.0), 0)/(sum(p)+1e-6) AS given,
 coalesce(sum(p) FILTER (WHERE f > pf-2 AND f < pf+2), 0)/(sum(p)+1e-6) AS found
FROM dft d JOIN pk USING (video_id, clip) GROUP BY ALL""")
def _(spark, d):
    t = v.luma(spark, d)
    k = ["video_id", "clip"]
    given = ra.led_flicker_index(t, k, freq_hz=3.0).withColumnRenamed("led_flicker_index", "given")
    return given.join(ra.led_flicker_index(t, k).withColumnRenamed("led_flicker_index", "found"), k)


# ---- masks ------------------------------------------------------------------------------------------------

@query("mask_run_lengths", "B29", "image_id:l counts:s area:l round_trip:l", "pixels", """
WITH m AS (SELECT *, CASE WHEN luma > 130 THEN 1 ELSE 0 END AS m, x*8+y AS p FROM pixels), c AS (SELECT *, CASE WHEN m <> lag(m) OVER (PARTITION BY image_id ORDER BY p) THEN 1 ELSE 0 END AS n FROM m),
r AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY p) AS r FROM c), g AS (SELECT image_id, r, count(*) AS c, max(m) AS m FROM r GROUP BY ALL)
SELECT image_id, CASE WHEN arg_min(m, r)=1 THEN '0,' ELSE '' END || string_agg(c::VARCHAR, ',' ORDER BY r) AS counts, sum(c*m) AS area, sum(c*m) AS round_trip FROM g GROUP BY image_id""")
def _(spark, d):
    r = ra.run_lengths(v.pixels(spark, d), ["image_id"], F.col("luma") > 130)
    back = ra.runs_to_pixels(r, ["image_id"], "counts", 8).groupBy("image_id").agg(F.count(F.lit(1)).alias("round_trip"))
    out = r.join(back, "image_id", "left").fillna(0, ["round_trip"])
    return out.select("image_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"), ra.run_area("counts").alias("area"), "round_trip")


def _masks(spark, d):
    """Truth and prediction masks: neighbouring images cut at different levels."""
    p = v.pixels(spark, d)
    a = p.select("image_id", "y", "x", (F.col("luma") > 130).cast("int").alias("m"))
    b = p.select((F.col("image_id") - 1).alias("image_id"), "y", "x", (F.col("luma") > 120).cast("int").alias("m"))
    ids = b.select("image_id").distinct().join(a.select("image_id").distinct(), "image_id")
    return a.join(ids, "image_id", "left_semi"), b.join(ids, "image_id", "left_semi")


v._sql("mk", "SELECT a.image_id, a.y, a.x, CASE WHEN a.luma>130 THEN 1 ELSE 0 END AS a, CASE WHEN b.luma>120 THEN 1 ELSE 0 END AS b FROM pixels a JOIN pixels b ON b.image_id=a.image_id+1 AND b.y=a.y AND b.x=a.x", "pixels")


@query("mask_overlap", "C9", "image_id:l mask_iou", "mk", "SELECT image_id, sum(a*b)/(sum(a)+sum(b)-sum(a*b)+1e-7) AS mask_iou FROM mk GROUP BY image_id HAVING sum(a)+sum(b) > 0")
def _(spark, d):
    a, b = _masks(spark, d)
    return ra.mask_overlap(a.where("m = 1"), b.where("m = 1"), ["image_id"])


@query("segmentation_overlap", "D37", "object_id:l overlap", "mk", """
WITH o AS (SELECT image_id//20 AS object_id, image_id%20 AS frame, CASE WHEN sum(a)+sum(b)=0 THEN 1 ELSE sum(a*b)::DOUBLE/(sum(a)+sum(b)-sum(a*b)) END AS o FROM mk GROUP BY ALL),
w AS (SELECT *, min(frame) OVER (PARTITION BY object_id) AS lo, max(frame) OVER (PARTITION BY object_id) AS hi FROM o)
SELECT object_id, 100*avg(o) AS overlap FROM w WHERE frame > lo AND frame < hi GROUP BY object_id""")
def _(spark, d):
    a, b = _masks(spark, d)
    key = lambda t: t.withColumns({"object_id": v.div("image_id", 20), "frame": F.col("image_id") % 20})
    a, b = key(a), key(b)
    frames = a.select("object_id", "frame").distinct()
    cols = ["object_id", "frame", "y", "x"]
    return ra.segmentation_overlap(frames, a.where("m = 1").select(cols), b.where("m = 1").select(cols), ["object_id"])[1]


def _edge(c: str) -> str:
    return f"""SELECT image_id, y, x FROM (SELECT *, lead({c}) OVER wx AS e, lead({c}) OVER wy AS s FROM mk WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)) t
 WHERE coalesce(e <> {c}, false) OR coalesce(s <> {c}, false) OR EXISTS (SELECT 1 FROM mk z WHERE z.image_id=t.image_id AND z.y=t.y+1 AND z.x=t.x+1 AND z.{c} <> t.{c})"""


@query("boundary_score", "D38", "image_id:l precision recall f", "mk", f"""
WITH ea AS ({_edge('a')}), eb AS ({_edge('b')}),
ha AS (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM eb WHERE eb.image_id=ea.image_id AND pow(eb.y-ea.y,2)+pow(eb.x-ea.x,2) <= 1)) AS h FROM ea GROUP BY image_id),
hb AS (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ea WHERE eb.image_id=ea.image_id AND pow(eb.y-ea.y,2)+pow(eb.x-ea.x,2) <= 1)) AS h FROM eb GROUP BY image_id),
j AS (SELECT i.image_id, coalesce(ha.n,0) AS na, coalesce(ha.h,0) AS xa, coalesce(hb.n,0) AS nb, coalesce(hb.h,0) AS xb FROM (SELECT DISTINCT image_id FROM mk) i LEFT JOIN ha USING (image_id) LEFT JOIN hb USING (image_id)),
q AS (SELECT image_id, CASE WHEN nb=0 THEN 1 WHEN na=0 THEN 0 ELSE xb::DOUBLE/nb END AS precision, CASE WHEN na=0 THEN 1 WHEN nb=0 THEN 0 ELSE xa::DOUBLE/na END AS recall FROM j)
SELECT *, CASE WHEN precision+recall=0 THEN 0 ELSE 2*precision*recall/(precision+recall) END AS f FROM q""")
def _(spark, d):
    a, b = _masks(spark, d)
    return ra.boundary_score(a, b, ["image_id"], 1)


@query("mask_boxes_and_stability", "D50 B34", "image_id:l x1:l y1:l x2:l y2:l stability", "pixels", """
SELECT image_id, min(x) FILTER (WHERE luma>130) AS x1, min(y) FILTER (WHERE luma>130) AS y1, max(x) FILTER (WHERE luma>130) AS x2, max(y) FILTER (WHERE luma>130) AS y2,
 (count(*) FILTER (WHERE luma > 140))::DOUBLE/nullif(count(*) FILTER (WHERE luma > 120),0) AS stability FROM pixels GROUP BY image_id""")
def _(spark, d):
    p = v.pixels(spark, d)
    s = ra.mask_stability(p, ["image_id"], "luma", 130, 10)
    return s.join(ra.mask_boxes(p.where("luma > 130"), ["image_id"]), "image_id", "left")


@query("keypoint_similarity", "C8", "image_id:l det_id:l oks", "dets lbls", """
WITH p AS (SELECT d.image_id, d.det_id, [d.x1,d.x2,d.x1,d.x2] AS px, [d.y1,d.y1,d.y2,d.y2] AS py, [l.x1,l.x2,l.x1,l.x2] AS gx, [l.y1,l.y1,l.y2,l.y2] AS gy, (l.x2-l.x1)*(l.y2-l.y1) AS area
 FROM dets d JOIN lbls l ON l.image_id=d.image_id AND l.label_id=d.det_id+1), k AS (SELECT *, unnest(generate_series(1,4)) AS i FROM p),
e AS (SELECT image_id, det_id, CASE WHEN i = 1 + (image_id+det_id)%4 THEN 0 ELSE 1 END AS vis, (pow(px[i]-gx[i],2)+pow(py[i]-gy[i],2))/(4*pow(0.05+i*0.02,2))/(area+1e-7)/2 AS e FROM k)
SELECT image_id, det_id, sum(exp(-e)*vis)/(sum(vis)+1e-7) AS oks FROM e GROUP BY ALL""")
def _(spark, d):
    b = v.boxes(spark, d)
    corner = lambda p: F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2"))]).alias(p)
    p = b.where("role = 'pred'").select("image_id", "det_id", corner("p"))
    g = b.where("role = 'label'").select("image_id", (F.col("det_id") - 1).alias("det_id"), corner("g"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    j = p.join(g, ["image_id", "det_id"]).select("image_id", "det_id", "area", F.posexplode(F.arrays_zip("p", "g")).alias("i", "e"))
    rows = j.select("image_id", "det_id", "area", F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), F.col("e.g.x").alias("gx"), F.col("e.g.y").alias("gy"),
                    F.when(F.col("i") == (F.col("image_id") + F.col("det_id")) % 4, 0).otherwise(1).alias("visible"), (0.05 + (F.col("i") + 1) * 0.02).alias("sigma"))
    return ra.keypoint_similarity(rows, ["image_id", "det_id"])


@query("flow_cycle_consistency", "C15", "image_id:l consistent", "pixels", """
WITH f AS (SELECT image_id, y, x, (luma-127)/40 AS u, (127-luma)/60 AS v FROM pixels), b AS (SELECT image_id, y, x, -(luma-127)/50 AS u, (luma-127)/70 AS v FROM pixels)
SELECT f.image_id, avg(CASE WHEN sqrt(pow(f.u+coalesce(b.u,0),2)+pow(f.v+coalesce(b.v,0),2)) < 0.8 THEN 1.0 ELSE 0 END) AS consistent
FROM f LEFT JOIN b ON b.image_id=f.image_id AND b.y=round_even(f.y+f.v,0) AND b.x=round_even(f.x+f.u,0) GROUP BY f.image_id""")
def _(spark, d):
    p = v.pixels(spark, d)
    c = F.col("luma") - 127
    f = p.select("image_id", "y", "x", (c / 40).alias("u"), (-c / 60).alias("v"))
    b = p.select("image_id", "y", "x", (-c / 50).alias("u"), (c / 70).alias("v"))
    return ra.cycle_consistency(f, b, ["image_id"], 8, 8)

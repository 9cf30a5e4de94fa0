"""Track trimming, summaries, counters and tracker scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayscore.operators import tracks as tk
from wayscore.plans import views as v
from wayscore.plans.detection_queries import inter_sql, iou_sql
from wayscore.plans.registry import query

TK = ["video_id", "clip", "track_id"]
KEYS = "video_id:l clip:l track_id:l"
TW = "PARTITION BY video_id, clip, track_id ORDER BY frame"
WAVE = [(100.0, 20.0), (300.0, 10.0), (350.0, 80.0), (120.0, 90.0)]

v._sql("tbox", """
SELECT *, cx - 30 - k % 20 AS x1, cy - 20 - k % 10 AS y1, cx + 30 + k % 20 AS x2, cy + 20 + k % 10 AS y2 FROM tracks
""", "tracks")


def tbox(spark, d):
    k = F.col("k")
    return v.tracks(spark, d).withColumns({"x1": F.col("cx") - 30 - k % 20, "y1": F.col("cy") - 20 - k % 10,
                                           "x2": F.col("cx") + 30 + k % 20, "y2": F.col("cy") + 20 + k % 10})


@query("trim_tracks_at_gap", "E5", f"{KEYS} frames:l last_frame:l", "tracks", """
WITH g AS (SELECT *, CASE WHEN gframe - lag(gframe) OVER w > 10 THEN 1 ELSE 0 END AS g FROM tracks WINDOW w AS (PARTITION BY video_id, clip, track_id ORDER BY gframe)),
s AS (SELECT *, sum(g) OVER (PARTITION BY video_id, clip, track_id ORDER BY gframe) AS s FROM g)
SELECT video_id, clip, track_id, count(*) AS frames, max(gframe) AS last_frame FROM s WHERE s = 0 GROUP BY ALL""")
def _(spark, d):
    t = tk.trim_at_gap(v.tracks(spark, d), TK, "gframe")
    return t.groupBy(*TK).agg(F.count(F.lit(1)).alias("frames"), F.max("gframe").alias("last_frame"))


@query("disappearance_frames", "E6", f"{KEYS} role:s slot:l frame:l", "tracks", """
WITH f AS (SELECT video_id, clip, track_id, list(gframe ORDER BY gframe) AS f FROM tracks GROUP BY ALL HAVING count(*) >= 2 AND max(gframe) <> 39)
SELECT video_id, clip, track_id, 'first' AS role, 0 AS slot, f[1] AS frame FROM f UNION ALL SELECT video_id, clip, track_id, 'first', 1, f[2] FROM f
UNION ALL SELECT video_id, clip, track_id, 'last', 0, f[greatest(1, len(f)-4)] FROM f UNION ALL SELECT video_id, clip, track_id, 'last', 1, f[-1] FROM f
UNION ALL SELECT video_id, clip, track_id, 'next', 0, f[-1]+1 FROM f UNION ALL SELECT video_id, clip, track_id, 'next', 1, CASE WHEN f[-1]+2 <= 39 THEN f[-1]+2 ELSE f[-1]+1 END FROM f""")
def _(spark, d):
    return tk.disappearance_frames(v.tracks(spark, d).select(*TK, "gframe"), TK, "gframe", 39)


@query("sample_track_budget", "E7", f"{KEYS} frame:l", "tracks", f"""
WITH t AS (SELECT *, row_number() OVER ({TW})-1 AS i, count(*) OVER (PARTITION BY video_id, clip, track_id) AS n FROM tracks),
p AS (SELECT DISTINCT video_id, clip, track_id, round_even(g.g*(n-5-1)/6.0, 0) AS i FROM t, generate_series(0,6) g(g))
SELECT video_id, clip, track_id, frame FROM t WHERE n <= 5 OR i >= n-5 OR n <= 12
 OR (i < n-5-1 AND EXISTS (SELECT 1 FROM p WHERE p.video_id=t.video_id AND p.clip=t.clip AND p.track_id=t.track_id AND p.i=t.i))""")
def _(spark, d):
    return tk.sample_track(v.tracks(spark, d), TK, keep_last=5, total_keep=12)


@query("sample_track_stride", "E7", f"{KEYS} frame:l", "tracks", f"""
WITH t AS (SELECT *, row_number() OVER ({TW})-1 AS i, count(*) OVER (PARTITION BY video_id, clip, track_id) AS n FROM tracks)
SELECT video_id, clip, track_id, frame FROM t WHERE n <= 5 OR i >= n-5 OR (i % 4 = 0 AND i < n-5-1)""")
def _(spark, d):
    return tk.sample_track(v.tracks(spark, d), TK, keep_last=5, stride=4)


v._sql("tsum_", """
WITH g AS (SELECT video_id, clip, track_id, count(*) AS frames_seen, min(frame) AS first_frame, max(frame) AS last_frame, avg(conf) AS c,
  arg_min(cx, frame) AS ax, arg_min(cy, frame) AS ay, arg_max(cx, frame) AS bx, arg_max(cy, frame) AS by_ FROM tracks GROUP BY ALL),
m AS (SELECT video_id, clip, track_id, class_name FROM (SELECT video_id, clip, track_id, class_name, count(*) AS n, min(frame) AS f FROM tracks GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY video_id, clip, track_id ORDER BY n DESC, f) = 1)
SELECT video_id, clip, track_id, class_name, frames_seen, first_frame, last_frame, round_even(c,3) AS avg_conf, round_even(ax,1) AS start_x, round_even(ay,1) AS start_y,
 round_even(bx,1) AS end_x, round_even(by_,1) AS end_y, round_even(sqrt(pow(bx-ax,2)+pow(by_-ay,2)),2) AS displacement_px,
 round_even(sqrt(pow(bx-ax,2)+pow(by_-ay,2))/sqrt(490*490+100*100.0),4) AS displacement_norm,
 CASE WHEN sqrt(pow(bx-ax,2)+pow(by_-ay,2)) < 0.04*sqrt(490*490+100*100.0) THEN 'stationary' WHEN abs(bx-ax) >= abs(by_-ay) THEN CASE WHEN bx > ax THEN 'rightward' ELSE 'leftward' END
  ELSE CASE WHEN by_ > ay THEN 'downward' ELSE 'upward' END END AS direction FROM g JOIN m USING (video_id, clip, track_id)
""", "tracks")
TS = f"{KEYS} class_name:s frames_seen:l first_frame:l last_frame:l avg_conf start_x start_y end_x end_y displacement_px displacement_norm direction:s"


def _tsum(spark, d):
    return tk.summarize_tracks(v.tracks(spark, d), ["video_id", "clip"], 490, 100)


@query("track_summaries", "D31 B16", TS, "tsum_", "SELECT * FROM tsum_")
def _(spark, d):
    return _tsum(spark, d)


@query("video_track_counts", "D31", "video_id:l clip:l num_detections:l num_unique_tracks:l num_vehicle_tracks:l num_moving_vehicle_tracks:l num_person_tracks:l num_traffic_light_tracks:l", "tsum_", """
SELECT video_id, clip, sum(frames_seen) AS num_detections, count(*) AS num_unique_tracks, count(*) FILTER (WHERE class_name IN ('click','view')) AS num_vehicle_tracks,
 count(*) FILTER (WHERE class_name IN ('click','view') AND direction <> 'stationary') AS num_moving_vehicle_tracks,
 count(*) FILTER (WHERE class_name = 'purchase') AS num_person_tracks, count(*) FILTER (WHERE class_name = 'error') AS num_traffic_light_tracks FROM tsum_ GROUP BY ALL""")
def _(spark, d):
    return tk.video_track_counts(_tsum(spark, d), ["video_id", "clip"], ["click", "view"], ["purchase"], ["error"])


@query("top_tracks_per_video", "F5 D31", "video_id:l clip:l track_id:l frames_seen:l displacement_px position:l", "tsum_", """
SELECT video_id, clip, track_id, frames_seen, displacement_px, row_number() OVER (PARTITION BY video_id, clip ORDER BY frames_seen DESC, displacement_px DESC, track_id) AS position
FROM tsum_ QUALIFY position <= 50""")
def _(spark, d):
    return tk.top_tracks(_tsum(spark, d), ["video_id", "clip"])


def _poly_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(WAVE, [*WAVE[1:], WAVE[0]]):
        parts.append(f"CASE WHEN (cy > {y1}) <> (cy > {y2}) AND cx < ({x2}-{x1})*(cy-{y1})/({y2}-{y1})+{x1} THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


@query("region_entry_counts", "H1", "video_id:l clip:l move:s n:l tracks:l", "tracks", f"""
WITH i AS (SELECT *, {_poly_sql()} AS ins FROM tracks), l AS (SELECT *, lag(ins) OVER ({TW}) AS was FROM i)
SELECT video_id, clip, CASE WHEN ins THEN 'in' ELSE 'out' END AS move, count(*) AS n, count(DISTINCT track_id) AS tracks FROM l WHERE was IS NOT NULL AND was <> ins GROUP BY ALL""")
def _(spark, d):
    t = tk.region_transitions(v.tracks(spark, d), TK, WAVE)
    per = t.groupBy(*TK, "move").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("video_id", "clip", "move").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tracks"))


@query("line_crossing_counts", "H1", f"{KEYS} moves_in:l moves_out:l", "tbox", f"""
WITH p AS (SELECT *, lag(cx) OVER ({TW}) AS px FROM tbox), i AS (SELECT *, (x1-px)*(150-px) > 0 AS ins FROM p),
l AS (SELECT *, lag(ins) OVER ({TW}) AS was FROM i)
SELECT video_id, clip, track_id, count(*) FILTER (WHERE ins) AS moves_in, count(*) FILTER (WHERE NOT ins) AS moves_out
FROM l WHERE ins IS NOT NULL AND (was IS NULL OR was <> ins) GROUP BY ALL""")
def _(spark, d):
    t = tk.region_transitions(tbox(spark, d), TK, [(100.0, 0.0), (200.0, 100.0)])
    n = lambda m: F.sum((F.col("move") == m).cast("int"))
    return t.groupBy(*TK).agg(n("in").alias("moves_in"), n("out").alias("moves_out"))


@query("line_crossing_speed", "H2", f"{KEYS} speed", "tracks", f"""
WITH z AS (SELECT *, epoch_us(ts)/1e6 AS t FROM tracks WHERE cx > 5 AND cx < 200),
l AS (SELECT *, lag(t) OVER ({TW}) AS pt, lag(cy) OVER ({TW}) AS py FROM z),
h AS (SELECT * FROM l WHERE pt IS NOT NULL AND ((cy > 10 AND cy < 30) OR (cy > 60 AND cy < 80)) QUALIFY row_number() OVER ({TW}) = 1)
SELECT video_id, clip, track_id, abs(cy-py)/(t-pt)*1000 AS speed FROM h WHERE t > pt""")
def _(spark, d):
    time = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return tk.crossing_speed(v.tracks(spark, d), TK, (5, 200), (20, 70), 10, time).withColumn("speed", F.col("speed") * 1000)


v._sql("hbox_", """
SELECT *, CAST(floor(cx/20) AS BIGINT) AS x1, CAST(floor(cy/10) AS BIGINT) AS y1, CAST(floor(cx/20) AS BIGINT)+4 AS x2, CAST(floor(cy/10) AS BIGINT)+3 AS y2 FROM tracks
""", "tracks")


@query("decayed_heat_map", "H3", "video_id:l clip:l y:l x:l heat", "hbox_", """
SELECT video_id, clip, y.y AS y, x.x AS x, sum(2*pow(0.99, 39-frame)) AS heat FROM hbox_, generate_series(0,20) y(y), generate_series(0,40) x(x)
WHERE y.y >= y1 AND y.y < y2 AND x.x >= x1 AND x.x < x2 GROUP BY ALL""")
def _(spark, d):
    return tk.heat_cells(_hbox(spark, d), ["video_id", "clip"], 39)


def _hbox(spark, d):
    t = v.tracks(spark, d).withColumns({"x1": v.div("cx", 20), "y1": v.div("cy", 10)})
    return t.withColumns({"x2": F.col("x1") + 4, "y2": F.col("y1") + 3})


@query("decayed_heat_map_round", "H3", "video_id:l clip:l y:l x:l heat", "hbox_", """
SELECT video_id, clip, y.y AS y, x.x AS x, sum(2*pow(0.99, 39-frame)) AS heat FROM hbox_, generate_series(0,20) y(y), generate_series(0,40) x(x)
WHERE y.y >= y1 AND y.y < y2 AND x.x >= x1 AND x.x < x2 AND pow(x.x-(x1+x2)//2,2)+pow(y.y-(y1+y2)//2,2) <= 1 GROUP BY ALL""")
def _(spark, d):
    return tk.heat_cells(_hbox(spark, d), ["video_id", "clip"], 39, circle=True)


@query("first_region_visits", "H3", f"{KEYS} frame:l move:s", "tbox", f"""
SELECT video_id, clip, track_id, min(frame) AS frame, CASE WHEN arg_min(x1, frame) < 217.5 THEN 'out' ELSE 'in' END AS move FROM tbox WHERE {_poly_sql()} GROUP BY ALL""")
def _(spark, d):
    return tk.first_region_visits(tbox(spark, d), TK, WAVE)


@query("chosen_pair_distance", "H5", "video_id:l clip:l frame:l a:l b:l pixels metres", "tracks", """
WITH c AS (SELECT video_id, min(track_id) AS a, max(track_id) AS b FROM tracks GROUP BY ALL HAVING a < b)
SELECT video_id, clip, frame, c.a, c.b, sqrt(pow(floor(p.cx)-floor(q.cx),2)+pow(floor(p.cy)-floor(q.cy),2)) AS pixels,
 sqrt(pow(floor(p.cx)-floor(q.cx),2)+pow(floor(p.cy)-floor(q.cy),2))/10 AS metres
FROM tracks p JOIN c USING (video_id) JOIN tracks q USING (video_id, clip, frame) WHERE p.track_id = c.a AND q.track_id = c.b""")
def _(spark, d):
    t = v.tracks(spark, d)
    chosen = t.groupBy("video_id").agg(F.min("track_id").alias("a"), F.max("track_id").alias("b")).where("a < b")
    return tk.pair_distance(t, chosen, ["video_id", "clip", "frame"], 10)


@query("repetition_counts", "H6", f"{KEYS} repetitions:l stage:s", "tracks", f"""
WITH a AS (SELECT *, abs(degrees(atan2(cy-50, cx-50) - atan2(0-50, 0-50))) AS t FROM tracks),
z AS (SELECT *, CASE WHEN (CASE WHEN t > 180 THEN 360-t ELSE t END) > 145 THEN 'up' WHEN (CASE WHEN t > 180 THEN 360-t ELSE t END) < 90 THEN 'down' END AS z FROM a),
l AS (SELECT *, last_value(z IGNORE NULLS) OVER ({TW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM z)
SELECT video_id, clip, track_id, count(*) FILTER (WHERE z='down' AND was='up') AS repetitions, arg_max(z, frame) FILTER (WHERE z IS NOT NULL) AS stage FROM l GROUP BY ALL""")
def _(spark, d):
    zero, mid = F.lit(0.0), F.lit(50.0)
    angle = tk.joint_angle(zero, zero, mid, mid, F.col("cx"), F.col("cy"))
    return tk.count_repetitions(v.tracks(spark, d), TK, angle, 145, 90)


@query("track_history_ring", "H7", f"{KEYS} frame:l points:l oldest_x mean_y", "tracks", f"""
SELECT video_id, clip, track_id, frame, count(*) OVER w AS points, first_value(cx) OVER w AS oldest_x, avg(cy) OVER w AS mean_y FROM tracks WINDOW w AS ({TW} ROWS 29 PRECEDING)""")
def _(spark, d):
    h = tk.track_history(v.tracks(spark, d), TK)
    mean = F.aggregate("history", F.lit(0.0), lambda a, p: a + p["cy"]) / F.size("history")
    return h.select(*TK, "frame", F.size("history").alias("points"), F.col("history")[0]["cx"].alias("oldest_x"), mean.alias("mean_y"))


@query("stable_track_gate", "H8", f"{KEYS} frame:l stable_frames:l weighted memory_size:l memory_last:l", "tracks", f"""
WITH r AS (SELECT *, sum(CASE WHEN conf > 0.3 THEN 0 ELSE 1 END) OVER ({TW}) AS run FROM tracks),
s AS (SELECT *, sum(CASE WHEN conf > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, clip, track_id, run ORDER BY frame) AS stable_frames,
 list(CASE WHEN conf > 0.5 AND cx > 20 AND cy > 10 AND frame > 1 THEN frame END) OVER ({TW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS al, lag(frame) OVER ({TW}) AS prev FROM r),
m AS (SELECT *, list_filter(coalesce(al, []), lambda q: q IS NOT NULL)[-6:] AS near FROM s)
SELECT video_id, clip, track_id, frame, stable_frames, 0.15*cy/100+0.85*conf AS weighted, len(near) + CASE WHEN prev IS NULL OR list_contains(near, prev) THEN 0 ELSE 1 END AS memory_size,
 coalesce(prev, -1) AS memory_last FROM m""")
def _(spark, d):
    t = tk.stable_streak(v.tracks(spark, d), TK, F.col("conf") > 0.3)
    m = tk.memory_frames(t, TK, (F.col("conf") > 0.5) & (F.col("cx") > 20) & (F.col("cy") > 10), 6)
    last = F.when(F.size("memory") == 0, -1).otherwise(F.element_at("memory", -1))
    return m.select(*TK, "frame", "stable_frames", (0.15 * F.col("cy") / 100 + 0.85 * F.col("conf")).alias("weighted"),
                    F.size("memory").alias("memory_size"), last.alias("memory_last"))


@query("track_occlusion", "C11 B13", f"{KEYS} n_occluded:l ratio frames:s", "tbox", f"""
WITH o AS (SELECT a.*, NOT (a.x1 <= 24.5 OR 490-a.x2 <= 24.5 OR 160-a.y2 <= 8) AND EXISTS (SELECT 1 FROM tbox b WHERE b.video_id=a.video_id AND b.clip=a.clip AND b.frame=a.frame AND b.track_id<>a.track_id AND {iou_sql('a', 'b', '1e-9')} >= 0.3) AS occ FROM tbox a)
SELECT video_id, clip, track_id, count(*) FILTER (WHERE occ) AS n_occluded, avg(CASE WHEN occ THEN 1.0 ELSE 0.0 END) AS ratio,
 coalesce(string_agg(CASE WHEN occ THEN frame::VARCHAR END, ',' ORDER BY frame), '') AS frames FROM o GROUP BY ALL""")
def _(spark, d):
    o = tk.occlusion(tbox(spark, d), ["video_id", "clip", "frame"], 490, 160, 0.3)
    return o.withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


@query("joined_track_lists", "G2", "video_id:l clip:l joined:l only_first:l", "tracks", """
WITH a AS (SELECT DISTINCT video_id, clip, track_id FROM tracks WHERE frame < 20), b AS (SELECT DISTINCT video_id, clip, track_id FROM tracks WHERE frame >= 20)
SELECT video_id, clip, count(DISTINCT track_id) AS joined, count(*) FILTER (WHERE src='a' AND (video_id, clip, track_id) NOT IN (SELECT (video_id, clip, track_id) FROM b)) AS only_first
FROM (SELECT *, 'a' AS src FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY ALL""")
def _(spark, d):
    t = v.tracks(spark, d)
    a, b = t.where("frame < 20").select(*TK).distinct(), t.where("frame >= 20").select(*TK).distinct()
    j = tk.join_tracks(a, b, TK).groupBy("video_id", "clip").agg(F.count(F.lit(1)).alias("joined"))
    s = tk.subtract_tracks(a, b, TK).groupBy("video_id", "clip").agg(F.count(F.lit(1)).alias("only_first"))
    return j.join(s, ["video_id", "clip"], "left").fillna(0, ["only_first"])


@query("duplicate_track_removal", "G3", "video_id:l clip:l frame:l track_id:l side:s", "tbox", f"""
WITH a AS (SELECT *, frame + track_id % 5 AS age FROM tbox WHERE track_id % 2 = 0), b AS (SELECT *, frame + track_id % 3 AS age FROM tbox WHERE track_id % 2 = 1),
p AS (SELECT a.video_id, a.clip, a.frame, a.track_id AS ta, b.track_id AS tb, a.age AS aa, b.age AS ab FROM a JOIN b USING (video_id, clip, frame) WHERE 1-({iou_sql('a', 'b')}) < 0.5)
SELECT video_id, clip, frame, track_id, 'a' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video_id=a.video_id AND p.clip=a.clip AND p.frame=a.frame AND ta=track_id AND aa <= ab)
UNION ALL SELECT video_id, clip, frame, track_id, 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video_id=b.video_id AND p.clip=b.clip AND p.frame=b.frame AND tb=track_id AND aa > ab)""")
def _(spark, d):
    t = tbox(spark, d)
    a = t.where("track_id % 2 = 0").withColumn("age", F.col("frame") + F.col("track_id") % 5)
    b = t.where("track_id % 2 = 1").withColumn("age", F.col("frame") + F.col("track_id") % 3)
    ka, kb = tk.drop_duplicate_tracks(a, b, ["video_id", "clip", "frame"], 0.5)
    cols = ["video_id", "clip", "frame", "track_id"]
    return ka.select(*cols, F.lit("a").alias("side")).unionByName(kb.select(*cols, F.lit("b").alias("side")))


v._sql("trk_", """
SELECT r.tracker, r.run_id, video_id, clip, track_id, frame, CASE WHEN k % 29 = 5 THEN 0.0 ELSE cx END AS x, cy AS y, CASE WHEN k % 29 = 5 THEN 0.0 ELSE 40.0 + k % 30 END AS w, 30.0 + k % 20 AS h,
 cx + r.s * (k % 9) AS px, cy + r.s * (k % 5) AS py, CASE WHEN k % 13 = 0 THEN 0.0 ELSE 42.0 + k % 25 END AS pw, 33.0 + k % 12 AS ph
FROM tracks, (VALUES ('alpha', 0, 1.0), ('alpha', 1, 2.0), ('beta', 0, 3.0)) r(tracker, run_id, s)
""", "tracks")
SEQ = ["tracker", "run_id", *TK]
SQ = "tracker, run_id, video_id, clip, track_id"


def _trk(spark, d):
    runs = F.array(*[F.struct(F.lit(a).alias("tracker"), F.lit(b).alias("run_id"), F.lit(s).alias("s")) for a, b, s in (("alpha", 0, 1.0), ("alpha", 1, 2.0), ("beta", 0, 3.0))])
    t = v.tracks(spark, d).withColumn("r", F.explode(runs))
    k, s, bad = F.col("k"), F.col("r.s"), F.col("k") % 29 == 5
    return t.select(
        "r.tracker", "r.run_id", *TK, "frame", F.when(bad, 0.0).otherwise(F.col("cx")).alias("x"), F.col("cy").alias("y"),
        F.when(bad, 0.0).otherwise(40.0 + k % 30).alias("w"), (30.0 + k % 20).alias("h"), (F.col("cx") + s * (k % 9)).alias("px"),
        (F.col("cy") + s * (k % 5)).alias("py"), F.when(k % 13 == 0, 0.0).otherwise(42.0 + k % 25).alias("pw"), (33.0 + k % 12).alias("ph"))


v._sql("terr_", f"""
WITH g AS (SELECT *, row_number() OVER w AS rn, max(CASE WHEN (pw <> 0 AND ph <> 0) OR frame = 0 THEN frame END) OVER w AS uf FROM trk_ WINDOW w AS (PARTITION BY {SQ} ORDER BY frame)),
u AS (SELECT g.tracker, g.run_id, g.video_id, g.clip, g.track_id, g.frame, g.x, g.y, g.w, g.h, CASE WHEN g.rn=1 THEN g.x ELSE s.px END AS px, CASE WHEN g.rn=1 THEN g.y ELSE s.py END AS py,
  CASE WHEN g.rn=1 THEN g.w ELSE s.pw END AS pw, CASE WHEN g.rn=1 THEN g.h ELSE s.ph END AS ph FROM g JOIN trk_ s ON s.tracker=g.tracker AND s.run_id=g.run_id AND s.video_id=g.video_id AND s.clip=g.clip AND s.track_id=g.track_id AND s.frame=g.uf),
c AS (SELECT *, w > 0 AND h > 0 AS valid, px+0.5*(pw-1)-(x+0.5*(w-1)) AS dx, py+0.5*(ph-1)-(y+0.5*(h-1)) AS dy,
  greatest(least(px+pw,x+w)-greatest(px,x),0)*greatest(least(py+ph,y+h)-greatest(py,y),0) AS i FROM u)
SELECT {SQ}, frame, valid, CASE WHEN valid THEN i/(pw*ph+w*h-i) ELSE -1 END AS overlap, CASE WHEN valid THEN sqrt(dx*dx+dy*dy) END AS center_error,
 CASE WHEN valid THEN sqrt(pow(dx/nullif(w,0),2)+pow(dy/nullif(h,0),2)) ELSE -1 END AS norm_error FROM c
""", "trk_")


@query("tracking_frame_errors", "D34", f"tracker:s run_id:l {KEYS} frame:l valid:b overlap center_error norm_error", "terr_", "SELECT * FROM terr_")
def _(spark, d):
    return tk.tracking_errors(_trk(spark, d), SEQ)


_LV = {"o": ("overlap > {}", 21, 0.05), "c": ("center_error <= {}", 51, 1.0), "n": ("norm_error <= {}", 51, 0.01)}
v._sql("tcur_", f"""
SELECT {SQ}, [{', '.join(f'avg(CASE WHEN overlap > {t} THEN 1.0 ELSE 0.0 END)' for t in tk.OVERLAP_LEVELS)}] AS oc,
 avg(CASE WHEN center_error <= 20 THEN 1.0 ELSE 0.0 END) AS p20, avg(CASE WHEN norm_error <= 0.2 THEN 1.0 ELSE 0.0 END) AS n20, avg(overlap) FILTER (WHERE valid) AS mo FROM terr_ GROUP BY ALL
""", "terr_")
_SUMMARY = "count(*) AS sequences, avg(list_sum(oc)/21)*100 AS auc, avg(oc[11])*100 AS op50, avg(oc[16])*100 AS op75, avg(p20)*100 AS precision20, avg(n20)*100 AS norm_precision"
SUM_COLS = "sequences:l auc op50 op75 precision20 norm_precision"


def _curves(spark, d):
    return tk.success_curves(tk.tracking_errors(_trk(spark, d), SEQ), SEQ)


@query("tracking_summary", "D35", f"tracker:s run_id:l {SUM_COLS}", "tcur_", f"SELECT tracker, run_id, {_SUMMARY} FROM tcur_ GROUP BY ALL")
def _(spark, d):
    return tk.tracking_summary(_curves(spark, d), ["tracker", "run_id"])


@query("tracking_success_curve", "D35", "tracker:s level success", "tcur_", """
SELECT tracker, (i-1)*0.05 AS level, avg(oc[i])*100 AS success FROM tcur_, generate_series(1,21) s(i) GROUP BY tracker, i""")
def _(spark, d):
    c = _curves(spark, d).select("tracker", F.posexplode("overlap_curve").alias("i", "s"))
    return c.groupBy("tracker", "i").agg((F.avg("s") * 100).alias("success")).withColumn("level", F.col("i") * 0.05)


@query("tracking_merged_runs", "D36", f"tracker:s {SUM_COLS}", "tcur_", f"""
WITH m AS (SELECT tracker, video_id, clip, track_id, list_transform(generate_series(1,21), lambda i: list_avg(list_transform(l, lambda c: c[i]))) AS oc, p20, n20
 FROM (SELECT tracker, video_id, clip, track_id, list(oc) AS l, avg(p20) AS p20, avg(n20) AS n20 FROM tcur_ GROUP BY ALL))
SELECT tracker, {_SUMMARY} FROM m GROUP BY tracker""")
def _(spark, d):
    return tk.tracking_summary(tk.merge_runs(_curves(spark, d), ["tracker", *TK]), ["tracker"])


@query("tracking_by_attribute", "D36", f"tracker:s attribute:s {SUM_COLS}", "tcur_", f"""
SELECT tracker, CASE WHEN track_id % 3 = 0 THEN 'fast motion' WHEN track_id % 3 = 1 THEN 'occlusion' ELSE 'scale' END AS attribute, {_SUMMARY} FROM tcur_ GROUP BY ALL""")
def _(spark, d):
    kind = F.when(F.col("track_id") % 3 == 0, "fast motion").when(F.col("track_id") % 3 == 1, "occlusion").otherwise("scale")
    c = _curves(spark, d)
    attr = c.select("track_id").distinct().withColumn("attribute", kind)
    return tk.tracking_summary(c.join(attr, "track_id"), ["tracker", "attribute"])


@query("tracking_per_sequence", "D36", f"{KEYS} alpha beta", "tcur_", """
SELECT video_id, clip, track_id, avg(mo) FILTER (WHERE tracker='alpha') AS alpha, avg(mo) FILTER (WHERE tracker='beta') AS beta FROM tcur_ GROUP BY ALL""")
def _(spark, d):
    return _curves(spark, d).groupBy(*TK).pivot("tracker", ["alpha", "beta"]).agg(F.avg("mean_overlap"))

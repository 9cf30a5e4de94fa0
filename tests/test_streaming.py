"""Stream results equal batch results, over several micro-batches."""

import tempfile

import pytest
from pyspark.sql import functions as F

from wayscore.operators import association as ac
from wayscore.operators import tracks as tk
from wayscore.plans import views as v
from wayscore.plans.association_queries import smooth_boxes
from wayscore.plans.track_queries import WAVE
from wayscore.streaming import processors as sp

TK = ["video_id", "clip", "track_id"]


@pytest.fixture(scope="module")
def stream_of(spark):
    def make(df, order="frame", pieces=3):
        """The batch cut into files by frame order, read one file per trigger."""
        out = tempfile.mkdtemp(prefix="wayscore-stream-")
        top = df.agg(F.max(order)).first()[0] + 1
        for i in range(pieces):
            lo, hi = top * i // pieces, top * (i + 1) // pieces
            df.where((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(out)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(out)

    return make


def run(df, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="wayscore-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    if q.exception():
        raise q.exception()
    return [r.asDict() for r in df.sparkSession.table(name).collect()]


def keyset(rows, cols):
    return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in rows)


def test_region_moves(spark, sf, stream_of):
    t = v.tracks(spark, sf).drop("ts")
    batch = [r.asDict() for r in tk.region_transitions(t, TK, WAVE).withColumn("at", F.col("frame").cast("double")).collect()]
    got = run(sp.stream_region_transitions(stream_of(t), TK, WAVE), "moves")
    cols = [*TK, "at", "move"]
    assert batch and keyset(got, cols) == keyset(batch, cols)


def test_repetitions(spark, sf, stream_of):
    t = v.tracks(spark, sf).drop("ts")
    z, m = F.lit(0.0), F.lit(50.0)
    angle = tk.joint_angle(z, z, m, m, F.col("cx"), F.col("cy"))
    batch = {tuple(r[k] for k in TK): r["repetitions"] for r in tk.count_repetitions(t, TK, angle, 145, 90).collect()}
    got = {}
    for r in run(sp.stream_repetitions(stream_of(t), TK, angle, 145, 90), "reps"):
        k = tuple(r[c] for c in TK)
        got[k] = max(got.get(k, 0), r["repetitions"])
    assert {k: n for k, n in batch.items() if n} == got


def test_crossing_speed(spark, sf, stream_of):
    t = v.tracks(spark, sf).withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).drop("ts")
    batch = [r.asDict() for r in tk.crossing_speed(t, TK, (5, 200), (20, 70), 10, F.col("sec")).collect()]
    got = run(sp.stream_crossing_speed(stream_of(t), TK, (5, 200), (20, 70), 10, "sec"), "speeds")
    assert batch and keyset(got, [*TK, "speed"]) == keyset(batch, [*TK, "speed"])


def test_history_and_streaks(spark, sf, stream_of):
    t = v.tracks(spark, sf).drop("ts")
    b = tk.track_history(t, TK).select(*TK, F.col("frame").cast("double").alias("at"), F.size("history").cast("long").alias("points"))
    got = run(sp.stream_history(stream_of(t), TK), "ring")
    assert keyset(got, [*TK, "at", "points"]) == keyset([r.asDict() for r in b.collect()], [*TK, "at", "points"])
    b = tk.stable_streak(t, TK, F.col("conf") > 0.3).select(*TK, F.col("frame").cast("double").alias("at"), "stable_frames")
    got = run(sp.stream_streaks(stream_of(t), TK, F.col("conf") > 0.3), "streaks")
    assert keyset(got, [*TK, "at", "stable_frames"]) == keyset([r.asDict() for r in b.collect()], [*TK, "at", "stable_frames"])


def test_tracker(spark, sf, stream_of):
    d = smooth_boxes(spark, sf)
    cols = ["video_id", "clip", "frame", "track", "det_id", "score", "x1", "y2"]
    batch = [r.asDict() for r in ac.track_clips(d, ["video_id", "clip"]).collect()]
    got = run(sp.stream_tracker(stream_of(d), ["video_id", "clip"]), "objects")
    assert batch and keyset(got, cols) == keyset(batch, cols)


def test_late_rows_are_dropped_and_counted(spark, stream_of):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 2, 5.0), (1, 3, 5.0)], "k long, frame long, cx double").withColumn("cy", F.lit(1.0))
    out = tempfile.mkdtemp(prefix="wayscore-late-")
    rows.where("frame >= 2").coalesce(1).write.mode("append").parquet(out)
    late = rows.where("frame = 0").unionByName(rows.where("frame = 3").withColumn("frame", F.lit(9).cast("long")))
    late.coalesce(1).write.mode("append").parquet(out)
    import glob
    import os
    import time
    first, second = sorted(glob.glob(out + "/*.parquet"), key=os.path.getmtime)
    os.utime(first, (time.time() - 100,) * 2)
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(out)
    got = run(sp.stream_history(s, ["k"]), "late")
    assert [(r["at"], r["points"], r["late"]) for r in sorted(got, key=lambda r: r["at"])] == [(2.0, 1, 0), (3.0, 2, 0), (9.0, 3, 1)]


def test_windowed_heat(spark, stream_of):
    rows = spark.createDataFrame([(1, i, 0, 0, 2, 1) for i in range(60)], "video_id long, s int, x1 int, y1 int, x2 int, y2 int")
    rows = rows.withColumn("t", F.timestamp_seconds("s"))
    got = run(sp.stream_heat(stream_of(rows, "s"), ["video_id"], "t", "10 seconds", "1 second"), "heat")
    closed = {r["window"]["start"] for r in got}
    assert len(closed) >= 4 and all(r["heat"] == 20 for r in got)


def test_pair_distance_join(spark, sf, stream_of):
    t = v.tracks(spark, sf).withColumn("t", F.timestamp_seconds(1_700_000_000 + F.col("clip") * 1000 + F.col("frame"))).drop("ts")
    chosen = t.groupBy("video_id").agg(F.min("track_id").alias("a"), F.max("track_id").alias("b")).where("a < b")
    keys = ["video_id", "clip", "frame"]
    batch = [r.asDict() for r in tk.pair_distance(t, chosen, keys, 10).collect()]
    got = run(sp.stream_pair_distance(stream_of(t.where("clip = 0")), chosen, keys, 10, "t"), "pairs")
    want = [r for r in batch if r["clip"] == 0]
    assert want and keyset(got, [*keys, "a", "b", "pixels"]) == keyset(want, [*keys, "a", "b", "pixels"])


def _waves(spark, rows, schema):
    """One file for each list of rows, in order, as a stream."""
    import os
    import time

    out = tempfile.mkdtemp(prefix="wayscore-waves-")
    seen = set()
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("t", F.timestamp_seconds(F.col("s") + 1_700_000_000)).coalesce(1).write.mode("append").parquet(out)
        new = {f for f in os.listdir(out) if f.endswith(".parquet")} - seen
        seen |= new
        for f in new:
            os.utime(f"{out}/{f}", (time.time() - 1000 + i,) * 2)
    return spark.readStream.schema(spark.read.parquet(out).schema).option("maxFilesPerTrigger", 1).parquet(out)


def _state_keys(spark, checkpoint, name):
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint).collect()
    return {r["key"]["k"] for r in rows}


def _run_at(df, name):
    checkpoint = tempfile.mkdtemp(prefix="wayscore-ckpt-")
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return [r.asDict() for r in df.sparkSession.table(name).collect()], checkpoint, q


def test_ended_tracks_leave_no_state_and_late_rows_are_counted(spark):
    waves = [[(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 5, 5)], [(2, 3, 6), (2, 7, 7)], [(2, 500, 500)], [(2, 501, 501)], [(1, 2, 3), (2, 502, 502)], [(2, 503, 900)]]
    rows = [[(k, f, float(f), 1.0, s) for k, f, s in w] for w in waves]
    s = _waves(spark, rows, "k long, frame long, cx double, cy double, s long")
    got, checkpoint, q = _run_at(sp.stream_history(s, ["k"], ends=sp.Ends("t", 60, "20 seconds")), "ended")
    at = lambda k: [(r["at"], r["points"], r["late"]) for r in sorted(got, key=lambda r: r["at"]) if r["k"] == k]
    assert at(1) == [(0.0, 1, 0), (1.0, 2, 0)]  # its row of second 3 comes behind the watermark
    assert at(2)[:3] == [(0.0, 1, 0), (5.0, 2, 0), (7.0, 3, 1)] and all(r[2] in (0, 1) for r in at(2))
    assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) == 1
    assert _state_keys(spark, checkpoint, "fold") == {2}


def test_tracker_state_is_one_entry_a_track_and_ends(spark):
    box = lambda k, f, i, x: (k, f, i, 0.9, x, 0.0, x + 40, 60.0, f)
    waves = [[box(1, f, i, 200.0 * i + f) for f in range(3) for i in (1, 2)] + [box(2, 0, 1, 0.0)], [box(2, 1, 1, 1.0)], [box(2, 1_000_000, 1, 5.0)], [box(2, 1_000_001, 1, 5.0)]]
    s = _waves(spark, waves, "k long, frame long, det_id long, conf double, x1 double, y1 double, x2 double, y2 double, s long")
    got, checkpoint, _ = _run_at(sp.stream_tracker(s, ["k"], sp.Ends("t", 60, "20 seconds")), "tracked")
    assert {(r["det_id"], r["track"]) for r in got if r["k"] == 1} == {(1, 1), (2, 2)}
    assert [r["frame"] for r in got if r["k"] == 2][:2] == [0, 1]
    assert _state_keys(spark, checkpoint, "fold") == {2} == _state_keys(spark, checkpoint, "tracks")


def test_a_gap_of_a_million_frames_passes_at_once():
    import time

    import numpy as np

    state = ac.new_tracker()
    box = np.array([[0.0, 0.0, 40.0, 60.0]])
    for _ in range(3):
        ac.track_frame(state, box, np.array([0.9]), [1])
    begin = time.time()
    ac.skip_frames(state, 1_000_000)
    assert time.time() - begin < 2 and state["tracks"] == [] and state["frame"] == 1_000_003

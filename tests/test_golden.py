"""Published demo values, literal cases and numpy twins on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayscore.functions import kalman as kf
from wayscore.functions import text as tx
from wayscore.operators import association as ac
from wayscore.operators import captions as cp
from wayscore.operators import distribution as ds
from wayscore.operators import trajectory as tr


@pytest.fixture(scope="module")
def circle(spark):
    rng = np.random.RandomState(0)
    t = np.linspace(0, 4 * np.pi, 101)
    truth = np.repeat(30 * np.stack([np.cos(t), np.sin(t)], -1)[None], 8, 0)
    pred = truth + 0.4 * rng.randn(8, 101, 2) + 0.3 * np.roll(truth, 10, axis=1)
    rows = [(b, f, *map(float, pred[b, f]), *map(float, truth[b, f])) for b in range(8) for f in range(101)]
    return spark.createDataFrame(rows, "scene_id long, frame long, px double, py double, gx double, gy double")


def test_golden_trajectory_values(circle):
    k = ["scene_id"]
    e = tr.displacement_errors(circle, k).agg(F.avg("ade"), F.avg("fde"), F.avg("success")).first()
    assert e[0] == pytest.approx(9.020381286932569, rel=1e-12)
    assert e[1] == pytest.approx(9.043563595143615, rel=1e-12)
    assert e[2] == 0
    assert tr.hausdorff(circle, k).agg(F.avg("hausdorff")).first()[0] == pytest.approx(5.470039531722291, rel=1e-12)
    w = tr.warping(circle, k).agg(F.avg("ndtw"), F.avg("dtw")).first()
    assert w[0] == pytest.approx(0.34880821820753677, rel=1e-12)
    assert w[1] == pytest.approx(425.529119564488, rel=1e-12)
    assert tr.dynamic_similarity(circle, k).agg(F.avg("dynamic_similarity")).first()[0] == pytest.approx(1.278691741265335e-06, rel=1e-9)


def test_same_path_has_no_distance(circle):
    same = circle.withColumns({"px": F.col("gx"), "py": F.col("gy")})
    assert tr.warping(same, ["scene_id"]).agg(F.max("dtw")).first()[0] == 0
    assert tr.hausdorff(same, ["scene_id"]).agg(F.max("hausdorff")).first()[0] == 0


def test_alignment_undoes_a_rotation(circle):
    a = 0.7
    start = circle.withColumns({"gx": F.col("gx") - 30, "gy": F.col("gy")})
    turned = start.withColumns({"px": np.cos(a) * F.col("gx") - np.sin(a) * F.col("gy"), "py": np.sin(a) * F.col("gx") + np.cos(a) * F.col("gy")})
    out = tr.align(turned.withColumns({"x": F.col("px"), "y": F.col("py")}), turned, ["scene_id"])
    err = out.agg(F.max(F.abs(F.col("x") - F.col("gx"))), F.max(F.abs(F.col("y") - F.col("gy")))).first()
    assert max(err) < 1e-9


def test_short_and_static_clips(spark):
    rows = [("still", f, 0.0, 0.0) for f in range(8)] + [("four", f, float(f), 0.0) for f in range(4)] + [("one", 0, 1.0, 2.0)]
    d = spark.createDataFrame(rows, "scene_id string, frame long, x double, y double")
    q = {r["scene_id"]: r for r in tr.quality(d, ["scene_id"]).collect()}
    assert q["still"]["comfort"] is None and q["still"]["speed_score"] == 0 and q["still"]["quality"] == 0
    assert q["four"]["comfort"] is None and q["four"]["curvature_score"] == pytest.approx(1.0)
    assert q["one"]["quality"] is None
    r = {(x["scene_id"], x["frame"]): x["x"] for x in tr.resample(d.withColumn("n", F.lit(7)), ["scene_id"], "n").collect()}
    assert [r["one", i] for i in range(7)] == [1.0] * 7
    assert [r["four", i] for i in range(7)] == pytest.approx([i / 2 for i in range(7)])


def test_resample_skips_missing_points(spark):
    vals = [0.0, float("nan"), 2.0, 3.0]
    rows = [("a", i, x, x) for i, x in enumerate(vals)] + [("b", i, float("nan"), float("nan")) for i in range(3)]
    d = spark.createDataFrame(rows, "scene_id string, frame long, x double, y double").withColumn("n", F.lit(7))
    r = {(x["scene_id"], x["frame"]): x["x"] for x in tr.resample(d, ["scene_id"], "n").collect()}
    want = np.interp(np.linspace(0, 1, 7), np.array([0, 2, 3]) / 3, [0.0, 2.0, 3.0])
    assert [r["a", i] for i in range(7)] == pytest.approx(list(want))
    assert [r["b", i] for i in range(7)] == [0.0] * 7
    half = spark.createDataFrame([("c", 0, 1.0, float("nan")), ("c", 1, float("nan"), 5.0), ("c", 2, 3.0, 9.0)],
                                 "scene_id string, frame long, x double, y double").withColumn("n", F.lit(5))
    r = {x["frame"]: (x["x"], x["y"]) for x in tr.resample(half, ["scene_id"], "n").collect()}
    assert [r[i] for i in range(5)] == [(1.0, 5.0), (1.5, 5.0), (2.0, 5.0), (2.5, 7.0), (3.0, 9.0)]


def test_polynomial_weights_keep_cubics():
    for k in (5, 7):
        h = tr.polyfit_weights(k, 3)
        y = np.arange(k, dtype=float) ** 3
        assert np.allclose(h @ y, y)


def test_tagged_text(spark):
    text = "Intro text\n<question>\nWhat is the capital of France?\n</question>\nMiddle text\n<answer>\nParis\n</answer>\nEnd text\n"
    open_ = "a <b> c <d>x</d>"
    d = spark.createDataFrame([(1, text), (2, open_), (3, ""), (4, "<a>1</a>")], "i int, t string")
    parts, rest = tx.tagged_parts(F.col("t"))
    got = {r["i"]: (([(p["tag"], p["text"]) for p in r["p"]]), r["r"]) for r in d.select("i", parts.alias("p"), rest.alias("r")).collect()}
    assert got[1] == ([("question", "\nWhat is the capital of France?\n"), ("answer", "\nParis\n")], ["Intro text\n", "\nMiddle text\n", "\nEnd text\n"])
    assert got[2] == ([("d", "x")], ["a ", " c "])
    assert got[3] == ([], []) and got[4] == ([("a", "1")], [""])


def test_conversation_order(spark):
    c = cp.conversation(F.lit("sys"), F.lit("hi"), F.array(F.lit("i1"), F.lit("i2")), F.array(F.lit("v1"), F.lit("v2")), F.lit(""), 10)
    turns = spark.range(1).select(c.alias("c")).first()["c"]
    assert [t["role"] for t in turns] == ["system", "user"]
    parts = turns[1]["content"]
    assert [p["type"] for p in parts] == ["image", "image", "video", "video", "text"]
    assert [p["max_pixels"] for p in parts] == [10, 10, 10, 10, None]


def test_root_removal(spark):
    d = spark.createDataFrame([("/a/b/c",), ("/ax/b/c",), ("ax/b/c",)], "p string")
    for root in ("a", "/a"):
        assert [r[0] for r in d.select(tx.remove_root(F.col("p"), root)).collect()] == ["b/c", "/ax/b/c", "ax/b/c"]


def test_frechet_matches_numpy(spark):
    rng = np.random.RandomState(1)
    a, b = rng.randn(300, 6), rng.randn(280, 6) * 1.3 + 0.4
    rows = [("a", x.tolist()) for x in a] + [("b", x.tolist()) for x in b]
    d = spark.createDataFrame(rows, "s string, v array<double>")
    got = ds.frechet_distance(d, "s", "a", "b", "v", 6, 1, 1e-6).first()[0]
    ca, cb = np.cov(a.T) + 1e-6 * np.eye(6), np.cov(b.T) + 1e-6 * np.eye(6)
    root = np.sqrt(np.clip(np.linalg.eigvals(ca @ cb).real, 0, None)).sum()
    m = a.mean(0) - b.mean(0)
    assert got == pytest.approx(m @ m + np.trace(ca) + np.trace(cb) - 2 * root, rel=1e-9)
    assert ds.frechet_distance(d.where("s = 'a'").unionByName(d.where("s = 'a'").withColumn("s", F.lit("b"))), "s", "a", "b", "v", 6).first()[0] < 1e-6


def test_assignment_beats_every_permutation():
    from itertools import permutations
    rng = np.random.RandomState(3)
    for n, m in ((3, 4), (4, 2), (5, 5), (1, 3)):
        for _ in range(20):
            c = rng.rand(n, m)
            limit = 0.8
            pairs = kf.assign(c, limit)
            total = lambda ps: sum(c[i, j] for i, j in ps) + (n + m - 2 * len(ps)) * limit / 2
            best = min(total([(i, j) for i, j in zip(rows, cols)])
                       for k in range(min(n, m) + 1) for rows in permutations(range(n), k) for cols in permutations(range(m), k))
            assert total(pairs) == pytest.approx(best)
            assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})


@pytest.mark.parametrize("aspect", [True, False])
def test_filter_matches_one_track_at_a_time(spark, aspect):
    """Full 8 x 8 matrices frame by frame, on tracks with gaps, a single box, a repeated frame and blocks of states."""
    from wayscore.operators import trackfilter as tf

    rng = np.random.RandomState(5)
    rows = [(t, f, 10.0 * f + rng.randn(), 5.0 * f + rng.randn(), 0.5 + rng.rand() / 10, 40.0 + rng.rand()) for t in range(3) for f in range(12) if (t, f) not in {(1, 4), (1, 5)}]
    rows += [(7, 3, 1.0, 2.0, 0.5, 30.0), (8, 0, 1.0, 2.0, 0.5, 30.0), (8, 5000, 9.0, 2.0, 0.5, 30.0), (9, 1, 1.0, 2.0, 0.5, 30.0), (9, 1, 2.0, 2.0, 0.5, 30.0)]
    rows += [(10, f, float(f), 0.0, 1.0, 50.0) for f in range(tf.BLOCK + 3)]
    d = spark.createDataFrame(rows, "track_id long, frame long, x double, y double, a double, h double")
    plan = tf.filter_tracks(d, ["track_id"], aspect)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in plan.collect():
        got.setdefault(r["track_id"], []).append((r["frame"], r["x"], r["y"], r["a"], r["h"], r["gate"]))
    motion = np.eye(8) + np.eye(8, k=4)

    def noise(mean, p, v, pa, va):
        h, w = mean[3], mean[2]
        return np.diag(np.square([p * h, p * h, pa, p * h, v * h, v * h, va, v * h] if aspect else [p * w, p * h, p * w, p * h, v * w, v * h, v * w, v * h]))

    assert set(got) == {r[0] for r in rows}
    for t in got:
        own = sorted(r for r in rows if r[0] == t)
        mean = np.r_[np.array(own[0][2:]), np.zeros(4)]
        cov = noise(mean, 2 / 20, 10 / 160, 1e-2, 1e-5)
        now, want = own[0][1], [(own[0][1], *mean[:4], 0.0)]
        for r in own[1:]:
            for _ in range(max(1, r[1] - now)):
                mean, cov = motion @ mean, motion @ cov @ motion.T + noise(mean, 1 / 20, 1 / 160, 1e-2, 1e-5)
                now += 1
            s = cov[:4, :4] + noise(mean, 1 / 20, 0, 1e-1, 0)[:4, :4]
            gain = cov[:, :4] @ np.linalg.inv(s)
            diff = np.array(r[2:]) - mean[:4]
            gate = diff @ np.linalg.inv(s) @ diff
            mean, cov = mean + gain @ diff, cov - gain @ s @ gain.T
            want.append((r[1], *mean[:4], gate))
        assert sorted(got[t]) == [pytest.approx(w, rel=1e-7, abs=1e-7) for w in sorted(want)]


def test_tracker_keeps_identities(spark):
    rows = []
    for f in range(20):
        rows += [("v", f, 1, 0.9, 5.0 * f, 0.0, 5.0 * f + 40, 60.0), ("v", f, 2, 0.9, 400 - 5.0 * f, 100.0, 440 - 5.0 * f, 160.0)]
        if 8 <= f <= 10:
            rows = [r for r in rows if not (r[1] == f and r[2] == 2)]
    d = spark.createDataFrame(rows, "video_id string, frame long, det_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    out = ac.track_clips(d, ["video_id"]).collect()
    by_det = {}
    for r in out:
        by_det.setdefault(r["det_id"], set()).add(r["track"])
    assert by_det == {1: {1}, 2: {2}}
    assert len([r for r in out if r["det_id"] == 2]) == 17


def test_frame_assignment_prefers_overlap(spark):
    t = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 20.0, 0.0, 30.0, 10.0)], "frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    d = spark.createDataFrame([(0, 7, 21.0, 0.0, 31.0, 10.0, 0.9), (0, 8, 1.0, 0.0, 11.0, 10.0, 0.9), (0, 9, 90.0, 0.0, 95.0, 5.0, 0.9)],
                              "frame long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double")
    got = {(r["track_id"], r["det_id"]) for r in ac.assign_frames(t, d, ["frame"]).collect()}
    assert got == {(1, 8), (2, 7)}

"""Overlap tables, suppression, assignment and descriptor matches against brute force."""

from itertools import permutations

import numpy as np
import pytest

from wayscore.functions import kalman as kf
from wayscore.operators import association as ac
from wayscore.operators import detection as dt
from wayscore.operators import instances as ins
from wayscore.operators import similarity as sm


def _lowest(rows, shape):
    """Of equal shapes in one image and class the lowest id."""
    out = {}
    for image, cls, i, s in rows:
        key = (image, cls, shape(s))
        out[key] = min(i, out.get(key, i))
    return [(image, cls, i, next(s for im, c, j, s in rows if (im, c, j) == (image, cls, i))) for (image, cls, _), i in out.items()]


def _pairs(dets, labels, measure, shape):
    out = {}
    for im, c, i, a in _lowest(dets, shape):
        for im2, c2, j, b in _lowest(labels, shape):
            if (im, c) == (im2, c2) and (x := measure(a, b)) >= 0.5:
                out[im, i, j] = x
    return out


def _got(df):
    return {(r["image_id"], r["det_id"], r["label_id"]): r["iou"] for r in df.collect()}


def test_mask_pairs(spark):
    rng = np.random.RandomState(1)

    def runs(m):
        edges = np.flatnonzero(np.diff(np.r_[0, m, 1 - m[-1]]))
        counts = np.diff(np.r_[0, edges])
        return [int(x) for x in counts]

    bases = [(rng.rand(90) < 0.5).astype(int) for _ in range(4)] + [np.zeros(90, int), np.ones(90, int)]
    noisy = lambda m: np.where(rng.rand(90) < 0.15, 1 - m, m)
    dets = [(i % 2, i % 3 // 2, i, noisy(bases[i % 6]) if i % 5 else bases[i % 6]) for i in range(60)]
    labels = [(i % 2, i % 3 // 2, 100 + i, noisy(bases[i % 6]) if i % 4 else bases[i % 6]) for i in range(40)]
    for m in [*dets, *labels]:
        assert sum(runs(m[3])) == 90
    iou = lambda a, b: (a & b).sum() / ((a | b).sum() + 1e-7)
    table = lambda rows, name: spark.createDataFrame([(im, c, i, runs(m)) for im, c, i, m in rows], f"image_id long, cls long, {name} long, counts array<int>")
    want = _pairs(dets, labels, iou, lambda m: tuple(m))
    for chunk in (7, 1024):
        got = _got(ins.mask_pairs(table(dets, "det_id"), table(labels, "label_id"), chunk=chunk))
        assert len(want) > 20 and got == pytest.approx(want)


def test_rotated_pairs_lose_no_pair_to_the_bound(spark):
    rng = np.random.RandomState(2)

    def cov(b):
        _, _, w, h, r = b
        c, s = np.cos(r), np.sin(r)
        return (np.array([[c, -s], [s, c]]) * [w * w / 12, h * h / 12]) @ np.array([[c, s], [-s, c]])

    def prob(a, b):
        s1, s2 = cov(a), cov(b)
        total, delta = s1 + s2, np.array(a[:2]) - np.array(b[:2])
        det = np.linalg.det(total)
        near = 0.25 * delta @ np.array([[total[1, 1], -total[0, 1]], [-total[0, 1], total[0, 0]]]) @ delta / (det + 1e-7)
        d = max(np.linalg.det(s1), 0) * max(np.linalg.det(s2), 0)
        bd = np.clip(near + 0.5 * np.log(det / (4 * np.sqrt(d) + 1e-7) + 1e-7), 1e-7, 100)
        return 1 - np.sqrt(1 - np.exp(-bd) + 1e-7)

    def box(i):
        long, short = (200.0, 3.0) if i % 3 == 0 else (30.0, 20.0) if i % 3 == 1 else (0.5, 0.3)
        return (float(rng.uniform(0, 60)), float(rng.uniform(0, 60)), long * rng.uniform(0.8, 1.2), short * rng.uniform(0.8, 1.2), float(rng.uniform(0, 0.6)))

    dets = [(0, i % 2, i, box(i)) for i in range(90)]
    labels = [(0, i % 2, 500 + i, tuple(np.array(dets[i][3]) + np.array([rng.randn() * 0.3 * dets[i][3][3], rng.randn() * 0.3 * dets[i][3][3], 0, 0, 0]))) for i in range(90)]
    labels += [(0, i % 2, 700 + i, (dets[i][3][0] + 0.3 * dets[i][3][2] * np.cos(dets[i][3][4]), dets[i][3][1] + 0.3 * dets[i][3][2] * np.sin(dets[i][3][4]), *dets[i][3][2:])) for i in range(60)]
    table = lambda rows, name: spark.createDataFrame([(im, c, i, *map(float, b)) for im, c, i, b in rows], f"image_id long, cls long, {name} long, cx double, cy double, w double, h double, angle double")
    want = _pairs(dets, labels, prob, lambda b: b)
    got = _got(ins.rotated_pairs(table(dets, "det_id"), table(labels, "label_id"), cell=16.0))
    assert len(want) > 100 and got == pytest.approx(want, rel=1e-6)


def test_keypoint_pairs_lose_no_pair_to_the_bound(spark):
    rng = np.random.RandomState(3)
    sigmas = [0.05, 0.1, 0.2]

    def oks(p, label):
        g, area = label
        e = [((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) / (4 * s * s) / (area + 1e-7) / 2 for a, b, s in zip(p, g, sigmas)]
        seen = [b[2] != 0 for b in g]
        return sum(np.exp(-x) for x, v in zip(e, seen) if v) / (sum(seen) + 1e-7)

    truth = [[(float(rng.uniform(0, 300)), float(rng.uniform(0, 300)), int(rng.rand() < 0.7)) for _ in sigmas] for _ in range(40)]
    truth[5] = [(x, y, 0) for x, y, _ in truth[5]]
    labels = [(0, i % 2, 500 + i, (t, float(rng.choice([100.0, 2500.0, 90000.0])))) for i, t in enumerate(truth)]
    dets = [(0, i % 2, i, [(x + rng.randn() * 15, y + rng.randn() * 15) for x, y, _ in truth[i % 40]]) for i in range(120)]
    dets += [(0, i % 2, 300 + i, [truth[i][0][:2], (9999.0, 0.0), (-9999.0, 0.0)]) for i in range(20)]
    d = spark.createDataFrame([(im, c, i, [tuple(map(float, x)) for x in p]) for im, c, i, p in dets], "image_id long, cls long, det_id long, points array<struct<x:double,y:double>>")
    t = spark.createDataFrame([(im, c, i, g, a) for im, c, i, (g, a) in labels], "image_id long, cls long, label_id long, points array<struct<x:double,y:double,visible:int>>, area double")
    want = {(im, i, j): x for im, c, i, p in dets for im2, c2, j, g in labels if c == c2 and (x := oks(p, g)) >= 0.5}
    got = _got(ins.keypoint_pairs(d, t, sigmas, cell=50.0))
    assert len(want) > 50 and got == pytest.approx(want, rel=1e-6)


def test_suppression_of_one_crowded_image(spark):
    """100,000 boxes of one image and class by rounds, against a greedy pass over a grid; small groups either way."""
    rng = np.random.RandomState(4)
    n = 100_000
    xy = rng.uniform(0, 3000, (n, 2)).round(1)
    wh = rng.uniform(20, 40, (n, 2)).round(1)
    conf = rng.randint(20, 1000, n) / 1000
    boxes = np.hstack([xy, xy + wh])
    order = np.lexsort((np.arange(n), -conf))
    grid, kept = {}, []
    for i in order:
        if conf[i] <= 0.25:
            continue
        x1, y1, x2, y2 = boxes[i]
        near = [j for cx in range(int(x1 // 64), int(x2 // 64) + 1) for cy in range(int(y1 // 64), int(y2 // 64) + 1) for j in grid.get((cx, cy), ())]
        if near:
            b = boxes[near]
            inter = np.clip(np.minimum(b[:, 2], x2) - np.maximum(b[:, 0], x1), 0, None) * np.clip(np.minimum(b[:, 3], y2) - np.maximum(b[:, 1], y1), 0, None)
            areas = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) + (x2 - x1) * (y2 - y1)
            if (inter / (areas - inter) > 0.45).any():
                continue
        kept.append(i)
        for cx in range(int(x1 // 64), int(x2 // 64) + 1):
            for cy in range(int(y1 // 64), int(y2 // 64) + 1):
                grid.setdefault((cx, cy), []).append(i)
    import pandas as pd

    pdf = pd.DataFrame({"image_id": 1, "det_id": np.arange(n), "cls": 0, "conf": conf, "x1": boxes[:, 0], "y1": boxes[:, 1], "x2": boxes[:, 2], "y2": boxes[:, 3]})
    d = spark.createDataFrame(pdf)
    got = {r["position"]: r["det_id"] for r in dt.suppress(d).collect()}
    assert [got[i + 1] for i in range(len(got))] == kept
    few = d.where("x1 < 500 AND y1 < 500").withColumn("image_id", d.det_id % 7)
    assert sorted(map(tuple, dt.suppress(few, fold=10**6).collect())) == sorted(map(tuple, dt.suppress(few, fold=0).collect()))


def test_assignment_by_appearance_is_the_best_one(spark):
    rng = np.random.RandomState(6)
    tracks, dets, want = [], [], {}
    for f in range(40):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        a = np.array([[x, y, x + 40, y + 40] for x, y in rng.uniform(0, 40, (n, 2))])
        b = np.array([[x, y, x + 40, y + 40] for x, y in rng.uniform(0, 40, (m, 2))])
        la, lb, conf = rng.randn(n, 3), rng.randn(m, 3), rng.rand(m)
        tracks += [(f, i, *map(float, a[i]), la[i].tolist()) for i in range(n)]
        dets += [(f, j, *map(float, b[j]), float(conf[j]), lb[j].tolist()) for j in range(m)]
        cost = np.zeros((n, m))
        for i in range(n):
            for j in range(m):
                w, h = min(a[i, 2], b[j, 2]) - max(a[i, 0], b[j, 0]), min(a[i, 3], b[j, 3]) - max(a[i, 1], b[j, 1])
                inter = max(w, 0) * max(h, 0)
                iou = inter / (3200 - inter + 1e-7)
                look = max(0, 1 - la[i] @ lb[j] / np.linalg.norm(la[i]) / np.linalg.norm(lb[j])) / 2
                cost[i, j] = min(1 - iou * conf[j], 1.0 if look > 0.25 or 1 - iou > 0.5 else look)
        want[f] = min(sum(cost[i, j] for i, j in zip(r, c)) + (n + m - 2 * k) * 0.4
                      for k in range(min(n, m) + 1) for r in permutations(range(n), k) for c in permutations(range(m), k) if all(cost[i, j] <= 0.8 for i, j in zip(r, c)))
    box = "x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame(tracks, f"frame long, track_id long, {box}, look array<double>")
    d = spark.createDataFrame(dets, f"frame long, det_id long, {box}, conf double, look array<double>")
    pairs = ac.assign_frames(t, d, ["frame"], feature="look")
    got = {r["frame"]: r["total"] for r in ac.assignment_totals(pairs, t, d, ["frame"]).collect()}
    assert got == pytest.approx(want)
    assert kf.appearance_cost(np.ones((1, 1)), np.ones(1), np.zeros((1, 2)), np.zeros((1, 2)))[0, 0] == 0.0


def test_tracker_keeps_identities_by_appearance(spark):
    """Two objects side by side swap places within one frame: boxes alone follow the place, embeddings the object."""
    rows = []
    for f in range(6):
        a, b = (0.0, 12.0) if f < 4 else (12.0, 0.0)
        rows += [("v", f, 1, 0.9, a, 0.0, a + 40, 60.0, [1.0, 0.0]), ("v", f, 2, 0.9, b, 0.0, b + 40, 60.0, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "video_id string, frame long, det_id long, conf double, x1 double, y1 double, x2 double, y2 double, look array<double>")

    def kept(feature):
        by_det = {}
        for r in ac.track_clips(d, ["video_id"], feature).collect():
            by_det.setdefault(r["det_id"], set()).add(r["track"])
        return by_det

    assert kept("look") == {1: {1}, 2: {2}}
    assert kept(None) == {1: {1, 2}, 2: {1, 2}}


@pytest.mark.parametrize("tile", [3, 1024])
def test_ratio_matches_by_tiles(spark, tile):
    rng = np.random.RandomState(7)
    rows = [(i, 100 * i + j, rng.randn(4).round(2).tolist()) for i in (0, 1, 2, 4) for j in range(20 if i < 4 else 1)]
    rows.append((1, 199, rows[3][2]))
    rows.append((5, 500, [0.0] * 4))
    d = spark.createDataFrame(rows, "image long, id long, v array<double>")
    want = set()
    for i, k, v in rows:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), m) for j, m, w in rows if j == i + 1)
        if len(near) > 1 and near[0][0] < 0.7 * near[1][0]:
            want.add((i, k, near[0][1]))
    got = {(r["image"], r["id"], r["match_id"]) for r in sm.ratio_matches(d, "image", "id", "v", 0.7, tile).collect()}
    assert got == want and len(want) > 3


@pytest.mark.parametrize("size", [3, 8, 256])
def test_pose_chain_in_blocks(spark, size):
    """Clips cut into small blocks, and blocks of blocks, against one product after the other."""
    from wayscore.operators import depthflow as df_

    rng = np.random.RandomState(8)
    rows, want = [], {}
    for k, n in ((1, 60), (2, 1), (3, 25)):
        pose = np.eye(4)
        for f in range(n):
            a = rng.uniform(-0.3, 0.3)
            rot = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]) * (2.0 if f % 7 == 3 else 1.0)
            t = rng.uniform(-1, 1, 3)
            if k == 3 and f % 2:
                continue  # frames without a step
            rows.append((k, f, rot.ravel().tolist(), t.tolist()))
            if f % 7 != 3:
                step = np.eye(4)
                step[:3, :3], step[:3, 3] = rot, t
                pose = pose @ np.linalg.inv(step)
            want[k, f] = pose.ravel()
    d = spark.createDataFrame(rows, "k long, frame long, rot array<double>, t array<double>")
    got = {(r["k"], r["frame"]): r["pose"] for r in df_.chain_poses(d, ["k"], size=size).collect()}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_a_repeated_run_has_its_lines_once(spark, tmp_path):
    from wayscore.sources import sinks as sk

    log = f"{tmp_path}/log"
    run = lambda v: spark.createDataFrame([("ade", v), ("fde", v + 1)], "metric string, value double")
    sk.append_metric(run(1.0), log, "a")
    sk.append_metric(run(2.0), log, "b")
    sk.append_metric(run(3.0), log, "a")
    got = sorted((r["run"], r["metric"], r["value"]) for r in spark.read.json(log).collect())
    assert got == [("a", "ade", 3.0), ("a", "fde", 4.0), ("b", "ade", 2.0), ("b", "fde", 3.0)]

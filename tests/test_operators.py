"""Skew-safe helpers against plain windows, scans and sinks on files, and edge rows."""

import json
import tempfile
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.functions import boxes as bx
from wayscore.functions import text as tx
from wayscore.operators import captions as cp
from wayscore.operators import depthflow as df_
from wayscore.operators import detection as dt
from wayscore.operators import distribution as ds
from wayscore.operators import motion as mo
from wayscore.operators import ordered as od
from wayscore.operators import similarity as sm
from wayscore.operators import trajectory as tr
from wayscore.sources import readers as rd
from wayscore.sources import sinks as sk


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows, and one value a third of them."""
    d = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 7).alias("k"), F.col("id"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 1009).cast("double")).alias("v"))
    return d.cache()


def test_numbering_matches_a_plain_window(hot):
    got = od.number_rows(hot, ["k"], {"b": F.floor(F.col("id") / 100)}, ["id"], "n")
    want = hot.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("id")) - 1)
    assert got.join(want.select("id", "w"), "id").where("n <> w").count() == 0


def test_running_totals_match_a_plain_window(hot):
    got = od.running_totals(hot, ["k"], {"a": F.floor(F.col("id") / 500), "b": F.floor(F.col("id") / 50), "c": F.floor(F.col("id") / 10)}, ["id"], {"s": F.col("id")})
    want = hot.withColumn("w", F.sum("id").over(W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, 0)))
    assert got.join(want.select("id", "w"), "id").where("s <> w").count() == 0


def test_grouped_quantiles_match_numpy(hot):
    probs = {"a": 0.02, "b": 0.5, "c": 0.98}
    got = {r["k"]: r for r in od.grouped_quantiles(hot, ["k"], "v", probs).collect()}
    low = {r["k"]: r for r in od.grouped_quantiles(hot, ["k"], "v", probs, "lower").collect()}
    pdf = hot.toPandas()
    for k, g in pdf.groupby("k"):
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(g["v"], p))
            assert low[k][n] == np.quantile(g["v"], p, method="lower")


def test_halo_blocks_give_every_neighbour(spark):
    d = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("frame"), (F.col("id") * F.col("id")).alias("v"))
    h = od.halo_blocks(d, "frame", 16, 1, 2)
    w = W.partitionBy("k", "_block").orderBy("frame")
    got = h.withColumns({"p": F.lag("v").over(w), "n": F.lead("v", 2).over(w)}).where("_own")
    wf = W.partitionBy("k").orderBy("frame")
    want = d.withColumns({"p0": F.lag("v").over(wf), "n0": F.lead("v", 2).over(wf)}).drop("v")
    assert got.join(want, ["k", "frame"]).where("NOT (p <=> p0) OR NOT (n <=> n0)").count() == 0
    assert got.count() == 200


def test_perfect_detections(spark):
    rows = [(i, j, j % 2, 0.5 + 0.01 * j, 30.0 * j, 0.0, 30.0 * j + 20, 20.0) for i in range(6) for j in range(5)]
    d = spark.createDataFrame(rows, "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    lab = d.drop("conf").withColumnRenamed("det_id", "label_id")
    ap = dt.average_precision(dt.match_detections(d, lab), lab).collect()
    assert len(ap) == 20 and all(r["ap"] == pytest.approx(0.995) for r in ap)
    cm = {(r["predicted"], r["actual"]): r["n"] for r in dt.confusion_matrix(d, lab, 2).collect()}
    assert cm == {(0, 0): 18, (1, 1): 12}


def test_matching_by_given_overlaps(spark):
    cols = "image_id long, {} long, cls long, conf double, x1 double, y1 double, x2 double, y2 double"
    box = (0.0, 0.0, 10.0, 10.0)
    d = spark.createDataFrame([(1, i, 0, 0.9 - i / 10, *box) for i in range(3)] + [(1, 3, 1, 0.5, *box)], cols.format("det_id"))
    lab = spark.createDataFrame([(1, i, 0, 0.0, *box) for i in range(2)], cols.format("label_id"))
    over = [(1, 0, 0, 0.3), (1, 0, 1, 0.45), (1, 1, 0, 0.62), (1, 1, 1, 0.81), (1, 2, 0, 0.97), (1, 2, 1, float("nan")), (1, 3, 0, 1.0)]
    m = dt.match_detections(d, lab, overlaps=spark.createDataFrame(over, "image_id long, det_id long, label_id long, iou double")).collect()
    assert {r["det_id"]: sum(r[f"t{i}"] for i in range(10)) for r in m} == {0: 0, 1: 7, 2: 10, 3: 0}


def test_images_without_labels_or_detections(spark):
    d = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, 0.8, 0.0, 0.0, 10.0, 10.0), (2, 2, 0, 0.7, 0.0, 0.0, 10.0, 10.0)],
                              "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    lab = spark.createDataFrame([(2, 5, 0, 0.0, 0.0, 10.0, 10.0), (3, 6, 1, 0.0, 0.0, 5.0, 5.0)], "image_id long, label_id long, cls int, x1 double, y1 double, x2 double, y2 double")
    m = {(r["image_id"], r["det_id"]): r["t0"] for r in dt.match_detections(d, lab).collect()}
    assert m == {(1, 1): 0, (2, 1): 1, (2, 2): 0}
    ap = {(r["cls"], r["lvl"]): r["ap"] for r in dt.average_precision(dt.match_detections(d, lab), lab).collect()}
    assert (1, 0) not in ap or ap[1, 0] == 0
    cm = {(r["predicted"], r["actual"]): r["n"] for r in dt.confusion_matrix(d, lab, 2).collect()}
    assert cm == {(0, 0): 1, (0, 2): 2, (2, 1): 1}


def brute_ap(hits, conf, n_l):
    order = np.lexsort((np.arange(len(conf)), -conf))
    tp = hits[order]
    j, n = tp.cumsum(), np.arange(1, len(tp) + 1)
    rec, pre = np.r_[0, j / n_l, 1], np.r_[1, j / n, 0]
    pre = np.flip(np.maximum.accumulate(np.flip(pre)))
    x = np.linspace(0, 1, 101)
    return np.trapezoid(np.interp(x, rec, pre), x)


def test_average_precision_matches_the_curve(spark):
    rng = np.random.RandomState(2)
    n, n_l = 400, 173
    hits = (rng.rand(n) < 0.35).astype(int)
    conf = rng.rand(n)
    rows = [(i // 20, i, 0, float(conf[i]), *[int(hits[i])] * 10) for i in range(n)]
    m = spark.createDataFrame(rows, "image_id long, det_id long, cls int, conf double, " + ", ".join(f"t{i} int" for i in range(10)))
    lab = spark.range(n_l).select(F.lit(0).alias("cls"))
    got = dt.average_precision(m, lab).first()["ap"]
    assert got == pytest.approx(brute_ap(hits, conf, n_l), abs=1e-12)
    c = {r["point"]: r for r in dt.confidence_curves(m, lab).collect()}
    order = np.argsort(-conf)
    tp = hits[order].cumsum()
    x = np.linspace(0, 1, 1000)
    rec = np.interp(-x, -conf[order], tp / n_l, left=0)
    pre = np.interp(-x, -conf[order], tp / np.arange(1, n + 1), left=1)
    assert [c[i]["recall"] for i in range(1000)] == pytest.approx(list(rec), abs=1e-12)
    assert [c[i]["precision"] for i in range(1000)] == pytest.approx(list(pre), abs=1e-12)


def test_nearest_points_on_a_hot_cloud(spark):
    rng = np.random.RandomState(4)
    pts = np.r_[rng.rand(400, 3), np.repeat(rng.rand(1, 3), 200, 0), rng.rand(5, 3) * 50]
    q = np.r_[rng.rand(60, 3), rng.rand(4, 3) * 80]
    a = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(q)], "c int, id long, x double, y double, z double")
    b = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], "c int, id long, x double, y double, z double")
    d2 = ((q[:, None] - pts[None]) ** 2).sum(-1)
    for k in (1, 4):
        got = {}
        for r in df_.nearest_points(a, b, ["c"], ["x", "y", "z"], k).collect():
            got.setdefault((r["x"], r["y"], r["z"]), {})[r["rank"]] = (r["d2"], r["ref"])
        for i, p in enumerate(q):
            order = np.lexsort((np.arange(len(pts)), d2[i]))[:k]
            mine = got[tuple(map(float, p))]
            assert [mine[j + 1][0] for j in range(k)] == pytest.approx(list(d2[i][order]))


def test_similarity_counts_copies(spark):
    rng = np.random.RandomState(6)
    v = np.r_[rng.rand(80, 5), np.repeat(rng.rand(1, 5), 40, 0)].astype("float32")
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<float>")
    got = {r["i"]: r["n_similar"] for r in sm.similarity_index(d, "i", "v", 0.2).collect()}
    d2 = ((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(-1)
    assert got == {i: int((d2[i] <= 0.2).sum()) for i in range(len(v))}


def test_similar_vectors_meet_by_pivots(spark, monkeypatch):
    """Clusters of many blocks: all links are found, and most pairs of blocks are never compared."""
    monkeypatch.setattr(sm, "BLOCK", 16)
    rng = np.random.RandomState(8)
    x = np.concatenate([rng.randn(1, 12) * 8 + rng.randn(60, 12) * 0.3 for _ in range(9)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    got = {(r["a"], r["b"]) for r in sm.within_distance(d, "i", "v", 1.5).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d2 <= 1.5))}
    width = 1.5 ** 0.5
    blocks = sm.vector_blocks(d.select(F.col("i").alias("rep"), F.lit(1).alias("copies"), "v"), width).cache()
    n = blocks.count()
    assert sm.block_pairs(blocks, width).count() < 0.3 * n * (n + 1) / 2


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_similar_vectors(spark, n):
    d = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(n)], "i long, v array<double>")
    assert {(r["a"], r["b"]) for r in sm.within_distance(d, "i", "v", 1.0).collect()} == {(a, b) for a in range(n) for b in range(n)}


def test_warping_of_long_and_short_clips():
    """Clips of unlike lengths in one batch, against the plain table; one long clip doesn't widen the others."""
    rng = np.random.RandomState(9)
    sides = [[rng.randn(n, 2).cumsum(0) for n in rng.randint(1, 40, 50)] for _ in range(2)]
    column = lambda s, c: pd.Series([x[:, c] for x in s])
    run = lambda a, b: tr._warp_cost.func(column(a, 0), column(a, 1), column(b, 0), column(b, 1))

    def plain(a, b):
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = np.hypot(*(a[i] - b[j])) + min(t[i, j], t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    assert list(run(*sides)) == [plain(a, b) for a, b in zip(*sides)]
    long = [rng.randn(5000, 2)] + sides[0]
    tracemalloc.start()
    assert list(run(long, long)) == [0.0] * 51
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_kernel_distance_of_equal_sets_is_small(spark):
    rng = np.random.RandomState(7)
    x = rng.randn(60, 4)
    rows = [(0, "r", i, r.tolist()) for i, r in enumerate(x)] + [(0, "g", i, r.tolist()) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "s int, side string, i long, v array<double>")
    got = ds.kernel_distance(d, ["s"], "side", "r", "g", "v", "i").first()["kernel_distance"]
    k = (x @ x.T / 4 + 1) ** 3
    m = 60
    want = ((2 * k.sum() - 2 * np.trace(k)) / (m - 1) - 2 * k.sum() / m) / m * 1000
    assert got == pytest.approx(want)


def test_box_growth_and_edges(spark):
    d = spark.createDataFrame([(2, 3, 6, 9), (0, 0, 100, 100), (95, 95, 130, 140), (-5, -5, 1, 1)], "x1 int, y1 int, x2 int, y2 int")
    g = [tuple(r) for r in d.select(*[c.alias(n) for n, c in bx.named(bx.grow_to_min(bx.box(), 100, 100, 12)).items()]).collect()]
    assert g[1] == (0, 0, 100, 100)
    assert all(0 <= r[0] < r[2] <= 100 and 0 <= r[1] < r[3] <= 100 for r in g)
    assert g[0] == (0, 0, 12, 12)


def test_score_words(spark):
    words = {"Yes": 1.0, " clearly followed ": 1.0, "0.5": 0.5, "0.76": 1.0, "0.24": 0.0, "what": 0.5, None: 0.5, "-3": 0.0, "inf": 1.0}
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in d.select(tx.normalize_score(F.col("w"))).collect()] == list(words.values())


def test_sentences_split_on_any_white_space(spark):
    d = spark.createDataFrame([("One.\nTwo!\tThree?  Four. ", 1)], "t string, i int")
    c = cp.fallback_claims(d, "i", "t").orderBy("pos").collect()
    assert [(r["claim_id"], r["claim"]) for r in c] == [("C1", "One."), ("C2", "Two!"), ("C3", "Three?"), ("C4", "Four.")]


def test_file_scans(spark):
    root = tempfile.mkdtemp(prefix="wayscore-scan-")

    def put(path, body):
        import os
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", encoding="utf-8") as f:
            f.write(body if isinstance(body, str) else json.dumps(body))
        return f"{root}/{path}"

    assert {r[0] for r in rd.scene_manifest(spark, put("m/scenes.json", ["a", "b"])).collect()} == {"a", "b"}
    caps = rd.read_captions(spark, put("c/caps.json", {"a.mp4": " x ", "b.mp4": {"caption": "y"}, "c.mp4": {"other": 1}})).collect()
    assert {(r["video_key"], r["caption"]) for r in caps} == {("a.mp4", "x"), ("b.mp4", "y")}
    lines = rd.read_result_lines(spark, put("r/results.txt", "vista: {'fvd': 1.5, 'agent_missing': None}\nnot a line\nx: {'fvd': 2}\n"), "struct<fvd:double,agent_missing:double>")
    assert {(r["model"], r["fvd"], r["agent_missing"]) for r in lines.collect()} == {("Vista-2B", 1.5, None), ("x", 2.0, None)}
    put("t/a/one.json", [{"is_correct": True}, {"is_correct": False}, {"note": 1}])
    put("t/two.json", {"is_correct": True})
    put("t/bad.json", "{oops")
    assert sorted(r[0] for r in rd.read_answer_tree(spark, f"{root}/t").collect()) == [False, True]
    put("s/m1/batch_summary.json", [{"pair_id": "p", "status": "success", "caption_usage_score": 50.0, "weighted_caption_usage_score": 40.0, "num_claims": 1, "category_scores": {"actions": 1.0}},
                                    {"pair_id": "q", "status": "failed"}])
    put("s/m1/p/caption_usage_report.json", {"claim_results": [{"category": "actions", "final_score": 0.5, "claim": "c"}]})
    put("s/m1/q/caption_usage_report.json", {"claim_results": [{"category": "actions", "final_score": 0.5, "claim": "d"}]})
    scenes, claims = rd.read_caption_reports(spark, f"{root}/s/*/batch_summary.json", f"{root}/s/*/*/caption_usage_report.json")
    assert [(r["model"], r["scene"]) for r in scenes.collect()] == [("m1", "p")]
    assert [r["claim"] for r in claims.collect()] == ["c"]
    put("b/seq1.txt", "1\t2\t3\t4\n5,6,7,8\n")
    b = rd.read_tracker_boxes(spark, f"{root}/b").orderBy("frame").collect()
    assert [(r["seq"], r["frame"], r["x"], r["h"]) for r in b] == [("seq1", 0, 1.0, 4.0), ("seq1", 1, 5.0, 8.0)]


def test_sinks(spark):
    root = tempfile.mkdtemp(prefix="wayscore-sink-")
    d = spark.createDataFrame([("m1", "s1", 1.5), ("m2", "s1", 2.5)], "model string, scene string, ade double")
    for fmt in ("csv", "json", "parquet"):
        sk.write_results(d, f"{root}/{fmt}", fmt)
        back = spark.read.option("header", True).option("inferSchema", True).format(fmt).load(f"{root}/{fmt}")
        assert {(r["model"], r["scene"], r["ade"]) for r in back.collect()} == {("m1", "s1", 1.5), ("m2", "s1", 2.5)}
    for _ in range(2):
        sk.append_metric(d, f"{root}/log")
        sk.append_result_line(d.select("model", "ade"), f"{root}/lines")
    assert spark.read.json(f"{root}/log").count() == 4
    again = rd.read_result_lines(spark, f"{root}/lines", "struct<ade:double>")
    assert again.groupBy("model").count().orderBy("model").collect() == [("m1", 2), ("m2", 2)]
    t = spark.createDataFrame([("s1", 1, 5.7, 6.0, 7.0, 8.0), ("s1", 0, 1.2, 2.0, 3.9, 4.0), ("_all", 0, 0.0, 0.0, 0.0, 0.0)], "seq string, frame int, x double, y double, w double, h double")
    sk.write_submission(t, f"{root}/sub")
    assert [r["value"] for r in spark.read.text(f"{root}/sub/seq=s1").collect()] == ["1,2,3,4", "5,6,7,8"]


def test_samples_are_stable_and_inside(spark):
    d = spark.range(300).select((F.col("id") % 3).alias("s"), F.floor(F.col("id") / 3).alias("frame"), (F.col("id") % 4 != 0).alias("vis"))
    a = mo.sequential_sample(d, ["s"], 10, "vis", 7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, mo.sequential_sample(d, ["s"], 10, "vis", 7).collect()))
    assert len(a) == 30 and all(r["frame"] % 1 == 0 and r["template_frame"] <= r["frame"] for r in a)
    short = mo.sequential_sample(d.where("frame < 6"), ["s"], 10, "vis", 7).collect()
    assert len(short) == 30 and max(r["frame"] for r in short) == 5
    sizes = mo.shard(d.select("frame").distinct(), "frame", 3, 4).groupBy("node", "worker").count().collect()
    assert len(sizes) == 12 and {r["count"] for r in sizes} <= {8, 9}
    b = mo.interval_sample(d, ["s"], 4, 5, "vis", 7).collect()
    for s in range(3):
        f = [r["frame"] for r in sorted((r for r in b if r["s"] == s), key=lambda r: r["position"])]
        assert len(f) == 4 and all(0 <= y - x <= 5 for x, y in zip(f, f[1:]))
    sp = mo.autosplit(d.select("frame").distinct(), "frame", (0.5, 0.3, 0.2)).groupBy("split").count().collect()
    assert {r["split"] for r in sp} == {"train", "val", "test"}


def test_scene_metrics_of_an_exact_copy(spark):
    truth = spark.createDataFrame([(0, 0, f, 3.0 + f, 4.0 + 0.1 * f * f) for f in range(12)], "scene_id long, clip long, frame long, x double, y double")
    local = tr.to_ego_frame(truth, ["scene_id", "clip"]).drop("theta")
    pred = local.select(F.lit("m").alias("model"), "scene_id", "clip", "frame", (-F.col("y")).alias("x"), F.col("x").alias("y"))
    r = tr.scene_metrics(pred, truth, ["model", "scene_id", "clip"], ["scene_id", "clip"]).first()
    assert r["ade_m"] == pytest.approx(0, abs=1e-9) and r["endpoint_error_m"] == pytest.approx(0, abs=1e-9)
    assert r["combined_abs_rel_error"] == pytest.approx(0, abs=1e-9)


def test_rank_ties_start_anew(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 1.0 + 5e-13), ("c", 1.0 + 1.2e-12), ("d", 2.0)], "model string, v double")
    got = {r["model"]: r["rank"] for r in tr.rank_models(d, "v").collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 4}

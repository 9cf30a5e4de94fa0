"""What pairing boxes may hold in one task."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from wayscore.operators import detection as dt
from wayscore.operators.boxjoin import overlap_pairs

BOX = "x1 double, y1 double, x2 double, y2 double"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _boxes(rng, images, per_image, side=60):
    """(image_id, id, x1, y1, x2, y2) on a coarse grid, so that copies and equal overlaps occur."""
    out = []
    for image in images:
        for i in range(rng.randint(1, per_image)):
            x, y = 10.0 * rng.randint(0, side // 10), 10.0 * rng.randint(0, side // 10)
            out.append((image, i, x, y, x + 10.0 * rng.randint(1, 4), y + 10.0 * rng.randint(1, 4)))
    return out


def _iou(a, b, eps):
    inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return inter / (area(a) + area(b) - inter + eps)


def test_best_overlaps_by_lists_and_by_cells(spark):
    rng = random.Random(5)
    q, c = _boxes(rng, range(0, 9), 12, 200), _boxes(rng, range(2, 11), 12, 200)
    want = {}
    for r in q:
        cands = [(_iou(r[2:], t[2:], 1e-8), -t[1]) for t in c if t[0] == r[0]]
        if cands:
            top = max(cands)
            same = [t[1] for t in q if t[0] == r[0] and t[2:] == r[2:]]
            want[r[0], min(same)] = (len(same), -top[1], pytest.approx(top[0]))
    a = spark.createDataFrame(q, f"image_id long, query_id long, {BOX}")
    b = spark.createDataFrame(c, f"image_id long, cand_id long, {BOX}")
    for limit in (0, 12, 2048):
        found = dt.best_overlap(a, b, ["image_id"], limit=limit)
        assert {(r["image_id"], r["query_id"]): (r["copies"], r["cand_id"], r["best_iou"]) for r in found.collect()} == want


def test_best_overlaps_of_ordinary_images_form_no_row_for_each_pair(spark):
    rng = random.Random(6)
    a = spark.createDataFrame(_boxes(rng, range(20), 12), f"image_id long, query_id long, {BOX}")
    b = spark.createDataFrame(_boxes(rng, range(20), 12), f"image_id long, cand_id long, {BOX}")
    found = dt.best_overlap(a, b, ["image_id"])
    assert found.collect()
    done = _plan(found).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in done and "Generate" not in done and "SortAggregate" not in done


def _matrix(dets, labels, none):
    """Confusion counts by brute force over (image, id, box, cls) rows."""
    claims = {}
    for d in dets:
        over = [(_iou(d[2:6], t[2:6], 1e-7), -t[1], t[6]) for t in labels if t[0] == d[0]]
        over = [o for o in over if o[0] > 0.45]
        if over:
            iou, neg, cls = max(over)
            claims.setdefault((d[0], -neg, cls), []).append((iou, -d[1], d[6]))
    won = {(image, label, cls): max(c) for (image, label, cls), c in claims.items()}
    out = Counter((c[2], k[2]) for k, c in won.items())
    taken, used = {(k[0], -c[1]) for k, c in won.items()}, {k[:2] for k in won}
    labelled, matched = {t[0] for t in labels}, {k[0] for k in won}
    out.update((d[6], none) for d in dets if (d[0], d[1]) not in taken and (d[0] not in labelled or d[0] in matched))
    out.update((none, t[6]) for t in labels if t[:2] not in used)
    return out


def _classed(rng, images, per_image, side):
    return [(*r, rng.randint(0, 2)) for r in _boxes(rng, images, per_image, side)]


def test_confusion_of_ordinary_and_crowded_images(spark):
    rng = random.Random(7)
    dets, labels = _classed(rng, range(0, 30), 10, 80), _classed(rng, range(4, 34), 5, 80)
    a = spark.createDataFrame([(*r, 0.9) for r in dets] + [(5, 99, 0.0, 0.0, 10.0, 10.0, 1, 0.1)], f"image_id long, det_id long, {BOX}, cls int, conf double")
    b = spark.createDataFrame(labels, f"image_id long, label_id long, {BOX}, cls long")
    want = _matrix(dets, labels, 3)
    assert {d[0] for d in dets if d[0] >= 4} - {k[0] for k in dt.confusion_pairs(a, b).select("image_id").collect()}  # labels, but no match
    for limit in (0, 8, 2048):
        found = dt.confusion_matrix(a, b, 3, limit=limit)
        assert {(r["predicted"], r["actual"]): r["n"] for r in found.collect()} == want
    assert {r["cls"]: (r["tp"], r["fp"]) for r in dt.true_false_positives(dt.confusion_matrix(a, b, 3), 3).collect()} == {
        c: (want[c, c], sum(n for (p, t), n in want.items() if p == c != t)) for c in range(3)}


def test_ordinary_images_are_matched_without_cells(spark):
    rng = random.Random(8)
    a = spark.createDataFrame([(*r, 0.9) for r in _classed(rng, range(20), 10, 80)], f"image_id long, det_id long, {BOX}, cls int, conf double")
    b = spark.createDataFrame(_classed(rng, range(20), 5, 80), f"image_id long, label_id long, {BOX}, cls int")
    found = dt.confusion_pairs(a, b)
    assert found.collect()
    assert "Generate" not in _plan(found).split("== Initial Plan ==")[0]


def test_positives_read_the_matrix_once(spark):
    matrix = spark.createDataFrame([(0, 0, 5), (0, 1, 2), (1, 3, 4), (3, 2, 6)], "predicted int, actual int, n long").repartition(2)
    assert _plan(dt.true_false_positives(matrix, 3)).count("Scan ExistingRDD") == 1
    assert {tuple(r) for r in dt.true_false_positives(matrix).collect()} == {(0, 5, 2), (1, 0, 4), (2, 0, 0), (3, 0, 6)}


def test_no_side_of_an_overlap_join_is_sent_whole_to_every_task(spark):
    box = lambda p: [f"{c} AS {p}{n}" for n, c in zip(("x1", "y1", "x2", "y2"), ("0.0D", "0.0D", "10.0D + id", "10.0D"))]
    left = spark.range(6).selectExpr("id % 2 AS image_id", *box("a_"))
    right = spark.range(4).selectExpr("id % 2 AS image_id", *box("b_"))
    pairs = overlap_pairs(left, right, ["image_id"])
    assert "Broadcast" not in _plan(pairs) and pairs.count() == 12
    images = spark.range(5).selectExpr("id AS image_id", "100 AS width", "60 AS height")
    labels = spark.range(5).selectExpr("id AS image_id", "id AS label_id", "1.0D AS x1", "1.0D AS y1", "20.0D AS x2", "20.0D AS y2")
    assert "Broadcast" not in _plan(dt.window_labels(dt.tile_windows(images, 50, 10), labels))

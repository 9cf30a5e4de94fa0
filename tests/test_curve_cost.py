"""Curves keep one small row for each detection, whatever columns the detections have."""

from __future__ import annotations

import re

from wayscore.operators import detection as dt


def test_curves_keep_bits_and_no_boxes(spark):
    box = ["0.0D AS x1", "0.0D AS y1", "10.0D + id % 3 AS x2", "10.0D AS y2"]
    dets = spark.range(40).selectExpr("id div 4 AS image_id", "id AS det_id", "id % 2 AS cls", "(id % 10) / 10 AS conf", *box)
    labels = spark.range(20).selectExpr("id div 2 AS image_id", "id AS label_id", "id % 2 AS cls", *box)
    matched = dt.match_detections(dets, labels)
    ap = dt.average_precision(matched, labels)
    kept = re.findall(r"InMemoryRelation \[(.*?)\]", ap._jdf.queryExecution().withCachedData().toString())
    assert kept and all(not re.search(r"\b(x1|t0|c0)#", k) for k in kept)
    assert ap.count() == 20 and sorted(dt.hit_bits(matched).columns) == ["bits", "cls", "conf", "det_id", "image_id"]
    flags = {r["det_id"]: sum(r[f"t{i}"] << i for i in range(10)) for r in matched.collect()}
    assert {r["det_id"]: r["bits"] for r in dt.hit_bits(matched).collect()} == flags and max(flags.values()) > 0

"""The tracker's work for a frame of a few boxes, and its one-track filter against the batched one."""

from __future__ import annotations

import cProfile
import pstats

import numpy as np

from wayscore.functions import kalman as kf
from wayscore.operators import association as ac


def test_one_track_filter_is_the_batched_one():
    rng = np.random.default_rng(3)
    z = rng.uniform([0, 0, 0.3, 20], [200, 200, 2, 90], (12, 4))
    m, c = kf.start(z[:1])
    one = kf.start_one(tuple(z[0]))
    for i in range(1, 12):
        m, c = kf.predict(m, c)
        one = kf.predict_one(*one)
        if i % 3:
            m, c = kf.update(m, c, z[[i]])
            one = kf.update_one(*one, tuple(z[i]))
        np.testing.assert_allclose(one[0], m[0], rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(kf.whole_cov(one[1]), c[0], rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(kf.cov_parts(c[0]), one[1], rtol=1e-9, atol=1e-12)


def test_overlaps_of_few_and_many_boxes_agree():
    rng = np.random.default_rng(4)
    a, b = (np.hstack([xy, xy + rng.integers(0, 9, (n, 2))]) for n in (5, 40) for xy in [rng.integers(0, 20, (n, 2)).astype(float)])
    few = [kf.iou_rows([p], b.tolist())[0] for p in a.tolist()]
    assert few == kf.iou_rows(a.tolist(), b.tolist()) == kf.box_iou(a, b).tolist()


def test_a_frame_of_few_boxes_is_little_work():
    state, run = ac.new_tracker(), cProfile.Profile()
    for f in range(50):
        xy = np.array([[60.0 * i + f, 0.5 * f] for i in range(4)])
        boxes = np.hstack([xy, xy + [40, 50]])
        run.runcall(ac.track_frame, state, boxes, np.array([0.9, 0.8, 0.7, 0.3]), [0, 1, 2, 3])
    assert len(state["tracks"]) == 3
    assert pstats.Stats(run).total_calls / 50 < 250

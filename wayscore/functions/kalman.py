"""Constant-velocity Kalman steps for batches of boxes, and the assignment of boxes to tracks.

States hold centre x, centre y, shape, height and their velocities; ``aspect``
chooses whether the third entry is the aspect ratio or the width. All functions
take arrays with a leading batch axis.
"""

from __future__ import annotations

import numpy as np

# Noise weights relative to the box size (fixed values).
POSITION_WEIGHT, VELOCITY_WEIGHT = 1.0 / 20, 1.0 / 160
# 95 % quantiles of the chi-square distribution for 1 to 4 degrees of freedom (fixed values).
GATE_95 = {1: 3.8415, 2: 5.9915, 3: 7.8147, 4: 9.4877}


def _scales(size: np.ndarray, shape: np.ndarray, weight: float, fixed: float, aspect: bool) -> np.ndarray:
    side = weight * size
    return np.stack([side if aspect else weight * shape, side, np.full_like(side, fixed) if aspect else weight * shape, side], axis=-1)


def start(z: np.ndarray, aspect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """State and covariance of new tracks from measurements (n, 4)."""
    pos = 2 * _scales(z[:, 3], z[:, 2], POSITION_WEIGHT, 0.5e-2, aspect)
    vel = 10 * _scales(z[:, 3], z[:, 2], VELOCITY_WEIGHT, 1e-6, aspect)
    var = np.concatenate([pos, vel], axis=1) ** 2
    return np.concatenate([z, np.zeros_like(z)], axis=1), var[:, :, None] * np.eye(8)


MOTION = np.eye(8) + np.eye(8, k=4)


def predict(mean: np.ndarray, cov: np.ndarray, aspect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One frame ahead."""
    noise = np.concatenate([_scales(mean[:, 3], mean[:, 2], POSITION_WEIGHT, 1e-2, aspect), _scales(mean[:, 3], mean[:, 2], VELOCITY_WEIGHT, 1e-5, aspect)], axis=1) ** 2
    return mean @ MOTION.T, MOTION @ cov @ MOTION.T + noise[:, :, None] * np.eye(8)


def project(mean: np.ndarray, cov: np.ndarray, aspect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Expected measurement and its covariance."""
    noise = _scales(mean[:, 3], mean[:, 2], POSITION_WEIGHT, 1e-1, aspect) ** 2
    return mean[:, :4], cov[:, :4, :4] + noise[:, :, None] * np.eye(4)


def update(mean: np.ndarray, cov: np.ndarray, z: np.ndarray, aspect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Correction by matched measurements."""
    zm, s = project(mean, cov, aspect)
    gain = np.swapaxes(np.linalg.solve(s, np.swapaxes(cov[:, :, :4], 1, 2)), 1, 2)
    new_mean = mean + np.einsum("nij,nj->ni", gain, z - zm)
    return new_mean, cov - gain @ s @ np.swapaxes(gain, 1, 2)


def gate_distance(mean: np.ndarray, cov: np.ndarray, z: np.ndarray, aspect: bool = True) -> np.ndarray:
    """Squared Mahalanobis distance of each state to its measurement."""
    zm, s = project(mean, cov, aspect)
    d = z - zm
    return np.einsum("ni,ni->n", d, np.linalg.solve(s, d[:, :, None])[:, :, 0])


# One track at a time. Its covariance falls into four 2 x 2 blocks, one for each entry and its velocity, so plain numbers do:
# ``var`` holds position variances, covariances and velocity variances, four each. For states with the aspect ratio.

def start_one(z: tuple) -> tuple[list, list]:
    pos, vel = 2 * (POSITION_WEIGHT * z[3]), 10 * (VELOCITY_WEIGHT * z[3])
    p, s = pos * pos, vel * vel
    return [*z, 0.0, 0.0, 0.0, 0.0], [p, p, 1e-4, p, 0.0, 0.0, 0.0, 0.0, s, s, 1e-10, s]


def predict_one(mean: list, var: list) -> tuple[list, list]:
    pos, vel = POSITION_WEIGHT * mean[3], VELOCITY_WEIGHT * mean[3]
    p, s = pos * pos, vel * vel
    moved, near = [], [var[4 + i] + var[8 + i] for i in range(4)]
    for i, noise in enumerate((p, p, 1e-4, p)):
        moved.append(var[i] + var[4 + i] + near[i] + noise)
    return [mean[i] + mean[4 + i] for i in range(4)] + mean[4:], [*moved, *near, var[8] + s, var[9] + s, var[10] + 1e-10, var[11] + s]


def update_one(mean: list, var: list, z: tuple) -> tuple[list, list]:
    pos = POSITION_WEIGHT * mean[3]
    p = pos * pos
    mean, var = list(mean), list(var)
    for i, noise in enumerate((p, p, 1e-2, p)):
        e = var[i] + noise
        gain, pull, off = var[i] / e, var[4 + i] / e, z[i] - mean[i]
        mean[i] += gain * off
        mean[4 + i] += pull * off
        var[8 + i] -= pull * e * pull
        var[4 + i] -= gain * e * pull
        var[i] -= gain * e * gain
    return mean, var


def whole_cov(var: list) -> np.ndarray:
    """The 8 x 8 covariance of one track."""
    p, c, s = (np.diag(var[i : i + 4]) for i in (0, 4, 8))
    return np.block([[p, c], [c, s]])


def cov_parts(cov: np.ndarray) -> list:
    return [*np.diag(cov)[:4].tolist(), *np.diag(cov, 4).tolist(), *np.diag(cov)[4:].tolist()]


#: Up to this many pairs of boxes, plain numbers are faster than arrays.
FEW_PAIRS = 64


def iou_rows(a: list, b: list, eps: float = 1e-7) -> list[list]:
    """``box_iou`` of two lists of corner boxes, as lists."""
    if len(a) * len(b) > FEW_PAIRS:
        return box_iou(np.array(a, float), np.array(b, float), eps).tolist()
    out = []
    for p in a:
        size, row = (p[2] - p[0]) * (p[3] - p[1]), []
        for q in b:
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            inter = w * h if w > 0 and h > 0 else 0.0
            row.append(inter / (size + (q[2] - q[0]) * (q[3] - q[1]) - inter + eps))
        out.append(row)
    return out


def box_iou(a: np.ndarray, b: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    """IoU matrix of corner boxes (n, 4) and (m, 4)."""
    wh = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None)
    inter = wh.prod(-1)
    area = lambda x: (x[:, 2:] - x[:, :2]).prod(-1)
    return inter / (area(a)[:, None] + area(b)[None, :] - inter + eps)


def unit_rows(a: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    return a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)


def appearance_cost(iou: np.ndarray, scores: np.ndarray, tracks: np.ndarray, dets: np.ndarray, proximity: float = 0.5, appearance: float = 0.25) -> np.ndarray:
    """The lower of the overlap cost fused with the scores and half the cosine distance of unit embeddings.

    The embedding counts only where the boxes' distance is at most ``proximity`` and its own half distance at most ``appearance``.
    """
    look = np.maximum(0.0, 1 - tracks @ dets.T) / 2
    return np.minimum(1 - iou * scores, np.where((look > appearance) | (1 - iou > proximity), 1.0, look))


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Minimum-cost pairs where leaving a row or column alone costs half the limit.

    Solved by shortest augmenting paths on the square matrix extended by the
    unmatched choices.
    """
    open_ = cost <= limit
    rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(rows):
        return []
    if open_.sum(1).max() == 1 and open_.sum(0).max() == 1:
        return [(int(i), int(j)) for i, j in np.argwhere(open_)]
    if len(rows) < cost.shape[0] or len(cols) < cost.shape[1]:
        return [(int(rows[i]), int(cols[j])) for i, j in assign(cost[np.ix_(rows, cols)], limit)]
    n, m = cost.shape
    size = n + m
    c = np.zeros((size, size))
    c[:n, :m] = cost
    c[:n, m:] = limit / 2
    c[n:, :m] = limit / 2
    u, w = np.zeros(size), np.zeros(size + 1)
    owner = np.full(size + 1, -1)
    for row in range(size):
        owner[size] = row
        col, dist_, prev, seen = size, np.full(size, np.inf), np.full(size, -1), np.zeros(size + 1, bool)
        while owner[col] != -1:
            seen[col] = True
            i = owner[col]
            slack = c[i] - u[i] - w[:size]
            free = ~seen[:size]
            better = free & (slack < dist_)
            dist_[better], prev[better] = slack[better], col
            nxt = int(np.where(free, dist_, np.inf).argmin())
            step = dist_[nxt]
            used = np.flatnonzero(seen)
            u[owner[used]] += step
            w[used] -= step
            dist_[free] -= step
            col = nxt
        while col != size:
            owner[col] = owner[prev[col]]
            col = prev[col]
    return [(int(owner[j]), j) for j in range(m) if owner[j] < n and cost[owner[j], j] <= limit]

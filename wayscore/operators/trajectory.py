"""Trajectory geometry, smoothing and per-clip measures.

Frames are long rows ``(keys..., frame, x, y)``. ``keys`` identify one clip, and a
clip has a fixed maximum length, so windows and folds over it are bounded. All
windows use the same partitioning: one shuffle serves a chain of calls.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayscore.functions.numeric import EPS, dist, finite, wrap_angle
from wayscore.operators.ordered import by_key, shared


def _ordered(keys):
    return W.partitionBy(*keys).orderBy("frame")


def _whole(keys):
    return W.partitionBy(*keys)


def to_ego_frame(df: DataFrame, keys: Sequence[str], k_ahead: int = 1, min_step: float = 1.0) -> DataFrame:
    """Move each clip to its first point and turn its first clear heading onto +x."""
    wo, wa = _ordered(keys), _whole(keys)
    df = df.withColumns({"_ox": F.first("x").over(wo), "_oy": F.first("y").over(wo),
                         "_i": F.row_number().over(wo) - 1})
    df = df.withColumns({"_rx": F.col("x") - F.col("_ox"), "_ry": F.col("y") - F.col("_oy")})
    v = F.struct(F.col("_rx").alias("vx"), F.col("_ry").alias("vy"))
    far = dist("_rx", "_ry") >= min_step
    df = df.withColumns({
        "_at_k": F.max(F.when(F.col("_i") == k_ahead, v)).over(wa),
        "_first_far": F.min_by(v, F.when(far & (F.col("_i") >= 1), F.col("frame"))).over(wa),
        "_last": F.max_by(v, F.col("frame")).over(wa),
    })
    at_k = F.coalesce(F.col("_at_k"), F.col("_last"))
    head = F.when(dist(at_k["vx"], at_k["vy"]) >= min_step, at_k).otherwise(
        F.coalesce(F.col("_first_far"), F.col("_last")))
    df = df.withColumn("theta", F.atan2(head["vy"], head["vx"]))
    c, s = F.cos("theta"), F.sin("theta")
    return df.withColumns({
        "x": F.col("_rx") * c + F.col("_ry") * s,
        "y": F.col("_ry") * c - F.col("_rx") * s,
    }).drop("_ox", "_oy", "_i", "_rx", "_ry", "_at_k", "_first_far", "_last")


def forward_lateral(df: DataFrame) -> DataFrame:
    """Camera axes (x right, y forward) to (forward, left)."""
    return df.withColumns({"x": F.col("y"), "y": -F.col("x")})


def apply_similarity(df: DataFrame, scale: Column, cos_t: Column, sin_t: Column) -> DataFrame:
    """Rotate and scale every point."""
    return df.withColumns({
        "x": scale * (cos_t * F.col("x") - sin_t * F.col("y")),
        "y": scale * (sin_t * F.col("x") + cos_t * F.col("y")),
    })


def _centred(c: str, w):
    nxt, prv = F.lead(c).over(w), F.lag(c).over(w)
    return F.coalesce(nxt - prv, nxt - F.col(c), F.col(c) - prv), F.when(
        nxt.isNotNull() & prv.isNotNull(), 2.0).otherwise(1.0)


def headings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Heading from the centred difference, one-sided at the ends."""
    w = _ordered(keys)
    dx, _ = _centred("x", w)
    dy, _ = _centred("y", w)
    return df.withColumn("heading", F.atan2(F.coalesce(dy, F.lit(0.0)), F.coalesce(dx, F.lit(0.0))))


def velocities(df: DataFrame, keys: Sequence[str], dt: float = 0.1) -> DataFrame:
    """Velocity from the centred difference, one-sided at the ends, and speed."""
    w = _ordered(keys)
    dx, n = _centred("x", w)
    dy, _ = _centred("y", w)
    df = df.withColumns({"vx": F.coalesce(dx / (n * dt), F.lit(0.0)), "vy": F.coalesce(dy / (n * dt), F.lit(0.0))})
    return df.withColumn("speed", dist("vx", "vy"))


def step_yaw(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Direction of the next step; the last frame repeats the one before."""
    w = _ordered(keys)
    yaw = F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x"))
    df = df.withColumn("_yaw", yaw)
    return df.withColumn("yaw", F.coalesce("_yaw", F.lag("_yaw").over(w), F.lit(0.0))).drop("_yaw")


def resample(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Linear resampling of each clip to ``target`` frames; non-finite values are skipped per axis.

    Every frame emits the grid positions between itself and the next one and carries
    the nearest finite values on both sides, so no as-of join is needed. ``target``
    names a column with the wanted length.
    """
    wo, wa = _ordered(keys), _whole(keys)
    back, ahead = wo.rowsBetween(W.unboundedPreceding, 0), wo.rowsBetween(1, W.unboundedFollowing)
    out = df.withColumns({
        "_i": (F.row_number().over(wo) - 1).cast("long"), "_t": F.count(F.lit(1)).over(wa), "x": finite("x"), "y": finite("y")})
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v"))) for c in ("x", "y")}
    out = out.withColumns({f"_p{c}": F.last(k, ignorenulls=True).over(back) for c, k in known.items()}
                          | {f"_n{c}": F.first(k, ignorenulls=True).over(ahead) for c, k in known.items()})
    n, span = F.col(target).cast("long"), F.greatest(F.col("_t") - 1, F.lit(1))
    up = lambda i: F.floor((i * (n - 1) + span - 1) / span).cast("long")
    lo = up(F.col("_i"))
    hi = F.when(F.col("_i") == F.col("_t") - 1, n - 1).otherwise(up(F.col("_i") + 1) - 1)
    out = out.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= F.col("_hi"))
    out = out.withColumn("_g", F.explode(F.sequence("_lo", "_hi")))
    at = F.col("_g") * (F.col("_t") - 1) / F.greatest(n - 1, F.lit(1))

    def lerp(c):
        p, q = F.col(f"_p{c}"), F.col(f"_n{c}")
        w = (at - p["i"]) / (q["i"] - p["i"])
        return F.coalesce(p["v"] + (q["v"] - p["v"]) * w, p["v"], q["v"], F.lit(0.0))

    return out.select(*keys, F.col("_g").alias("frame"), lerp("x").alias("x"), lerp("y").alias("y"))


def fit_alignment(pair: DataFrame, keys: Sequence[str], with_scale: bool = False, centred: bool = False) -> DataFrame:
    """Best rotation (and scale) of prediction onto truth per clip, from grouped sums.

    In the plane the proper rotation has a closed form: the angle of the summed
    cross and inner products. ``pair`` holds px, py, gx, gy by frame.
    """
    if centred:
        wa = _whole(keys)
        p0x, p0y, q0x, q0y = (F.avg(c).over(wa) for c in ("px", "py", "gx", "gy"))
    else:
        wo = _ordered(keys)
        p0x, p0y = F.first("px").over(wo), F.first("py").over(wo)
        q0x = q0y = F.lit(0.0)
    d = pair.withColumns({"_p0x": p0x, "_p0y": p0y, "_q0x": q0x, "_q0y": q0y})
    ax, ay = F.col("px") - F.col("_p0x"), F.col("py") - F.col("_p0y")
    bx, by = F.col("gx") - F.col("_q0x"), F.col("gy") - F.col("_q0y")
    agg = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(ax * by - ay * bx).alias("_cross"), F.sum(ax * bx + ay * by).alias("_dot"),
        F.sum(ax * ax + ay * ay).alias("_pp"),
        F.min("_p0x").alias("p0x"), F.min("_p0y").alias("p0y"),
        F.min("_q0x").alias("q0x"), F.min("_q0y").alias("q0y"),
    )
    turn = F.when(F.col("_n") >= 2, F.atan2("_cross", "_dot")).otherwise(0.0)
    agg = agg.withColumns({"cos_t": F.cos(turn), "sin_t": F.sin(turn), "theta": turn})
    fitted = (F.col("_dot") * F.col("cos_t") + F.col("_cross") * F.col("sin_t")) / F.nullif(F.col("_pp"), F.lit(0.0))
    scale = F.when((F.col("_n") >= 2) & (F.col("_pp") / F.col("_n") > EPS), fitted).otherwise(1.0) if with_scale else F.lit(1.0)
    return agg.select(*keys, "theta", "cos_t", "sin_t", scale.alias("scale"), "p0x", "p0y", "q0x", "q0y")


def align(pred: DataFrame, pair: DataFrame, keys: Sequence[str], mode: str = "rotate", centred: bool = False) -> DataFrame:
    """Prediction moved onto truth: ``none``, ``rotate`` or ``rotate-scale``."""
    fit = fit_alignment(pair, keys, mode == "rotate-scale", centred)
    if mode == "none":
        fit = fit.withColumns({"cos_t": F.lit(1.0), "sin_t": F.lit(0.0), "theta": F.lit(0.0)})
    d = pred.join(fit, list(keys))
    ax, ay = F.col("x") - F.col("p0x"), F.col("y") - F.col("p0y")
    return d.withColumns({
        "x": F.col("scale") * (F.col("cos_t") * ax - F.col("sin_t") * ay) + F.col("q0x"),
        "y": F.col("scale") * (F.col("sin_t") * ax + F.col("cos_t") * ay) + F.col("q0y"),
    }).drop("p0x", "p0y", "q0x", "q0y", "cos_t", "sin_t")


def polyfit_weights(k: int, poly: int) -> np.ndarray:
    """Row r gives the weights of a local polynomial fit evaluated at point r of a k-point window."""
    a = np.vander(np.arange(k, dtype=float), poly + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def smooth_polynomial(df: DataFrame, keys: Sequence[str], dt: float = 0.1, win_sec: float = 0.4, poly: int = 3) -> DataFrame:
    """Local polynomial smoothing with fitted edges; very short clips use a shorter window."""
    full = round(win_sec / dt)
    full += 1 - full % 2
    wo = _ordered(keys)
    d = df.withColumns({"_i": F.row_number().over(wo) - 1, "_t": F.count(F.lit(1)).over(_whole(keys))})
    sizes = [k for k in range(3, full + 1, 2)]
    reach = full - 1
    shifted = {}
    for c in ("x", "y"):
        for o in range(-reach, reach + 1):
            shifted[f"_{c}{o + reach}"] = F.lag(c, -o).over(wo) if o < 0 else F.lead(c, o).over(wo) if o else F.col(c)
    d = d.withColumns(shifted)
    branches: dict[str, Column | None] = {"x": None, "y": None}
    for k in sizes:
        order = poly if poly < k - 1 else max(1, k - 2)
        hat = polyfit_weights(k, order)
        start = F.greatest(F.lit(0), F.least(F.col("_i") - k // 2, F.col("_t") - k))
        row = F.col("_i") - start
        top = F.col("_t") >= k if k == full else (F.col("_t") >= k) & (F.col("_t") < k + 2)
        for c in ("x", "y"):
            for r in range(k):
                val = None
                for j in range(k):
                    term = F.col(f"_{c}{j - r + reach}") * float(hat[r, j])
                    val = term if val is None else val + term
                cond = top & (row == r)
                branches[c] = F.when(cond, val) if branches[c] is None else branches[c].when(cond, val)
    d = d.withColumns({f"_s{c}": branches[c].otherwise(F.col(c)) for c in ("x", "y")})
    return d.withColumns({"x": F.col("_sx"), "y": F.col("_sy")}).drop("_i", "_t", "_sx", "_sy", *shifted)


def smooth_mean(df: DataFrame, keys: Sequence[str], window: int = 5) -> DataFrame:
    """Centred moving average with edge values repeated; the window shrinks to the clip."""
    wo, wa = _ordered(keys), _whole(keys)
    full = wo.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    size = F.least(F.lit(window), F.count(F.lit(1)).over(wa))
    d = df.withColumn("_r", F.floor((size - F.when(size % 2 == 0, 1).otherwise(0)) / 2))
    d = d.withColumn("_r", F.when((F.count(F.lit(1)).over(wa) < 3) | (F.col("_r") < 1), 0).otherwise(F.col("_r")))
    r = window // 2
    outs = {}
    for c in ("x", "y"):
        total = F.col(c)
        for o in range(1, r + 1):
            both = F.coalesce(F.lag(c, o).over(wo), F.first(c).over(full)) + F.coalesce(
                F.lead(c, o).over(wo), F.last(c).over(full))
            total = total + F.when(F.col("_r") >= o, both).otherwise(0.0)
        outs[f"_m{c}"] = total / (2 * F.col("_r") + 1)
    d = d.withColumns(outs)
    return d.withColumns({"x": F.col("_mx"), "y": F.col("_my")}).drop("_r", "_mx", "_my")


# ---- measures over matched frames -------------------------------------------------

def pair_frames(pred: DataFrame, truth: DataFrame, truth_keys: Sequence[str]) -> DataFrame:
    """Prediction and truth of the same clip and frame."""
    p = pred.withColumnsRenamed({"x": "px", "y": "py"})
    g = truth.withColumnsRenamed({"x": "gx", "y": "gy"})
    return p.join(g, [*truth_keys, "frame"])


def audit_pairs(pred: DataFrame, truth: DataFrame, keys: Sequence[str], truth_keys: Sequence[str]) -> DataFrame:
    """Frame counts on both sides and their overlap, to find clips of unequal shape."""
    np_ = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("pred_frames"))
    ng = truth.groupBy(*truth_keys).agg(F.count(F.lit(1)).alias("truth_frames"))
    nb = pair_frames(pred, truth, truth_keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"))
    out = np_.join(ng, list(truth_keys), "left").join(nb, list(keys), "left")
    out = out.fillna(0, ["truth_frames", "matched"])
    return out.withColumn("same_shape", (F.col("pred_frames") == F.col("truth_frames")) & (F.col("matched") == F.col("pred_frames")))


def displacement_errors(pair: DataFrame, keys: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Mean and final displacement error and the success flag per clip."""
    e = finite(dist(F.col("px") - F.col("gx"), F.col("py") - F.col("gy")))
    out = pair.groupBy(*keys).agg(F.avg(e).alias("ade"), F.max_by(e, F.col("frame")).alias("fde"))
    return out.withColumn("success", (F.col("fde") < threshold).cast("double"))


def folded(pair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per clip with the frame-ordered point arrays of both sides."""
    rows = by_key(pair, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "px", "py", "gx", "gy"))).alias("_f"))
    pick = lambda a, b: F.transform("_f", lambda r: F.struct(r[a].alias("x"), r[b].alias("y")))
    return rows.select(*keys, pick("px", "py").alias("p"), pick("gx", "gy").alias("g"))


def hausdorff(pair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric Hausdorff distance; the inner minimum is taken inside the clip's row."""
    def side(a, b):
        return F.array_max(F.transform(a, lambda u: F.array_min(
            F.transform(b, lambda v: dist(u["x"] - v["x"], u["y"] - v["y"])))))
    f = folded(pair, keys)
    return f.select(*keys, F.greatest(side("p", "g"), side("g", "p")).alias("hausdorff"))


def _length_class(n: np.ndarray) -> np.ndarray:
    """Lengths of one class differ by less than a quarter."""
    return np.ceil(np.log(np.maximum(n, 1)) / np.log(1.25)).astype(int)


def _waves(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Warping costs of clips side by side, one anti-diagonal of all their cell tables after the other.

    A cell needs only the two diagonals before its own, so three of them are all that is held; cells of the padding
    come after those of a clip and don't reach its last one.
    """
    clips, rows = ax.shape
    cols = bx.shape[1]
    back, last = np.full((clips, rows + 1), np.inf), np.full((clips, rows + 1), np.inf)
    back[:, 0] = 0.0  # before the first cell; column i + 1 is row i of the table
    result, ends = np.full(clips, np.nan), n + m - 2
    for d in range(int(ends.max()) + 1):
        lo, hi = max(0, d - cols + 1), min(rows - 1, d)
        j0, j1 = d - hi, d - lo
        step = np.hypot(ax[:, lo : hi + 1] - bx[:, j0 : j1 + 1][:, ::-1], ay[:, lo : hi + 1] - by[:, j0 : j1 + 1][:, ::-1])
        now = np.full((clips, rows + 1), np.inf)
        now[:, lo + 1 : hi + 2] = step + np.minimum(np.minimum(last[:, lo + 1 : hi + 2], last[:, lo : hi + 1]), back[:, lo : hi + 1])
        done = np.flatnonzero(ends == d)
        result[done] = now[done, n[done]]
        back, last = last, now
    return result


#: Points of one side that clips worked on side by side have at most (a longer clip is on its own).
WAVE_POINTS = 1 << 20


@F.pandas_udf(T.DoubleType())
def _warp_cost(px: pd.Series, py: pd.Series, gx: pd.Series, gy: pd.Series) -> pd.Series:
    """Warping cost for a batch of clips, those of about the same lengths together."""
    px, py, gx, gy = (s.to_numpy() for s in (px, py, gx, gy))
    n, m = (np.fromiter(map(len, s), int, len(s)) for s in (px, gx))
    result = np.full(len(n), np.nan)

    def padded(s, which):
        out = np.zeros((len(which), max(len(s[i]) for i in which)))
        for row, i in zip(out, which):
            row[: len(s[i])] = s[i]
        return out

    whole = np.flatnonzero((n > 0) & (m > 0))
    kind = np.stack([_length_class(n[whole]), _length_class(m[whole])], axis=1)
    for k in np.unique(kind, axis=0):
        members = whole[(kind == k).all(axis=1)]
        wide = max(1, WAVE_POINTS // int(max(n[members].max(), m[members].max())))
        for at in range(0, len(members), wide):
            which = members[at : at + wide]
            result[which] = _waves(*(padded(s, which) for s in (px, py, gx, gy)), n[which], m[which])
    return pd.Series(result)


def warping(pair: DataFrame, keys: Sequence[str], alpha: float = 4.0, threshold: float = 2.0) -> DataFrame:
    """Dynamic-time-warping cost, its normalised form and the success-weighted form."""
    f = folded(pair, keys)
    cost = _warp_cost("p.x", "p.y", "g.x", "g.y")
    last = F.element_at("p", -1), F.element_at("g", -1)
    fde = dist(last[0]["x"] - last[1]["x"], last[0]["y"] - last[1]["y"])
    out = f.select(*keys, F.size("p").alias("_t"), fde.alias("_fde"), cost.alias("dtw"))
    nd = F.exp(-F.col("dtw") / (alpha * F.col("_t")))
    return out.select(*keys, "dtw", nd.alias("ndtw"), (nd * (F.col("_fde") < threshold).cast("double")).alias("sdtw"))


def _mean_gap(a: str, b: str) -> Column:
    """Mean absolute difference of two equally long sorted samples: their 1-Wasserstein distance."""
    gaps = F.zip_with(F.array_sort(a), F.array_sort(b), lambda u, v: F.abs(u - v))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


def dynamic_similarity(pair: DataFrame, keys: Sequence[str], dt: float = 0.1) -> DataFrame:
    """exp(-W1 of speeds) * exp(-W1 of speed changes)."""
    w = _ordered(keys)
    step = lambda a, b: dist((F.col(a) - F.lag(a).over(w)) / dt, (F.col(b) - F.lag(b).over(w)) / dt)
    d = pair.withColumns({"vp": step("px", "py"), "vg": step("gx", "gy")})
    d = d.withColumns({"ap": F.col("vp") - F.lag("vp").over(w), "ag": F.col("vg") - F.lag("vg").over(w)})
    d = d.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in ("vp", "vg", "ap", "ag")])
    return d.where(F.size("ap") > 0).select(
        *keys, (F.exp(-_mean_gap("vp", "vg")) * F.exp(-_mean_gap("ap", "ag"))).alias("dynamic_similarity"))


# ---- measures of one trajectory ----------------------------------------------------

def smoothness(df: DataFrame, keys: Sequence[str], dt: float = 0.1, v_static: float = 0.1, eps: float = EPS) -> DataFrame:
    """Speed and acceleration consistency; a clip that never moves has none."""
    w = _ordered(keys)
    d = df.withColumn("_v", dist((F.col("x") - F.lag("x").over(w)) / dt, (F.col("y") - F.lag("y").over(w)) / dt))
    d = d.withColumn("_a", (F.col("_v") - F.lag("_v").over(w)) / dt)
    out = d.groupBy(*keys).agg(
        F.max("_v").alias("_mx"),
        F.exp(-F.stddev_pop("_v") / (F.avg("_v") + eps)).alias("_sv"),
        F.exp(-F.stddev_pop("_a") / (F.avg(F.abs("_a")) + eps)).alias("_sa"),
    )
    return out.select(*keys, F.when(F.col("_mx") >= v_static, 0.5 * (F.col("_sv") + F.col("_sa"))).alias("consistency"))


def comfort(df: DataFrame, keys: Sequence[str], dt: float = 0.1, v_static: float = 0.1, pct: float | None = None,
            length_eps: float = 1.0, j_scale: float = 1.0, a_scale: float = 1.0, y_scale: float = 1.0,
            eps: float = EPS) -> DataFrame:
    """Geometric mean of jerk, acceleration and yaw-rate scores per metre travelled."""
    w = _ordered(keys)
    d = df.withColumn("_len", dist(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    for c in ("x", "y"):
        nxt, prv = F.lead(c).over(w), F.lag(c).over(w)
        d = d.withColumns({f"_v{c}": (nxt - prv) / (2 * dt), f"_a{c}": (nxt - 2 * F.col(c) + prv) / (dt ** 2)})
    d = d.withColumn("_th", F.atan2("_vy", "_vx"))
    jx = (F.lead("_ax").over(w) - F.lag("_ax").over(w)) / (2 * dt)
    jy = (F.lead("_ay").over(w) - F.lag("_ay").over(w)) / (2 * dt)
    yaw = wrap_angle(F.lead("_th").over(w) - F.lag("_th").over(w)) / (2 * dt)
    d = d.withColumns({"_jk": dist(jx, jy), "_yw": F.abs(yaw)})
    d = d.withColumn("_ac", F.when(F.col("_jk").isNotNull(), dist("_ax", "_ay")))
    red = (lambda c: F.avg(c)) if pct is None else (lambda c: F.percentile(c, F.lit(pct / 100)))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(dist("_vx", "_vy")).alias("_mx"), F.sum("_len").alias("_length"),
        red("_jk").alias("_j"), red("_ac").alias("_a"), red("_yw").alias("_y"))
    valid = (F.col("_n") >= 5) & (F.col("_mx") >= v_static) & (F.col("_length") > length_eps)
    score = lambda c, s: F.when(valid, 1.0 / (1.0 + (F.col(c) / (F.col("_length") + eps)) / max(s, eps)))
    g = g.withColumns({"jerk_score": score("_j", j_scale), "accel_score": score("_a", a_scale), "yaw_score": score("_y", y_scale)})
    logs = (F.ln("jerk_score") + F.ln("accel_score") + F.ln("yaw_score")) / 3
    return g.select(*keys, F.exp(logs).alias("comfort"), "jerk_score", "accel_score", "yaw_score")


def curvature(df: DataFrame, keys: Sequence[str], dt: float = 0.1, v_static: float = 0.1, pct: float | None = None,
              eps: float = EPS) -> DataFrame:
    """1 / (1 + RMS curvature); with ``pct`` the spikes above that percentile are left out."""
    w = _ordered(keys)
    d = df.withColumns({f"_v{c}": (F.col(c) - F.lag(c).over(w)) / dt for c in ("x", "y")})
    d = d.withColumns({f"_a{c}": (F.col(f"_v{c}") - F.lag(f"_v{c}").over(w)) / dt for c in ("x", "y")})
    num = F.abs(F.col("_vx") * F.col("_ay") - F.col("_vy") * F.col("_ax"))
    den = F.pow(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy") + eps, F.lit(1.5))
    d = d.withColumn("_k", num / den)
    if pct is not None:
        d = d.withColumn("_thr", F.percentile("_k", F.lit(pct / 100)).over(_whole(keys)))
        d = d.withColumn("_k", F.when(F.col("_k") <= F.col("_thr") + eps, F.col("_k")))
    g = d.groupBy(*keys).agg(F.max(dist("_vx", "_vy")).alias("_mx"), F.sqrt(F.avg(F.col("_k") * F.col("_k"))).alias("_rms"))
    return g.select(*keys, F.when(F.col("_mx") >= v_static, 1.0 / (1.0 + F.col("_rms"))).alias("curvature_score"))


def speed_score(df: DataFrame, keys: Sequence[str], dt: float = 0.1, v_static: float = 0.1, v_ref: float = 6.0,
                k: float = 2.5, pct: float | None = None) -> DataFrame:
    """Log-scaled mean speed clipped to [0, 1]; a static clip scores 0."""
    w = _ordered(keys)
    d = df.withColumn("_v", dist((F.col("x") - F.lag("x").over(w)) / dt, (F.col("y") - F.lag("y").over(w)) / dt))
    stat = F.avg("_v") if pct is None else F.percentile("_v", F.lit(pct / 100))
    g = d.groupBy(*keys).agg(F.max("_v").alias("_mx"), stat.alias("_s"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p("_s") / math.log1p(k * v_ref)))
    return g.select(*keys, F.when(F.col("_mx") >= v_static, s).when(F.col("_mx").isNotNull(), 0.0).alias("speed_score"))


def quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the comfort, curvature and speed scores that exist for a clip."""
    df = shared(df)
    d = comfort(df, keys).join(curvature(df, keys), list(keys)).join(speed_score(df, keys), list(keys))
    parts = F.array_compact(F.array("comfort", "curvature_score", "speed_score"))
    q = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(parts), F.lit(0))
    return d.select(*keys, "comfort", "curvature_score", "speed_score", q.alias("quality"))


# ---- displacement ranking ------------------------------------------------------------

def relative_denominator(truth: Column, floor_m: float) -> Column:
    return F.greatest(F.abs(truth), F.lit(floor_m), F.lit(EPS))


def scene_metrics(pred: DataFrame, truth: DataFrame, keys: Sequence[str], truth_keys: Sequence[str],
                  mode: str = "rotate", floor_m: float = 5.0) -> DataFrame:
    """Localise, resample to the longer clip, align and measure, one row per model and clip."""
    g = to_ego_frame(truth, truth_keys).drop("theta")
    p = forward_lateral(pred)
    n_p = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("_np"))
    n_g = truth.groupBy(*truth_keys).agg(F.count(F.lit(1)).alias("_ng"))
    jobs = n_p.join(n_g, list(truth_keys)).withColumn("_target", F.greatest("_np", "_ng")).select(*keys, "_target")
    p = resample(p.join(jobs, list(keys)), keys, "_target")
    gj = g.join(jobs, list(truth_keys))
    g = resample(gj, keys, "_target")
    pair = p.withColumnsRenamed({"x": "px", "y": "py"}).join(
        g.withColumnsRenamed({"x": "gx", "y": "gy"}), [*keys, "frame"])
    pair = shared(pair)
    aligned = align(pair.withColumns({"x": F.col("px"), "y": F.col("py")}), pair, keys, mode)
    return displacement_summary(aligned, keys, floor_m)


def displacement_summary(d: DataFrame, keys: Sequence[str], floor_m: float = 5.0) -> DataFrame:
    """Path, displacement, endpoint and axis errors of aligned frames (x, y against gx, gy)."""
    w = _ordered(keys)
    d = d.withColumns({
        "_sp": dist(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)),
        "_sg": dist(F.col("gx") - F.lag("gx").over(w), F.col("gy") - F.lag("gy").over(w)),
    })
    pt = F.struct("x", "y", "gx", "gy")
    a = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gt_frames"), F.max("scale").alias("alignment_scale"),
        F.coalesce(F.sum(finite("_sg")), F.lit(0.0)).alias("gt_distance_m"),
        F.coalesce(F.sum(finite("_sp")), F.lit(0.0)).alias("pred_distance_m"),
        F.min_by(pt, "frame").alias("_a"), F.max_by(pt, "frame").alias("_b"),
        F.avg(dist(F.col("x") - F.col("gx"), F.col("y") - F.col("gy"))).alias("ade_m"),
    )
    a = a.withColumns({
        "gt_forward_m": F.col("_b.gx") - F.col("_a.gx"), "gt_lateral_left_m": F.col("_b.gy") - F.col("_a.gy"),
        "pred_forward_m": F.col("_b.x") - F.col("_a.x"), "pred_lateral_left_m": F.col("_b.y") - F.col("_a.y"),
    })
    a = a.withColumns({
        "gt_displacement_m": dist("gt_forward_m", "gt_lateral_left_m"),
        "pred_displacement_m": dist("pred_forward_m", "pred_lateral_left_m"),
        "forward_error_m": F.col("pred_forward_m") - F.col("gt_forward_m"),
        "lateral_left_error_m": F.col("pred_lateral_left_m") - F.col("gt_lateral_left_m"),
    })
    a = a.withColumn("endpoint_error_m", dist("forward_error_m", "lateral_left_error_m"))
    cols = {}
    for q in ("distance", "displacement"):
        diff = F.col(f"pred_{q}_m") - F.col(f"gt_{q}_m")
        rel = relative_denominator(F.col(f"gt_{q}_m"), floor_m)
        cols |= {f"{q}_signed_error_m": diff, f"{q}_abs_error_m": F.abs(diff),
                 f"{q}_signed_rel_error": diff / rel, f"{q}_abs_rel_error": F.abs(diff) / rel}
    cols["endpoint_rel_error"] = F.col("endpoint_error_m") / relative_denominator(F.col("gt_displacement_m"), floor_m)
    a = a.withColumns(cols)
    half = lambda u, v: 0.5 * (F.col(u) + F.col(v))
    return a.withColumns({
        "combined_abs_rel_error": half("distance_abs_rel_error", "displacement_abs_rel_error"),
        "combined_endpoint_distance_rel_error": half("distance_abs_rel_error", "endpoint_rel_error"),
        "combined_endpoint_distance_error_m": half("distance_abs_error_m", "endpoint_error_m"),
    }).drop("_a", "_b")


# Columns averaged per model, in report order (fixed values).
MODEL_MEANS = (
    "gt_distance_m", "pred_distance_m", "distance_abs_error_m", "distance_abs_rel_error",
    "distance_signed_rel_error", "gt_displacement_m", "pred_displacement_m", "displacement_abs_error_m",
    "displacement_abs_rel_error", "displacement_signed_rel_error", "endpoint_error_m", "endpoint_rel_error",
    "ade_m", "forward_error_m", "lateral_left_error_m", "combined_abs_rel_error",
    "combined_endpoint_distance_rel_error", "combined_endpoint_distance_error_m",
)


def model_means(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("model").agg(
        F.count(F.lit(1)).alias("num_scenes"), *[F.avg(c).alias(f"mean_{c}") for c in MODEL_MEANS])


def rank_models(models: DataFrame, by: str, tol: float = 1e-12) -> DataFrame:
    """Shared ranks for values within ``tol`` of the group's first value.

    Works on one row per model. The chain of ties starts anew where a value is
    farther than ``tol`` from the first value of the running group.
    """
    w = W.orderBy(by, "model")
    d = models.withColumns({"_i": F.row_number().over(w)})
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(by).alias("v"), F.col("model").alias("m"), F.col("_i").alias("i"))).over(
            W.partitionBy(F.lit(1)))),
        F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("r"), F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<int>")).alias("out")),
        lambda acc, e: F.when(
            acc["v"].isNull() | (F.abs(e["v"] - acc["v"]) > tol),
            F.struct(e["v"].alias("v"), e["i"].alias("r"), F.map_concat(acc["out"], F.create_map(e["m"], e["i"])).alias("out")),
        ).otherwise(F.struct(acc["v"].alias("v"), acc["r"].alias("r"),
                             F.map_concat(acc["out"], F.create_map(e["m"], acc["r"])).alias("out"))),
        lambda acc: acc["out"],
    )
    return d.withColumn("rank", F.element_at(fold, F.col("model"))).drop("_i")

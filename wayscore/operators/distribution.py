"""Feature statistics and distances between feature sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.functions.numeric import cosine
from wayscore.operators.ordered import number_rows


def moment_sums(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Count, sums and sums of products per key, as long rows (key, i, j, value).

    Each task adds up its own rows with numpy and emits one triangle per key; the
    rest is a small aggregate. Row i = -1 holds the count (j = -1) and the sums.
    """
    tri = np.triu_indices(dim)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for k, g in pdf.groupby(key, sort=False):
                x = np.asarray(g[vector].tolist(), dtype=float)
                n, s, xx = acc.get(k, (0, np.zeros(dim), np.zeros((dim, dim))))
                acc[k] = (n + len(x), s + x.sum(0), xx + x.T @ x)
        for k, (n, s, xx) in acc.items():
            yield pd.DataFrame({
                key: k, "i": np.r_[-1, np.full(dim, -1), tri[0]], "j": np.r_[-1, np.arange(dim), tri[1]],
                "value": np.r_[float(n), s, xx[tri]]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(partial, f"{key} {kind}, i int, j int, value double")
    return rows.groupBy(key, "i", "j").agg(F.sum("value").alias("value"))


def covariance(df: DataFrame, key: str, vector: str, dim: int, ddof: int = 1, ridge: float = 0.0) -> DataFrame:
    """Mean and covariance per key: rows (key, i, j, mean_i, mean_j, cov) with i <= j.

    The sums table has at most dim * dim rows per key, so sharing its sums row by row is cheap.
    """
    m = moment_sums(df, key, vector, dim)
    head = m.where("i = -1")
    n = head.where("j = -1").select(key, F.col("value").alias("_n"))
    s = head.where("j >= 0").select(key, F.col("j").alias("_d"), F.col("value").alias("_s")).join(n, key)
    si = s.select(key, F.col("_d").alias("i"), F.col("_s").alias("_si"), "_n")
    sj = s.select(key, F.col("_d").alias("j"), F.col("_s").alias("_sj"))
    out = m.where("i >= 0").join(si, [key, "i"]).join(sj, [key, "j"])
    cov = (F.col("value") - F.col("_si") * F.col("_sj") / F.col("_n")) / (F.col("_n") - ddof)
    return out.select(key, "i", "j", F.col("_n").cast("long").alias("n"), (F.col("_si") / F.col("_n")).alias("mean_i"), (F.col("_sj") / F.col("_n")).alias("mean_j"),
                      (cov + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)).alias("cov"))


def _frechet(pdf: pd.DataFrame) -> pd.DataFrame:
    dim = int(pdf["j"].max()) + 1
    stats = []
    for _, g in pdf.groupby("side"):
        c = np.zeros((dim, dim))
        i, j, v = g["i"].to_numpy(), g["j"].to_numpy(), g["cov"].to_numpy()
        c[i, j] = v
        c[j, i] = v
        mu = np.zeros(dim)
        mu[j] = g["mean_j"].to_numpy()
        stats.append((mu, c))
    if len(stats) < 2:
        return pd.DataFrame({"frechet": [None]}, dtype="float64")
    (ma, ca), (mb, cb) = stats
    lam, vec = np.linalg.eigh(ca)
    root = (vec * np.sqrt(np.clip(lam, 0, None))) @ vec.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cb @ root), 0, None)).sum()
    d = ma - mb
    return pd.DataFrame({"frechet": [max(float(d @ d + np.trace(ca) + np.trace(cb) - 2 * cross), 0.0)]})


def frechet_distance(df: DataFrame, key: str, a: str, b: str, vector: str, dim: int, ddof: int = 1, ridge: float = 1e-6) -> DataFrame:
    """Fréchet distance between the feature sets ``a`` and ``b``.

    The covariance is distributed; only its dim x dim entries meet in one task for
    the eigenvalues.
    """
    c = covariance(df.where(F.col(key).isin(a, b)), key, vector, dim, ddof, ridge)
    side = F.when(F.col(key) == a, 0).otherwise(1)
    both = c.select(F.lit(1).alias("pair"), side.alias("side"), "i", "j", "mean_j", "cov")
    return both.groupBy("pair").applyInPandas(_frechet, "frechet double")


def kernel_distance(df: DataFrame, subset: Sequence[str], side: str, real: str, gen: str, vector: str, order: str) -> DataFrame:
    """Cubic-kernel discrepancy per subset (times 1000).

    Each subset takes equally many rows of both sides, in ``order``. A subset is a
    group of limited size chosen by the caller; the mean over subsets is the score.
    """
    w = W.partitionBy(*subset, side)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(order)))
    sizes = W.partitionBy(*subset)
    n_of = lambda s: F.sum((F.col(side) == s).cast("int")).over(sizes)
    d = d.withColumn("_m", F.least(n_of(real), n_of(gen))).where("_r <= _m AND _m > 1")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.asarray(pdf.loc[pdf[side] == gen, vector].tolist(), dtype=float)
        y = np.asarray(pdf.loc[pdf[side] == real, vector].tolist(), dtype=float)
        m, n = len(x), x.shape[1]
        k = lambda u, v: (u @ v.T / n + 1) ** 3
        a, b = k(x, x) + k(y, y), k(x, y)
        out = pdf.loc[:, list(subset)].head(1).reset_index(drop=True)
        out["m"], out["kernel_distance"] = m, ((a.sum() - np.trace(a)) / (m - 1) - 2 * b.sum() / m) / m * 1000
        return out

    kinds = ", ".join(f"{s} {df.schema[s].dataType.simpleString()}" for s in subset)
    keep = d.select(*subset, side, F.col(vector).cast("array<double>").alias(vector))
    return keep.groupBy(*subset).applyInPandas(score, f"{kinds}, m int, kernel_distance double")


def inception_score(df: DataFrame, probs: str, order: str, bucket: Column, splits: int) -> DataFrame:
    """exp of the mean divergence of class probabilities from their split mean, per split.

    mean KL = mean(sum p ln p) - sum p̄ ln p̄, so one pass per split is enough.
    """
    d = number_rows(df.withColumn("_all", F.lit(0)), ["_all"], {"b": bucket}, [order], "_pos")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(F.broadcast(n))
    d = d.withColumn("split", F.floor((F.col("_pos") * splits + splits - 1) / F.col("_n")))
    lo = F.floor(F.col("split") * F.col("_n") / splits)
    d = d.withColumn("split", F.when(F.col("_pos") < lo, F.col("split") - 1).otherwise(F.col("split")))
    e = d.select("split", F.posexplode(probs).alias("c", "p"))
    per_class = e.groupBy("split", "c").agg(F.avg("p").alias("m"), F.avg(F.col("p") * F.ln("p")).alias("plp"))
    return per_class.groupBy("split").agg(F.exp(F.sum(F.col("plp") - F.col("m") * F.ln("m"))).alias("score"))


def repeat_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation of a metric over its repeats."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def top_accuracy(df: DataFrame, scores: str, target: str) -> DataFrame:
    """Top-1 and top-5 accuracy from a score array per row (lowest class wins ties)."""
    ranked = F.transform(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("n"), i.alias("c")))), lambda e: e["c"])
    hit = lambda k: F.array_contains(F.slice(ranked, 1, k), F.col(target)).cast("double")
    return df.agg(F.avg(hit(1)).alias("top1"), F.avg(hit(5)).alias("top5"))


def softmax(values: str | Column) -> Column:
    e = F.transform(values, lambda x: F.exp(x.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


# ---- consistency over embeddings of one clip ------------------------------------------------

def key_frames(df: DataFrame, keys: Sequence[str], motion: str, v_low: float = 1.0, v_high: float = 10.0, min_k: int = 3, max_k: int = 20,
               extra: Sequence[str] = ()) -> DataFrame:
    """Frames spread evenly over the summed motion of each clip; more motion gives more frames.

    ``motion`` belongs to the step that ends at a frame and is null at the first
    one. Frames that come out twice are kept twice. ``extra`` columns are folded to
    arrays in frame order. Sums that differ by less than the rounding of doubles count as
    equal: a target halfway between two frames takes the later one.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", F.coalesce(motion, F.lit(0.0)).alias("_m"), *extra))).alias("_r"))
    start = F.array(F.lit(0.0))
    summed = F.aggregate(F.slice(F.col("_r"), 2, F.greatest(F.size("_r") - 1, F.lit(0))), start,
                         lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + r["_m"]))
    d = rows.withColumns({"_s": summed, "_n": F.size("_r")})
    d = d.withColumn("_total", F.element_at("_s", -1))
    r = F.least(F.greatest((F.col("_total") / F.greatest(F.col("_n") - 1, F.lit(1)) - v_low) / (max(v_high, v_low + 1e-6) - v_low), F.lit(0.0)), F.lit(1.0))
    k = F.least(F.greatest(F.bround(min_k + r * (max_k - min_k)), F.lit(min_k)), F.lit(max_k))
    d = d.withColumn("_k", F.least(k, F.col("_n")).cast("int"))

    def nearest(j):
        t, noise = j * (F.col("_total") / (F.col("_k") - 1)), F.col("_total") * 1e-12
        p = F.greatest(F.size(F.filter("_s", lambda s: s < t - noise)), F.lit(1))
        at = lambda i: F.get("_s", i)
        return F.when((p < F.col("_n")) & (F.abs(at(p) - t) > F.abs(at(p - 1) - t) + noise), p - 1).otherwise(p)

    inner = F.when(F.col("_k") > 2, F.transform(F.sequence(F.lit(1), F.greatest(F.col("_k") - 2, F.lit(1))), nearest)).otherwise(
        F.array().cast("array<int>"))
    moving = F.concat(F.array(F.lit(0)), inner, F.array(F.col("_n") - 1))
    still = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.floor(i * (F.col("_n") - 1) / F.greatest(F.col("_k") - 1, F.lit(1))).cast("int"))
    idx = F.when(F.col("_n") <= 2, F.sequence(F.lit(0), F.col("_n") - 1)).when(F.col("_total") <= 1e-6, still).otherwise(moving)
    return d.select(*keys, F.col("_n").alias("frames"), idx.alias("idx"), *[F.col(f"_r.{c}").alias(c) for c in extra])


def pairs_with_middle(idx: str) -> Column:
    """(i, j, middle) for neighbouring key frames at least two apart."""
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.size(idx) - 1, F.lit(1))),
                       lambda p: F.struct(F.get(idx, p - 1).alias("i"), F.get(idx, p).alias("j")))
    wide = F.filter(all_, lambda t: t["j"] - t["i"] >= 2)
    return F.transform(wide, lambda t: F.struct(t["i"].alias("i"), t["j"].alias("j"), F.floor((t["i"] + t["j"]) / 2).alias("mid")))


def scene_consistency(frames: DataFrame, keys: Sequence[str], embedding: str) -> DataFrame:
    """Mean non-negative cosine of neighbouring key frames; fewer than two key frames score 0."""
    at = lambda i: F.get(embedding, i)
    sims = F.transform(F.sequence(F.lit(1), F.greatest(F.size("idx") - 1, F.lit(1))),
                       lambda p: F.greatest(cosine(at(F.get("idx", p - 1)), at(F.get("idx", p))), F.lit(0.0)))
    mean = F.aggregate(sims, F.lit(0.0), lambda a, s: a + s) / F.size(sims)
    return frames.select(*keys, F.when(F.size("idx") < 2, 0.0).otherwise(mean).alias("consistency"))


def agent_consistency(df: DataFrame, keys: Sequence[str], embedding: str, w_first: float = 0.5, w_next: float = 0.5) -> DataFrame:
    """Per track: mean cosine to its first crop and to the previous crop, and their weighted sum."""
    w = W.partitionBy(*keys).orderBy("frame")
    pos = lambda c: F.greatest(c, F.lit(0.0))
    d = df.withColumns({"_f": F.first(embedding).over(w), "_p": F.lag(embedding).over(w)})
    d = d.where(F.col("_p").isNotNull()).groupBy(*keys).agg(
        F.avg(pos(cosine(embedding, "_f"))).alias("to_first"), F.avg(pos(cosine(embedding, "_p"))).alias("to_previous"))
    return d.withColumn("score", w_first * F.col("to_first") + w_next * F.col("to_previous"))


def smoothed_embeddings(df: DataFrame, keys: Sequence[str], embedding: str, alpha: float = 0.9) -> DataFrame:
    """Moving average of a track's unit embeddings, renormalised at every step."""
    def unit(a):
        n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(a, lambda x: x / F.greatest(n, F.lit(1e-12)))

    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", F.col(embedding).cast("array<double>").alias("e")))).alias("r"))
    first = unit(F.element_at("r", 1)["e"])
    fold = F.aggregate(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), first,
                       lambda acc, r: unit(F.zip_with(acc, unit(r["e"]), lambda a, b: alpha * a + (1 - alpha) * b)))
    return rows.select(*keys, fold.alias("smooth"))


# ---- agent-centred features -------------------------------------------------------------------

# Car size used when a path is turned into an agent state: length, width, height (fixed values).
CAR_SIZE = (4.5, 2.0, 1.8)
# Agent kinds in one-hot order (fixed values).
AGENT_KINDS = ("TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_CYCLIST")


def path_to_state(df: DataFrame, keys: Sequence[str], dt: float = 0.1) -> DataFrame:
    """A path as the ten-column agent state of a car."""
    from wayscore.operators.trajectory import headings, velocities
    d = velocities(headings(df, keys), keys, dt).drop("speed")
    length, width, height = CAR_SIZE
    return d.withColumns({"z": F.lit(0.0), "l": F.lit(length), "w": F.lit(width), "h": F.lit(height), "valid": F.lit(True)})


def centred_features(state: DataFrame, keys: Sequence[str], kind: str = "TYPE_VEHICLE", dt: float = 0.1) -> DataFrame:
    """Agent state seen from its last frame: moved, rotated, with type, time, heading, velocity and acceleration."""
    w = W.partitionBy(*keys).orderBy("frame")
    wa = W.partitionBy(*keys)
    last = F.max_by(F.struct("x", "y", "z", "heading"), "frame").over(wa)
    d = state.withColumns({"_c": last, "_t": F.row_number().over(w) - 1})
    c, s = F.cos("_c.heading"), F.sin("_c.heading")
    rx, ry = F.col("x") - F.col("_c.x"), F.col("y") - F.col("_c.y")
    d = d.withColumns({
        "fx": rx * c + ry * s, "fy": ry * c - rx * s, "fz": F.col("z") - F.col("_c.z"), "fh": F.col("heading") - F.col("_c.heading"),
        "fvx": F.col("vx") * c + F.col("vy") * s, "fvy": F.col("vy") * c - F.col("vx") * s})
    for a in ("x", "y"):
        d = d.withColumn(f"_a{a}", (F.col(f"fv{a}") - F.lag(f"fv{a}").over(w)) / dt)
        d = d.withColumn(f"fa{a}", F.coalesce(f"_a{a}", F.lead(f"_a{a}").over(w), F.lit(0.0)))
    zero = lambda x: F.when(F.col("valid"), x).otherwise(0.0)
    return d.select(
        *keys, "frame", *[zero(F.col(f"f{n}")).alias(f"f{n}") for n in ("x", "y", "z")],
        *[zero(F.col(n)).alias(f"f{n}") for n in ("l", "w", "h")],
        *[zero(F.lit(1.0 if kind == k else 0.0)).alias(f"kind_{i}") for i, k in enumerate(AGENT_KINDS)],
        zero(F.col("_t") * dt).alias("time"), zero(F.sin("fh")).alias("sin_h"), zero(F.cos("fh")).alias("cos_h"),
        zero(F.col("fvx")).alias("fvx"), zero(F.col("fvy")).alias("fvy"), zero(F.col("fax")).alias("fax"), zero(F.col("fay")).alias("fay"))


def sliding_windows(df: DataFrame, size: int = 11, stride: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Rows repeated into the complete windows of ``size`` frames that start every ``stride`` frames."""
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - size + 1) / stride)).cast("int")
    d = df.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("frame") / stride).cast("int"))))
    full = F.count(F.lit(1)).over(W.partitionBy(*keys, "window"))
    return d.withColumn("_full", full).where(F.col("_full") == size).drop("_full")


FEATURE_COLUMNS = ("fx", "fy", "sin_h", "cos_h", "fvx", "fvy", "fax", "fay")


def window_features(df: DataFrame, keys: Sequence[str], size: int = 11, stride: int = 10) -> DataFrame:
    """Mean centred features per window, then per trajectory, as columns and as one vector."""
    wins = sliding_windows(df, size, stride, keys)
    wk = [*keys, "window"]
    feats = centred_features(path_to_state(wins, wk), wk)
    per_window = feats.groupBy(*wk).agg(*[F.avg(c).alias(c) for c in FEATURE_COLUMNS])
    out = per_window.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), *[F.avg(c).alias(c) for c in FEATURE_COLUMNS])
    return out.withColumn("vector", F.array(*FEATURE_COLUMNS))

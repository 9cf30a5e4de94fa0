"""Depth, flow and point-cloud errors over pixel and point rows.

Rows of one image may be many. Sums are partial aggregates, quantiles go through
the bucketed exact quantiles, and per-image values come back to the pixels by a
salted join.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.functions.numeric import dist
from wayscore.operators.boxjoin import top_rows
from wayscore.operators.ordered import HOT, by_key, grouped_quantiles, lower_quantile, salted_join, shared, sorted_quantile, split_hot

AUC_STEPS = 100


def _ratio(g: Column, p: Column) -> Column:
    return F.greatest(g / p, p / g)


def auc_share(inlier: Column) -> Column:
    """Mean trapezoid weight of the thresholds 1.25^e, e from .01 to 5 in 100 steps, that lie above a ratio.

    The half steps are averaged before they are scaled: their sum is exact, so the mean does not depend on the rows' order.
    """
    step = (5.0 - 0.01) / (AUC_STEPS - 1)
    e = F.ln(inlier) / math.log(1.25)
    below = F.when(e < 0.01, 0).otherwise(F.least(F.floor((e - 0.01) / step) + 1, F.lit(AUC_STEPS)))
    n = AUC_STEPS - below
    return F.avg(F.when(n == 0, 0.0).otherwise(n - 0.5 - F.when(below == 0, 0.5).otherwise(0.0))) * step / 5.0


def depth_measures(g: Column, p: Column) -> dict[str, Column]:
    """Name to aggregate expression over matched depths."""
    r, d = _ratio(g, p), g - p
    lg = F.ln(g) - F.ln(p)
    share = lambda c: F.avg(c.cast("double"))
    return {
        "d1": share(r < 1.25), "d2": share(r < 1.25 ** 2), "d3": share(r < 1.25 ** 3),
        "rmse": F.sqrt(F.avg(d * d)), "rmselog": F.sqrt(F.avg(lg * lg)), "arel": F.avg(F.abs(d) / g), "sqrel": F.avg(d * d / g),
        "log10": F.avg(F.abs(F.log10(p) - F.log10(g))), "silog": 100 * F.stddev_samp(-lg), "d_auc": auc_share(r), "tau": share(r < 1.03),
    }


ALIGNED = ("tau", "d1", "arel")


def depth_errors(df: DataFrame, keys: Sequence[str], max_depth: float | None = None, measures: Sequence[str] | None = None, limit: int = HOT) -> DataFrame:
    """Depth error suite per image, plus scale- and scale-shift-aligned variants.

    Images of up to ``limit`` valid pixels are hashed by image once; medians of larger ones go through value buckets.
    """
    keys = list(keys)
    d = df.where("valid = 1") if max_depth is None else df.where((F.col("valid") == 1) & (F.col("gt") <= max_depth))
    few, many = split_hot(shared(d.select(*keys, "gt", "pred")), keys, limit)
    return _depth_errors(by_key(few, *keys), keys, measures, False).unionByName(_depth_errors(many, keys, measures, True))


def _depth_errors(d: DataFrame, keys: list[str], measures: Sequence[str] | None, hot: bool) -> DataFrame:
    g, p = F.col("gt"), F.col("pred")
    d = shared(d.withColumn("_lr", F.ln(p) - F.ln(g)))
    chosen = {n: e for n, e in depth_measures(g, p).items() if measures is None or n in measures}
    medians = {"_mlr": "_lr", "_mg": "gt", "_mp": "pred"}
    whole = {} if hot else {n: lower_quantile(c, 0.5) for n, c in medians.items()}
    st = d.groupBy(*keys).agg(
        *[e.alias(n) for n, e in (chosen | whole).items()], F.count(F.lit(1)).alias("_n"), F.sum("pred").alias("_sp"), F.sum("gt").alias("_sg"),
        F.sum(p * p).alias("_spp"), F.sum(p * g).alias("_spg"))
    if hot:
        long = d.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("of"), F.col(c).alias("v")) for n, c in medians.items()])).alias("_m")).select(*keys, "_m.*")
        med = grouped_quantiles(long, [*keys, "of"], "v", {"q": 0.5}, "lower")
        st = st.join(med.groupBy(*keys).agg(*[F.max(F.when(F.col("of") == n, F.col("q"))).alias(n) for n in medians]), keys)
    a, b, m = F.col("_spp") + 1e-9, F.col("_sp"), F.col("_n") + 1e-9
    det = a * m - b * b
    st = st.withColumns({"_scale": (m * F.col("_spg") - b * F.col("_sg")) / det, "_shift": (a * F.col("_sg") - b * F.col("_spg")) / det,
                         "_ratio": F.col("_mg") / F.col("_mp"), "medianlog": 100 * F.abs("_mlr")})
    fit = st.select(*keys, "_scale", "_shift", "_ratio")
    px = salted_join(d, fit, keys, ["gt", "pred"]) if hot else d.join(fit, keys)
    outs = []
    for tag, q in (("ssi", p * F.col("_scale") + F.col("_shift")), ("si", p * F.col("_ratio"))):
        ms = depth_measures(g, q)
        outs += [ms[n].alias(f"{n}_{tag}") for n in ALIGNED]
    al = px.groupBy(*keys).agg(*outs)
    return st.drop("_n", "_sp", "_sg", "_spp", "_spg", "_mlr", "_mg", "_mp", "_scale", "_shift", "_ratio").join(al, keys)


def metric_store(per_image: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean over images per evaluation type, five places, as rows."""
    m = per_image.groupBy(*by).agg(*[F.bround(F.avg(c), 5).alias(c) for c in metrics])
    return m.unpivot(list(by), list(metrics), "metric", "value")


def flow_errors(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Endpoint error, 1/3/5 px shares and outlier counts per image over valid pixels."""
    epe = dist(F.col("u") - F.col("u_gt"), F.col("v") - F.col("v_gt"))
    d = df.where("valid = 1").withColumns({"_e": epe, "_m": dist("u_gt", "v_gt")})
    within = lambda t: F.avg((F.col("_e") < t).cast("double"))
    bad = (F.col("_e") > 3.0) & (F.col("_e") > 0.05 * F.col("_m"))
    return d.groupBy(*keys).agg(F.avg("_e").alias("epe"), within(1.0).alias("px1"), within(3.0).alias("px3"), within(5.0).alias("px5"),
                                F.sum(bad.cast("int")).alias("outliers"), F.count(F.lit(1)).alias("pixels"))


def flow_summary(per_image: DataFrame) -> DataFrame:
    """Image means; the outlier rate is pooled over pixels (percent)."""
    return per_image.agg(F.avg("epe").alias("epe"), (100 * (1 - F.avg("px1"))).alias("outlier_1px"), (100 * (1 - F.avg("px3"))).alias("outlier_3px"),
                         (100 * (1 - F.avg("px5"))).alias("outlier_5px"), (100 * F.sum("outliers") / F.sum("pixels")).alias("fl"))


def clip_sigma(df: DataFrame, keys: Sequence[str], value: str, sigma: float = 2.0, rounds: int = 3) -> DataFrame:
    """Rounds of dropping values beyond ``sigma`` deviations, then mean, deviation and count.

    The rows are counted by value once; each round reads that table with the bounds found so far, one row per key.
    Deviations are taken from the previous mean. A key whose values are all dropped, as equal values are, gives no row.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    state = counts.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"))
    for left in range(rounds, -1, -1):
        inside = salted_join(counts, state, keys, ["_v"]).where((F.col("_v") > F.col("_lo")) & (F.col("_v") < F.col("_hi")))
        away = F.col("_v") - F.col("mean")
        got = inside.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(away * F.col("_n")).alias("_s"), F.sum(away * away * F.col("_n")).alias("_q"),
                                        F.max("mean").alias("_c"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        off = F.col("_s") / F.col("n")
        got = got.select(*keys, (F.col("_c") + off).alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("n") - off * off, F.lit(0.0))).alias("std"), "n", "_lo", "_hi")
        if left:
            state = got.select(*keys, "mean", F.greatest("_lo", F.col("mean") - sigma * F.col("std")).alias("_lo"), F.least("_hi", F.col("mean") + sigma * F.col("std")).alias("_hi"))
    return got.drop("_lo", "_hi")


def agent_depth(df: DataFrame, keys: Sequence[str], method: str = "mean", use_percentile: bool = True, limit: int = HOT) -> DataFrame:
    """Depth of an object from its mask pixels (columns y, depth): whole mask or top half, mean or median.

    Objects of up to ``limit`` pixels are hashed once and measured in one row each; only larger ones go through value buckets.
    """
    keys = list(keys)
    if "mean" in method and "top" not in method and not use_percentile:
        return df.groupBy(*keys).agg(F.avg("depth").alias("agent_depth"))
    d = shared(df.select(*keys, "y", "depth").dropna(subset=keys))
    large = shared(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt")).where(F.col("_cnt") > limit).drop("_cnt"))
    if large.isEmpty():
        return _agent_depth_in_rows(by_key(d, *keys), keys, method, use_percentile)
    few, many = (d.join(F.broadcast(large), keys, how) for how in ("left_anti", "left_semi"))
    return _agent_depth_in_rows(by_key(few, *keys), keys, method, use_percentile).unionByName(
        _agent_depth_by_buckets(many, keys, method, use_percentile))


def _agent_depth_in_rows(d: DataFrame, keys: list[str], method: str, use_percentile: bool) -> DataFrame:
    pixel = F.collect_list(F.struct("y", F.col("depth").cast("double").alias("depth")))
    g = d.groupBy(*keys).agg(pixel.alias("_p"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    if "top" in method:
        middle = F.col("_y0") + (F.col("_y1") - F.col("_y0") + 1) * 0.5
        g = g.withColumn("_p", F.filter("_p", lambda e: e["y"] < middle))
    g = g.select(*keys, F.sort_array(F.filter(F.transform("_p", lambda e: e["depth"]), lambda v: v.isNotNull())).alias("_v")).where(F.size("_v") > 0)
    if use_percentile:
        g = g.withColumns({"_lo": sorted_quantile("_v", 0.02), "_hi": sorted_quantile("_v", 0.98)})
        g = g.withColumn("_v", F.filter("_v", lambda v: (v >= F.col("_lo")) & (v <= F.col("_hi")))).where(F.size("_v") > 0)
    value = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v) / F.size("_v") if "mean" in method else sorted_quantile("_v", 0.5)
    return g.select(*keys, value.alias("agent_depth"))


def _agent_depth_by_buckets(d: DataFrame, keys: list[str], method: str, use_percentile: bool) -> DataFrame:
    if "top" in method:
        span = d.groupBy(*keys).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"))
        d = salted_join(d, span, keys, ["y", "depth"])
        d = d.where(F.col("y") < F.col("_y0") + (F.col("_y1") - F.col("_y0") + 1) * 0.5).drop("_y0", "_y1")
    if use_percentile:
        q = grouped_quantiles(d, keys, "depth", {"_lo": 0.02, "_hi": 0.98})
        d = salted_join(d, q, keys, ["y", "depth"]).where((F.col("depth") >= F.col("_lo")) & (F.col("depth") <= F.col("_hi"))).drop("_lo", "_hi")
    if "mean" in method:
        return d.groupBy(*keys).agg(F.avg("depth").alias("agent_depth"))
    return grouped_quantiles(d, keys, "depth", {"agent_depth": 0.5})


def masked_statistics(df: DataFrame, keys: Sequence[str], value: str, mask: str) -> DataFrame:
    """Mean and variance of the values under a mask."""
    v = F.when(F.col(mask) == 1, F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("masked_mean"), F.var_pop(v).alias("masked_var"))


def scale_shift(df: DataFrame, keys: Sequence[str], target: str, source: str) -> DataFrame:
    """Least-squares scale and shift from source to target."""
    return df.groupBy(*keys).agg(F.regr_slope(target, source).alias("scale"), F.regr_intercept(target, source).alias("shift"))


def mean_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(F.avg(value).alias(value))


# ---- nearest points ---------------------------------------------------------------------------

#: Points of a cloud, both sides together, that are compared all with all in one task; larger clouds go through grid cells.
SMALL_CLOUD = 8192
#: Distances that such a task holds at a time: few enough for the processor's cache.
BLOCK = 1 << 16


def nearest_points(queries: DataFrame, refs: DataFrame, keys: Sequence[str], axes: Sequence[str], k: int = 1, id_: str = "id",
                   growth: int = 4, levels: int = 2, small: int = SMALL_CLOUD) -> DataFrame:
    """The ``k`` nearest reference points of every distinct query point, exactly; the lowest ids on ties.

    Clouds of up to ``small`` points are hashed by cloud and compared block by block, so their work grows with the
    rows and needs one shuffle. Only larger ones go through grid cells. Copies of a query are counted in ``copies``.
    """
    keys, axes = list(keys), list(axes)
    q, r = (d.select(*keys, *axes, *more).dropna(subset=[*keys, *axes]) for d, more in ((queries, []), (refs, [id_])))
    sizes = q.select(*keys).unionAll(r.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    many = shared(sizes.where(F.col("_cnt") > small).drop("_cnt"))
    if many.isEmpty():
        return _nearest_in_blocks(q, r, keys, axes, k, id_)
    # at most one such cloud for each ``small`` points
    part = lambda d, how: d.join(F.broadcast(many), keys, how)
    return _nearest_in_blocks(part(q, "left_anti"), part(r, "left_anti"), keys, axes, k, id_).unionByName(
        _nearest_in_cells(part(q, "left_semi"), part(r, "left_semi"), keys, axes, k, id_, growth, levels))


def _nearest_in_blocks(queries: DataFrame, refs: DataFrame, keys: list[str], axes: list[str], k: int, id_: str) -> DataFrame:
    """Nearest points of clouds that one task can hold."""
    sides = queries.withColumns({id_: F.lit(None).cast(refs.schema[id_].dataType), "_query": F.lit(True)}).unionByName(refs.withColumn("_query", F.lit(False)))
    kinds = dict(sides.dtypes)
    kinds["ref"] = kinds[id_]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, *axes]], "copies long", "rank int", "d2 double", f"ref {kinds['ref']}"])
    names = [*keys, *axes, "copies", "rank", "d2", "ref"]

    def points(t: pa.Table) -> np.ndarray:
        return np.stack([t[a].to_numpy().astype(float) for a in axes])

    def run(cloud: pa.Table) -> pa.Table:
        q, r = cloud.filter(cloud["_query"]), cloud.filter(pc.invert(cloud["_query"]))
        r = r.take(pc.sort_indices(r[id_], null_placement="at_start"))
        at, to = points(q) + 0.0, points(r)
        order = np.lexsort(at)
        apart = np.diff(at[:, order]) != 0
        first = np.flatnonzero(np.concatenate([[True], apart.any(0)]))[: at.shape[1]]
        copies = np.diff(np.append(first, at.shape[1]))
        rows = order[first]
        n, m = len(rows), to.shape[1]
        take = min(k, m)
        ids, found = np.empty((n, take), int), np.empty((n, take))
        step = max(1, BLOCK // max(1, m))
        for lo in range(0, n if take else 0, step):
            part = at[:, rows[lo : lo + step]]
            d = None
            for a, b in zip(part, to, strict=True):
                away = np.subtract.outer(a, b)
                away *= away
                d = away if d is None else np.add(d, away, out=d)
            if take <= 4 and d.max() < np.inf:
                line = np.arange(len(d))
                for i in range(take):
                    j = d.argmin(1)
                    ids[lo : lo + step, i], found[lo : lo + step, i] = j, d[line, j]
                    d[line, j] = np.inf
            else:
                j = d.argsort(1, kind="stable")[:, :take]
                ids[lo : lo + step], found[lo : lo + step] = j, np.take_along_axis(d, j, 1)
        own = q.select([*keys, *axes]).take(pa.array(np.repeat(rows, take)))
        cols = [*own.columns, pa.array(np.repeat(copies, take), pa.int64()), pa.array(np.tile(np.arange(1, take + 1), n), pa.int32()),
                pa.array(found.ravel()), r[id_].take(pa.array(ids.ravel()))]
        return pa.table(cols, names=names)

    return sides.groupBy(*keys).applyInArrow(run, schema)


def _nearest_in_cells(queries: DataFrame, refs: DataFrame, keys: list[str], axes: list[str], k: int, id_: str, growth: int, levels: int) -> DataFrame:
    """Nearest points of clouds of any size.

    Points meet in grid cells whose size follows each cloud's own density. A query
    that finds ``k`` points within one cell width is settled; the rest go on to wider
    cells, and the last level is the whole cloud. Copies of a point are reduced to
    the ``k`` lowest ids beforehand.
    """
    q = queries.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("copies"))
    r = top_rows(refs.select(*keys, *axes, id_), [*keys, *axes], [id_], k, [id_]).drop("position")
    both = q.select(*keys, *axes).unionByName(r.select(*keys, *axes))
    side = F.greatest(*[F.max(a) - F.min(a) for a in axes])
    per_axis = F.greatest(F.lit(1.0), F.floor(F.pow(F.count(F.lit(1)) / (2.0 * k), F.lit(1.0 / len(axes)))))
    cells = both.groupBy(*keys).agg((F.greatest(side, F.lit(1e-9)) / per_axis).alias("_s"), F.greatest(side, F.lit(1e-9)).alias("_w"))
    q = shared(salted_join(q, cells, keys, axes))
    r = shared(salted_join(r.withColumnsRenamed({a: f"_r{a}" for a in axes} | {id_: "_rid"}), cells, keys, ["_rid"]))

    def spot(prefix, size):
        return {f"_g{i}": F.floor(F.col(f"{prefix}{a}") / size) for i, a in enumerate(axes)}

    grid = [f"_g{i}" for i in range(len(axes))]
    sq = sum(((F.col(a) - F.col(f"_r{a}")) * (F.col(a) - F.col(f"_r{a}")) for a in axes), F.lit(0.0))
    found = None
    left = q
    for level in range(levels + 1):
        final = level == levels
        size = F.col("_w") * 2 if final else F.col("_s") * float(growth ** level)
        lq = left.withColumns(spot("", size)).withColumn("_size", size)
        for g in grid:
            lq = lq.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
        lr = r.withColumns(spot("_r", size)).drop("_s", "_w")
        p = lq.join(lr, [*keys, *grid]).withColumn("_d", sq)
        if not final:
            p = p.where(F.col("_d") <= F.col("_size") * F.col("_size"))
        if k == 1:
            best = p.groupBy(*keys, *axes, "copies").agg(F.min(F.struct(F.col("_d").alias("d2"), F.col("_rid").alias("ref"))).alias("_b"))
            got = best.select(*keys, *axes, "copies", F.lit(1).alias("rank"), "_b.d2", "_b.ref")
            got = got if final else shared(got)
            done = got.select(*keys, *axes)
        else:
            got = top_rows(p.select(*keys, *axes, "copies", F.col("_d").alias("d2"), F.col("_rid").alias("ref")), [*keys, *axes], ["d2", "ref"], k, ["ref"]
                           ).withColumnRenamed("position", "rank")
            if not final:
                got = shared(got)
                done = got.where(F.col("rank") == k).select(*keys, *axes)
                got = got.join(done, [*keys, *axes], "left_semi")
        found = got if found is None else found.unionByName(got)
        if not final:
            left = left.join(done, [*keys, *axes], "left_anti")
    return found


def chamfer(a: DataFrame, b: DataFrame, keys: Sequence[str], axes: Sequence[str], id_: str = "id") -> DataFrame:
    """Mean nearest distance both ways and their average, per cloud."""
    def side(x, y, name):
        n = nearest_points(x, y, keys, axes, 1, id_)
        return n.groupBy(*keys).agg((F.sum(F.sqrt("d2") * F.col("copies")) / F.sum("copies")).alias(name))
    out = side(a, b, "a_to_b").join(side(b, a, "b_to_a"), list(keys))
    return out.withColumn("chamfer", (F.col("a_to_b") + F.col("b_to_a")) / 2)


def point_f1(a: DataFrame, b: DataFrame, keys: Sequence[str], axes: Sequence[str], thresholds: Sequence[float], id_: str = "id") -> DataFrame:
    """F1 of point coverage averaged over squared-distance thresholds by the trapezoid rule, and the area under precision over recall."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    n_t = len(thresholds)

    def share(x, y, name):
        n = nearest_points(x, y, keys, axes, 1, id_)
        i = F.size(F.filter(levels, lambda t: t <= F.col("d2")))
        h = n.groupBy(*keys, i.alias("i")).agg(F.sum("copies").alias("n"))
        cov = h.groupBy(*keys).agg(F.collect_list(F.struct("i", "n")).alias("_h"), F.sum("n").alias("_t"))
        add = lambda lim: F.aggregate(F.filter("_h", lambda e: e["i"] <= lim), F.lit(0).cast("long"), lambda acc, e: acc + e["n"])
        return cov.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n_t - 1)), lambda lim: add(lim) / F.col("_t")).alias(name))

    d = share(a, b, "p").join(share(b, a, "r"), list(keys))
    f1 = F.zip_with("p", "r", lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    total = F.aggregate(F.col("_f"), F.lit(0.0), lambda acc, v: acc + v) - (F.col("_f")[0] + F.element_at("_f", -1)) / 2
    steps = F.transform(F.sequence(F.lit(1), F.lit(n_t - 1)),
                        lambda i: (F.get("p", i) + F.get("p", i - 1)) / 2 * (F.get("r", i) - F.get("r", i - 1)))
    return d.withColumn("_f", f1).select(*keys, (total / n_t).alias("f1"), F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v).alias("pr_auc"))


def point_error(df: DataFrame, keys: Sequence[str], pairs: Mapping[str, str]) -> DataFrame:
    """Mean distance of matched points; ``pairs`` maps true to predicted coordinate columns."""
    s = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in pairs.items()), F.lit(0.0))
    return df.groupBy(*keys).agg(F.avg(F.sqrt(s)).alias("mse_3d"))


# ---- cameras ------------------------------------------------------------------------------------

def inverse3(k: Sequence[Column]) -> list[Column]:
    """Closed-form inverse of a 3x3 matrix given row by row."""
    a, b, c, d, e, f, g, h, i = k
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    adj = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return [x / det for x in adj]


def matvec(m: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [m[3 * r] * v[0] + m[3 * r + 1] * v[1] + m[3 * r + 2] * v[2] for r in range(3)]


def back_project(u: Column, v: Column, z: Column, k: Sequence[Column], rot: Sequence[Column], t: Sequence[Column]) -> tuple[Column, Column]:
    """Pixel with depth to world (x, z)."""
    ray = matvec(inverse3(k), [u, v, F.lit(1.0)])
    world = matvec(rot, [c * z for c in ray])
    return world[0] + t[0], world[2] + t[2]


def spherical_to_euclidean(theta: Column, phi: Column, r: Column) -> tuple[Column, Column, Column]:
    return r * F.sin(phi) * F.sin(theta), r * F.cos(phi), r * F.cos(theta) * F.sin(phi)


def euclidean_to_spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    return F.atan2(x / r, z / r), F.acos(y / r), r


def project_depth(df: DataFrame, keys: Sequence[str], k: Sequence[float], height: int, width: int) -> DataFrame:
    """Mean depth per pixel of points (x, y, z) seen through a camera; pixels truncate toward zero."""
    m = [F.lit(float(v)) for v in k]
    u, v, w = matvec(m, [F.col("x"), F.col("y"), F.col("z")])
    cut = lambda c: (c / F.nullif(w, F.lit(0.0))).cast("int")
    d = df.select(*keys, "z", cut(u).alias("px"), cut(v).alias("py"))
    ok = (F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)
    return d.where(ok).groupBy(*keys, "py", "px").agg(F.avg("z").alias("depth"), F.count(F.lit(1)).alias("points"))


def _mul4(a: Column, b: Column) -> Column:
    cell = lambda r, c: F.get(a, r * 4) * F.get(b, c) + F.get(a, r * 4 + 1) * F.get(b, c + 4) + F.get(a, r * 4 + 2) * F.get(b, c + 8) + F.get(a, r * 4 + 3) * F.get(b, c + 12)
    at = lambda i: F.lit(i)
    return F.array(*[cell(at(r), at(c)) for r in range(4) for c in range(4)])


def rigid_inverse(rot: Sequence[Column], t: Sequence[Column]) -> list[Column]:
    """Row-major 4x4 inverse of [R | t]."""
    i = inverse3(rot)
    back = matvec(i, t)
    return [i[0], i[1], i[2], -back[0], i[3], i[4], i[5], -back[1], i[6], i[7], i[8], -back[2], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


#: Steps of a pose chain that are multiplied in one row.
CHAIN = 256


def _products(steps: Column, begin: Column) -> Column:
    """The running products ``begin`` times each step's matrix, as (frame, p); a step without a matrix repeats the last one."""
    kinds = "array<struct<frame:bigint,p:array<double>>>"

    def step(acc, e):
        nxt = F.when(e["m"].isNull(), acc["p"]).otherwise(_mul4(acc["p"], e["m"]))
        grown = lambda n: F.struct(n.alias("p"), F.array_append(acc["out"], F.struct(e["frame"].alias("frame"), n.alias("p"))).alias("out"))
        return F.get(F.transform(F.array(nxt), grown), F.lit(0))

    return F.aggregate(steps, F.struct(begin.alias("p"), F.array().cast(kinds).alias("out")), step, lambda acc: acc["out"])


def _prefixes(blocks: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """For each block of a key (_b, m: its own product) the product of all earlier blocks, itself by blocks of blocks."""
    eye = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    rows = blocks.select(*keys, F.floor(F.col("_b") / size).alias("_u"), F.struct(F.col("_b").alias("frame"), "m").alias("_s"))
    lists = rows.groupBy(*keys, "_u").agg(F.array_sort(F.collect_list("_s")).alias("_r"))
    inner = lists.withColumn("_o", _products(F.col("_r"), eye))
    if inner.where("_u > 0").isEmpty():
        outer = inner.withColumn("_before", eye)
    else:
        inner = shared(inner)
        upper = _prefixes(inner.select(*keys, F.col("_u").alias("_b"), F.element_at("_o", -1)["p"].alias("m")), keys, size)
        outer = inner.join(upper.select(*keys, F.col("_b").alias("_u"), "_before"), [*keys, "_u"])
    # a block starts from the product after the one before it in its list
    at = F.posexplode(F.transform("_r", lambda e: e["frame"])).alias("_i", "_b")
    e = outer.select(*keys, "_before", "_o", at)
    own = F.when(F.col("_i") == 0, eye).otherwise(F.get("_o", F.col("_i") - 1)["p"])
    return e.select(*keys, "_b", _mul4(F.col("_before"), own).alias("_before"))


def chain_poses(df: DataFrame, keys: Sequence[str], det_tol: float = 1e-2, trans_lim: float = 50.0, size: int = CHAIN) -> DataFrame:
    """World pose after every step from local steps (rot array of 9, t array of 3).

    A step that is no rotation, moves too far or is not finite repeats the last pose. Products of transforms may be
    bracketed at will: steps are multiplied in blocks of ``size`` numbers of a key, the products of the blocks become
    prefixes the same way, and each block then starts from its prefix. So one long sequence is the work of many tasks.
    """
    r = [F.get("rot", F.lit(i)) for i in range(9)]
    t = [F.get("t", F.lit(i)) for i in range(3)]
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    ok = (F.abs(det - 1.0) <= det_tol) & (F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]) <= trans_lim)
    d = df.withColumn("_ok", F.coalesce(ok & ~F.isnan(det), F.lit(False)))
    m = F.when(F.col("_ok"), F.array(*rigid_inverse(r, t)))
    frame = F.col("frame").cast("long")
    steps = d.select(*keys, F.floor(frame / size).alias("_b"), F.struct(frame.alias("frame"), m.alias("m")).alias("_s"))
    eye = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    blocks = shared(steps.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list("_s")).alias("_r")))
    several = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if several.isEmpty():
        placed = blocks.withColumn("_before", eye)
    else:
        own = blocks.select(*keys, "_b", F.element_at(_products(F.col("_r"), eye), -1)["p"].alias("m"))
        placed = blocks.join(_prefixes(own, keys, size), [*keys, "_b"])
    e = placed.select(*keys, F.explode(_products(F.col("_r"), F.col("_before"))).alias("e"))
    return e.select(*keys, F.col("e.frame").alias("frame"), F.col("e.p")[3].alias("x"), F.col("e.p")[7].alias("y"), F.col("e.p")[11].alias("z"), F.col("e.p").alias("pose"))

"""Motion forecasts, map polylines, frame sampling, grids and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.functions.numeric import dist
from wayscore.operators.depthflow import nearest_points
from wayscore.operators.ordered import number_rows

HORIZONS = (5, 9, 15)


def min_ade(df: DataFrame, keys: Sequence[str], by: Sequence[str] = (), horizons: Sequence[int] = HORIZONS, every: int | None = 5) -> DataFrame:
    """Best-mode average displacement at several horizons, averaged over objects and horizons.

    Rows hold keys, mode, frame (from 0), px, py, gx, gy and valid. With ``every`` the
    frames 4, 9, 14, ... are scored and renumbered.
    """
    d = df
    if every:
        d = d.where((F.col("frame") - (every - 1)) % every == 0).withColumn("frame", F.floor(F.col("frame") / every))
    e = dist(F.col("px") - F.col("gx"), F.col("py") - F.col("gy")) * F.col("valid")
    aggs = []
    for h in horizons:
        inside = F.col("frame") <= h
        aggs.append((F.sum(F.when(inside, e)) / F.greatest(F.sum(F.when(inside, F.col("valid"))), F.lit(1))).alias(f"h{h}"))
    per_mode = d.groupBy(*keys, *by, "mode").agg(*aggs)
    best = per_mode.groupBy(*keys, *by).agg(*[F.min(f"h{h}").alias(f"h{h}") for h in horizons])
    mean = sum((F.avg(f"h{h}") for h in horizons), F.lit(0.0)) / len(horizons)
    return best.groupBy(*by).agg(F.count(F.lit(1)).alias("objects"), mean.alias("min_ade"))


def shape_forecasts(df: DataFrame, keys: Sequence[str], top_k: int, frames: int, every: int = 5) -> DataFrame:
    """Modes ranked by score with normalised scores, the top ones, at every fifth frame."""
    modes = df.select(*keys, "mode", "score").distinct()
    w = W.partitionBy(*keys)
    modes = modes.withColumns({"rank": F.row_number().over(w.orderBy(F.col("score").desc(), "mode")), "score": F.col("score") / F.sum("score").over(w)})
    d = df.drop("score").join(modes.where(F.col("rank") <= top_k), [*keys, "mode"])
    d = d.where((F.col("frame") - (every - 1)) % every == 0).withColumn("step", F.floor(F.col("frame") / every))
    return d.where(F.col("step") < frames)


def breakdown_means(df: DataFrame, kind: str, value: str) -> DataFrame:
    """Mean of a metric per object kind, and over kinds."""
    per = df.groupBy(kind).agg(F.avg(value).alias(value))
    return per.unionByName(per.agg(F.avg(value).alias(value)).withColumn(kind, F.lit("AVERAGE")))


def suppress_goals(df: DataFrame, keys: Sequence[str], radius: float, keep: int = 6) -> DataFrame:
    """Greedy choice of modes by score whose goals (gx, gy) cover each other within ``radius``.

    An object has a fixed small number of modes; the fold runs over that list. When
    all are covered the best covered one not yet taken fills the place.
    """
    item = F.struct((-F.col("score")).alias("n"), "mode", "gx", "gy")
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("m"))
    near = lambda a, b: dist(a["gx"] - b["gx"], a["gy"] - b["gy"]) < radius
    free = F.aggregate("m", F.slice("m", 1, 0), lambda acc, e: F.when(F.exists(acc, lambda s: near(s, e)), acc).otherwise(F.array_append(acc, e)))
    d = rows.withColumn("free", free)
    filler = F.filter("m", lambda e: ~F.exists(F.col("free"), lambda s: s["mode"] == e["mode"]))
    d = d.withColumn("all", F.slice(F.concat("free", filler), 1, keep))
    return d.select(*keys, F.posexplode("all").alias("place", "e")).select(*keys, "place", F.col("e.mode").alias("mode"), (-F.col("e.n")).alias("score"))


def keep_kinds(scenes: DataFrame, objects: str, kinds: Sequence[str]) -> DataFrame:
    """Objects of the wanted kinds in each scene's array; scenes left empty are dropped."""
    kept = F.filter(objects, lambda o: o["kind"].isin(*kinds))
    return scenes.withColumn(objects, kept).where(F.size(objects) > 0)


# ---- polylines ---------------------------------------------------------------------------------

def polyline_parts(df: DataFrame, keys: Sequence[str], break_at: float = 1.0, size: int = 20, order: str = "frame") -> DataFrame:
    """Direction of each point, and the part and chunk it belongs to: lines break at long steps, chunks hold ``size`` points."""
    w = W.partitionBy(*keys).orderBy(order)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    d = df.withColumns({"_dx": F.coalesce(dx, F.lit(0.0)), "_dy": F.coalesce(dy, F.lit(0.0))})
    n = F.greatest(dist("_dx", "_dy"), F.lit(1e-6))
    d = d.withColumns({"dir_x": F.col("_dx") / n, "dir_y": F.col("_dy") / n, "_brk": (dist("_dx", "_dy") > break_at).cast("int")})
    d = d.withColumn("part", F.sum("_brk").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = F.row_number().over(W.partitionBy(*keys, "part").orderBy(order))
    return d.withColumn("chunk", F.floor((r - 1) / size)).drop("_dx", "_dy", "_brk")


def nearest_polylines(agents: DataFrame, parts: DataFrame, scene: Sequence[str], k: int, ahead: tuple[float, float] = (30.0, 0.0)) -> DataFrame:
    """The ``k`` map pieces nearest to a point ahead of each agent.

    ``agents`` holds scene keys, agent, x, y, heading; ``parts`` scene keys, line, x, y.
    """
    centre = parts.groupBy(*scene, "line").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    c, s = F.cos("heading"), F.sin("heading")
    at = agents.withColumns({"x": F.col("x") + ahead[0] * c - ahead[1] * s, "y": F.col("y") + ahead[0] * s + ahead[1] * c})
    near = nearest_points(at, centre, scene, ["x", "y"], k, "line")
    return at.select(*scene, "agent", "x", "y").join(near.drop("copies"), [*scene, "x", "y"]).select(
        *scene, "agent", "rank", F.col("ref").alias("line"), F.sqrt("d2").alias("distance"))


def into_agent_frame(points: DataFrame, x: str, y: str, ax: str, ay: str, heading: str) -> DataFrame:
    """Points seen from an agent: moved and rotated by minus its heading."""
    c, s = F.cos(heading), F.sin(heading)
    rx, ry = F.col(x) - F.col(ax), F.col(y) - F.col(ay)
    return points.withColumns({x: rx * c + ry * s, y: ry * c - rx * s})


# ---- frames and grids ------------------------------------------------------------------------------

def spread_frames(total: Column, n: Column) -> Column:
    """n frame numbers from 0 to total - 1, evenly spread, truncated."""
    step = (total - 1) / F.nullif(n - 1, F.lit(0))
    return F.when(n <= 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * step).cast("int")))


def frames_by_rate(total: Column, video_fps: Column, sample_fps: float) -> Column:
    n = F.greatest(F.lit(1), F.bround(total / video_fps * sample_fps).cast("int"))
    return spread_frames(total, n)


def sample_index(i: Column, out_count: Column, source_count: Column) -> Column:
    """Source frame shown at output position i."""
    return F.when((source_count <= 1) | (out_count <= 1), 0).otherwise(F.bround(i * (source_count - 1) / (out_count - 1)).cast("int"))


def clip_frames(df: DataFrame, keys: Sequence[str], n: int, factor: int, offset: int = 0) -> DataFrame:
    """n frames, every ``factor``-th from an offset; videos that are too short are dropped."""
    total = F.count(F.lit(1)).over(W.partitionBy(*keys))
    f = F.col("frame") - offset
    return df.withColumn("_t", total).where((F.col("_t") >= n * factor) & (f >= 0) & (f < n * factor) & (f % factor == 0)).drop("_t")


def close_ring(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Polygon points with the first one repeated at the end."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "frame").alias("p"), (F.max("frame") + 1).alias("frame"))
    return df.select(*keys, "frame", "x", "y").unionByName(first.select(*keys, "frame", "p.x", "p.y"))


def crop_pyramid(images: DataFrame, layers: int, overlap: float) -> DataFrame:
    """Crop boxes per layer: the image itself, then 2, 4, ... crops per side with overlap."""
    full = images.select("image_id", F.lit(0).alias("layer"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    out = full
    short = F.least("width", "height")
    for layer in range(layers):
        n = 2 ** (layer + 1)
        lap = F.floor(overlap * short * (2 / n)).cast("int")
        d = images.withColumns({"_cw": F.ceil((lap * (n - 1) + F.col("width")) / n).cast("int"), "_ch": F.ceil((lap * (n - 1) + F.col("height")) / n).cast("int"), "_lap": lap})
        d = d.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        x0, y0 = (F.col("_cw") - F.col("_lap")) * F.col("_i"), (F.col("_ch") - F.col("_lap")) * F.col("_j")
        out = out.unionByName(d.select("image_id", F.lit(layer + 1).alias("layer"), x0.alias("x0"), y0.alias("y0"),
                                       F.least(x0 + F.col("_cw"), "width").alias("x1"), F.least(y0 + F.col("_ch"), "height").alias("y1")))
    return out


def point_grids(crops: DataFrame, per_side: int, scale: int = 1) -> DataFrame:
    """Point grid of every crop in image coordinates; deeper layers have fewer points."""
    n = F.floor(per_side / F.pow(F.lit(float(scale)), F.col("layer"))).cast("int")
    d = crops.withColumn("_n", n).where("_n > 0")
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda i: (2 * F.col(i) + 1) / (2 * F.col("_n"))
    return d.select("image_id", "layer", "x0", "y0", (F.col("x0") + at("_i") * (F.col("x1") - F.col("x0"))).alias("px"), (F.col("y0") + at("_j") * (F.col("y1") - F.col("y0"))).alias("py"))


# ---- splits, shards and samples ---------------------------------------------------------------------

def seeded(*parts, seed: int) -> Column:
    """A number of 48 bits that depends on the parts and the seed alone, in any engine with SHA-256."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def autosplit(df: DataFrame, key: str, weights: Sequence[float] = (0.9, 0.1, 0.0), names: Sequence[str] = ("train", "val", "test"), seed: int = 0) -> DataFrame:
    """Stable weighted split by a hash of the key."""
    u = F.pmod(seeded(key, seed=seed), F.lit(1_000_000)) / 1_000_000
    edge, c = 0.0, None
    for n, w in zip(names[:-1], weights[:-1]):
        edge += w / sum(weights)
        c = F.when(u < edge, n) if c is None else c.when(u < edge, n)
    return df.withColumn("split", c.otherwise(names[-1]))


def shard(df: DataFrame, key: str, nodes: int, workers: int, seed: int = 2026) -> DataFrame:
    """Keys in seeded order dealt over nodes, then over the workers of a node; sizes differ by one at most.

    Positions come from 4,096 ranges of the hash, so that no task sorts all keys.
    """
    d = df.withColumn("_h", seeded(key, seed=seed))
    d = number_rows(d, [], {"range": F.shiftright("_h", 36)}, ["_h", key], "_p").drop("_h")
    return d.withColumns({"node": F.pmod("_p", F.lit(nodes)), "worker": F.pmod(F.floor(F.col("_p") / nodes), F.lit(workers))}).drop("_p")


def _sequences(df: DataFrame, keys: Sequence[str], visible: str) -> DataFrame:
    """One row per sequence (a clip of bounded length): its visible frames in order, and the frame after its last."""
    d = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col(visible), F.col("frame")))).alias("_v"), (F.max("frame") + 1).alias("_end"))
    return d.where(F.size("_v") > 0)


def _pick(frames: Column, h: Column, other: Column) -> Column:
    return F.when(F.size(frames) > 0, F.get(frames, F.pmod(h, F.size(frames)).cast("int"))).otherwise(other)


def sequential_sample(df: DataFrame, keys: Sequence[str], n: int, visible: str, seed: int = 0, max_gap: int | None = None) -> DataFrame:
    """Per sequence a seeded ``template_frame`` and ``n`` search frames (``position`` from 0), as keys and these columns.

    The template is a visible frame before the last ``n``, else the first visible one. The search starts at it, or at a
    seeded visible frame less than ``max_gap`` after it, and takes the visible frames from there; where they run out, the
    last frame of the sequence fills up. Sequences without visible frames give no rows.
    """
    early = lambda f: f < F.col("_end") - n
    d = _sequences(df, keys, visible).withColumn("template_frame", _pick(F.filter("_v", early), seeded(*keys, F.lit("template"), seed=seed), F.get("_v", F.lit(0))))
    start = F.col("template_frame")
    if max_gap is not None:
        near = F.filter("_v", lambda f: (f >= F.col("template_frame")) & early(f) & (f < F.col("template_frame") + max_gap))
        start = _pick(near, seeded(*keys, F.lit("search"), seed=seed), start)
    d = d.withColumn("_s", start)
    d = d.withColumn("_f", F.slice(F.filter("_v", lambda f: f >= F.col("_s")), 1, n))
    filled = F.concat("_f", F.array_repeat(F.col("_end") - 1, (F.lit(n) - F.size("_f")).cast("int")))
    return d.select(*keys, "template_frame", F.posexplode(filled).alias("position", "frame"))


def interval_sample(df: DataFrame, keys: Sequence[str], n: int, max_interval: int, visible: str, seed: int = 0, max_gap: int | None = None) -> DataFrame:
    """Per sequence a seeded ``template_frame`` and ``n`` search frames, each at most ``max_interval`` after the one before.

    Steps are seeded and may stay on a frame, so there are always ``n`` (two at least are asked for). The template leaves
    room for ``n - 1`` steps of the widest interval, up to ``max_interval``, that a visible frame allows; where none does,
    it is the first visible one. The first search frame is the template, or a seeded visible frame less than ``max_gap``
    after it. Sequences without visible frames give no rows.
    """
    d = _sequences(df, keys, visible).withColumn("_len", F.col("_end"))
    widest = F.greatest(F.lit(1), F.least(F.lit(max_interval), F.floor(F.col("_len") / (n - 1))))
    wide = F.least(widest, F.ceil((F.col("_len") - F.get("_v", F.lit(0))) / (n - 1)) - 1)
    d = d.withColumns({"_widest": widest, "_wide": wide})
    room = F.filter("_v", lambda f: (F.col("_wide") >= 1) & (f < F.col("_len") - F.col("_wide") * (n - 1)))
    d = d.withColumn("template_frame", _pick(room, seeded(*keys, F.lit("template"), seed=seed), F.get("_v", F.lit(0))))
    t = F.col("template_frame")
    first = t
    if max_gap is not None:
        end = F.least(F.greatest(F.col("_len") - F.col("_widest") * (n - 1), t + 1), t + max_gap)
        first = _pick(F.filter("_v", lambda f: (f >= t) & (f < end)), seeded(*keys, F.lit("search"), seed=seed), t)
    d = d.withColumn("_s0", first)
    for i in range(1, n):
        last = F.col(f"_s{i - 1}")
        d = d.withColumn(f"_s{i}", _pick(F.filter("_v", lambda f: (f >= last) & (f <= last + max_interval)), seeded(*keys, F.lit(i), seed=seed), last))
    return d.select(*keys, "template_frame", F.posexplode(F.array(*[f"_s{i}" for i in range(n)])).alias("position", "frame"))


def near_template(df: DataFrame, keys: Sequence[str], template: DataFrame, max_gap: int, n: int, visible: str, seed: int = 0) -> DataFrame:
    """``n`` seeded visible frames after each sequence's template frame, within ``max_gap``."""
    d = df.where(F.col(visible)).join(template.select(*keys, F.col("frame").alias("template_frame")), list(keys))
    d = d.where((F.col("frame") > F.col("template_frame")) & (F.col("frame") <= F.col("template_frame") + max_gap))
    w = W.partitionBy(*keys, "template_frame").orderBy(seeded(*keys, "frame", seed=seed), "frame")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fingerprint(files: DataFrame, group: Sequence[str], path: str = "path", size: str = "length") -> DataFrame:
    """Order-free fingerprint of a file set: total size and a combined hash of the paths.

    Each path is hashed on its own and the hashes are added, so the file list is
    never gathered in one place.
    """
    h = F.conv(F.substring(F.sha2(F.col(path), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    g = files.groupBy(*group).agg(F.sum(size).alias("total_size"), F.sum(h).alias("_h"), F.count(F.lit(1)).alias("files"))
    return g.select(*group, "total_size", "files", F.sha2(F.concat_ws(":", F.col("total_size").cast("string"), F.col("_h").cast("decimal(38,0)").cast("string")), 256).alias("fingerprint"))



"""The tracker's box filter as a fold of column expressions.

Motion and noise treat the four coordinates alike and apart: each has its own value, velocity and 2 x 2 covariance, and
they meet only in the noise, which follows the box's height (and width). So one coordinate's step needs no matrices.
A gap of g frames is one step too: the noise of its g predictions is a sum over powers of the frame number, in closed
form, so a gap costs the same whatever its length. Nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.functions.kalman import POSITION_WEIGHT, VELOCITY_WEIGHT
from wayscore.operators.ordered import by_key

COORDINATES = ("x", "y", "a", "h")
#: Observations folded before their states go into the outer list.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _noise(i: str, aspect: bool, h: Column, w: Column, weight: float, fixed: float) -> Column:
    """Standard deviation of one coordinate's noise; the shape ratio has a fixed one."""
    if aspect:
        return F.lit(fixed) if i == "a" else weight * h
    return weight * (h if i in "yh" else w)


def _start(o: Column, aspect: bool) -> Column:
    """State of a new track: a coordinate holds value m, velocity v and covariance p, c, s."""
    fields = [o["frame"].alias("now")]
    for i in COORDINATES:
        position = 2 * _noise(i, aspect, o["h"], o["a"], POSITION_WEIGHT, 0.5e-2)
        velocity = 10 * _noise(i, aspect, o["h"], o["a"], VELOCITY_WEIGHT, 1e-6)
        fields += [o[i].alias(f"m{i}"), F.lit(0.0).alias(f"v{i}"), (position * position).alias(f"p{i}"), F.lit(0.0).alias(f"c{i}"), (velocity * velocity).alias(f"s{i}")]
    return F.struct(*fields)


def _power_sums(g: Column) -> Column:
    """Sums of j ** n over j = 0 .. g - 1 for n = 0 .. 4."""
    t1 = g * (g - 1) / 2
    t2 = (g - 1) * g * (2 * g - 1) / 6
    return F.struct(g.alias("t0"), t1.alias("t1"), t2.alias("t2"), (t1 * t1).alias("t3"), (t2 * (3 * g * g - 3 * g - 1) / 5).alias("t4"))


def _squares(t: Column, value: Column, velocity: Column) -> list[Column]:
    """Sums of (value in frame k) ** 2 * j ** n for n = 0, 1, 2, where j = g - 1 - k."""
    last = value + (t["t0"] - 1) * velocity
    return [last * last * t[f"t{n}"] - 2 * last * velocity * t[f"t{n + 1}"] + velocity * velocity * t[f"t{n + 2}"] for n in range(3)]


def _predict(s: Column, frame: Column, aspect: bool) -> Column:
    """The state after the frames up to ``frame``, one at least."""
    steps = F.greatest(F.lit(1), frame - s["now"])

    def moved(e: Column) -> Column:
        g, t = e["g"], e["t"]
        fields = [(s["now"] + e["steps"]).alias("now")]
        for i in COORDINATES:
            m, v, p, c, var = (s[f"{n}{i}"] for n in "mvpcs")
            if aspect and i == "a":
                q, r = [F.lit(1e-4) * t["t0"]], [F.lit(1e-10) * t[f"t{n}"] for n in range(3)]
            else:
                squares = [e[f"{'h' if aspect or i in 'yh' else 'w'}{n}"] for n in range(3)]
                q, r = [POSITION_WEIGHT**2 * squares[0]], [VELOCITY_WEIGHT**2 * x for x in squares]
            fields += [
                (m + g * v).alias(f"m{i}"),
                v.alias(f"v{i}"),
                (p + 2 * g * c + g * g * var + q[0] + r[2]).alias(f"p{i}"),
                (c + g * var + r[1]).alias(f"c{i}"),
                (var + r[0]).alias(f"s{i}"),
            ]
        return F.struct(*fields)

    def sums(e: Column) -> Column:
        named = [x.alias(f"h{n}") for n, x in enumerate(_squares(e["t"], s["mh"], s["vh"]))]
        if not aspect:
            named += [x.alias(f"w{n}") for n, x in enumerate(_squares(e["t"], s["ma"], s["va"]))]
        return let(F.struct(e["steps"].alias("steps"), e["g"].alias("g"), e["t"].alias("t"), *named), moved)

    return let(steps, lambda n: let(F.struct(n.alias("steps"), n.cast("double").alias("g"), _power_sums(n.cast("double")).alias("t")), sums))


def _update(s: Column, o: Column, aspect: bool) -> Column:
    """State after an observation, and its squared gate distance."""
    parts = []
    for i in COORDINATES:
        r = _noise(i, aspect, s["mh"], s["ma"], POSITION_WEIGHT, 1e-1)
        parts += [(s[f"p{i}"] + r * r).alias(f"e{i}"), (o[i] - s[f"m{i}"]).alias(f"d{i}")]

    def corrected(e: Column) -> Column:
        fields, gate = [s["now"].alias("now")], F.lit(0.0)
        for i in COORDINATES:
            m, v, p, c, var = (s[f"{n}{i}"] for n in "mvpcs")
            d, total = e[f"d{i}"], e[f"e{i}"]
            gate = gate + d * d / total
            fields += [
                (m + p / total * d).alias(f"m{i}"),
                (v + c / total * d).alias(f"v{i}"),
                (p - p * p / total).alias(f"p{i}"),
                (c - p * c / total).alias(f"c{i}"),
                (var - c * c / total).alias(f"s{i}"),
            ]
        return F.struct(F.struct(*fields).alias("state"), gate.alias("gate"))

    return let(F.struct(*parts), corrected)


def filter_tracks(df: DataFrame, keys: Sequence[str], aspect: bool = True) -> DataFrame:
    """Filtered box state after every observed frame, and the gate distance of the observation.

    Rows hold frame and the measurement x, y, a, h (``aspect``: a is the shape ratio, else the width). Frames without a
    box only predict; a frame that comes again counts as the one after it. The states of a track go into blocks, so the
    fold copies short lists only.
    """
    kinds = "frame:bigint,x:double,y:double,a:double,h:double,gate:double"
    observed = F.struct(F.col("frame").cast("long").alias("frame"), *[F.col(i).cast("double").alias(i) for i in COORDINATES])
    rows = by_key(df, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(observed)).alias("_r"))
    first = F.col("_r")[0]
    rest = F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_r") - 1) / BLOCK).cast("int")), lambda b: F.slice(rest, b * BLOCK + 1, BLOCK))

    def seen(o: Column, s: Column, gate: Column) -> Column:
        return F.struct(o["frame"].alias("frame"), *[s[f"m{i}"].alias(i) for i in COORDINATES], gate.alias("gate"))

    def step(acc: Column, o: Column) -> Column:
        done = lambda u: F.struct(u["state"].alias("state"), F.array_append(acc["out"], seen(o, u["state"], u["gate"])).alias("out"))
        return let(_predict(acc["state"], o["frame"], aspect), lambda p: let(_update(p, o, aspect), done))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(f"array<struct<{kinds}>>").alias("out")), step)
        return let(inner, lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["outs"], x["out"]).alias("outs")))

    begin = F.struct(_start(first, aspect).alias("state"), F.array(F.array(seen(first, _start(first, aspect), F.lit(0.0)))).alias("outs"))
    states = rows.select(*keys, F.explode(F.flatten(F.aggregate(blocks, begin, block)["outs"])).alias("s"))
    return states.select(*keys, "s.frame", "s.x", "s.y", "s.a", "s.h", "s.gate")

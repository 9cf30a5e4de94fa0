"""Stateful stream forms of the frame-ordered operators.

State is kept per key in the state store, so a lost executor resumes from the
checkpoint. It is typed: a fold has one row of named fields for a key, the tracker
one entry for a track. Order comes from an event-time column (or frame), never from
the arrival clock: rows of one micro-batch are sorted, and rows at or before the
last one handled for their key are late; they are dropped and counted.

A key that gets no more rows would keep its state for ever. ``Ends`` names the
event-time column and how long a key may be silent: an event-time timer then
clears its state. A row that comes later still lies behind the watermark, which
drops it and counts it among the query's dropped rows, or starts the key anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wayscore.functions.kalman import cov_parts, whole_cov

STATE_PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
                  "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ends(NamedTuple):
    """When a key's state goes: ``idle`` seconds of event time without a row, as the watermark tells."""

    time: str
    idle: float = 600.0
    watermark: str = "1 minute"


def _timed(df: DataFrame, ends: Ends | None) -> tuple[DataFrame, list[Column]]:
    """The rows under their watermark, and the column that carries the time."""
    if ends is None:
        return df, []
    return df.withWatermark(ends.time, ends.watermark), [F.col(ends.time).alias("event_time")]


class KeyedFold(StatefulProcessor):
    """Folds the ordered rows of a key; ``step(state, row)`` gives (state, output rows). ``fields`` is the state's DDL."""

    def __init__(self, keys: Sequence[str], order: str, columns: Sequence[str], fields: str, start: dict, step: Callable[[dict, Any], tuple[dict, list[dict]]],
                 ends: Ends | None = None):
        self.keys, self.order, self.columns = list(keys), order, list(columns)
        self.fields, self.start, self.step, self.ends = fields, start, step, ends

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fold", f"last double, late bigint, {self.fields}")

    def load(self) -> tuple[float, int, dict]:
        if not self.value.exists():
            return float("-inf"), 0, {k: list(x) if isinstance(x, list) else x for k, x in self.start.items()}
        last, late, *rest = self.value.get()
        return last, late, dict(zip(self.start, rest))

    def save(self, last: float, late: int, state: dict) -> None:
        self.value.update((last, late, *[state[k] for k in self.start]))

    def clear(self) -> None:
        self.value.clear()

    def parts(self, pdf: pd.DataFrame):
        return pdf.itertuples(index=False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, late, state = self.load()
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        if self.ends is not None:
            until = int(pdf["event_time"].max().value // 1_000_000 + self.ends.idle * 1000)
            set_for = list(self.handle.listTimers())
            if not set_for or until > max(set_for):
                for t in set_for:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(until)
        order = pdf[self.order].astype(float)
        late += int((order <= last).sum())
        pdf = pdf[order > last]
        out: list[dict] = []
        for part in self.parts(pdf):
            state, more = self.step(state, part)
            out += more
        if len(pdf):
            last = float(pdf[self.order].iloc[-1])
        self.save(last, late, state)
        if out:
            frame = pd.DataFrame(out)
            for name, k in zip(self.keys, key):
                frame[name] = k
            frame["late"] = late
            yield frame[[*self.keys, *self.columns, "late"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter([])

    def close(self) -> None:
        pass


#: A track in the state: its fields by id.
TRACK = "mean array<double>, cov array<double>, start bigint, end bigint, confirmed boolean, lost boolean, score double, det bigint"


class TrackerFold(KeyedFold):
    """The tracker's state: frame counters, and a map from track id to track of which only what changed is written."""

    def init(self, handle) -> None:
        super().init(handle)
        self.tracks = handle.getMapState("tracks", "id bigint", TRACK)

    def load(self) -> tuple[float, int, dict]:
        last, late, state = super().load()
        self.known = {}
        for (i,), t in self.tracks.iterator() if self.tracks.exists() else ():
            self.known[i] = tuple(t)
        state["tracks"] = [
            {"id": i, "mean": list(t[0]), "var": cov_parts(np.array(t[1]).reshape(8, 8)), "start": t[2], "end": t[3], "confirmed": t[4], "lost": t[5], "score": t[6], "det": t[7]}
            for i, t in sorted(self.known.items())
        ]
        return last, late, state

    def save(self, last: float, late: int, state: dict) -> None:
        super().save(last, late, state)
        live = {t["id"] for t in state["tracks"]}
        for i in self.known:
            if i not in live:
                self.tracks.removeKey((i,))
        for t in state["tracks"]:
            row = (list(t["mean"]), whole_cov(t["var"]).ravel().tolist(), t["start"], t["end"], t["confirmed"], t["lost"], t["score"], t["det"])
            if self.known.get(t["id"]) != row:
                self.tracks.updateValue((t["id"],), row)

    def clear(self) -> None:
        super().clear()
        self.tracks.clear()

    def parts(self, pdf: pd.DataFrame):
        return (g for _, g in pdf.groupby(self.order, sort=True))


def _run(df: DataFrame, keys: Sequence[str], order: str, out: str, fields: str, start: dict, step, ends: Ends | None, kind: type[KeyedFold] = KeyedFold) -> DataFrame:
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    columns = [c.split()[0] for c in out.split(", ")]
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=kind(keys, order, columns, fields, start, step, ends), outputStructType=f"{kinds}, {out}, late long", outputMode="Append",
        timeMode="None" if ends is None else "EventTime")


def stream_region_transitions(df: DataFrame, keys: Sequence[str], region: Sequence[tuple[float, float]], order: str = "frame", ends: Ends | None = None) -> DataFrame:
    """In and out moves of each track over a polygon, as they happen. Needs cx and cy."""
    from wayscore.operators.tracks import in_polygon
    df, time = _timed(df, ends)
    d = df.withColumn("_in", in_polygon(F.col("cx"), F.col("cy"), region)).select(*keys, F.col(order).cast("double").alias("at"), F.col("_in").alias("inside"), *time)

    def step(state, row):
        was, now = state["inside"], bool(row.inside)
        return {"inside": now}, ([{"at": float(row.at), "move": "in" if now else "out"}] if was is not None and was != now else [])

    return _run(d, keys, "at", "at double, move string", "inside boolean", {"inside": None}, step, ends)


def stream_crossing_speed(df: DataFrame, keys: Sequence[str], x_range: tuple[float, float], lines: Sequence[float], near: float, time: str, order: str = "frame", ends: Ends | None = None) -> DataFrame:
    """Speed of each track at its first line hit inside the zone, in event time."""
    df, stamp = _timed(df, ends)
    d = df.where((F.col("cx") > x_range[0]) & (F.col("cx") < x_range[1])).select(*keys, F.col(order).cast("double").alias("at"), F.col(time).cast("double").alias("t"), "cy", *stamp)
    lines = list(lines)

    def step(state, row):
        out = []
        hit = any(y - near < row.cy < y + near for y in lines)
        if state["t"] is not None and hit and not state["done"]:
            state["done"] = True
            if row.t > state["t"]:
                out = [{"at": float(row.at), "speed": abs(row.cy - state["y"]) / (row.t - state["t"])}]
        state["t"], state["y"] = float(row.t), float(row.cy)
        return state, out

    return _run(d, keys, "at", "at double, speed double", "t double, y double, done boolean", {"t": None, "y": None, "done": False}, step, ends)


def stream_repetitions(df: DataFrame, keys: Sequence[str], angle, up: float, down: float, order: str = "frame", ends: Ends | None = None) -> DataFrame:
    """One row per finished repetition with the running count."""
    df, time = _timed(df, ends)
    d = df.select(*keys, F.col(order).cast("double").alias("at"), angle.alias("angle"), *time)

    def step(state, row):
        zone = "up" if row.angle > up else "down" if row.angle < down else None
        out = []
        if zone == "down" and state["zone"] == "up":
            state["n"] += 1
            out = [{"at": float(row.at), "repetitions": state["n"]}]
        if zone:
            state["zone"] = zone
        return state, out

    return _run(d, keys, "at", "at double, repetitions long", "zone string, n bigint", {"zone": None, "n": 0}, step, ends)


def stream_history(df: DataFrame, keys: Sequence[str], size: int = 30, order: str = "frame", ends: Ends | None = None) -> DataFrame:
    """Length and mean centre of the last ``size`` positions after every row."""
    df, time = _timed(df, ends)
    d = df.select(*keys, F.col(order).cast("double").alias("at"), "cx", "cy", *time)

    def step(state, row):
        xs, ys = [*state["xs"], float(row.cx)][-size:], [*state["ys"], float(row.cy)][-size:]
        return {"xs": xs, "ys": ys}, [{"at": float(row.at), "points": len(xs), "mean_x": float(np.mean(xs)), "mean_y": float(np.mean(ys))}]

    return _run(d, keys, "at", "at double, points long, mean_x double, mean_y double", "xs array<double>, ys array<double>", {"xs": [], "ys": []}, step, ends)


def stream_streaks(df: DataFrame, keys: Sequence[str], good, order: str = "frame", ends: Ends | None = None) -> DataFrame:
    """Running length of the run of good frames."""
    df, time = _timed(df, ends)
    d = df.select(*keys, F.col(order).cast("double").alias("at"), good.alias("good"), *time)

    def step(state, row):
        n = state["n"] + 1 if row.good else 0
        return {"n": n}, [{"at": float(row.at), "stable_frames": n}]

    return _run(d, keys, "at", "at double, stable_frames long", "n bigint", {"n": 0}, step, ends)


def stream_tracker(dets: DataFrame, keys: Sequence[str], ends: Ends | None = None) -> DataFrame:
    """Frame-ordered multi-object tracking keyed by video. A frame's detections arrive in one micro-batch."""
    from wayscore.operators.association import skip_frames, track_frame
    dets, time = _timed(dets, ends)
    d = dets.select(*keys, F.col("frame").cast("double").alias("frame"), "det_id", "conf", "x1", "y1", "x2", "y2", *time)

    def step(state, g):
        f = int(g["frame"].iloc[0])
        if state["at"] is not None:
            skip_frames(state, f - state["at"] - 1)
        g = g.sort_values("det_id")
        rows = track_frame(state, g[["x1", "y1", "x2", "y2"]].to_numpy(float), g["conf"].to_numpy(float), g["det_id"].tolist())
        state["at"] = f
        return state, [{"frame": f, **r} for r in rows]

    out = "frame long, track long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"
    return _run(d, keys, "frame", out, "frame bigint, next bigint, at bigint", {"frame": 0, "next": 1, "at": None}, step, ends, TrackerFold)


def stream_heat(df: DataFrame, keys: Sequence[str], time: str, window: str = "10 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Box coverage per cell and time window (each box adds 2), closed by the watermark; decay is applied when windows are added up."""
    d = df.withWatermark(time, watermark).withColumn("_y", F.explode(F.sequence(F.col("y1").cast("int"), F.col("y2").cast("int") - 1)))
    d = d.withColumn("_x", F.explode(F.sequence(F.col("x1").cast("int"), F.col("x2").cast("int") - 1)))
    return d.groupBy(*keys, F.window(time, window).alias("window"), F.col("_y").alias("y"), F.col("_x").alias("x")).agg(F.sum(F.lit(2)).alias("heat"))


def stream_pair_distance(df: DataFrame, chosen: DataFrame, frame_keys: Sequence[str], px_per_m: float, time: str, watermark: str = "10 seconds") -> DataFrame:
    """Distance of chosen track pairs per frame: a stream-stream join bounded by the watermark."""
    on = [c for c in chosen.columns if c not in ("a", "b")]
    a = df.select(*frame_keys, F.col("track_id").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col(time).alias("ta")).withWatermark("ta", watermark)
    b = df.select(*[F.col(k).alias(f"b_{k}") for k in frame_keys], F.col("track_id").alias("b_id"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col(time).alias("tb")).withWatermark("tb", watermark)
    left = a.join(chosen, [*on, "a"])
    same = [F.col(k) == F.col(f"b_{k}") for k in frame_keys]
    cond = (F.col("b") == F.col("b_id")) & (F.col("tb") >= F.col("ta") - F.expr(f"INTERVAL {watermark}")) & (F.col("tb") <= F.col("ta") + F.expr(f"INTERVAL {watermark}"))
    for s in same:
        cond = cond & s
    px = F.sqrt(F.pow(F.floor("ax") - F.floor("bx"), F.lit(2)) + F.pow(F.floor("ay") - F.floor("by"), F.lit(2)))
    return left.join(b, cond).select(*frame_keys, "a", "b", px.alias("pixels"), (px / px_per_m).alias("metres"))

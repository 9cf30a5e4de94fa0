"""Discovery, selection and job building for scoring runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.regexp_replace(c, re.escape(suffix) + "$", "")


def discover_predictions(inventory: DataFrame, suffix: str) -> DataFrame:
    """First path per model and scene; ``inventory`` holds folder, scene_id and path."""
    model = strip_suffix(F.col("folder"), suffix)
    return inventory.groupBy(model.alias("model"), "scene_id").agg(F.min("path").alias("path"))


def parse_selection(args: DataFrame, column: str, name: str) -> DataFrame:
    """Comma lists (one per row, or one id per line) to a table of ids."""
    ids = args.select(F.explode(F.split(column, "[,\n]")).alias(name)).select(F.trim(name).alias(name))
    return ids.where(F.length(name) > 0).distinct()


def limit_dimension(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the first ``n`` values of a dimension."""
    keep = df.select(column).distinct().orderBy(column).limit(n)
    return df.join(keep, column, "left_semi")


def build_jobs(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Model by scene grid with flags: both inputs exist, and they exist for every model.

    The grid is models times scenes, which is the list of jobs to decide on. The
    scene list is the large side; each scene row is expanded by the model list,
    an array of model names built once (one entry per model).
    """
    models = predictions.select("model").distinct().agg(F.array_sort(F.collect_set("model")).alias("_models"))
    scenes = predictions.select("scene_id").union(truth.select("scene_id")).distinct()
    have = predictions.groupBy("scene_id").agg(F.collect_set("model").alias("_have"))
    d = (
        scenes.join(have, "scene_id", "left")
        .join(truth.select("scene_id").distinct().withColumn("_gt", F.lit(True)), "scene_id", "left")
        .join(models)
    )
    ready = F.coalesce(F.col("_gt"), F.lit(False))
    have = F.coalesce("_have", F.array().cast("array<string>"))
    common = ready & (F.size(F.array_except("_models", have)) == 0)
    return d.select("scene_id", F.explode("_models").alias("model"), have.alias("_h"), ready.alias("_r"), common.alias("common")).select(
        "model", "scene_id", "common", (F.col("_r") & F.array_contains("_h", F.col("model"))).alias("runnable"))


def validate_points(df: DataFrame, keys: Sequence[str], point: str, min_frames: int = 1) -> DataFrame:
    """Rank, channel and length checks per trajectory, as rows instead of errors."""
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.min(F.size(point)).alias("channels"))
    reason = F.when(F.col("channels") < 2, "too few channels").when(F.col("frames") < min_frames, "too short").otherwise("ok")
    return g.select(*keys, "frames", "channels", (reason == "ok").alias("valid"), reason.alias("reason"))


def position_ranks(df: DataFrame, metrics: dict[str, bool], tie_break: Sequence[str]) -> DataFrame:
    """Positions without ties per metric (True = larger is better), their mean and the final order."""
    for m, larger in metrics.items():
        order = F.col(m).desc_nulls_last() if larger else F.col(m).asc_nulls_last()
        df = df.withColumn(f"{m}_rank", F.row_number().over(W.orderBy(order, *tie_break)))
    mean = sum((F.col(f"{m}_rank") for m in metrics), F.lit(0)) / len(metrics)
    df = df.withColumn("average_rank", mean)
    return df.withColumn("overall_rank", F.row_number().over(W.orderBy("average_rank", *tie_break)))

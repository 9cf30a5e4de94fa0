"""Scans of manifests, captions, results and tracker files, and clip-name parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayscore.functions import text as tx

TRAJECTORY_SCHEMA = T.StructType([
    T.StructField("scene_id", T.StringType()), T.StructField("frame", T.IntegerType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def scene_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scene ids of a JSON list file."""
    return manifest_ids(spark.read.text(path, wholetext=True), "value")


def manifest_ids(df: DataFrame, column: str) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(F.from_json(column, "array<string>")).alias("scene_id"))


def resolve_scenes(scenes: DataFrame, images: DataFrame, captions: DataFrame, limit: int = -1) -> tuple[DataFrame, DataFrame]:
    """Scenes with their image and prompt, and the scenes that lack one of them."""
    if limit >= 0:
        scenes = scenes.orderBy("scene_id").limit(limit)
    d = scenes.join(images, "scene_id", "left").join(captions, "scene_id", "left")
    ok = F.col("image_path").isNotNull() & F.col("prompt").isNotNull()
    return d.where(ok), d.where(~ok)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAJECTORY_SCHEMA).parquet(path)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    from wayscore.operators.captions import parse_captions
    return parse_captions(spark.read.text(path, wholetext=True), "value")


def read_result_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from wayscore.operators.report import parse_result_lines
    return parse_result_lines(spark.read.text(path), "value", schema)


def read_caption_reports(spark: SparkSession, summaries: str, reports: str) -> tuple[DataFrame, DataFrame]:
    """Scene rows and claim rows from batch summaries and pair reports; folder names give model and scene."""
    from wayscore.operators.report import caption_claims, caption_summaries
    part = lambda n: F.element_at(F.split("_metadata.file_path", "/"), n)
    s = spark.read.text(summaries, wholetext=True).select(part(-2).alias("model_key"), "value")
    r = spark.read.text(reports, wholetext=True).select(part(-3).alias("model_key"), part(-2).alias("scene"), "value")
    scenes = caption_summaries(s, "model_key", "value")
    return scenes, caption_claims(r, "model_key", "scene", "value", scenes)


def read_answer_tree(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of a tree of JSON files; files that hold no list and items without a verdict are skipped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return answer_items(files, "value")


def answer_items(df: DataFrame, column: str) -> DataFrame:
    """Items with a verdict from JSON lists; other top levels and items are left out."""
    v = F.try_parse_json(column)
    keep = [c for c in df.columns if c != column]
    lists = df.select(*keep, v.alias("_v")).where(F.schema_of_variant("_v").startswith("ARRAY"))
    items = lists.select(*keep, F.explode(F.try_variant_get("_v", "$", "array<variant>")).alias("_i"))
    return items.select(*keep, F.try_variant_get("_i", "$.is_correct", "boolean").alias("is_correct")).where("is_correct IS NOT NULL")


def read_tracker_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Tracker result files: one box per line, separated by tabs, commas or blanks; the file name is the sequence.

    Frame numbers come from the line order inside each (small) file.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt$", 1).alias("seq"), "value")
    return parse_tracker_boxes(files, "value")


def parse_tracker_boxes(df: DataFrame, column: str) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    lines = df.select(*keep, F.posexplode(F.split(F.regexp_replace(column, r"\s+$", ""), "\r?\n")).alias("frame", "_l"))
    return lines.select(*keep, "frame", *tracker_box(F.col("_l")))


def tracker_box(line: Column) -> list[Column]:
    parts = F.split(tx.strip(line), r"[\t,]\s*| +")
    return [F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x", "y", "w", "h"))]


def pad_to_truth(results: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Results for every truth frame; missing boxes are zero, extra frames are dropped."""
    d = truth.select(*keys, "frame").join(results, [*keys, "frame"], "left")
    return d.fillna(0.0, ["x", "y", "w", "h"])


# ---- clip names -----------------------------------------------------------------------------

def dashed_clip(c: Column) -> Column:
    """task-episode-video-first-last, with an optional clips/ prefix and .mp4 suffix."""
    p = F.split(F.regexp_replace(F.regexp_replace(tx.strip(c), "^clips/", ""), r"\.mp4$", ""), "-")
    at = lambda i: F.get(p, F.lit(i))
    return F.struct(at(0).alias("task"), at(1).alias("episode"), at(2).alias("video"), at(3).try_cast("int").alias("first_frame"), at(4).try_cast("int").alias("last_frame"))


def coarse_fine_clip(c: Column) -> Column:
    """prefix_coarse_i_fine_j to (prefix, fine id); nulls when the name has another form."""
    pat = r"^(.*?)_coarse_(\d+)_fine_(\d+)"
    return F.struct(F.nullif(F.regexp_extract(c, pat, 1), F.lit("")).alias("prefix"), F.regexp_extract(c, pat, 3).try_cast("int").alias("fine_id"))


def dotted_clip(c: Column) -> Column:
    """folder.episode.x.clipNNN.ext to (folder, episode, last frame)."""
    p = F.split(c, r"\.")
    return F.struct(F.translate(F.get(p, F.lit(0)), "-", "/").alias("folder"), F.get(p, F.lit(1)).alias("episode"),
                    F.lit(0).alias("first_frame"), F.substring(F.get(p, F.lit(3)), -3, 3).try_cast("int").alias("last_frame"))

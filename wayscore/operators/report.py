"""Leaderboards and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.functions import text as tx

# Display names of model folders (fixed values).
MODEL_NAMES = {
    "ltx_2b": "LTX-2B",
    "ltx_13b": "LTX-13B",
    "nvidia-cosmos-predict-2.5-2b": "NVIDIA Cosmos 2.5-2B",
    "vista-2b": "Vista-2B",
    "wan2.2-5b": "WAN2.2-5B",
    "ltx-video-2b": "LTX-2B",
    "ltx-video-13b": "LTX-13B",
    "nvidia-cosmos-predict2-2b": "NVIDIA Cosmos 2.5-2B",
    "vista": "Vista-2B",
    "ltx-video-2bx": "LTX-2B",
    "ltx-video-13bx": "LTX-13B",
    "nvidia-cosmos-predict2.5-2b": "NVIDIA Cosmos 2.5-2B",
    "vista2b": "Vista-2B",
}


def display_name(c: Column, names: Mapping[str, str] = MODEL_NAMES) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def parse_result_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """``model: {dict}`` lines to typed columns; lines that do not parse are left out."""
    at = F.instr(column, ":")
    body = tx.strip(F.expr(f"substring({column}, instr({column}, ':') + 1)"))
    for old, new in ((r"(^|[{\[,:])(\s*)'", '$1$2"'), (r"'(\s*)($|[,:}\]])", '"$1$2'), (r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bnan\b", "null")):
        body = F.regexp_replace(body, old, new)
    d = lines.where(at > 0).select(
        tx.strip(F.expr(f"substring({column}, 1, instr({column}, ':') - 1)")).alias("raw_model"), F.from_json(body, schema).alias("_r"))
    return d.where("_r IS NOT NULL").select("raw_model", display_name(F.col("raw_model")).alias("model"), "_r.*")


SUMMARY_SCHEMA = ("array<struct<pair_id:string,status:string,caption_usage_score:double,weighted_caption_usage_score:double,"
                  "num_claims:int,category_scores:map<string,double>>>")
REPORT_SCHEMA = "struct<claim_results:array<struct<category:string,claim_type:string,importance:double,final_score:double,usage_label:string,claim:string>>>"


def caption_summaries(df: DataFrame, model: str, body: str) -> DataFrame:
    """Scene rows of the successful pairs from batch summaries (one JSON list per model or file)."""
    rows = df.select(F.col(model).alias("model_key"), F.explode(F.from_json(body, SUMMARY_SCHEMA)).alias("r")).where("r.status = 'success'")
    return rows.select(
        "model_key", display_name(F.col("model_key")).alias("model"), F.col("r.pair_id").alias("scene"), "r.caption_usage_score",
        "r.weighted_caption_usage_score", F.coalesce("r.num_claims", F.lit(0)).alias("num_claims"), "r.category_scores")


def caption_claims(df: DataFrame, model: str, scene: str, body: str, scenes: DataFrame) -> DataFrame:
    """Claim rows from pair reports, for the successful scenes only."""
    c = df.select(display_name(F.col(model)).alias("model"), F.col(scene).alias("scene"), F.explode(F.from_json(body, REPORT_SCHEMA)["claim_results"]).alias("c"))
    out = c.select("model", "scene", F.coalesce("c.category", F.lit("unknown")).alias("category"), F.coalesce("c.claim_type", F.lit("unknown")).alias("claim_type"),
                   F.coalesce("c.importance", F.lit(0.0)).alias("importance"), F.coalesce("c.final_score", F.lit(0.0)).alias("final_score"),
                   F.coalesce("c.usage_label", F.lit("")).alias("usage_label"), F.coalesce("c.claim", F.lit("")).alias("claim"))
    return out.join(scenes.select("model", "scene").distinct(), ["model", "scene"], "left_semi")


def spread(c: str) -> Column:
    """Population deviation, 0 for fewer than two values."""
    return F.when(F.count(c) < 2, 0.0).otherwise(F.stddev_pop(c))


def model_leaderboard(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("model").agg(
        F.count(F.lit(1)).alias("num_scenes"), F.avg("caption_usage_score").alias("mean_caption_usage_score"),
        spread("caption_usage_score").alias("std_caption_usage_score"), F.avg("weighted_caption_usage_score").alias("mean_weighted_caption_usage_score"))


def category_table(scenes: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Mean category score per model; the overall-impression category stays out."""
    e = scenes.select("model", F.explode("category_scores").alias("category", "v")).where("category <> 'global_subjective' AND v IS NOT NULL")
    return e.groupBy("model").pivot("category", list(categories)).agg(F.avg("v"))


def common_scenes(scenes: DataFrame, model: str = "model", scene: str = "scene") -> DataFrame:
    """Scenes that every model has."""
    total = scenes.select(model).distinct().agg(F.count(F.lit(1)).alias("_total"))
    per = scenes.select(scene, model).distinct().groupBy(scene).agg(F.count(F.lit(1)).alias("_n"))
    return per.join(F.broadcast(total)).where("_n = _total").select(scene)


def common_summary(scenes: DataFrame) -> DataFrame:
    d = scenes.join(common_scenes(scenes), "scene", "left_semi")
    return d.groupBy("model").agg(F.count(F.lit(1)).alias("num_common_scenes"), F.avg("weighted_caption_usage_score").alias("mean_common_weighted_score"))


def scene_difficulty(scenes: DataFrame, tie: str = "model") -> DataFrame:
    """Mean score and best model per scene, hardest first by ``mean_weighted_score``."""
    s = F.col("weighted_caption_usage_score")
    return scenes.groupBy("scene").agg(
        F.avg(s).alias("mean_weighted_score"), F.count(F.lit(1)).alias("num_models"),
        F.min_by("model", F.struct(-s, F.col(tie))).alias("best_model"), F.max(s).alias("best_score"))


def metric_table(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Category and metric by model with four places, a dash where there is no value."""
    p = rows.groupBy("category", "metric").pivot("model", list(models)).agg(F.first("value"))
    text = lambda c: F.coalesce(F.regexp_replace(F.format_number(F.col(f"`{c}`"), 4), ",", ""), F.lit("-"))
    return p.select("category", "metric", *[text(m).alias(m) for m in models])


def sheet_row(rows: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """One spreadsheet formula per model with its metrics in order; missing values stay empty."""
    p = rows.groupBy(by).pivot("metric", list(metrics)).agg(F.first("value"))
    cell = lambda c: F.coalesce(F.regexp_replace(F.format_number(F.col(f"`{c}`"), 4), ",", ""), F.lit(""))
    vals = F.concat_ws(",", *[cell(m) for m in metrics])
    return p.select(by, F.concat(F.lit('=SPLIT("'), vals, F.lit('", ",")')).alias("formula"))


def rescale_quality(score: Column, mean: Column, std: Column, z_min: Column, z_max: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """z-score against a reference distribution, clipped to its range and mapped to [lo, hi]."""
    z = (score - mean) / (std + 1e-9)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (z - z_min) / (z_max - z_min + 1e-9)))
    return scaled * (hi - lo) + lo


def missing_agents(df: DataFrame, scene: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per scene: any unnatural disappearance, and how many agents; overall: 1 minus the share of such scenes."""
    per = df.groupBy(*scene).agg(
        F.max(F.col("unnatural").cast("int")).alias("any_missing"), F.count(F.lit(1)).alias("agents"),
        F.sum(F.col("unnatural").cast("int")).alias("missing_agents"))
    total = per.agg((1 - F.avg("any_missing")).alias("agent_missing"), F.sum("agents").alias("agents"),
                    (1 - F.sum("missing_agents") / F.sum("agents")).alias("agent_level_missing"))
    return per, total


def objective_quality(frames: DataFrame, video: Sequence[str], metrics: Sequence[str], inverted: Sequence[str] = ("fmp_alias",)) -> DataFrame:
    """Frame mean per video, then mean over videos, as rows (metric, value); some metrics count as 1 - x."""
    per = frames.groupBy(*video).agg(*[F.avg(F.nanvl(F.col(m), F.lit(None))).alias(m) for m in metrics])
    tot = per.agg(*[F.avg((1 - F.col(m)) if m in inverted else F.col(m)).alias(m) for m in metrics])
    return tot.unpivot([], list(metrics), "metric", "value")

"""Caption claims, verdicts, fusion and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.functions import text as tx
from wayscore.operators.ordered import spread_by_key


def fallback_claims(captions: DataFrame, key: str, caption: str, keep: Sequence[str] = ()) -> DataFrame:
    """One claim per sentence, with a category and verifier chosen by key words; columns ``keep`` come along.

    Captions are dealt over the shuffle partitions by their key first: sentences and key words cost far more than the
    bytes of a caption say, and what follows groups by that key.
    """
    d = spread_by_key(captions, key).select(key, *keep, F.posexplode(tx.sentences(F.col(caption))).alias("_pos", "claim")).where(F.length("claim") > 0)
    d = d.withColumn("_low", F.lower("claim"))  # a column of its own, so that it is made once and not for every key word
    cat = None
    for name, words in tx.CATEGORY_WORDS:
        cond = tx.has_any(F.col("_low"), words)
        cat = F.when(cond, name) if cat is None else cat.when(cond, name)
    d = d.withColumn("category", cat.otherwise("global_subjective"))
    verifier = F.when(F.col("category").isin("traffic_agents", "actions"), tx.BOTH_VERIFIERS).otherwise(tx.LANGUAGE_VERIFIER)
    return d.select(
        key, *keep, (F.col("_pos") + 1).alias("pos"), F.concat(F.lit("C"), (F.col("_pos") + 1).cast("string")).alias("claim_id"), "claim", "category",
        F.lit("unknown").alias("claim_type"), verifier.alias("preferred_verifier"), F.lit(3).alias("importance"),
        F.concat(F.lit("Is the following claim visible in the video: "), "claim").alias("question"))


def clean_claims(claims: DataFrame) -> DataFrame:
    """Known categories and verifiers only, importance 1..5, no empty claims, appearance terms never to the detector."""
    d = claims.withColumn("claim", tx.strip(F.coalesce("claim", F.lit("")))).where(F.length("claim") > 0)
    d = d.withColumns({"_low": F.lower("claim"), "_cat": tx.strip(F.coalesce("category", F.lit("environment"))),
                       "_ver": tx.strip(F.coalesce("preferred_verifier", F.lit(tx.LANGUAGE_VERIFIER)))})
    cat, ver = F.col("_cat"), F.col("_ver")
    known = ver.isin(tx.LANGUAGE_VERIFIER, tx.DETECTOR_VERIFIER, tx.BOTH_VERIFIERS) & ~tx.has_any(F.col("_low"), tx.NOT_FOR_DETECTOR)
    imp = F.coalesce(F.col("importance").cast("string").try_cast("int"), F.lit(3))
    return d.withColumns({
        "category": F.when(cat.isin(*tx.CATEGORIES), cat).otherwise("environment"),
        "preferred_verifier": F.when(known, ver).otherwise(tx.LANGUAGE_VERIFIER),
        "importance": F.greatest(F.lit(1), F.least(F.lit(5), imp)),
    }).drop("_low", "_cat", "_ver")


def detector_score(text: Column, counts: dict[str, Column], stability: Column, red_to_green: Column) -> Column:
    """Score a claim from track counts by key word, in rule order; null where the detector has no say.

    ``counts`` holds vehicles, moving, persons and lights. ``stability`` is null when
    the camera was not measured.
    """
    any_ = lambda words: tx.has_any(text, words)
    zero = lambda c: F.coalesce(c, F.lit(0))
    moving, vehicles, persons, lights = (zero(counts[k]) for k in ("moving", "vehicles", "persons", "lights"))
    flag = lambda n: F.when(n >= 1, 1.0).otherwise(0.0)
    car = F.when(any_(tx.MOTION_WORDS), F.when(moving >= 2, 1.0).when(moving == 1, 0.5).otherwise(0.0)).otherwise(flag(vehicles))
    light = F.when(
        any_(tx.CHANGE_WORDS),
        F.when(F.coalesce(red_to_green, F.lit(False)), 1.0).when(lights >= 1, 0.5).otherwise(0.0)).otherwise(flag(lights))
    return (
        F.when(any_(tx.VEHICLE_WORDS), car).when(any_(tx.PERSON_WORDS), flag(persons)).when(any_(("traffic light", "traffic lights")), light)
        .when(any_(tx.STILL_WORDS) & stability.isNotNull(), tx.normalize_score(stability)))


def fuse_scores(language: Column, detector: Column, verifier: Column, fuse: bool = True) -> Column:
    """Weighted mix of the two scores by preferred verifier, three places."""
    if not fuse:
        return language
    mix = (
        F.when(verifier == tx.DETECTOR_VERIFIER, 0.7 * detector + 0.3 * language)
        .when(verifier == tx.BOTH_VERIFIERS, 0.5 * detector + 0.5 * language).otherwise(0.8 * language + 0.2 * detector))
    return F.when(detector.isNull(), language).otherwise(F.bround(mix, 3))


def combine_verdicts(claims: DataFrame, verdicts: DataFrame, key: str, order: str) -> DataFrame:
    """Claims with their verdict; the last verdict of a repeated id counts and a missing one is .5."""
    v = verdicts.withColumn("claim_id", tx.strip("claim_id") if isinstance("claim_id", Column) else tx.strip(F.col("claim_id")))
    v = v.where(F.length("claim_id") > 0).groupBy(key, "claim_id").agg(F.max_by("raw_score", order).alias("raw_score"), F.count(F.lit(1)).alias("verdicts"))
    d = claims.join(v, [key, "claim_id"], "left")
    return d.withColumns({"language_score": F.when(F.col("verdicts").isNull(), 0.5).otherwise(tx.normalize_score(F.col("raw_score"))),
                          "verdicts": F.coalesce("verdicts", F.lit(0))})


def caption_report(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean and importance-weighted score (percent), category means and counts per caption.

    Scores have three places, so they are added as whole thousandths: the sums do
    not depend on the order of the rows.
    """
    milli = F.round(F.col("final_score") * 1000).cast("long")
    in_cat = lambda c: F.when(F.col("category") == c, milli)
    per_cat = [F.avg(in_cat(c)).alias(f"_{c}") for c in tx.CATEGORIES]
    label = lambda cond: F.sum(cond.cast("int"))
    s = F.col("final_score")
    g = results.groupBy(*key).agg(
        F.sum(milli).alias("_s"), F.sum(milli * F.col("importance")).alias("_w"), F.sum("importance").alias("_i"), F.count(F.lit(1)).alias("num_claims"),
        label(s >= 0.75).alias("most_followed"), label((s > 0.25) & (s < 0.75)).alias("partially_followed"), label(s <= 0.25).alias("least_followed"), *per_cat)
    pct = lambda c: tx.half_even(c / 10.0, 2)
    return g.select(
        *key, "num_claims", pct(F.col("_s") / F.col("num_claims")).alias("caption_usage_score"),
        pct(F.col("_w") / F.greatest(F.lit(1), F.col("_i"))).alias("weighted_caption_usage_score"),
        *[pct(F.col(f"_{c}")).alias(c) for c in tx.CATEGORIES], "most_followed", "partially_followed", "least_followed")


def followed_claims(results: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Claims with their group (most, partly, least followed) and their place in it."""
    from pyspark.sql import Window as W
    s = F.col("final_score")
    group = F.when(s >= 0.75, "most").when(s <= 0.25, "least").otherwise("partly")
    d = results.withColumn("follow_group", group).withColumn("_o", F.when(F.col("follow_group") == "least", s).otherwise(-s))
    return d.withColumn("place", F.row_number().over(W.partitionBy(*key, "follow_group").orderBy("_o", order))).drop("_o")


def light_events(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Colour events per video from red and green pixel shares."""
    red = (F.col("red_ratio") > 0.02) & (F.col("red_ratio") > F.col("green_ratio") * 1.5)
    green = (F.col("green_ratio") > 0.02) & (F.col("green_ratio") > F.col("red_ratio") * 1.5)
    c = F.when(red, "red").when(green, "green")
    at = lambda name: F.when(c == name, F.col("frame"))
    g = df.groupBy(*key).agg(
        F.count(c).alias("num_color_events"), F.min(at("red")).alias("first_red_frame"), F.min(at("green")).alias("first_green_frame"), F.max(at("green")).alias("_lg"))
    return g.select(*key, "num_color_events", "first_red_frame", "first_green_frame",
                    F.coalesce(F.col("first_red_frame") < F.col("_lg"), F.lit(False)).alias("red_to_green"))


def camera_stability(df: DataFrame, key: Sequence[str], diagonal: float) -> DataFrame:
    """Stability score from frame-pair translations and rotations."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("valid_pairs"), F.avg("translation").alias("_t"), F.avg("rotation").alias("_r"))
    n = F.col("_t") / max(diagonal, 1.0)
    score = F.when((n < 0.005) & (F.col("_r") < 0.5), 1.0).when((n < 0.02) & (F.col("_r") < 2.0), 0.5).otherwise(0.0)
    return g.select(*key, "valid_pairs", F.bround("_t", 3).alias("avg_translation_px"), F.bround(n, 5).alias("avg_translation_norm"),
                    F.bround("_r", 3).alias("avg_rotation_deg"), score.alias("camera_stability_score"))


# ---- captions and their videos ---------------------------------------------------------------

ITEM_KEYS = ("video", "video_path", "filename", "file")


def parse_captions(df: DataFrame, column: str) -> DataFrame:
    """(video_key, caption) from three JSON shapes: key to text, key to object, or a list of objects."""
    d = df.withColumn("_v", F.try_parse_json(column))
    field = lambda c, p: F.try_variant_get(c, p, "string")
    as_map = F.from_json(F.col(column), "map<string,string>")
    as_list = F.from_json(F.col(column), "array<struct<video:string,video_path:string,filename:string,file:string,caption:string>>")
    is_list = F.schema_of_variant("_v").startswith("ARRAY")
    keep = [c for c in df.columns if c != column]
    objects = d.where(~is_list).select(*keep, F.explode(as_map).alias("video_key", "_val"))
    inner = F.try_parse_json("_val")
    inside = F.when(F.col("_val").startswith("{"), field(inner, "$.caption")).otherwise(F.col("_val"))
    a = objects.select(*keep, "video_key", inside.alias("caption"))
    item = d.where(is_list).select(*keep, F.explode(as_list).alias("_i"))
    key = F.coalesce(*[F.nullif(F.col(f"_i.{k}"), F.lit("")) for k in ITEM_KEYS])
    b = item.select(*keep, key.alias("video_key"), F.col("_i.caption").alias("caption"))
    out = a.unionByName(b).where("video_key IS NOT NULL AND caption IS NOT NULL")
    return out.withColumn("caption", tx.strip(F.col("caption")))


def pair_captions(videos: DataFrame, mapping: DataFrame, folder: DataFrame | None = None) -> DataFrame:
    """Caption of every video by key priority (path, full path, name, stem), then from the caption folder.

    ``videos`` holds path and full_path, ``mapping`` holds video_key and caption,
    ``folder`` holds stem and caption. A video without a caption has null.
    """
    name = tx.file_name(F.col("path"))
    keys = F.array(F.col("path"), F.col("full_path"), name, tx.without_suffix(name))
    cand = videos.select("path", F.posexplode(keys).alias("priority", "video_key"))
    hit = cand.join(mapping, "video_key").groupBy("path").agg(F.min_by("caption", "priority").alias("_m"))
    d = videos.join(hit, "path", "left").withColumn("stem", tx.without_suffix(name))
    if folder is not None:
        d = d.join(folder.withColumnRenamed("caption", "_f"), "stem", "left")
    else:
        d = d.withColumn("_f", F.lit(None).cast("string"))
    text = tx.strip(F.coalesce("_m", "_f"))
    return d.select(*videos.columns, tx.pair_id(F.col("path")).alias("pair_id"), F.nullif(text, F.lit("")).alias("caption"))


# ---- questions and conversations ---------------------------------------------------------------

def question_tasks(videos: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks per video and question, and the videos that have no questions.

    ``videos`` holds file; ``questions`` holds video (``clips/<id>.<ext>``) and qa, a
    JSON object or a list of objects.
    """
    v = videos.where(F.col("file").rlike(r"\.(mp4|avi|mov)$")).withColumn("video_id", F.regexp_replace("file", r"\.[^.]*$", ""))
    schema = "array<struct<question:string,answer:string,correct_answer:string>>"
    listed = F.when(F.col("qa").startswith("["), F.col("qa")).otherwise(F.concat(F.lit("["), "qa", F.lit("]")))
    q = questions.where(F.col("video").rlike(r"^clips/.*\.")).select(
        F.regexp_replace(tx.file_name(F.col("video")), r"\.[^.]*$", "").alias("video_id"), F.from_json(listed, schema).alias("_qa"))
    d = v.join(q, "video_id").select("video_id", F.posexplode("_qa").alias("idx", "_q"))
    tasks = d.select("video_id", "idx", F.col("_q.question").alias("question"),
                     F.coalesce("_q.correct_answer", "_q.answer", F.lit("")).alias("correct_answer"))
    return tasks, v.join(q, "video_id", "left_anti")


def conversation(system: Column, user: Column, images: Column, videos: Column, response: Column, max_pixels: int | None = None) -> Column:
    """Chat turns as an array of (role, content parts); media come before the text."""
    px = F.lit(max_pixels).cast("int")
    part = lambda kind, **kw: F.struct(
        F.lit(kind).alias("type"), *[kw.get(k, F.lit(None).cast("string")).alias(k) for k in ("text", "image", "video")],
        (px if kind != "text" else F.lit(None).cast("int")).alias("max_pixels"))
    none = F.array().cast("array<string>")
    imgs = F.transform(F.coalesce(images, none), lambda i: part("image", image=i))
    vids = F.transform(F.coalesce(videos, none), lambda i: part("video", video=i))
    say = lambda c: F.array(part("text", text=c))
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    nothing = F.filter(say(F.lit("")), lambda x: F.lit(False))
    user_content = F.concat(imgs, vids, F.when(has(user), say(user)).otherwise(nothing))
    turns = F.array(
        F.when(has(system), turn("system", say(system))), turn("user", user_content), F.when(has(response), turn("assistant", say(response))))
    return F.array_compact(turns)


def answer_accuracy(df: DataFrame, answer: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of answers equal to the truth, ignoring case; rows without a verdict do not count."""
    ok = (F.lower(answer) == F.lower(truth)).cast("int")
    return df.groupBy(*by).agg(F.count(ok).alias("samples"), F.sum(ok).alias("correct"), F.avg(ok).alias("accuracy"))


def skip_done(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")

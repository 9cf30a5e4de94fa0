"""Text and model-output helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str methods and \s see it (fixed value).
SPACE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))
# Words that stand for a score (fixed values).
YES_WORDS = ("yes", "true", "followed", "clearly followed", "1", "1.0")
HALF_WORDS = ("partial", "partially", "ambiguous", "unclear", "0.5")
NO_WORDS = ("no", "false", "not followed", "ignored", "missing", "0", "0.0")
# Label and colour of a score: at least .75, at most .25, between (fixed values).
SCORE_LABELS = ("followed", "ignored", "partially_followed")
SCORE_COLORS = ("#c8f7c5", "#ffc7c7", "#fff3b0")
# Claim categories, verifiers and the key words that choose them, in rule order (fixed values).
CATEGORIES = ("actions", "ego_vehicle", "environment", "global_subjective", "traffic_agents")
LANGUAGE_VERIFIER, DETECTOR_VERIFIER, BOTH_VERIFIERS = "qwen_vl", "yolo", "both"
CATEGORY_WORDS = (
    ("ego_vehicle", ("camera", "ego", "mounted", "forward", "stationary")),
    ("traffic_agents", ("vehicle", "vehicles", "cars", "truck", "bus", "pedestrian", "traffic light")),
    ("actions", ("change", "move", "pass", "cross", "turn", "stop", "follows")),
    ("environment", ("night", "urban", "street", "intersection", "wet", "building", "crosswalk", "rain", "overcast",
                     "tree", "barrier", "sign")),
)
NOT_FOR_DETECTOR = (
    "wet", "overcast", "rain", "wiper", "windshield", "tree", "barrier", "sign", "speed limit", "sky", "weather",
    "road surface", "calm", "quiet", "atmosphere", "headlights", "reflections",
)
VEHICLE_WORDS = ("car", "cars", "vehicle", "vehicles", "truck", "bus")
MOTION_WORDS = ("pass", "passes", "move", "moves", "moving", "drives", "drive", "through", "cross", "travel", "traveling")
PERSON_WORDS = ("pedestrian", "person", "people")
CHANGE_WORDS = ("red to green", "change", "changes", "turns green")
STILL_WORDS = ("stationary", "stable", "consistent view", "camera remains")
# Detector class names by group (fixed values).
VEHICLE_CLASSES = ("car", "truck", "bus", "motorcycle", "motorbike", "bicycle", "van")
PERSON_CLASSES = ("person", "pedestrian")
LIGHT_CLASSES = ("traffic light", "traffic_light")


def half_even(c: Column, digits: int) -> Column:
    """Scale, round halves to even, scale back."""
    t = c * float(10 ** digits)
    f = F.floor(t)
    up = F.when(t - f > 0.5, f + 1).when(t - f < 0.5, f).otherwise(f + F.abs(f % 2))
    return up / float(10 ** digits)


def strip(c: Column) -> Column:
    """Without white space at both ends; looks at the ends only, where a pattern would be tried at every position."""
    return F.btrim(c, F.lit(SPACES))


def has_any(c: Column, words) -> Column:
    hit = c.contains(words[0])
    for w in words[1:]:
        hit = hit | c.contains(w)
    return hit


def normalize_score(c: Column) -> Column:
    """Free text or number to 0, .5 or 1; anything unreadable is .5."""
    s = F.lower(strip(c.cast("string")))
    val = F.least(F.greatest(F.expr("0.0D"), F.least(s.try_cast("double"), F.lit(1.0))), F.lit(1.0))
    num = F.when(val >= 0.75, 1.0).when(val <= 0.25, 0.0).otherwise(0.5)
    return (
        F.when(s.isin(*YES_WORDS), 1.0).when(s.isin(*HALF_WORDS), 0.5).when(s.isin(*NO_WORDS), 0.0)
        .when(s.try_cast("double").isNull(), 0.5).otherwise(num))


def _three_way(score: Column, values) -> Column:
    return F.when(score >= 0.75, values[0]).when(score <= 0.25, values[1]).otherwise(values[2])


def score_label(score: Column) -> Column:
    return _three_way(score, SCORE_LABELS)


def score_color(score: Column) -> Column:
    return _three_way(score, SCORE_COLORS)


def sanitize_name(c: Column) -> Column:
    """Runs of other characters than word characters, dash and dot become one underscore; ends trimmed."""
    c = F.regexp_replace(c, r"(?U)[^\w\-.]+", "_")
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_+|_+$", "")


def clean_symbols(c: Column) -> Column:
    """Special characters to underscores."""
    return F.regexp_replace(c, "[|@#!¡·$€%&()=?¿^*;:,¨´><+]", "_")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def pair_id(path: Column, root: str | None = None) -> Column:
    """Identifier of a video: its path below the root with parts joined by __, or its stem."""
    stem = sanitize_name(without_suffix(file_name(path)))
    if root is None:
        return stem
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(path, "^" + re.escape(prefix), "")
    return F.when(path.startswith(prefix), sanitize_name(F.regexp_replace(without_suffix(rel), "/", "__"))).otherwise(stem)


def remove_root(path: Column, root: str) -> Column:
    """Path below ``root``; unchanged when the first part is another one."""
    root = root.strip("/")
    return F.regexp_replace(path, "^/?" + re.escape(root) + "/", "")


def lenient_json(c: Column) -> Column:
    """Variant parsed from model text: a fenced block or the whole, else the outer {...}, else the outer [...]."""
    fence = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)```", 1)
    text = strip(F.when(c.rlike(r"(?is)```(?:json)?\s*(.*?)```"), fence).otherwise(c))
    obj = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    arr = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    pick = lambda t: F.try_parse_json(F.when(F.length(t) > 0, t))
    return F.coalesce(pick(text), pick(obj), pick(arr))


def sentences(c: Column) -> Column:
    """Split after sentence marks that are followed by white space."""
    return F.split(strip(c), r"(?<=[.!?])" + SPACE + "+")


TAG = r"(?s)<([a-zA-Z]*?)>(.*?)</\1>"


def tagged_parts(c: Column) -> tuple[Column, Column]:
    """Tagged pieces as an array of (tag, text) and the remaining pieces; unclosed tags are dropped."""
    tags = F.regexp_extract_all(c, F.lit(TAG), F.lit(1))
    bodies = F.regexp_extract_all(c, F.lit(TAG), F.lit(2))
    parts = F.split(F.regexp_replace(c, TAG, "\u0001"), "\u0001|<[a-zA-Z]*>")
    rest = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.arrays_zip(tags.alias("tag"), bodies.alias("text")), rest


def letter_in_answer(c: Column) -> Column:
    """First capital letter inside the answer tag, else an empty text."""
    return first_letter(F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1))


def first_letter(c: Column) -> Column:
    return F.regexp_extract(c, LETTER, 0)


LETTER = "[A-Z]"


def reasoning(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1))


def natural_verdict(c: Column) -> Column:
    """natural or unnatural inside the answer tag, or null."""
    inner = F.regexp_replace(F.regexp_extract(c, r"(?is)<answer>(.*?)</answer>", 1), "<[^>]+>", "")
    return F.nullif(F.lower(F.regexp_extract(inner, r"(?i)\b(natural|unnatural)\b", 1)), F.lit(""))


CRITIC_SCHEMA = ("STRUCT<think: STRUCT<overview: STRING, component: ARRAY<STRUCT<_name: STRING, analysis: STRING, anomaly: STRING>>>, answer: STRING>")


def critic_answer(c: Column) -> Column:
    """Critic reply (overview, components, answer) from tagged text; malformed text gives null fields."""
    return F.from_xml(F.concat(F.lit("<root>"), strip(c), F.lit("</root>")), CRITIC_SCHEMA, {"mode": "PERMISSIVE"})


def shorten(c: Column, limit: int = 46) -> Column:
    text = strip(F.regexp_replace(F.translate(c, "+_", "  "), SPACE + "+", " "))
    cut = F.regexp_replace(F.substring(text, 1, limit - 3), SPACE + "+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def file_stem(c: Column) -> Column:
    """Pair id to file stem: every underscore becomes a plus."""
    return F.translate(c, "_", "+")

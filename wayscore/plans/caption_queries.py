"""Claims, verdicts, reports, leaderboards and text helpers on the driver tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.functions import text as tx
from wayscore.operators import captions as cp
from wayscore.operators import ranking as rk
from wayscore.operators import report as rp
from wayscore.operators.ordered import grouped_quantiles
from wayscore.plans import views as v
from wayscore.plans.registry import query

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def any_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_CAT = " ".join(f"WHEN {any_sql('low', words)} THEN '{name}'" for name, words in tx.CATEGORY_WORDS)
# Sentences appended to the captions, by doc_id % 4, so that every rule is met.
EXTRA = (" A car passes the corner. Two people wait. The view is stable! ", " Vehicles park by a tree.\nThe traffic light changes? A person stands. ",
         " The camera remains still. A truck turns at night.  The traffic light is on. ", "")
_EX = "[" + ",".join("'" + e + "'" for e in EXTRA) + "][1 + doc_id % 4]"
v._sql("claims", f"""
WITH p AS (SELECT doc_id, n_chars, string_split(regexp_replace({strip_sql('text || ' + _EX)}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
s AS (SELECT doc_id, n_chars, unnest(generate_series(1, len(parts))) AS pos, parts FROM p),
c AS (SELECT doc_id, n_chars, pos, {strip_sql('parts[pos]')} AS claim FROM s),
l AS (SELECT *, lower(claim) AS low FROM c WHERE length(claim) > 0)
SELECT doc_id, n_chars, pos, 'C' || pos AS claim_id, claim, low, CASE {_CAT} ELSE 'global_subjective' END AS category FROM l
""")


def claims(spark, d):
    extra = F.get(F.array(*[F.lit(e) for e in EXTRA]), (F.col("doc_id") % 4).cast("int"))
    docs = v.table(spark, d, "documents").select("doc_id", "n_chars", F.concat("text", extra).alias("text"))
    return cp.fallback_claims(docs, "doc_id", "text", ["n_chars"])


@query("fallback_claims", "B19", "doc_id:l pos:l claim_id:s claim:s category:s preferred_verifier:s importance:l", "claims", """
SELECT *, CASE WHEN category IN ('traffic_agents','actions') THEN 'both' ELSE 'qwen_vl' END AS preferred_verifier, 3 AS importance FROM claims""")
def _(spark, d):
    return claims(spark, d)


RAW_IMPORTANCE = "CASE pos % 6 WHEN 0 THEN '7' WHEN 1 THEN 'abc' WHEN 2 THEN '-3' WHEN 3 THEN '4.5' ELSE CAST(pos % 5 AS VARCHAR) END"
v._sql("cleaned", f"""
WITH r AS (SELECT doc_id, n_chars, pos, claim_id, claim, low, CASE WHEN pos % 11 = 0 THEN 'scenery' ELSE category END AS rawcat,
  CASE pos % 5 WHEN 0 THEN 'yolo' WHEN 1 THEN 'both' WHEN 2 THEN 'human' ELSE 'qwen_vl' END AS rawver, {RAW_IMPORTANCE} AS imp FROM claims)
SELECT doc_id, n_chars, pos, claim_id, claim, low, CASE WHEN rawcat = 'scenery' THEN 'environment' ELSE rawcat END AS category,
 CASE WHEN {any_sql('low', tx.NOT_FOR_DETECTOR)} OR rawver = 'human' THEN 'qwen_vl' ELSE rawver END AS preferred_verifier,
 greatest(1, least(5, CASE WHEN imp IN ('abc','4.5') THEN 3 ELSE TRY_CAST(imp AS INTEGER) END)) AS importance FROM r
""", "claims")


def cleaned(spark, d):
    c = claims(spark, d)
    p = F.col("pos")
    raw = c.withColumns({
        "category": F.when(p % 11 == 0, "scenery").otherwise(F.col("category")),
        "preferred_verifier": F.when(p % 5 == 0, "yolo").when(p % 5 == 1, "both").when(p % 5 == 2, "human").otherwise("qwen_vl"),
        "importance": F.when(p % 6 == 0, "7").when(p % 6 == 1, "abc").when(p % 6 == 2, "-3").when(p % 6 == 3, "4.5").otherwise((p % 5).cast("string"))})
    return cp.clean_claims(raw)


@query("cleaned_claims", "B20", "doc_id:l pos:l category:s preferred_verifier:s importance:l", "cleaned", "SELECT * FROM cleaned")
def _(spark, d):
    return cleaned(spark, d)


WORDS = ("yes", "Partial", " NO ", "0.8", "0.3", "bad", "1", "unclear", "missing", "-2", "0.76", "nan", "1e-3")
VALS = (1.0, 0.5, 0.0, 1.0, 0.5, 0.5, 1.0, 0.5, 0.0, 0.0, 1.0, 1.0, 0.0)


def _word(i):
    return F.get(F.array(*[F.lit(w) for w in WORDS]), (i % len(WORDS)).cast("int"))


@query("normalized_scores", "B14 B15", "doc_id:l score label:s color:s", "", f"""
WITH s AS (SELECT doc_id, [{','.join(map(str, VALS))}][1 + (doc_id + n_chars) % {len(WORDS)}] AS score FROM documents)
SELECT doc_id, score, CASE WHEN score >= 0.75 THEN 'followed' WHEN score <= 0.25 THEN 'ignored' ELSE 'partially_followed' END AS label,
 CASE WHEN score >= 0.75 THEN '#c8f7c5' WHEN score <= 0.25 THEN '#ffc7c7' ELSE '#fff3b0' END AS color FROM s""")
def _(spark, d):
    s = v.table(spark, d, "documents").select("doc_id", tx.normalize_score(_word(F.col("doc_id") + F.col("n_chars"))).alias("score"))
    return s.withColumns({"label": tx.score_label(F.col("score")), "color": tx.score_color(F.col("score"))})


v._sql("verd", f"""
SELECT c.*, CASE WHEN pos % 7 = 0 THEN 0 WHEN pos % 5 = 0 THEN 2 ELSE 1 END AS verdicts,
 CASE WHEN pos % 7 = 0 THEN 0.5 WHEN pos % 5 = 0 THEN [{','.join(map(str, VALS))}][1 + (doc_id + pos + 3) % {len(WORDS)}] ELSE [{','.join(map(str, VALS))}][1 + (doc_id + pos) % {len(WORDS)}] END AS language_score FROM cleaned c
""", "cleaned")


def verdicts(spark, d, *read):
    """Claims with verdicts on most of them; both are made from one shuffle of the captions, and no text is kept.

    The key of a verdict depends on its place, and on the columns of the captions that the caller will ``read``: a test
    for nulls on it then stays above the sentences, and both sides need the same columns, so the shuffle is one.
    """
    c = cleaned(spark, d)
    p = F.col("pos")
    n = F.when(p % 5 == 0, 2).otherwise(1)
    always = reduce(or_, [F.col(r).isNull() for r in read], p > 0)
    ids = c.where(p % 7 != 0).select(F.when(always, F.col("doc_id")).alias("doc_id"), "claim_id", "pos")
    raw = ids.select("doc_id", F.concat(F.lit(" "), "claim_id").alias("claim_id"), "pos", F.explode(F.sequence(F.lit(0), n - 1)).alias("copy"))
    raw = raw.withColumn("raw_score", _word(F.col("doc_id") + F.col("pos") + 3 * F.col("copy")))
    return cp.combine_verdicts(c, raw, "doc_id", "copy")


@query("claims_with_verdicts", "C4", "doc_id:l pos:l verdicts:l language_score", "verd", "SELECT * FROM verd")
def _(spark, d):
    return verdicts(spark, d)


_CAR = "CASE WHEN {m} THEN CASE WHEN n_chars % 3 >= 2 THEN 1.0 WHEN n_chars % 3 = 1 THEN 0.5 ELSE 0.0 END ELSE CASE WHEN n_chars % 4 >= 1 THEN 1.0 ELSE 0.0 END END".format(m=any_sql("t", tx.MOTION_WORDS))
_LIGHT = "CASE WHEN {c} THEN CASE WHEN n_chars % 10 = 3 THEN 1.0 WHEN n_chars % 6 >= 1 THEN 0.5 ELSE 0.0 END ELSE CASE WHEN n_chars % 6 >= 1 THEN 1.0 ELSE 0.0 END END".format(c=any_sql("t", tx.CHANGE_WORDS))
v._sql("fused", f"""
WITH t AS (SELECT *, low || ' ' || lower('Is the following claim visible in the video: ' || claim) AS t FROM verd),
s AS (SELECT *, CASE WHEN {any_sql('t', tx.VEHICLE_WORDS)} THEN {_CAR} WHEN {any_sql('t', tx.PERSON_WORDS)} THEN CASE WHEN n_chars % 5 >= 1 THEN 1.0 ELSE 0.0 END
 WHEN {any_sql('t', ('traffic light',))} THEN {_LIGHT} WHEN {any_sql('t', tx.STILL_WORDS)} AND n_chars % 2 = 0 THEN 0.5 END AS detector_score FROM t)
SELECT *, CASE WHEN detector_score IS NULL THEN language_score WHEN preferred_verifier = 'yolo' THEN round(0.7*detector_score + 0.3*language_score, 3)
 WHEN preferred_verifier = 'both' THEN round(0.5*detector_score + 0.5*language_score, 3) ELSE round(0.8*language_score + 0.2*detector_score, 3) END AS final_score FROM s
""", "verd")


def fused(spark, d):
    n = F.col("n_chars")
    c = verdicts(spark, d, "n_chars")
    c = c.withColumn("_text", F.lower(F.concat_ws(" ", "claim", "question")))
    det = cp.detector_score(F.col("_text"), {"vehicles": n % 4, "moving": n % 3, "persons": n % 5, "lights": n % 6}, F.when(n % 2 == 0, F.lit(0.5)), n % 10 == 3)
    c = c.withColumn("detector_score", det).drop("_text")
    return c.withColumn("final_score", cp.fuse_scores(F.col("language_score"), F.col("detector_score"), F.col("preferred_verifier")))


@query("fused_claim_scores", "B21 B22", "doc_id:l pos:l language_score detector_score final_score", "fused", "SELECT * FROM fused")
def _(spark, d):
    return fused(spark, d)


_C = ", ".join(f"round_even(avg(CASE WHEN category='{c}' THEN CAST(round(final_score*1000) AS BIGINT) END)/10.0, 2) AS {c}" for c in tx.CATEGORIES)
v._sql("report_", f"""
SELECT doc_id, count(*) AS num_claims, round_even(sum(CAST(round(final_score*1000) AS BIGINT))/count(*)/10.0, 2) AS caption_usage_score,
 round_even(sum(CAST(round(final_score*1000) AS BIGINT)*importance)/greatest(1, sum(importance))/10.0, 2) AS weighted_caption_usage_score, {_C},
 count(*) FILTER (WHERE final_score >= 0.75) AS most_followed, count(*) FILTER (WHERE final_score > 0.25 AND final_score < 0.75) AS partially_followed,
 count(*) FILTER (WHERE final_score <= 0.25) AS least_followed FROM fused GROUP BY doc_id
""", "fused")
REPORT = "caption_usage_score weighted_caption_usage_score " + " ".join(tx.CATEGORIES)


@query("caption_report", "D30", f"doc_id:l num_claims:l {REPORT} most_followed:l partially_followed:l least_followed:l", "report_", "SELECT * FROM report_")
def _(spark, d):
    return cp.caption_report(fused(spark, d), ["doc_id"])


@query("followed_claim_lists", "F4", "doc_id:l pos:l follow_group:s place:l final_score", "fused", """
WITH g AS (SELECT *, CASE WHEN final_score >= 0.75 THEN 'most' WHEN final_score <= 0.25 THEN 'least' ELSE 'partly' END AS follow_group FROM fused)
SELECT doc_id, pos, follow_group, final_score, row_number() OVER (PARTITION BY doc_id, follow_group ORDER BY CASE WHEN follow_group='least' THEN final_score ELSE -final_score END, pos) AS place FROM g""")
def _(spark, d):
    return cp.followed_claims(fused(spark, d), ["doc_id"], "pos")


@query("traffic_light_events", "D32", "video_id:l clip:l num_color_events:l first_red_frame:l first_green_frame:l red_to_green:b", "tracks", """
WITH r AS (SELECT video_id, clip, frame, least(cx,100)/1000 AS red, cy/1000 AS green FROM tracks),
c AS (SELECT *, CASE WHEN red > 0.02 AND red > green*1.5 THEN 'red' WHEN green > 0.02 AND green > red*1.5 THEN 'green' END AS c FROM r)
SELECT video_id, clip, count(c) AS num_color_events, min(CASE WHEN c='red' THEN frame END) AS first_red_frame, min(CASE WHEN c='green' THEN frame END) AS first_green_frame,
 coalesce(min(CASE WHEN c='red' THEN frame END) < max(CASE WHEN c='green' THEN frame END), false) AS red_to_green FROM c GROUP BY ALL""")
def _(spark, d):
    t = v.tracks(spark, d).withColumns({"red_ratio": F.least("cx", F.lit(100.0)) / 1000, "green_ratio": F.col("cy") / 1000})
    return cp.light_events(t, ["video_id", "clip"])


@query("camera_stability", "D33", "video_id:l clip:l valid_pairs:l avg_translation_px avg_translation_norm avg_rotation_deg camera_stability_score", "tracks", """
WITH g AS (SELECT video_id, clip, count(*) AS valid_pairs, avg(cx/sqrt(50.0)) AS t, avg(cy/sqrt(1090.0)) AS r FROM tracks GROUP BY ALL)
SELECT video_id, clip, valid_pairs, round(t,3) AS avg_translation_px, round(t/700,5) AS avg_translation_norm, round(r,3) AS avg_rotation_deg,
 CASE WHEN t/700 < 0.005 AND r < 0.5 THEN 1.0 WHEN t/700 < 0.02 AND r < 2.0 THEN 0.5 ELSE 0.0 END AS camera_stability_score FROM g""")
def _(spark, d):
    t = v.tracks(spark, d).withColumns({"translation": F.col("cx") / F.sqrt(F.lit(50.0)), "rotation": F.col("cy") / F.sqrt(F.lit(1090.0))})
    return cp.camera_stability(t, ["video_id", "clip"], 700)


# ---- model output -----------------------------------------------------------------------------

v._sql("answers", """
SELECT conv_id, turn, role, text, concat('<think>', text, '</think><answer>', upper(substr(role, 1, 1)), '</answer> tail<open>end') AS raw,
       CASE WHEN turn % 2 = 0 THEN 'u' ELSE 'a' END AS reference FROM conversations
""")


def answers(spark, d):
    c = v.table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", "text", F.concat(F.lit("<think>"), "text", F.lit("</think><answer>"), F.upper(F.substring("role", 1, 1)), F.lit("</answer> tail<open>end")).alias("raw"),
                    F.when(F.col("turn") % 2 == 0, "u").otherwise("a").alias("reference"))


@query("tagged_text_parts", "B23", "conv_id:l turn:l tags:s think:s answer:s rest:s", "answers", """
SELECT conv_id, turn, 'think,answer' AS tags, text AS think, upper(substr(role,1,1)) AS answer, '|| tail|end' AS rest FROM answers""")
def _(spark, d):
    parts, rest = tx.tagged_parts(F.col("raw"))
    a = answers(spark, d).withColumns({"p": parts, "r": rest})
    pick = lambda t: F.element_at(F.filter("p", lambda e: e["tag"] == t), 1)["text"]
    return a.select("conv_id", "turn", F.array_join(F.transform("p", lambda e: e["tag"]), ",").alias("tags"), pick("think").alias("think"),
                    pick("answer").alias("answer"), F.array_join("r", "|").alias("rest"))


@query("parsed_answers", "B24", "conv_id:l turn:l answer:s reasoning:s bare_letter:s verdict:s", "answers", f"""
SELECT conv_id, turn, upper(substr(role,1,1)) AS answer, {strip_sql('text')} AS reasoning, regexp_extract(raw, '[A-Z]') AS bare_letter,
 CASE WHEN turn % 3 = 0 THEN 'natural' WHEN turn % 3 = 1 THEN 'unnatural' END AS verdict FROM answers""")
def _(spark, d):
    t = F.when(F.col("turn") % 3 == 0, "<answer>It is <b>Natural</b>.</answer>").when(F.col("turn") % 3 == 1, "<ANSWER>unnatural</ANSWER>").otherwise("<answer>supernatural</answer>")
    return answers(spark, d).select("conv_id", "turn", tx.letter_in_answer(F.col("raw")).alias("answer"), tx.reasoning(F.col("raw")).alias("reasoning"),
                                    tx.first_letter(F.col("raw")).alias("bare_letter"), tx.natural_verdict(t).alias("verdict"))


@query("answer_accuracy", "D45", "role:s samples:l correct:l accuracy", "answers", """
SELECT role, count(*) AS samples, count(*) FILTER (WHERE lower(substr(role,1,1)) = reference) AS correct, avg(CASE WHEN lower(substr(role,1,1)) = reference THEN 1.0 ELSE 0.0 END) AS accuracy FROM answers GROUP BY role""")
def _(spark, d):
    a = answers(spark, d).withColumn("answer", tx.letter_in_answer(F.col("raw")))
    return cp.answer_accuracy(a, "answer", "reference", ["role"])


@query("lenient_json", "B18", "conv_id:l turn:l score id:s second:l", "", """
SELECT conv_id, turn, CASE (conv_id+turn)%5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 END AS score, CASE WHEN (conv_id+turn)%5 = 0 THEN 'C'||turn END AS id,
 CASE WHEN (conv_id+turn)%5 = 3 THEN turn END AS second FROM conversations""")
def _(spark, d):
    k = (F.col("conv_id") + F.col("turn")) % 5
    words = F.translate("text", "{}[]`", "")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"score": 0.8, "id": "C'), "turn", F.lit('"}')))
        .when(k == 1, F.concat(words, F.lit('\n```json\n{"score": 0.3}\n```\n'), words))
        .when(k == 2, F.concat(words, F.lit(' {"score": 0.5} '), words))
        .when(k == 3, F.concat(words, F.lit(" list [1, "), "turn", F.lit("] "), words)).otherwise(words))
    j = tx.lenient_json(raw)
    c = v.table(spark, d, "conversations").withColumn("j", j)
    return c.select("conv_id", "turn", F.try_variant_get("j", "$.score", "double").alias("score"), F.try_variant_get("j", "$.id", "string").alias("id"),
                    F.try_variant_get("j", "$[1]", "long").alias("second"))


@query("critic_reply_parts", "B25", "conv_id:l turn:l overview:s components:l first_anomaly:s answer:s", "", f"""
SELECT conv_id, turn, {strip_sql("translate(text, '<>&', '')")} AS overview, 2 AS components, 'none' AS first_anomaly, CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END AS answer FROM conversations""")
def _(spark, d):
    raw = F.concat(F.lit("<think><overview> "), F.translate("text", "<>&", ""), F.lit(" </overview><component name='a'><analysis>fine</analysis><anomaly> none </anomaly></component>"
                   "<component name='b'><analysis>x</analysis></component></think><answer>"), F.when(F.col("turn") % 2 == 0, "yes").otherwise("no"), F.lit("</answer>"))
    c = v.table(spark, d, "conversations").withColumn("p", tx.critic_answer(raw))
    return c.select("conv_id", "turn", tx.strip(F.col("p.think.overview")).alias("overview"), F.size("p.think.component").alias("components"),
                    tx.strip(F.col("p.think.component")[0]["anomaly"]).alias("first_anomaly"), "p.answer")


@query("chat_conversations", "B32", "conv_id:l turn:l turns:l roles:s parts:s user_text:s", "", """
SELECT conv_id, turn, 1 + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS turns,
 CASE WHEN turn % 2 = 0 THEN 'system,' ELSE '' END || 'user' || CASE WHEN turn % 3 = 0 THEN ',assistant' ELSE '' END AS roles,
 'image:10,video:10,video:10,text:' AS parts, text AS user_text FROM conversations WHERE length(text) > 0""")
def _(spark, d):
    t = F.col("turn")
    c = v.table(spark, d, "conversations").where(F.length("text") > 0)
    conv = cp.conversation(F.when(t % 2 == 0, "You are a judge."), F.col("text"), F.array(F.concat(F.lit("img"), "conv_id")), F.array(F.lit("v1"), F.lit("v2")),
                           F.when(t % 3 == 0, "done"), 10)
    c = c.withColumn("c", conv).withColumn("u", F.element_at(F.filter("c", lambda e: e["role"] == "user"), 1)["content"])
    label = F.transform("u", lambda p: F.concat(p["type"], F.lit(":"), F.coalesce(p["max_pixels"].cast("string"), F.lit(""))))
    return c.select("conv_id", "turn", F.size("c").alias("turns"), F.array_join(F.transform("c", lambda e: e["role"]), ",").alias("roles"),
                    F.array_join(label, ",").alias("parts"), F.element_at("u", -1)["text"].alias("user_text"))


# ---- captions, questions and names -----------------------------------------------------------------

@query("caption_mappings", "A5", "doc_id:l video_key:s caption:s", "", f"""
SELECT doc_id, 'v'||doc_id||'.mp4' AS video_key, {strip_sql('text')} AS caption FROM documents
UNION ALL SELECT doc_id, 'f'||doc_id||'.mp4', lang FROM documents WHERE doc_id % 3 = 2""")
def _(spark, d):
    k, key, t = F.col("doc_id") % 3, F.concat(F.lit("v"), "doc_id", F.lit(".mp4")), F.col("text")
    body = (
        F.when(k == 0, F.to_json(F.create_map(key, t)))
        .when(k == 1, F.to_json(F.create_map(key, F.struct(t.alias("caption"), F.lit(1).alias("fps")))))
        .otherwise(F.to_json(F.array(
            F.struct(key.alias("video"), F.lit(None).cast("string").alias("file"), t.alias("caption")),
            F.struct(F.lit("").alias("video"), F.concat(F.lit("f"), "doc_id", F.lit(".mp4")).alias("file"), F.col("lang").alias("caption"))))))
    return cp.parse_captions(v.table(spark, d, "documents").select("doc_id", body.alias("body")), "body")


@query("video_caption_pairs", "C3 B17", "doc_id:l pair_id:s caption:s", "", f"""
SELECT doc_id, 'clip_'||doc_id AS pair_id, CASE WHEN doc_id % 6 <= 3 THEN nullif({strip_sql('source')}, '') WHEN doc_id % 6 = 4 THEN lang END AS caption FROM documents""")
def _(spark, d):
    k = F.col("doc_id") % 6
    docs = v.table(spark, d, "documents").withColumns({
        "path": F.concat(F.lit("videos/"), "lang", F.lit("/clip "), "doc_id", F.lit(".mp4")), "stem": F.concat(F.lit("clip "), "doc_id")})
    docs = docs.withColumn("full_path", F.concat(F.lit("/data/"), "path"))
    key = F.when(k == 0, F.col("path")).when(k == 1, F.col("full_path")).when(k == 2, F.concat("stem", F.lit(".mp4"))).when(k == 3, F.col("stem"))
    mapping = docs.where(k <= 3).select(key.alias("video_key"), F.col("source").alias("caption"))
    worse = docs.where(k == 0).select(F.col("stem").alias("video_key"), F.lit("worse").alias("caption"))
    folder = docs.where(k == 4).select("stem", F.col("lang").alias("caption"))
    return cp.pair_captions(docs.select("doc_id", "path", "full_path"), mapping.unionByName(worse), folder)


@query("video_question_tasks", "C19", "doc_id:l idx:l question:s correct_answer:s", "", """
SELECT doc_id, 0 AS idx, source AS question, lang AS correct_answer FROM documents WHERE doc_id % 4 IN (0, 1)
UNION ALL SELECT doc_id, 1, 'second', 'B' FROM documents WHERE doc_id % 4 = 0""")
def _(spark, d):
    k = F.col("doc_id") % 4
    docs = v.table(spark, d, "documents")
    ext = F.when(k == 2, ".txt").otherwise(".mp4")
    one = F.struct(F.col("source").alias("question"), F.when(k == 0, F.col("lang")).alias("answer"), F.when(k == 1, F.col("lang")).alias("correct_answer"))
    two = F.struct(F.lit("second").alias("question"), F.lit("A").alias("answer"), F.lit("B").alias("correct_answer"))
    q = docs.where(k <= 2).select(F.concat(F.lit("clips/"), "doc_id", F.lit(".mp4")).alias("video"),
                                  F.when(k == 0, F.to_json(F.array(one, two))).otherwise(F.to_json(one)).alias("qa"))
    tasks, _ = cp.question_tasks(docs.select(F.concat("doc_id", ext).alias("file")), q)
    return tasks.withColumn("doc_id", F.col("video_id").cast("long"))


@query("video_ids_from_paths", "B17", "page_id:l pair_id:s clean:s rel:s", "", """
WITH p AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS u FROM pages), q AS (SELECT *, regexp_replace(u, '^[^/]*/', '') AS rel FROM p),
s AS (SELECT *, replace(CASE WHEN regexp_matches(regexp_extract(rel, '[^/]*$'), '^.+\\.[^.]+$') THEN regexp_replace(rel, '\\.[^./]+$', '') ELSE rel END, '/', '__') AS j FROM q)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(j, '[^\\p{L}\\p{N}_\\-.]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS pair_id,
 regexp_replace(url, '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS clean, rel FROM s""")
def _(spark, d):
    p = v.table(spark, d, "pages").withColumn("u", F.regexp_replace("url", "^https?://", ""))
    p = p.withColumn("rel", F.regexp_replace("u", "^[^/]*/", ""))
    return p.select("page_id", tx.pair_id(F.concat(F.lit("/root/"), "rel"), "/root").alias("pair_id"), tx.clean_symbols(F.col("url")).alias("clean"),
                    tx.remove_root(F.concat(F.lit("/data/"), "rel"), "data").alias("rel"))


@query("display_names", "B26", "o_orderkey:l model:s scene:s stem:s", "", """
WITH m AS (SELECT o_orderkey, """ + f"{[*rp.MODEL_NAMES.values(), 'other']}[1 + o_orderkey % {len(rp.MODEL_NAMES) + 1}]" + """ AS model,
 o_orderpriority || '_' || c_name || '+' || c_mktsegment || '__near the river' AS scene FROM orders JOIN customer ON o_custkey=c_custkey),
t AS (SELECT *, trim(regexp_replace(translate(scene,'+_','  '), '\\s+', ' ', 'g')) AS s FROM m)
SELECT o_orderkey, model, CASE WHEN length(s) <= 46 THEN s ELSE rtrim(substr(s,1,43)) || '...' END AS scene, replace(scene,'_','+') AS stem FROM t""")
def _(spark, d):
    o = v.table(spark, d, "orders").join(v.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = [*rp.MODEL_NAMES, "other"]
    key = F.get(F.array(*[F.lit(x) for x in keys]), (F.col("o_orderkey") % len(keys)).cast("int"))
    scene = F.concat("o_orderpriority", F.lit("_"), "c_name", F.lit("+"), "c_mktsegment", F.lit("__near the river"))
    return o.select("o_orderkey", rp.display_name(key).alias("model"), tx.shorten(scene).alias("scene"), tx.file_stem(scene).alias("stem"))


@query("clip_name_parts", "B30", "p_partkey:l task:s episode:s video:s first_frame:l last_frame:l prefix:s fine_id:l start_s bridge_episode:s bridge_end:l", "", """
SELECT p_partkey, 't'||p_size AS task, 'e'||p_partkey%7 AS episode, 'head' AS video, p_partkey AS first_frame, p_partkey+p_size AS last_frame, 'R'||p_partkey AS prefix, p_size AS fine_id,
 CASE WHEN p_size % 2 = 0 THEN p_size*1.5 END AS start_s, 'ep'||p_size AS bridge_episode, p_partkey % 1000 AS bridge_end FROM part""")
def _(spark, d):
    from wayscore.sources import readers as rd
    p = v.table(spark, d, "part")
    a = F.concat(F.lit(" clips/t"), "p_size", F.lit("-e"), F.col("p_partkey") % 7, F.lit("-head-"), "p_partkey", F.lit("-"), F.col("p_partkey") + F.col("p_size"), F.lit(".mp4 "))
    h = F.concat(F.lit("R"), "p_partkey", F.lit("_coarse_3_fine_"), "p_size", F.lit(".mp4"))
    b = F.concat(F.lit("toy-kit.ep"), "p_size", F.lit(".x.clip"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".mp4"))
    out = p.select("p_partkey", rd.dashed_clip(a).alias("a"), rd.coarse_fine_clip(h).alias("h"), rd.dotted_clip(b).alias("b"))
    actions = p.where("p_size % 2 = 0").select(F.concat(F.lit("R"), "p_partkey").alias("prefix"), F.col("p_size").alias("fine_id"), (F.col("p_size") * 1.5).alias("start_s"))
    flat = out.select("p_partkey", "a.*", "h.*", F.col("b.episode").alias("bridge_episode"), F.col("b.last_frame").alias("bridge_end"))
    return flat.join(actions, ["prefix", "fine_id"], "left")


# ---- score tables -------------------------------------------------------------------------------------

def _batches(spark, d):
    """Batch summaries as JSON text, one list per model, scene and customer segment group of runs."""
    s = v.scores(spark, d)
    item = F.struct(
        F.col("scene_id").alias("pair_id"), F.when(F.col("run_id") % 9 == 0, "failed").otherwise("success").alias("status"),
        F.col("score").alias("caption_usage_score"), (F.col("score") * 0.9).alias("weighted_caption_usage_score"), F.col("importance").alias("num_claims"),
        F.create_map("category", F.col("score"), F.lit("global_subjective"), F.lit(1.0)).alias("category_scores"))
    return s.select(F.col("model").alias("model_key"), F.to_json(F.array(item)).alias("body"))


v._sql("cap_", "SELECT model, scene_id AS scene, score AS u, score*0.9 AS w, importance, category FROM scores WHERE run_id % 9 <> 0", "scores")


@query("caption_model_rows", "A6 D48", "model:s num_scenes:l mean_caption_usage_score std_caption_usage_score mean_weighted_caption_usage_score", "cap_", """
SELECT model, count(*) AS num_scenes, avg(u) AS mean_caption_usage_score, stddev_pop(u) AS std_caption_usage_score, avg(w) AS mean_weighted_caption_usage_score FROM cap_ GROUP BY model""")
def _(spark, d):
    return rp.model_leaderboard(rp.caption_summaries(_batches(spark, d), "model_key", "body"))


@query("caption_scene_rows", "A6", "model:s scene:s n:l num_claims:l usage weighted", "cap_", """
SELECT model, scene, count(*) AS n, sum(importance) AS num_claims, avg(u) AS usage, avg(w) AS weighted FROM cap_ GROUP BY ALL""")
def _(spark, d):
    s = rp.caption_summaries(_batches(spark, d), "model_key", "body")
    return s.groupBy("model", "scene").agg(F.count(F.lit(1)).alias("n"), F.sum("num_claims").alias("num_claims"), F.avg("caption_usage_score").alias("usage"),
                                           F.avg("weighted_caption_usage_score").alias("weighted"))


@query("caption_claim_rows", "A6", "model:s scene:s category:s claims:l importance final_score", "scores", """
SELECT model, scene_id AS scene, category, count(*) AS claims, sum(importance) AS importance, sum(score) AS final_score FROM scores
WHERE (model, scene_id) IN (SELECT (model, scene_id) FROM scores WHERE run_id % 9 <> 0) GROUP BY ALL""")
def _(spark, d):
    s = v.scores(spark, d)
    claim = F.struct("category", F.col("importance").cast("double").alias("importance"), F.col("score").alias("final_score"))
    reports = s.select("model", F.col("scene_id").alias("scene"), F.to_json(F.struct(F.array(claim).alias("claim_results"))).alias("body"))
    scenes = rp.caption_summaries(_batches(spark, d), "model_key", "body")
    c = rp.caption_claims(reports, "model", "scene", "body", scenes)
    return c.groupBy("model", "scene", "category").agg(F.count(F.lit(1)).alias("claims"), F.sum("importance").alias("importance"), F.sum("final_score").alias("final_score"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("caption_category_table", "D48", "model:s " + " ".join(SEGMENTS), "cap_",
       "SELECT model, " + ", ".join(f"avg(CASE WHEN category='{s}' THEN u END) AS {s}" for s in SEGMENTS) + " FROM cap_ GROUP BY model")
def _(spark, d):
    return rp.category_table(rp.caption_summaries(_batches(spark, d), "model_key", "body"), SEGMENTS)


v._sql("cms_", """
SELECT o_orderpriority AS model, 'S' || o_custkey AS scene, avg(o_totalprice)/997 AS w FROM orders GROUP BY ALL
""")


def _cms(spark, d):
    # not every customer has orders of every priority, so scenes are missing by themselves
    o = v.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("model"), F.concat(F.lit("S"), "o_custkey").alias("scene")).agg(
        (F.avg("o_totalprice") / 997).alias("weighted_caption_usage_score"))


@query("common_scene_summary", "D48 G1", "model:s num_common_scenes:l mean_common_weighted_score", "cms_", """
SELECT model, count(*) AS num_common_scenes, avg(w) AS mean_common_weighted_score FROM cms_
WHERE scene IN (SELECT scene FROM cms_ GROUP BY scene HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM cms_)) GROUP BY model""")
def _(spark, d):
    return rp.common_summary(_cms(spark, d))


@query("scene_difficulty", "D48", "scene:s mean_weighted_score num_models:l best_model:s best_score", "cms_", """
SELECT scene, avg(w) AS mean_weighted_score, count(*) AS num_models, arg_min(model, (-w, model)) AS best_model, max(w) AS best_score FROM cms_ GROUP BY scene""")
def _(spark, d):
    return rp.scene_difficulty(_cms(spark, d))


@query("hardest_scenes", "F5", "scene:s mean_weighted_score num_models:l", "cms_", """
SELECT scene, avg(w) AS mean_weighted_score, count(*) AS num_models FROM cms_ GROUP BY scene ORDER BY mean_weighted_score, scene LIMIT 5""")
def _(spark, d):
    return rp.scene_difficulty(_cms(spark, d)).orderBy("mean_weighted_score", "scene").limit(5)


M5 = ("fvd", "objective_quality", "subjective_quality", "scene_consistency", "agent_consistency")
v._sql("lines_", "SELECT n_name AS model, " + ", ".join(f"avg(o_totalprice * ((o_orderkey * {i + 3}) % 17)) / 1000 AS {m}" for i, m in enumerate(M5)) +
       " FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY n_name")


def _result_lines(spark, d):
    o = v.table(spark, d, "orders")
    c = v.table(spark, d, "customer")
    n = v.table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    g = j.groupBy("n_name").agg(*[(F.avg(F.col("o_totalprice") * ((F.col("o_orderkey") * (i + 3)) % 17)) / 1000).alias(m) for i, m in enumerate(M5)])
    body = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{m}': "), F.col(m).cast("string")) for m in M5]), F.lit(", 'agent_missing': None}"))
    return g.select(F.concat("n_name", F.lit(": "), body).alias("value"))


LINE_SCHEMA = "struct<" + ",".join(f"{m}:double" for m in (*M5, "agent_missing")) + ">"


@query("result_line_scan", "A7", "model:s " + " ".join(M5), "lines_", "SELECT * FROM lines_")
def _(spark, d):
    return rp.parse_result_lines(_result_lines(spark, d), "value", LINE_SCHEMA)


@query("average_rank_leaderboard", "F2", "model:s average_rank overall_rank:l", "lines_", """
WITH r AS (SELECT model, (row_number() OVER (ORDER BY fvd, model) + row_number() OVER (ORDER BY objective_quality DESC, model) + row_number() OVER (ORDER BY subjective_quality DESC, model)
 + row_number() OVER (ORDER BY scene_consistency DESC, model) + row_number() OVER (ORDER BY agent_consistency DESC, model)) / 5.0 AS average_rank FROM lines_)
SELECT *, row_number() OVER (ORDER BY average_rank, model) AS overall_rank FROM r""")
def _(spark, d):
    rows = rp.parse_result_lines(_result_lines(spark, d), "value", LINE_SCHEMA)
    return rk.position_ranks(rows, {"fvd": False, **{m: True for m in M5[1:]}}, ["model"])


PR = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("metric_by_model_table", "F3", "category:s metric:s urgent:s high:s low:s", "scores", """
WITH g AS (SELECT category, scene_id AS metric, model, avg(score) AS v FROM scores GROUP BY ALL)
SELECT category, metric, coalesce(printf('%.4f', max(CASE WHEN model='1-URGENT' THEN v END)), '-') AS urgent, coalesce(printf('%.4f', max(CASE WHEN model='2-HIGH' THEN v END)), '-') AS high,
 coalesce(printf('%.4f', max(CASE WHEN model='5-LOW' THEN v END)), '-') AS low FROM g GROUP BY category, metric""")
def _(spark, d):
    s = v.scores(spark, d)
    rows = s.groupBy("category", F.col("scene_id").alias("metric"), "model").agg(F.avg("score").alias("value"))
    t = rp.metric_table(rows, PR)
    return t.withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"})


@query("spreadsheet_rows", "F3", "model:s formula:s", "scores", """
WITH g AS (SELECT model, category, avg(score) AS v FROM scores GROUP BY ALL)
SELECT model, '=SPLIT("' || string_agg(CASE WHEN v IS NULL THEN '' ELSE printf('%.4f', v) END, ',' ORDER BY o) || '", ",")' AS formula
FROM (SELECT m.model, c.o, g.v FROM (SELECT DISTINCT model FROM scores) m, (VALUES (0,'AUTOMOBILE'),(1,'NONE'),(2,'MACHINERY')) c(o, category) LEFT JOIN g ON g.model=m.model AND g.category=c.category) GROUP BY model""")
def _(spark, d):
    rows = v.scores(spark, d).groupBy("model", F.col("category").alias("metric")).agg(F.avg("score").alias("value"))
    return rp.sheet_row(rows, "model", ["AUTOMOBILE", "NONE", "MACHINERY"])


@query("missing_agent_scenes", "D27", "video_id:l clip:l any_missing:l agents:l missing_agents:l", "tracks", """
SELECT video_id, clip, max(u) AS any_missing, count(*) AS agents, sum(u) AS missing_agents FROM
 (SELECT video_id, clip, track_id, CASE WHEN max(frame) < 39 AND arg_max(k, frame) % 3 = 0 THEN 1 ELSE 0 END AS u FROM tracks GROUP BY ALL) GROUP BY ALL""")
def _(spark, d):
    return rp.missing_agents(_verdicts(spark, d), ["video_id", "clip"])[0]


def _verdicts(spark, d):
    t = v.tracks(spark, d).groupBy("video_id", "clip", "track_id").agg(F.max("frame").alias("f"), F.max_by("k", "frame").alias("k"))
    return t.select("video_id", "clip", "track_id", ((F.col("f") < 39) & (F.col("k") % 3 == 0)).alias("unnatural"))


@query("missing_agent_score", "D27", "agent_missing agents:l agent_level_missing", "tracks", """
WITH u AS (SELECT video_id, clip, track_id, CASE WHEN max(frame) < 39 AND arg_max(k, frame) % 3 = 0 THEN 1 ELSE 0 END AS u FROM tracks GROUP BY ALL),
s AS (SELECT video_id, clip, max(u) AS m, count(*) AS n, sum(u) AS su FROM u GROUP BY ALL)
SELECT 1-avg(m) AS agent_missing, sum(n) AS agents, 1-sum(su)/sum(n) AS agent_level_missing FROM s""")
def _(spark, d):
    return rp.missing_agents(_verdicts(spark, d), ["video_id", "clip"])[1]


@query("objective_quality", "D28", "metric:s value", "luma", """
WITH p AS (SELECT video_id, clip, avg(luma/255) AS mmp_alias, avg(k/100.0) AS fmp_alias FROM luma GROUP BY ALL)
SELECT 'mmp_alias' AS metric, avg(mmp_alias) AS value FROM p UNION ALL SELECT 'fmp_alias', avg(1-fmp_alias) FROM p""")
def _(spark, d):
    f = v.luma(spark, d).select("video_id", "clip", (F.col("luma") / 255).alias("mmp_alias"), (F.col("k") / 100).alias("fmp_alias"))
    return rp.objective_quality(f, ["video_id", "clip"], ["mmp_alias", "fmp_alias"])


@query("subjective_quality_rescaled", "D29 B27", "video_id:l quality rescaled", "luma", """
WITH q AS (SELECT video_id, avg(luma) AS quality FROM luma GROUP BY video_id),
s AS (SELECT avg(quality) AS m, stddev_pop(quality) AS sd, quantile_cont(quality, 0.05) AS lo, quantile_cont(quality, 0.95) AS hi FROM q)
SELECT video_id, quality, greatest(0, least(1, ((quality-m)/(sd+1e-9) - (lo-m)/(sd+1e-9)) / ((hi-m)/(sd+1e-9) - (lo-m)/(sd+1e-9) + 1e-9))) AS rescaled FROM q, s""")
def _(spark, d):
    q = v.luma(spark, d).groupBy("video_id").agg(F.avg("luma").alias("quality")).withColumn("all_rows", F.lit(0))
    pct = grouped_quantiles(q, ["all_rows"], "quality", {"lo": 0.05, "hi": 0.95})
    st = q.groupBy("all_rows").agg(F.avg("quality").alias("m"), F.stddev_pop("quality").alias("sd")).join(pct, "all_rows").drop("all_rows")
    z = lambda c: (F.col(c) - F.col("m")) / (F.col("sd") + 1e-9)
    return q.join(F.broadcast(st)).select("video_id", "quality", rp.rescale_quality(F.col("quality"), F.col("m"), F.col("sd"), z("lo"), z("hi")).alias("rescaled"))


@query("subjective_quality", "D29", "videos:l quality", "luma", "SELECT count(*) AS videos, avg(q) AS quality FROM (SELECT video_id, clip, avg(luma) AS q FROM luma GROUP BY ALL)")
def _(spark, d):
    q = v.luma(spark, d).groupBy("video_id", "clip").agg(F.avg("luma").alias("q"))
    return q.agg(F.count(F.lit(1)).alias("videos"), F.avg("q").alias("quality"))


@query("pending_tasks", "A15", "o_orderkey:l", "", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    done = v.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return cp.skip_done(v.table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])

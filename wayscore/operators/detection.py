"""Detection scoring: matching, average precision, confusion, suppression.

Detections hold image_id, det_id, cls, conf and a box; labels hold image_id,
label_id, cls and a box. Equal boxes of one image are collapsed to their lowest
id before pairing: only that one can win a label, so nothing is lost, and a pile
of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.functions import boxes as bx
from wayscore.operators.boxjoin import CROWDED, GEOM, PAIRED, crowded_keys, distinct_boxes, overlap_pairs, same_class, split_crowded, top_rows
from wayscore.operators.ordered import checkpointed, number_rows, running_totals, salted_join, shared

IOU_LEVELS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
PR_GRID = 101
CURVE_GRID = 1000


def best_overlap(query: DataFrame, candidates: DataFrame, keys: Sequence[str], eps: float = 1e-8, cell: float = 64.0, limit: int = CROWDED) -> DataFrame:
    """Best candidate (lowest id on ties) per distinct query box; no overlap gives the first candidate with 0.

    Keys of up to ``limit`` boxes compare each query with the list of their candidates, without a row for each pair; the
    others pair in cells.
    """
    few_q, few_c, many_q, many_c = split_crowded(query, candidates, keys, limit)
    few = _best_in_lists(few_q, few_c, keys, eps)
    return few.unionByName(_best_in_cells(many_q, many_c, keys, eps, cell))


def _distinct_queries(query: DataFrame, keys: Sequence[str]) -> DataFrame:
    return distinct_boxes(query, keys, "a_", F.min("query_id").alias("query_id"), F.count(F.lit(1)).alias("copies"))


def _best_in_lists(query: DataFrame, candidates: DataFrame, keys: Sequence[str], eps: float) -> DataFrame:
    lists = candidates.groupBy(*keys).agg(F.collect_list(F.struct(*GEOM, "cand_id")).alias("_c"))
    a = bx.box("a_")

    def scored(c):
        b = tuple(c[g] for g in GEOM)
        iou = F.when(bx.intersection(a, b) > 0, bx.iou(a, b, eps))
        return F.struct(F.coalesce(iou, F.lit(0.0)).alias("iou"), (-c["cand_id"]).alias("neg"))

    best = _distinct_queries(query, keys).join(lists.hint("merge"), list(keys)).withColumn("_b", F.array_max(F.transform("_c", scored)))
    return best.select(*keys, "query_id", "copies", (-F.col("_b.neg")).alias("cand_id"), F.col("_b.iou").alias("best_iou"))


def _best_in_cells(query: DataFrame, candidates: DataFrame, keys: Sequence[str], eps: float, cell: float) -> DataFrame:
    q = _distinct_queries(query, keys)
    c = distinct_boxes(candidates, keys, "b_", F.min("cand_id").alias("cand_id"))
    score = bx.iou(bx.box("a_"), bx.box("b_"), eps)
    geom = [f"a_{g}" for g in GEOM]
    best = (
        overlap_pairs(q.select(*keys, *geom), c, keys, cell)
        .groupBy(*keys, *geom)
        .agg(F.max(F.struct(score.alias("iou"), (-F.col("cand_id")).alias("neg"))).alias("_b"))
    )
    first = c.groupBy(*keys).agg(F.min("cand_id").alias("_first"))
    return (
        q.join(best, [*keys, *geom], "left").join(first, list(keys))
        .select(*keys, "query_id", "copies", F.coalesce(-F.col("_b.neg"), F.col("_first")).alias("cand_id"),
                F.coalesce(F.col("_b.iou"), F.lit(0.0)).alias("best_iou"))
    )


def pair_similarity(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """Overlap measures of the overlapping distinct pairs, with how often each pair of copies occurs."""
    a = distinct_boxes(left, keys, "a_", F.count(F.lit(1)).alias("a_copies"))
    b = distinct_boxes(right, keys, "b_", F.count(F.lit(1)).alias("b_copies"))
    p = overlap_pairs(a, b, keys, cell).withColumn("copies", F.col("a_copies") * F.col("b_copies"))
    m = bx.iou_family(bx.box("a_"), bx.box("b_"))
    return p.withColumns({**m, "ioa": bx.ioa(bx.box("a_"), bx.box("b_"))})


def _best_labels(pairs: DataFrame, k: Sequence[str]) -> DataFrame:
    """Detections with their best label, the lowest on ties, of pairs (k, cls, det_id, label_id, iou)."""
    return (
        pairs.groupBy(*k, "cls", "det_id")
        .agg(F.max(F.struct("iou", (-F.col("label_id")).alias("neg"))).alias("_b"))
        .select(*k, "cls", "det_id", F.col("_b.iou").alias("iou"), (-F.col("_b.neg")).alias("label_id"))
    )


def _class_pairs(dets: DataFrame, labels: DataFrame, k: Sequence[str]) -> DataFrame:
    """Boxes of one image and class that overlap enough, met by image alone, where the rows of an image lie together."""
    side = lambda df, name, c, prefix: df.select(*k, name, F.col("cls").alias(c), *[F.col(g).alias(f"{prefix}{g}") for g in GEOM])
    a, b = bx.box("a_"), bx.box("b_")
    met = side(dets, "det_id", "cls", "a_").join(side(labels, "label_id", "_lcls", "b_").hint("merge"), list(k))
    met = met.where(same_class(F.col("cls"), F.col("_lcls")) & (bx.intersection(a, b) > 0)).withColumn("iou", bx.iou(a, b))
    return met.where(F.col("iou") >= IOU_LEVELS[0]).select(*k, "cls", "det_id", "label_id", "iou")


def _class_pairs_in_cells(dets: DataFrame, labels: DataFrame, k: Sequence[str], cell: float) -> DataFrame:
    """The same pairs of crowded images: the lowest of equal boxes, met in grid cells."""
    d = distinct_boxes(dets, [*k, "cls"], "a_", F.min("det_id").alias("det_id"))
    lab = distinct_boxes(labels, [*k, "cls"], "b_", F.min("label_id").alias("label_id"))
    iou = bx.iou(bx.box("a_"), bx.box("b_"))
    return overlap_pairs(d, lab, [*k, "cls"], cell).withColumn("iou", iou).where(F.col("iou") >= IOU_LEVELS[0]).select(*k, "cls", "det_id", "label_id", "iou")


def _won_levels(best: DataFrame, k: Sequence[str]) -> DataFrame:
    """Detections that win a label, with one bit for each IoU level: of the claims on a label the lowest detection wins."""
    won = best.groupBy(*k, "label_id").agg(
        *[F.min(F.when(F.col("iou") >= t, F.col("det_id"))).alias(f"t{i}") for i, t in enumerate(IOU_LEVELS)])
    entries = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.col(f"t{i}").alias("det_id")) for i in range(len(IOU_LEVELS))])
    return (
        won.select(*k, F.explode(entries).alias("w")).where("w.det_id IS NOT NULL")
        .groupBy(*k, F.col("w.det_id").alias("det_id")).agg(F.bit_or("w.bit").alias("_bits"))
    )


def _with_flags(dets: DataFrame) -> DataFrame:
    bits = F.coalesce("_bits", F.lit(0))
    return dets.withColumns({f"t{i}": F.shiftright(bits, i).bitwiseAND(F.lit(1)) for i in range(len(IOU_LEVELS))}).drop("_bits")


def match_detections(dets: DataFrame, labels: DataFrame, keys: Sequence[str] = (), cell: float = 64.0, overlaps: DataFrame | None = None,
                     limit: int = PAIRED) -> DataFrame:
    """Detections with one flag per IoU level.

    Each detection claims its best label; of the claims on one label at a level
    the lowest detection id is kept. ``overlaps`` (keys, image_id, det_id, label_id, iou)
    takes the place of the overlap of boxes: of masks, keypoints or rotated boxes. Those that name the class
    of both (cls) and whether their image has more than ``limit`` boxes (crowded) need no look at either.

    Images of up to ``limit`` boxes are matched where their rows lie: nothing is hashed on finer keys, and winners come
    back to the detections as one map for each image. The boxes of the others meet in cells and are joined by id.
    """
    k = [*keys, "image_id"]
    many = crowded_keys(dets, labels, k, limit)
    few, rest = lambda df: df.join(many, k, "left_anti"), lambda df: df.join(many, k, "left_semi")
    if overlaps is None:
        near, far = _class_pairs(few(dets), few(labels), k), _class_pairs_in_cells(rest(dets), rest(labels), k, cell)
    else:
        pairs = overlaps.where((F.col("iou") >= IOU_LEVELS[0]) & ~F.isnan("iou"))
        if "crowded" in pairs.columns:
            near, far = pairs.where(~F.col("crowded")), pairs.where("crowded")
        else:
            pairs = pairs.select(*k, "det_id", "label_id", "iou").join(dets.select(*k, "det_id", "cls"), [*k, "det_id"])
            pairs = pairs.join(labels.select(*k, "label_id", "cls"), [*k, "label_id", "cls"])
            near, far = few(pairs), rest(pairs)
    won = _won_levels(_best_labels(near, k), k).groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("det_id", "_bits"))).alias("_won"))
    in_place = few(dets).join(won.hint("merge"), k, "left").withColumn("_bits", F.col("_won")[F.col("det_id")]).drop("_won")
    by_id = rest(dets).join(_won_levels(_best_labels(far, k), k), [*k, "det_id"], "left")
    return _with_flags(in_place.unionByName(by_id)).select(*dets.columns, *[f"t{i}" for i in range(len(IOU_LEVELS))])


def hit_bits(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What the curves need of matched detections, kept: their order and one bit for each IoU level that is a hit."""
    bits = sum((F.col(f"t{i}").cast("int") * (1 << i) for i in range(len(IOU_LEVELS))), F.lit(0))
    return shared(matched.select(*keys, "cls", "conf", "image_id", "det_id", bits.alias("bits")))


def _hit(i: int) -> Column:
    return F.shiftright("bits", i).bitwiseAND(F.lit(1))


def curve_counts(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running detection and hit counts per class by falling confidence (then image, then id)."""
    k = [*keys, "cls"]
    bucket = {
        "a": F.floor((1 - F.col("conf")) * 1024), "b": -F.col("conf"), "c": F.floor(F.col("image_id") / 65536),
    }
    sums = {"n": F.lit(1), **{f"c{i}": _hit(i) for i in range(len(IOU_LEVELS))}}
    counts = running_totals(hit_bits(matched, keys), k, bucket, [F.col("conf").desc(), "image_id", "det_id"], sums)
    return counts.select(*k, "conf", "bits", *sums)


def average_precision(matched: DataFrame, labels: DataFrame, keys: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """Area under the precision envelope sampled at 101 recall points, per class and IoU level.

    Only hits change recall, so the curve is kept as per-grid-cell summaries of
    the hits: best precision, last hit, first hit. ``counts`` are the ``curve_counts``, where they serve other curves too.
    """
    k = [*keys, "cls"]
    counts = curve_counts(matched, keys) if counts is None else counts
    n_l = labels.groupBy(*k).agg(F.count(F.lit(1)).alias("n_labels"))
    n_p = hit_bits(matched, keys).groupBy(*k).agg(F.count(F.lit(1)).alias("n_preds"))
    step = 1.0 / (PR_GRID - 1)
    hits = counts.where("bits <> 0").select(*k, "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("lvl"), _hit(i).alias("hit"), F.col(f"c{i}").alias("j"))
        for i in range(len(IOU_LEVELS))])).alias("h")).where("h.hit = 1")
    hits = salted_join(hits.select(*k, "n", F.col("h.lvl").alias("lvl"), F.col("h.j").alias("j")), n_l, k, ["n"])
    recall = F.col("j") / F.col("n_labels")
    guess = F.ceil(recall * (PR_GRID - 1)).cast("int")
    cell = F.when((guess - 1) * step >= recall, guess - 1).when(guess * step >= recall, guess).otherwise(guess + 1)
    cells = hits.withColumn("cell", cell).groupBy(*k, "lvl", "cell").agg(
        F.max(F.col("j") / F.col("n")).alias("best"), F.max("j").alias("last_j"), F.max("n").alias("last_n"),
        F.min("j").alias("first_j"), F.min("n").alias("first_n"))
    grid = (
        n_l.join(n_p, k).withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(len(IOU_LEVELS) - 1))))
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(PR_GRID)))).join(cells, [*k, "lvl", "cell"], "left")
    )
    wk = W.partitionBy(*k, "lvl").orderBy("cell")
    upto, after = wk.rowsBetween(W.unboundedPreceding, 0), wk.rowsBetween(1, W.unboundedFollowing)
    g = grid.withColumns({
        "lj": F.coalesce(F.max("last_j").over(upto), F.lit(0)), "ln": F.coalesce(F.max("last_n").over(upto), F.lit(0)),
        "fn": F.min("first_n").over(after), "env": F.max("best").over(after),
    }).where(F.col("cell") < PR_GRID)
    x = F.col("cell") * step
    r0 = F.col("lj") / F.col("n_labels")
    own = F.when(F.col("lj") == 0, F.lit(1.0)).otherwise(F.greatest(F.col("lj") / F.nullif(F.col("ln"), F.lit(0)), F.col("env")))
    left = (
        F.when(F.col("fn").isNull(), F.when((F.col("lj") == 0) & (F.col("n_preds") == 0), 1.0).otherwise(F.col("lj") / F.col("n_preds")))
        .when(F.col("fn") > F.col("ln") + 1, F.col("env")).otherwise(own)
    )
    r1 = F.when(F.col("fn").isNull(), F.lit(1.0)).otherwise((F.col("lj") + 1) / F.col("n_labels"))
    right = F.coalesce("env", F.lit(0.0))
    y = F.when(x >= 1.0, 0.0).otherwise(left + (right - left) * (x - r0) / (r1 - r0))
    weight = F.when(F.col("cell").isin(0, PR_GRID - 1), 0.5).otherwise(1.0)
    return g.groupBy(*k, "lvl").agg(F.sum(y * weight * step).alias("ap"), F.max("n_labels").alias("n_labels"),
                                    F.max("n_preds").alias("n_preds"))


def confidence_curves(matched: DataFrame, labels: DataFrame, keys: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 at the lowest IoU level over 1000 confidence values; ``counts`` as in ``average_precision``."""
    k = [*keys, "cls"]
    n_l = labels.groupBy(*k).agg(F.count(F.lit(1)).alias("n_labels"))
    step = 1.0 / (CURVE_GRID - 1)
    c = (curve_counts(matched, keys) if counts is None else counts).select(*k, "conf", "n", F.col("c0").alias("j"))
    guess = F.floor(F.col("conf") * (CURVE_GRID - 1)).cast("int")
    cell = F.when((guess + 1) * step <= F.col("conf"), guess + 1).when(guess * step <= F.col("conf"), guess).otherwise(guess - 1)
    last = F.struct("n", "j", "conf")
    cells = c.withColumn("cell", cell).groupBy(*k, "cell").agg(F.max(last).alias("last"), F.min(last).alias("first"))
    grid = n_l.withColumn("cell", F.explode(F.sequence(F.lit(-1), F.lit(CURVE_GRID - 1)))).join(cells, [*k, "cell"], "left")
    wk = W.partitionBy(*k).orderBy(F.col("cell").desc())
    g = grid.withColumns({
        "a": F.max("last").over(wk.rowsBetween(W.unboundedPreceding, 0)),
        "b": F.min("first").over(wk.rowsBetween(1, W.unboundedFollowing)),
    }).where(F.col("cell") >= 0)
    x = F.col("cell") * step
    w = F.when(F.col("b").isNull() | (F.col("a.conf") == x), 0.0).otherwise((F.col("a.conf") - x) / (F.col("a.conf") - F.col("b.conf")))

    def curve(num, none):
        at = lambda s: num(F.col(s))
        return F.when(F.col("a").isNull(), F.lit(none)).otherwise(at("a") + F.coalesce(at("b") - at("a"), F.lit(0.0)) * w)

    p = curve(lambda s: s["j"] / s["n"], 1.0)
    r = curve(lambda s: s["j"] / F.col("n_labels"), 0.0)
    g = g.withColumns({"precision": p, "recall": r})
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-16)
    return g.select(*k, "n_labels", F.col("cell").alias("point"), x.alias("conf"), "precision", "recall", f1.alias("f1"))


def best_f1(curves: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-class values at the point where the smoothed mean F1 is highest.

    The curve table has 1000 points per class; the window runs on the 1000-point mean.
    """
    half = (round(CURVE_GRID * 0.1 * 2) // 2 + 1) // 2
    mean = curves.groupBy(*keys, "point").agg(F.avg("f1").alias("m"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    w = part.orderBy("point")
    mean = mean.withColumns({
        "s": F.sum("m").over(w.rowsBetween(-half, half)),
        "lo": F.first("m").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "hi": F.last("m").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    miss_lo = F.greatest(F.lit(0), half - F.col("point"))
    miss_hi = F.greatest(F.lit(0), F.col("point") + half - (CURVE_GRID - 1))
    mean = mean.withColumn("s", F.bround((F.col("s") + miss_lo * F.col("lo") + miss_hi * F.col("hi")) / (2 * half + 1), 12))
    top = mean.withColumn("_r", F.row_number().over(part.orderBy(F.col("s").desc(), "point"))).where("_r = 1").select(*keys, "point")
    out = curves.join(top, [*keys, "point"])
    tp = F.bround(F.col("recall") * F.col("n_labels"))
    return out.withColumns({"tp": tp, "fp": F.bround(tp / (F.col("precision") + 1e-16) - tp)})


def summary(ap: DataFrame, best: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean AP at .5, .75 and over all levels, mean precision and recall, and the weighted fitness."""
    m = ap.groupBy(*keys).agg(
        F.avg(F.when(F.col("lvl") == 0, F.col("ap"))).alias("map50"),
        F.avg(F.when(F.col("lvl") == 5, F.col("ap"))).alias("map75"), F.avg("ap").alias("map"))
    b = best.groupBy(*keys).agg(F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"))
    out = m.join(b, list(keys)) if keys else m.join(b)
    return out.withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map"))


def confusion_pairs(dets: DataFrame, labels: DataFrame, conf: float = 0.25, iou_min: float = 0.45, cell: float = 64.0, limit: int = CROWDED) -> DataFrame:
    """Mutual greedy matches regardless of class: detection to its best label, then label to its best detection.

    Images of up to ``limit`` boxes pair whole, where their rows already lie together; copies need no collapse there, as
    the lowest id wins among equal overlaps. The others collapse copies and pair in cells.
    """
    k = ["image_id"]
    few_d, few_l, many_d, many_l = split_crowded(dets.where(F.col("conf") > conf), labels, k, limit)
    a, b = bx.box("a_"), bx.box("b_")
    side = lambda df, name, c, prefix: df.select(*k, name, F.col("cls").alias(c), *[F.col(g).alias(f"{prefix}{g}") for g in GEOM])
    few = side(few_d, "det_id", "dcls", "a_").join(side(few_l, "label_id", "lcls", "b_").hint("merge"), k).where(bx.intersection(a, b) > 0)
    d = distinct_boxes(many_d, k, "a_", F.min_by("cls", "det_id").alias("dcls"), F.min("det_id").alias("det_id"))
    lab = distinct_boxes(many_l, k, "b_", F.min_by("cls", "label_id").alias("lcls"), F.min("label_id").alias("label_id"))
    scored = lambda p: p.withColumn("iou", bx.iou(a, b)).where(F.col("iou") > iou_min).select("image_id", "det_id", "dcls", "label_id", "lcls", "iou")
    p = scored(few).unionByName(scored(overlap_pairs(d, lab, k, cell)))
    neg = lambda c: (-F.col(c)).alias(f"neg_{c}")
    claim = p.groupBy("image_id", "det_id", "dcls").agg(F.max(F.struct("iou", neg("label_id"), "lcls")).alias("b"))
    claim = claim.select("image_id", "det_id", "dcls", F.col("b.iou").alias("iou"), (-F.col("b.neg_label_id")).alias("label_id"), F.col("b.lcls").alias("lcls"))
    won = claim.groupBy("image_id", "label_id", "lcls").agg(F.max(F.struct("iou", neg("det_id"), "dcls")).alias("b"))
    return won.select("image_id", "label_id", "lcls", (-F.col("b.neg_det_id")).alias("det_id"), F.col("b.dcls").alias("dcls"), F.col("b.iou").alias("iou"))


def confusion_matrix(dets: DataFrame, labels: DataFrame, background: int, conf: float = 0.25, iou_min: float = 0.45, limit: int = CROWDED) -> DataFrame:
    """Counts by predicted and true class; ``background`` is the extra row and column.

    A detection without a match counts as background only in images that have no
    labels or at least one match, which is how the scoring loop behaves.
    """
    m = shared(confusion_pairs(dets, labels, conf, iou_min, limit=limit))
    sure = dets.where(F.col("conf") > conf)
    unscored = sure.join(labels.select("image_id").join(m, "image_id", "left_anti"), "image_id", "left_semi")
    none, n = F.lit(background), F.col("n")
    count = lambda df, p, a: df.groupBy(F.col(p).alias("predicted"), F.col(a).alias("actual")).agg(F.count(F.lit(1)).alias("n"))
    by_class = lambda df: df.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    entry = lambda df, p, a, c: df.select(p.alias("predicted"), a.alias("actual"), c.alias("n"))
    hit, cls = count(m, "dcls", "lcls"), F.col("cls")
    parts = [
        entry(hit, F.col("predicted"), F.col("actual"), n),
        entry(by_class(sure), cls, none, n), entry(by_class(unscored), cls, none, -n), entry(hit, F.col("predicted"), none, -n),
        entry(by_class(labels), none, cls, n), entry(hit, none, F.col("actual"), -n),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("predicted", "actual").agg(F.sum("n").alias("n")).where("n > 0")


def classification_confusion(scores: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items by predicted class (highest score, lowest class on ties) and true class.

    ``scores`` holds keys, cls, score; ``truth`` keys and actual. Items without scores or truth take no part.
    """
    best = scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("cls")).alias("neg"))).alias("_b"))
    pairs = best.join(truth, list(keys)).select((-F.col("_b.neg")).alias("predicted"), "actual")
    return pairs.groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))


def true_false_positives(matrix: DataFrame, background: int | None = None) -> DataFrame:
    """True and false positives of each class from a confusion table (predicted, actual, n); ``background`` is no class."""
    hit, known = F.col("predicted") == F.col("actual"), F.col("predicted").isNotNull()
    count = lambda when: F.when(when, F.col("n")).otherwise(0)
    # the matrix is read once: each entry counts for its predicted class and names its true one
    sides = F.array(F.struct(F.col("predicted").alias("cls"), count(hit).alias("tp"), count(known & ~F.coalesce(hit, F.lit(False))).alias("fp")),
                    F.struct(F.col("actual").alias("cls"), count(F.lit(False)).alias("tp"), count(F.lit(False)).alias("fp")))
    out = matrix.select(F.explode(sides).alias("_c")).groupBy("_c.cls").agg(F.sum("_c.tp").alias("tp"), F.sum("_c.fp").alias("fp"))
    return out if background is None else out.where(F.col("cls") != background)


#: Distinct boxes of one image and class that are suppressed in one row; larger groups go by rounds.
FOLD = 512


def _fold_kept(d: DataFrame, iou_max: float) -> DataFrame:
    """Greedy suppression of small groups, each in one row: boxes by falling confidence against those kept so far."""
    item = F.struct((-F.col("conf")).alias("neg"), "det_id", *GEOM)
    lists = d.groupBy("image_id", "cls").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(kept, e):
        as_box = lambda s: (s["x1"], s["y1"], s["x2"], s["y2"])
        hit = F.exists(kept, lambda o: bx.iou(as_box(o), as_box(e), 0.0) > iou_max)
        return F.when(hit, kept).otherwise(F.array_append(kept, e))

    kept = F.aggregate("items", F.slice("items", 1, 0), step)
    return lists.select("image_id", "cls", F.explode(kept).alias("e")).select(
        "image_id", "cls", F.col("e.det_id").alias("det_id"), (-F.col("e.neg")).alias("conf"))


def _rounds_kept(d: DataFrame, iou_max: float, cell: float) -> DataFrame:
    """The same result by rounds over the graph of boxes that overlap too much.

    A box without a stronger open neighbour is kept, its weaker neighbours go, and so on with what is open. Boxes meet
    in grid cells, so one crowded image is the work of many tasks. Every round settles at least the strongest open box
    of each cluster of neighbours, and in practice most of them.
    """
    k = ["image_id", "cls"]
    side = lambda p: d.select(*k, *[F.col(g).alias(f"{p}{g}") for g in GEOM], F.col("conf").alias(f"{p}conf"), F.col("det_id").alias(f"{p}det_id"))
    over = (bx.iou(bx.box("a_"), bx.box("b_"), 0.0) > iou_max) & (
        (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_det_id") < F.col("b_det_id"))))
    near = overlap_pairs(side("a_"), side("b_"), k, cell).where(over)
    edges = checkpointed(near.select(*k, F.col("a_det_id").alias("strong"), F.col("b_det_id").alias("weak")))
    gone = None  # boxes suppressed so far; edges hold pairs of open boxes only
    while not edges.isEmpty():
        weak = edges.select(*k, "weak").distinct()
        top = edges.join(weak.withColumnRenamed("weak", "strong"), [*k, "strong"], "left_anti")
        lost = checkpointed(top.select(*k, "weak").distinct())
        gone = lost if gone is None else checkpointed(gone.unionByName(lost))
        edges = edges.join(lost, [*k, "weak"], "left_anti").join(lost.withColumnRenamed("weak", "strong"), [*k, "strong"], "left_anti")
        edges = checkpointed(edges)
    kept = d if gone is None else d.join(gone.withColumnRenamed("weak", "det_id"), [*k, "det_id"], "left_anti")
    return kept.select(*k, "det_id", "conf")


def suppress(dets: DataFrame, conf: float = 0.25, iou_max: float = 0.45, max_in: int | None = None, max_out: int | None = None, fold: int = FOLD,
             cell: float = 64.0) -> DataFrame:
    """Greedy non-maximum suppression per image and class.

    Equal boxes collapse to the strongest first (the others would be suppressed
    by it). ``max_in`` and ``max_out``, where given, limit the boxes of an image before
    and after. Groups of up to ``fold`` distinct boxes are folded in a row; larger ones, of
    any size, are settled by rounds over grid cells.
    """
    strong = F.max(F.struct("conf", (-F.col("det_id")).alias("neg"))).alias("_b")
    d = dets.where(F.col("conf") > conf).groupBy("image_id", "cls", *GEOM).agg(strong)
    d = d.select("image_id", "cls", *GEOM, F.col("_b.conf").alias("conf"), (-F.col("_b.neg")).alias("det_id"))
    if max_in is not None:
        d = top_rows(d, ["image_id"], [F.col("conf").desc(), "det_id"], max_in, ["det_id"])
    d = shared(d)
    large = d.groupBy("image_id", "cls").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold).select("image_id", "cls")
    if large.isEmpty():
        out = _fold_kept(d, iou_max)
    else:
        crowded = checkpointed(large)
        out = _fold_kept(d.join(crowded, ["image_id", "cls"], "left_anti"), iou_max).unionByName(
            _rounds_kept(d.join(crowded, ["image_id", "cls"], "left_semi"), iou_max, cell))
    order = [F.col("conf").desc(), "det_id"]
    if max_out is not None:
        return top_rows(out, ["image_id"], order, max_out, ["det_id"])
    return number_rows(out, ["image_id"], {"c": F.floor((1 - F.col("conf")) * 1024)}, order, "position", 1)


def top_scores(scores: DataFrame, max_det: int) -> DataFrame:
    """Suppression-free selection: strongest boxes by best class, then strongest (box, class) entries.

    ``scores`` holds image_id, det_id, cls, score: one row per box and class.
    """
    best = scores.groupBy("image_id", "det_id").agg(F.max("score").alias("best"))
    keep = top_rows(best, ["image_id"], [F.col("best").desc(), "det_id"], max_det, ["det_id"]).select("image_id", "det_id")
    entries = scores.join(keep, ["image_id", "det_id"], "left_semi")
    return top_rows(entries, ["image_id"], [F.col("score").desc(), "det_id", "cls"], max_det, ["det_id", "cls"])


# ---- label tables --------------------------------------------------------------------

# Category numbers of the 91-class scheme that the 80-class scheme leaves out (fixed values).
UNUSED_CATEGORIES = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)


def category_to_class(c):
    """91-class category number (from 1) to 80-class index (from 0); unused numbers give null."""
    skipped = F.lit(0)
    for u in UNUSED_CATEGORIES:
        skipped = skipped + (c > u).cast("int")
    return F.when(~c.isin(*UNUSED_CATEGORIES), c - 1 - skipped)


def annotations_to_labels(annotations: DataFrame, images: DataFrame, remap: bool = True) -> DataFrame:
    """Annotation boxes to normalised centre boxes, without crowd, empty and repeated boxes."""
    d = annotations.where(F.col("iscrowd") == 0).select("image_id", "category_id", "bx", "by", "bw", "bh").distinct()
    d = salted_join(d, images, ["image_id"], ["category_id", "bx", "by"])
    cls = category_to_class(F.col("category_id")) if remap else F.col("category_id") - 1
    w, h = F.col("bw") / F.col("width"), F.col("bh") / F.col("height")
    out = d.select(
        "image_id", cls.alias("cls"), ((F.col("bx") + F.col("bw") / 2) / F.col("width")).alias("cx"),
        ((F.col("by") + F.col("bh") / 2) / F.col("height")).alias("cy"), w.alias("w"), h.alias("h"))
    return out.where("w > 0 AND h > 0").distinct()


def audit_labels(images: DataFrame, labels: DataFrame, n_classes: int) -> DataFrame:
    """Per-image status (missing, empty, found, corrupt), reason and duplicates.

    ``images`` holds image_id and has_file; ``labels`` holds image_id, n_columns, cls and x, y, w, h.
    """
    worst = F.greatest("x", "y", "w", "h")
    least = F.least("cls", "x", "y", "w", "h")
    per_row = labels.groupBy("image_id", "n_columns", "cls", "x", "y", "w", "h").agg(F.count(F.lit(1)).alias("copies"))
    g = per_row.groupBy("image_id").agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("kept"),
        F.max((F.col("n_columns") != 5).cast("int")).alias("bad_cols"), F.max((worst > 1).cast("int")).alias("bad_range"),
        F.max((least < 0).cast("int")).alias("negative"), F.max((F.col("cls") > n_classes).cast("int")).alias("bad_class"))
    d = images.join(g, "image_id", "left")
    reason = (
        F.when(~F.col("has_file"), "missing").when(F.col("rows").isNull(), "empty").when(F.col("bad_cols") == 1, "columns")
        .when(F.col("bad_range") == 1, "out of bounds").when(F.col("negative") == 1, "negative")
        .when(F.col("bad_class") == 1, "class").otherwise("ok"))
    return d.select(
        "image_id", reason.alias("status"), reason.isin("columns", "out of bounds", "negative", "class").alias("corrupt"),
        F.when(reason == "ok", F.col("rows") - F.col("kept")).otherwise(0).alias("duplicates"),
        F.when(reason == "ok", F.col("kept")).otherwise(0).alias("labels"))


def dataset_statistics(images: DataFrame, labels: DataFrame, split: str = "split") -> DataFrame:
    """Instances and images per split and class, with totals, and unlabelled images per split."""
    per = labels.groupBy("image_id", "cls").agg(F.count(F.lit(1)).alias("n")).join(images, "image_id")
    per_class = per.groupBy(split, "cls").agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("images"))
    any_label = per.groupBy(split, "image_id").agg(F.sum("n").alias("n"))
    total = (
        images.join(any_label, [split, "image_id"], "left").groupBy(split)
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("instances"), F.count(F.lit(1)).alias("images"),
             F.sum(F.col("n").isNull().cast("int")).alias("unlabelled"))
        .withColumn("cls", F.lit(-1).cast("long")))
    return per_class.withColumn("unlabelled", F.lit(0)).unionByName(total.select(split, "cls", "instances", "images", "unlabelled"))


def detections_to_json(dets: DataFrame) -> DataFrame:
    """Detection records as JSON lines: top-left box to 3 places, score to 5."""
    r = lambda c, n: F.bround(c, n)
    b = bx.xyxy_to_ltwh(bx.box())
    rec = F.struct("image_id", F.col("cls").alias("category_id"), F.array(*[r(c, 3) for c in b]).alias("bbox"), r(F.col("conf"), 5).alias("score"))
    return dets.select("image_id", "det_id", *[r(c, 3).alias(n) for c, n in zip(b, ("box_left", "box_top", "box_width", "box_height"))],
                       r(F.col("conf"), 5).alias("score"), F.to_json(rec).alias("json"))


def six_digits(c):
    """Shortest text of a value at six significant digits, halves to even."""
    a = F.abs(c)
    r = F.when(a >= 100, F.bround(c, 3)).when(a >= 10, F.bround(c, 4)).when(a >= 1, F.bround(c, 5)).when(a >= 0.1, F.bround(c, 6)).when(
        a >= 0.01, F.bround(c, 7)).when(a >= 0.001, F.bround(c, 8)).otherwise(F.bround(c, 9))
    return F.regexp_replace(F.format_string("%.6g", r), r"\.?0+(e|$)", "$1")


def detections_to_lines(dets: DataFrame, width: float, height: float, with_conf: bool = True) -> DataFrame:
    """Label-text lines: class, normalised centre box and, if wanted, the confidence."""
    b = bx.xyxy_to_xywhn(bx.box(), width, height)
    parts = [F.col("cls").cast("double"), *b, *([F.col("conf")] if with_conf else [])]
    short = [six_digits(p) for p in parts]
    return dets.select("image_id", "det_id", F.concat_ws(" ", *short).alias("line"))


def tile_windows(images: DataFrame, crop: int, gap: int, rate: float = 0.6, eps: float = 0.01) -> DataFrame:
    """Sliding windows over each image; a window is kept where enough of it lies in the image."""
    step = crop - gap
    n = lambda c: F.when(F.col(c) <= crop, F.lit(1)).otherwise(F.ceil((F.col(c) - crop) / step + 1)).cast("int")
    d = images.withColumns({"_nx": n("width"), "_ny": n("height")})
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    at = lambda i, n_, size: F.when((F.col(n_) > 1) & (F.col(i) == F.col(n_) - 1) & (F.col(i) * step + crop > F.col(size)),
                                    F.col(size) - crop).otherwise(F.col(i) * step)
    d = d.withColumns({"wx1": at("_i", "_nx", "width"), "wy1": at("_j", "_ny", "height")})
    d = d.withColumns({"wx2": F.col("wx1") + crop, "wy2": F.col("wy1") + crop})
    inside = (F.least("wx2", "width") - F.col("wx1")) * (F.least("wy2", "height") - F.col("wy1"))
    d = d.withColumn("_rate", inside / (crop * crop))
    top = F.max("_rate").over(W.partitionBy("image_id"))
    keep = F.when(top > rate, F.col("_rate") > rate).otherwise(F.abs(F.col("_rate") - top) < eps)
    return d.withColumn("_keep", keep).where("_keep").select("image_id", "wx1", "wy1", "wx2", "wy2")


def window_labels(windows: DataFrame, labels: DataFrame, share: float = 0.7, cell: float = 64.0, eps: float = 1e-6) -> DataFrame:
    """Labels with at least ``share`` of their area inside a window (axis-aligned)."""
    w = windows.withColumnsRenamed({f"w{c}": f"a_{c}" for c in GEOM})
    lab = labels.withColumnsRenamed({c: f"b_{c}" for c in GEOM})
    p = overlap_pairs(w, lab, ["image_id"], cell)
    iof = bx.intersection(bx.box("a_"), bx.box("b_")) / F.greatest(bx.area(bx.box("b_")), F.lit(eps))
    return p.withColumn("iof", iof).where(F.col("iof") >= share)

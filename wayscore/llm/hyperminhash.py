"""Near-duplicate documents by HyperMinHash sketches.

A document's set of word shingles becomes 128 registers: the shingle's hash picks a register, and the
register keeps of its smallest hash the count of leading zeros and the 10 bits after the first one, in
16 bits. Bands of five registers are hashed; documents that share a band are candidates, whose Jaccard
similarity is estimated from equal registers less the expected chance collisions before the full sets
decide.

At a similarity of 0.85 one band agrees with a chance of 0.44 and at least one of 25 with all but 5e-7.
Within a band nothing is paired at random: every member meets the band's first document and its most central
one (whose bands have the most members; the base of a group of copies is that), and only where verified links leave a band in several components do the members outside its largest
component meet the others: all of them in small bands, those with a rare difference from a hub in common in
large ones (an exact prefix filter). Members already connected add nothing, so no component is missed.

The driver holds what it plans and broadcasts at one time. So tables of ids are stored step by step, each plan reads
few of them, and they are joined by merging.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.llm.common import SPACES, Alphabet, Texts, merged, mixed, ranges, runs_of, stored, texts_of
from wayscore.llm.components import components
from wayscore.llm.fm_index import content_hash

REGISTERS = 128
MANTISSA = 10
ROWS = 5
BANDS = REGISTERS // ROWS
#: Bands with more members than this find the rest of their links by their differences.
CROWD = 32
#: Words of 64 parities of a difference's elements.
WORDS = 4
#: Candidates this many standard errors below the threshold are not verified.
MARGIN = 6.0

LOWER = Alphabet(SPACES, lower=True)
#: Ids lie below; rows without one count on from here.
NO_ID = 1 << 62


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and where each text's begin (one more at the end)."""
    n = len(texts.offsets) - 1
    words = LOWER.scan(texts)
    counts = words.counts(n)
    hashes = runs_of(words.hash, size)
    whole = words.text[: len(hashes)] == words.text[size - 1 :] if len(hashes) else np.zeros(0, bool)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    owner = np.concatenate([words.text[: len(hashes)][whole], short])
    values = np.concatenate([hashes[whole], content_hash(words.hash, first[short], counts[short])])
    if len(short):
        order = np.argsort(owner, kind="stable")
        owner, values = owner[order], values[order]
    edge = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(n + 1))


def registers(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The sketch of each set: 0 for an empty register, else leading zeros plus one, then the mantissa."""
    n = len(edge) - 1
    owner = np.repeat(np.arange(n), np.diff(edge))
    slot = (values >> np.uint64(57)).astype(np.int64)
    lead = np.ones(len(values), bool)  # ascending values: the first in a register is its smallest
    lead[1:] = (slot[1:] != slot[:-1]) | (owner[1:] != owner[:-1])
    rest = (values[lead] << np.uint64(7)) | np.uint64(64)
    zeros = 64 - np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    zeros = np.clip(zeros, 0, 57)
    mantissa = (rest << np.uint64(1) << zeros.astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = np.zeros((n, REGISTERS), np.uint16)
    out[owner[lead], slot[lead]] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def band_keys(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands with at least one register in use, and where each sketch's begin."""
    cut = sketch[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for k in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, k])
    used = cut.any(axis=2)
    return h[used].view(np.int64), np.concatenate([[0], np.cumsum(used.sum(axis=1))])


SKETCHED = "doc_id long, text_key long, n_shingles long, s1 long, s2 long, sketch binary, bands array<long>"


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for i, j in texts.slices(4 << 20):
                values, edge = shingle_sets(texts.part(i, j), size)
                sketch = registers(values, edge)
                keys, at = band_keys(sketch)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]) for v in (values, mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                digests = [pa.array((c[edge[1:]] - c[edge[:-1]]).view(np.int64)) for c in sums]
                blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), j - i, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
                bands = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(edge)), *digests, blobs, bands], names=["doc_id", "text_key", "n_shingles", "s1", "s2", "sketch", "bands"])

    return run


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity from two blocks of sketches, corrected for chance collisions, and its registers in use."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    x, y = na[:, None] / REGISTERS, nb[:, None] / REGISTERS
    level = np.arange(57)[None, :]
    low, high = 2.0 ** -(level + 1), 2.0**-level
    chance = (low / 2**MANTISSA * x * y / np.maximum(x + y, 1e-9) * (np.exp(-(x + y) * low) - np.exp(-(x + y) * high))).sum(axis=1)
    return np.clip((equal - chance * REGISTERS) / np.maximum(either, 1), 0, 1), either


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("sketch_a", "sketch_b"))
            na, nb = (batch.column(k).to_numpy().astype(float) for k in ("n_a", "n_b"))
            got, used = estimate(a, b, na, nb)
            keep = got >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = texts_of(batch.column("text_a")), texts_of(batch.column("text_b"))
            ends = np.cumsum(np.diff(a.offsets) + np.diff(b.offsets))
            keep, i = np.zeros(batch.num_rows, bool), 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (8 << 20))))
                va, ea = shingle_sets(a.part(i, j), size)
                vb, eb = shingle_sets(b.part(i, j), size)
                for k in range(j - i):
                    x, y = va[ea[k] : ea[k + 1]], vb[eb[k] : eb[k + 1]]
                    if len(x) and len(y):
                        at = np.searchsorted(x, y)
                        both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                        keep[i + k] = 100 * both >= percent * (len(x) + len(y) - both)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, stand_ins: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where their sets of ``size``-word shingles have a Jaccard similarity of at least
    ``percent`` hundredths; component_id is the smallest doc_id reachable. A text of fewer words is one shingle;
    null and wordless texts have none and stay alone. Rows of one doc_id with one text are one document with a row
    each; rows without an id link like others, are never kept, and a component of them alone has the null id; with
    ``stand_ins`` they come with numbers from ``NO_ID`` on instead. An empty table gives no rows; further columns are dropped.
    """
    pa.system_memory_pool().release_unused()  # what the steps before have freed on the driver, numpy's arrays too
    text = F.col("text").cast("string")
    # rows without an id go by their text, after all ids
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), _stand_in(text)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    sketched = stored(rows.mapInArrow(_sketch(size), SKETCHED))
    # equal sets are one class, by a digest of 128 bits and the size; a class number that two of them would share is parted
    alike = ["s1", "s2", "n_shingles"]
    first = sketched.where("n_shingles > 0").groupBy(*alike).agg(F.min("doc_id").alias("doc_id")).withColumn("cid", F.xxhash64(*alike))
    nth = F.row_number().over(W.partitionBy("cid").orderBy(*alike))
    first = stored(first.withColumn("_nth", nth).withColumn("cid", F.when(F.col("_nth") == 1, F.col("cid")).otherwise(F.xxhash64("cid", "_nth", *alike))).drop("_nth"))
    chosen = sketched.join(first, [*alike, "doc_id"]).dropDuplicates(["cid"])
    classes = stored(chosen.select("cid", F.col("doc_id").alias("rep"), "text_key", F.col("n_shingles").alias("n"), "sketch", "bands"))
    bands = classes.select("cid", "rep", "n", F.explode("bands").alias("band"))
    # the base of a group of copies shares more of their bands than any copy does
    met = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    central = bands.join(merged(met), "band").groupBy("cid", "rep", "n").agg(F.sum("m").alias("pull"), F.collect_list("band").alias("bands"))
    bands = stored(central).select("cid", "rep", "n", "pull", F.explode("bands").alias("band"))
    ends = bands.groupBy("band").agg(F.min(F.struct("rep", "cid")).alias("lo"), F.max(F.struct("pull", "rep", "cid")).alias("hi"))
    spread = bands.join(merged(ends), "band").withColumn("hub", F.explode(F.array_distinct(F.array("lo.cid", "hi.cid")))).where("hub <> cid")
    pairs = stored(spread.select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct())
    edges = _confirmed(rows, classes, pairs, size, percent)
    label = stored(components(edges))
    # bands that the links so far leave in several components
    named = bands.join(merged(label.withColumnRenamed("node", "cid")), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    shares = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m"))
    split = shares.groupBy("band").agg(F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m")).where("parts > 1").select("band", "m", F.col("main.label").alias("main"))
    members = stored(named.join(merged(split), "band").select("band", "cid", "n", "label", "main", "m"))
    left, right = members.where("label <> main").where(F.col("m") <= CROWD).alias("l"), members.where(F.col("m") <= CROWD).alias("r")
    other = (
        left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.label") != F.col("r.label")) & (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")))
        .select(F.least("l.cid", "r.cid").alias("a"), F.greatest("l.cid", "r.cid").alias("b"))
        .distinct()
        .join(merged(pairs), ["a", "b"], "left_anti")
    )
    crowd = stored(members.where(F.col("m") > CROWD).select(F.col("main").alias("hub"), "cid", "label").distinct())
    other = stored(other)
    found = [] if other.isEmpty() else [_confirmed(rows, classes, other, size, percent)]
    found += [] if crowd.isEmpty() else [_in_crowds(rows, classes, crowd, size, percent)]
    more = stored(reduce(DataFrame.union, found)) if found else None
    if more is not None and not more.isEmpty():
        label = stored(components(edges.union(more)))
    groups = stored(classes.select("cid", "rep").join(merged(label.withColumnRenamed("node", "cid")), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    least = groups.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = stored(groups.join(merged(least), "label").select("cid", "component_id").join(merged(first.drop("doc_id")), "cid").drop("cid"))
    worded = sketched.where("n_shingles > 0").select("doc_id", *alike).join(merged(ids), alike).select("doc_id", "n_shingles", "component_id")
    out = worded.union(sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    real = lambda c: F.col(c) if stand_ins else F.when(F.col(c) < NO_ID, F.col(c))
    kept = F.coalesce(real("doc_id") == F.col("component_id"), F.lit(False))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), kept.alias("kept"))


def _stand_in(text: Column) -> Column:
    """An id for a row without one, by its text: at least ``NO_ID``."""
    return F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """The documents, all columns kept whatever their names, with one of each component: its smallest doc_id, once.
    Documents without an id rank after all others, by their text."""
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    placed = docs.toDF(*place.values())
    text = F.col(place["text"]).cast("string")
    rows = placed.withColumn("rank", F.coalesce(F.col(place["doc_id"]).cast("long"), _stand_in(text))).withColumn("key", F.xxhash64(text))
    found = near_duplicates(rows.select(F.col("rank").alias("doc_id"), text.alias("text")), size, percent, stand_ins=True)
    kept = stored(found.where("kept").select(F.col("doc_id").alias("rank")).distinct())
    return rows.join(kept, "rank", "left_semi").dropDuplicates(["rank", "key"]).select(*place.values()).toDF(*docs.columns)


def _in_crowds(rows: DataFrame, classes: DataFrame, crowd: DataFrame, size: int, percent: int) -> DataFrame:
    """The links between different labels among the classes ``cid`` around each class ``hub``, exactly.

    Each set is written as its difference D from the hub's set. The symmetric difference of two sets is that of their D;
    a similarity of t allows it (1 - t) / (1 + t) of the two sizes. If two D together are no larger, both sets are linked to
    the hub. Else two linked sets share at least |D| - (1 - t) / t * n elements of either D, so they share one of its
    rarest |D| less that many, plus one (prefix filtering). The place of the shared element in both orders and the parities
    of 256 hashed parts of D bound the difference of a pair from below within the join, both exactly. Copies of one text, which have most of it in common, thus meet
    only by what they changed in common, and sets that only share a passage meet nobody.
    """
    side = classes.select("cid", F.col("rep").alias("doc_id"), "text_key", "n")
    used = crowd.select("cid").union(crowd.select("hub")).distinct()
    texts = stored(rows.join(side.join(used, "cid"), ["doc_id", "text_key"]).dropDuplicates(["cid"]).select("cid", "n", "text"))
    hubs = texts.select(F.col("cid").alias("hub"), F.col("n").alias("n_hub"), F.col("text").alias("text_hub"))
    pairs = crowd.join(texts, "cid").join(hubs, "hub").select("hub", "cid", "label", "n", "n_hub", "text_hub", "text")
    apart = stored(pairs.mapInArrow(_differences(size), "hub long, cid long, label long, n long, n_hub long, d array<long>, bits array<long>")).withColumn("size", F.size("d"))

    def linked(n: str, m: str, apart_: str) -> Column:
        both = (F.col(n) + F.col(m) - F.expr(apart_)) / 2
        return 100 * both >= percent * (both + F.expr(apart_))

    to_hub = apart.where("hub <> cid").where(linked("n", "n_hub", "size")).select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    single = apart.select("hub", "cid", "label", "n", "size", "bits", F.explode("d").alias("item"))
    shares = single.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    least = F.greatest(F.lit(1), F.ceil(F.col("size") - (100 - percent) * F.col("n") / percent - 1e-9))
    # items of one set alone come first in the order and meet nobody: they only count
    alone = F.col("size") - F.count(F.lit(1)).over(W.partitionBy("hub", "cid"))
    at = F.row_number().over(W.partitionBy("hub", "cid").orderBy("df", "item"))
    heads = single.join(shares, ["hub", "item"]).withColumn("at", alone + at).where(F.col("at") <= F.col("size") - least + 1)
    heads = stored(heads.select("hub", "item", "cid", "label", "n", "size", "at", *(F.col("bits")[k].alias(f"bits{k}") for k in range(WORDS))))
    x, y = heads.alias("l"), heads.alias("r")
    fits = (F.col("l.hub") == F.col("r.hub")) & (F.col("l.item") == F.col("r.item")) & (F.col("l.cid") < F.col("r.cid")) & (F.col("l.label") != F.col("r.label"))
    fits &= 100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")
    # how far the two may differ; at their first common element all other common ones still lie ahead of both
    room = (100 - percent) * (F.col("l.n") + F.col("r.n")) / (100 + percent) + 1e-9
    fits &= 2 * (1 + F.least(F.col("l.size") - F.col("l.at"), F.col("r.size") - F.col("r.at"))) >= F.col("l.size") + F.col("r.size") - room
    # parities differ in no more places than the sets do
    fits &= sum(F.bit_count(F.col(f"l.bits{k}").bitwiseXOR(F.col(f"r.bits{k}"))) for k in range(WORDS)) <= room
    met = x.join(y, fits)
    met = met.select("l.hub", F.col("l.cid").alias("a"), F.col("r.cid").alias("b")).distinct()
    own = lambda k: apart.select("hub", F.col("cid").alias(k), F.col("n").alias(f"n_{k}"), F.col("d").alias(f"d_{k}"))
    full = met.join(own("a"), ["hub", "a"]).join(own("b"), ["hub", "b"])
    both = full.where(linked("n_a", "n_b", "size(d_a) + size(d_b) - 2 * size(array_intersect(d_a, d_b))")).select("a", "b")
    return to_hub.union(both).distinct()


def _differences(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, own = texts_of(batch.column(5)), texts_of(batch.column(6))
            ends = np.cumsum(np.diff(hub.offsets) + np.diff(own.offsets))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (8 << 20))))
                vh, eh = shingle_sets(hub.part(i, j), size)
                vo, eo = shingle_sets(own.part(i, j), size)
                out, bits = [], np.zeros((j - i, 64 * WORDS), np.uint8)
                for k in range(j - i):
                    h, o = vh[eh[k] : eh[k + 1]], vo[eo[k] : eo[k + 1]]
                    # what the set lacks is told apart from what it has beyond the hub's
                    out.append(np.concatenate([np.setdiff1d(o, h, assume_unique=True), mixed(np.setdiff1d(h, o, assume_unique=True))]))
                    bits[k] = np.bincount((out[-1] % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32)), pa.array(np.concatenate(out).view(np.int64)))
                parities = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(bits, axis=1).view(np.int64).ravel()), WORDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(5)), lists, parities], names=["hub", "cid", "label", "n", "n_hub", "d", "bits"])
                i = j

    return run


def _confirmed(rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of classes (a, b) that hold on the full sets."""
    side = lambda k: classes.select(F.col("cid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = stored(near.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_likely(percent / 100), "a long, b long"))
    used = likely.select(F.col("a").alias("cid")).union(likely.select(F.col("b").alias("cid"))).distinct()
    wanted = classes.join(used, "cid").select("cid", F.col("rep").alias("doc_id"), "text_key")
    texts = stored(rows.join(wanted, ["doc_id", "text_key"]).select("cid", "text").dropDuplicates(["cid"]))
    full = likely.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(full.mapInArrow(_verify(size, percent), "a long, b long"))

"""Nearest neighbours and similarity over embedding tables."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayscore.functions.numeric import sq_l2
from wayscore.operators.ordered import salted_join, shared


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """One row with the element-wise mean of the rows' vectors."""
    e = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "v"))
    m = e.groupBy("pos").agg(F.avg("v").alias("v"))
    return m.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("query"))


def nearest(df: DataFrame, query: DataFrame, vector: str, limit: int, tie: str) -> DataFrame:
    """The ``limit`` rows nearest to a one-row query table, by squared distance."""
    d = df.join(F.broadcast(query)).withColumn("distance", sq_l2(vector, "query")).drop("query")
    return d.orderBy("distance", tie).limit(limit)


#: Vectors of a block, rows the pivots are chosen from, pivots in all and those whose distances make the cells.
BLOCK = 256
PIVOT_ROWS = 512
PIVOTS = 8
CELL_PIVOTS = 3
_HITS = "array<struct<a:long,b:long,a_copies:long,b_copies:long,distance:double>>"


def _tile_hits(max_sq: float):
    @F.pandas_udf(_HITS)
    def hits(a_ids: pd.Series, a_n: pd.Series, a_vecs: pd.Series, b_ids: pd.Series, b_n: pd.Series, b_vecs: pd.Series, same: pd.Series) -> pd.Series:
        out = []
        for ia, na, va, ib, nb, vb, one in zip(a_ids, a_n, a_vecs, b_ids, b_n, b_vecs, same):
            x, y = np.stack(va).astype(float), np.stack(vb).astype(float)
            rough = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
            i, j = np.nonzero(rough <= max_sq + 1e-6)
            d = ((x[i] - y[j]) ** 2).sum(1)
            found = [(int(ia[p]), int(ib[q]), int(na[p]), int(nb[q]), float(e)) for p, q, e in zip(i, j, d) if e <= max_sq]
            both = found if one else found + [(b, a, m, n, e) for a, b, n, m, e in found]
            out.append([dict(zip(("a", "b", "a_copies", "b_copies", "distance"), h)) for h in both])
        return pd.Series(out)

    return hits


def pivots(vectors: DataFrame) -> DataFrame:
    """One row with up to ``PIVOTS`` vectors that lie far from each other, chosen from ``PIVOT_ROWS`` rows by hash.

    The choice only decides how much is pruned, not what is found.
    """
    def farthest(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(sorted(map(tuple, pdf["v"])), dtype=float)
        gap = ((rows - rows.mean(0)) ** 2).sum(1)
        chosen: list[int] = []
        while len(chosen) < min(PIVOTS, len(rows)):
            chosen.append(int(gap.argmax()))
            new = ((rows - rows[chosen[-1]]) ** 2).sum(1)
            gap = new if len(chosen) == 1 else np.minimum(gap, new)
        return pd.DataFrame({"pivots": [rows[chosen].tolist()]})

    some = vectors.where("v IS NOT NULL").orderBy(F.xxhash64("v"), "v").limit(PIVOT_ROWS)
    return some.groupBy(F.lit(0).alias("_one")).applyInPandas(farthest, "pivots array<array<double>>")


def vector_blocks(groups: DataFrame, width: float) -> DataFrame:
    """Distinct vectors (``rep``, ``copies``, ``v``) in blocks: cell, blk, blocks, ids, n, vs and the least and largest distance to each pivot.

    A cell is the distances to the first pivots in steps of ``width``. A crowded one has many blocks of about ``BLOCK``.
    """
    placed = groups.join(F.broadcast(pivots(groups))).withColumn("_d", F.transform("pivots", lambda p: F.sqrt(sq_l2("v", p)))).drop("pivots")
    placed = placed.withColumn("cell", F.transform(F.slice("_d", 1, CELL_PIVOTS), lambda x: F.floor(x / width)))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = salted_join(placed, sizes, ["cell"], ["rep"]).withColumn("blk", F.pmod(F.xxhash64("rep", F.lit(17)), F.col("blocks")))
    ends = [f(F.get("_d", F.lit(k))).alias(f"{name}{k}") for k in range(PIVOTS) for name, f in (("lo", F.min), ("hi", F.max))]
    return placed.groupBy("cell", "blk", "blocks").agg(F.collect_list(F.struct("rep", "copies", "v")).alias("_l"), *ends).select(
        "cell", "blk", "blocks", F.col("_l.rep").alias("ids"), F.col("_l.copies").alias("n"), F.col("_l.v").alias("vs"),
        F.array(*[f"lo{k}" for k in range(PIVOTS)]).alias("lo"), F.array(*[f"hi{k}" for k in range(PIVOTS)]).alias("hi"))


def block_pairs(blocks: DataFrame, width: float) -> DataFrame:
    """Pairs of blocks, each once, that may hold vectors within ``width``, with their ids, copies and vectors.

    Distances to a pivot differ by no more than the distance itself, so only blocks of the same or a neighbouring cell
    meet whose spans of every pivot distance come within ``width``. Blocks of two cells are dealt into a grid of the
    square roots of their numbers: a task holds as many blocks of one side as of the other, and a block goes to no more
    tasks than that root.
    """
    groups = F.ceil(F.sqrt(F.col("blocks")))
    cells = blocks.select("cell", groups.alias("g")).distinct()
    near = cells.select(F.col("cell").alias("a_cell"), F.col("g").alias("a_g"), F.col("cell").alias("b_cell"))
    shifts = F.array(*[F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=CELL_PIVOTS)])
    # with fewer vectors than pivots a cell is shorter, and some moves are the same
    moved = F.transform(shifts, lambda s: F.zip_with("b_cell", F.slice(s, 1, F.size("b_cell")), lambda x, y: x + y))
    near = near.withColumn("b_cell", F.explode(F.array_distinct(moved)))
    near = near.where("a_cell <= b_cell").join(cells.select(F.col("cell").alias("b_cell"), F.col("g").alias("b_g")), "b_cell")

    def side(p: str, other: str) -> DataFrame:
        d = blocks.select(F.col("cell").alias(f"{p}_cell"), *[F.col(c).alias(f"{p}_{c}") for c in ("blk", "ids", "n", "vs", "lo", "hi")])
        d = near.select("a_cell", "b_cell", "a_g", "b_g").join(d, f"{p}_cell").withColumn(f"_{p}", F.pmod(f"{p}_blk", f"{p}_g"))
        return d.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_g") - 1))).drop("a_g", "b_g")

    met = side("a", "b").join(side("b", "a"), ["a_cell", "b_cell", "_a", "_b"])
    met = met.where("a_cell < b_cell OR a_blk <= b_blk")
    apart = lambda x, y: F.exists(F.zip_with(x, y, lambda u, v: u - v > width), lambda far: far)
    met = met.where(~F.coalesce(apart("a_lo", "b_hi"), F.lit(False)) & ~F.coalesce(apart("b_lo", "a_hi"), F.lit(False)))
    same = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_blk") == F.col("b_blk"))
    return met.select("a_ids", "a_n", "a_vs", "b_ids", "b_n", "b_vs", same.alias("same"))


def within_distance(df: DataFrame, id_: str, vector: str, max_sq: float) -> DataFrame:
    """Pairs of distinct vectors within a squared distance.

    Equal vectors are collapsed first. Blocks of vectors meet where their stored distances to pivots allow a hit (see
    ``block_pairs``) and are compared as matrices, and only the hits leave a task.
    """
    v = F.col(vector).cast("array<double>")
    groups = shared(df.groupBy(v.alias("v")).agg(F.min(id_).alias("rep"), F.count(F.lit(1)).alias("copies")))
    width = max(max_sq, 1e-12) ** 0.5 * (1 + 1e-6)  # room for the rounding of distances
    tiles = block_pairs(shared(vector_blocks(groups, width)), width)
    hits = _tile_hits(max_sq)("a_ids", "a_n", "a_vs", "b_ids", "b_n", "b_vs", "same")
    return tiles.select(F.explode(hits).alias("h")).select("h.*")


def similarity_index(df: DataFrame, id_: str, vector: str, max_dist: float = 0.2, top_k: int | None = None) -> DataFrame:
    """Number of vectors within ``max_dist`` (squared, itself included) and the ids of the distinct ones."""
    p = within_distance(df, id_, vector, max_dist)
    if top_k is not None:
        w = W.partitionBy("a").orderBy("distance", "b").rowsBetween(W.unboundedPreceding, -1)
        p = p.withColumn("_before", F.coalesce(F.sum("b_copies").over(w), F.lit(0))).where(F.col("_before") < top_k)
        p = p.withColumn("b_copies", F.least(F.col("b_copies"), top_k - F.col("_before")))
    reps = p.groupBy("a").agg(F.sum("b_copies").alias("n_similar"), F.array_sort(F.collect_list("b")).alias("similar_ids"))
    rows = df.select(id_, F.col(vector).cast("array<double>").alias("v"))
    rep_of = salted_join(rows, rows.groupBy("v").agg(F.min(id_).alias("a")), ["v"], [id_]).drop("v")
    return rep_of.join(reps, "a").select(id_, "n_similar", "similar_ids")


#: Descriptors of one side in a tile.
TILE = 1024


def _two_nearest(ids: str):
    """For each left vector of a tile its two nearest right ones, as (left id, distance, right id)."""
    kind = T.ArrayType(T.StructType([T.StructField(ids, T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("match_id", T.LongType())]))

    @F.pandas_udf(kind)
    def run(a_ids: pd.Series, a_v: pd.Series, b_ids: pd.Series, b_v: pd.Series) -> pd.Series:
        out = []
        for ia, va, ib, vb in zip(a_ids, a_v, b_ids, b_v):
            ib = np.asarray(ib)
            by = np.argsort(ib, kind="stable")
            ib, right = ib[by], np.array([list(vb[j]) for j in by], float)
            rows = []
            for i, v in zip(ia, va):
                d = np.zeros(len(right))
                for x, col in zip(v, right.T):  # one component after the other, as the plain sum goes
                    d += (x - col) ** 2
                d = np.sqrt(d)
                near = np.argsort(d, kind="stable")[:2]
                rows += [{ids: int(i), "d": float(d[j]), "match_id": int(ib[j])} for j in near]
            out.append(rows)
        return pd.Series(out)

    return run


def ratio_matches(df: DataFrame, image: str, id_: str, vector: str, ratio: float = 0.7, tile: int = TILE) -> DataFrame:
    """Descriptor matches of each image to the next one that pass the best / second-best test.

    Descriptors lie in tiles of about ``tile`` by a hash of their id; each pair of tiles gives two candidates for a
    left descriptor, and of those the two nearest overall are taken. No row holds a whole image.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(image).cast("long").alias("_image"), F.col(id_).cast("long").alias("_id"), v.alias("_v"))
    sizes = rows.groupBy("_image").agg(F.ceil(F.count(F.lit(1)) / tile).alias("_k"))
    placed = salted_join(rows, sizes, ["_image"], ["_id"]).withColumn("_t", F.pmod(F.xxhash64("_id", F.lit(23)), F.col("_k")))
    tiles = placed.groupBy("_image", "_t").agg(F.collect_list(F.struct("_id", "_v")).alias("_l"))
    part = lambda p, shift: tiles.select((F.col("_image") - shift).alias("_image"), F.col("_t").alias(f"_{p}t"), F.col("_l._id").alias(f"_{p}i"), F.col("_l._v").alias(f"_{p}v"))
    pairs = part("a", 0).join(part("b", 1), "_image")
    near = pairs.select("_image", F.explode(_two_nearest("_id")("_ai", "_av", "_bi", "_bv")).alias("n")).select("_image", "n.*")
    one = F.struct("d", F.col("match_id").alias("id"))
    best = near.groupBy("_image", "_id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, 2).alias("_c"))
    best = best.where(F.size("_c") == 2).select("_image", "_id", F.col("_c")[0].alias("a"), F.col("_c")[1].alias("b"))
    return best.where(F.col("a.d") < ratio * F.col("b.d")).select(F.col("_image").alias(image), F.col("_id").alias(id_), F.col("a.id").alias("match_id"), F.col("a.d").alias("distance"))


def sql_over(df: DataFrame, text: str, name: str = "table_rows") -> DataFrame:
    """A SELECT over the table (named ``table``), or only its WHERE clause."""
    text = text.strip()
    if not text.startswith(("SELECT", "WHERE")):
        raise ValueError(f"query must start with SELECT or WHERE, got {text[:40]!r}")
    df.createOrReplaceTempView(name)
    body = f"SELECT * FROM {name} {text}" if text.startswith("WHERE") else text.replace("'table'", name)
    return df.sparkSession.sql(body)

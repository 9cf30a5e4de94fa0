"""Exact top-k by inner product with M-trees.

Every batch of vectors becomes a small M-tree: pages of vectors around a routing vector, each page with its covering
radius and its distance to the tree's root vector, each vector with its distance to the page's. Inner products are turned
into distances by one more component, sqrt(M - |v|^2) with M the largest squared norm of the tree (0 for queries): then
d(q, v)^2 = |q|^2 + M - 2 q.v, so the nearest are those of the highest product.

The search is best-first. A page's bound comes first from the stored distances to the root alone,
| d(q, root) - d(page, root) | - radius; only when it is the query's best page is its own distance computed and the
bound sharpened, and only if it is best again is the page read. There, vectors with | d(q, page) - d(v, page) | over the
k-th distance are skipped. A block of queries goes through a tree together, each in its own order.

Distances prune with a small slack and pages at equal bounds are read, so ties are kept; scores are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = 128
#: Queries of one broadcast block, about.
QUERY_BLOCK = 2048


class MTree:
    """Two levels: a root of routing vectors over pages. Copies are held once, with the ids that can matter."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T))
        vectors, ids = vectors[order], ids[order]
        # a row that stands several times counts once
        once = np.ones(len(ids), bool)
        once[1:] = (vectors[1:] != vectors[:-1]).any(axis=1) | (ids[1:] != ids[:-1])
        vectors, ids = vectors[once], ids[once]
        self.repeats = len(np.unique(ids)) < len(ids)  # an id with several vectors
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        # of copies, only the k + 1 smallest ids can be among the k best (one may be the query itself)
        near = np.arange(len(ids)) - first[group] <= k
        self.copy_ids, self.copy_start = ids[near], np.searchsorted(group[near], np.arange(len(first) + 1))
        v = vectors[first].astype(np.float64)
        norm = (v**2).sum(axis=1)
        self.most = float(norm.max())
        v = np.column_stack([v, np.sqrt(self.most - norm)])
        rng = np.random.default_rng(len(v))
        routes = v[np.sort(rng.choice(len(v), -(-len(v) // PAGE), replace=False))]
        gaps = self._distances(v, routes)
        page = gaps.argmin(axis=1)
        by_page = np.argsort(page, kind="stable")
        self.vectors, self.entry, self.to_route = v[by_page], by_page, gaps[by_page, page[by_page]]
        used, self.begin = np.unique(page[by_page], return_index=True)
        self.begin = np.append(self.begin, len(v))
        self.routes = routes[used]
        self.radius = np.maximum.reduceat(self.to_route, self.begin[:-1])
        self.root = v.mean(axis=0)
        self.to_root = np.sqrt(((self.routes - self.root) ** 2).sum(axis=1))

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, scores, ids) of the k best in this tree for each query, its own id left out."""
        q = np.column_stack([queries.astype(np.float64), np.zeros(len(queries))])
        squared = (q**2).sum(axis=1)
        slack = 1e-6 * (np.sqrt(squared.max(initial=0) + self.most) + 1)
        from_root = np.sqrt(((q - self.root) ** 2).sum(axis=1))
        bound = np.abs(from_root[:, None] - self.to_root[None, :]) - self.radius[None, :]
        exact = np.zeros(bound.shape)  # computed distances to routing vectors
        known = np.zeros(bound.shape, bool)
        kth = np.full(len(q), np.inf)
        scores = np.full((len(q), k), -np.inf)
        ids = np.full((len(q), k), np.iinfo(np.int64).max)
        live = np.arange(len(q))
        while len(live):
            best = bound[live].argmin(axis=1)
            go = bound[live, best] <= kth[live] + slack
            live, best = live[go], best[go]
            fresh = ~known[live, best]
            i, j = live[fresh], best[fresh]
            if len(i):
                exact[i, j] = np.sqrt(((q[i] - self.routes[j]) ** 2).sum(axis=1))
                known[i, j] = True
                bound[i, j] = np.maximum(bound[i, j], exact[i, j] - self.radius[j])
            ready, pages = live[~fresh], best[~fresh]
            for p in np.unique(pages):
                mine = ready[pages == p]
                bound[mine, p] = np.inf
                a, b = self.begin[p], self.begin[p + 1]
                near = np.abs(exact[mine, p][:, None] - self.to_route[None, a:b]) <= kth[mine][:, None] + slack
                some = np.flatnonzero(near.any(axis=0))
                if not len(some):
                    continue
                product = q[mine, :-1] @ self.vectors[a + some, :-1].T  # whole numbers below 2^53
                entries = self.entry[a + some]
                size = self.copy_start[entries + 1] - self.copy_start[entries]
                column = np.repeat(np.arange(len(some)), size)
                name = np.concatenate([self.copy_ids[self.copy_start[e] : self.copy_start[e + 1]] for e in entries])
                value = np.where(near[:, some][:, column] & (name[None, :] != own[mine][:, None]), product[:, column], -np.inf)
                both = np.concatenate([scores[mine], value], axis=1)
                names = np.concatenate([ids[mine], np.broadcast_to(name, value.shape)], axis=1)
                top = np.lexsort((names, -both), axis=1)
                if self.repeats:  # vectors of one id with the same score are one neighbour
                    score, name = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
                    again = np.zeros(both.shape, bool)
                    np.put_along_axis(again, top[:, 1:], (score[:, 1:] == score[:, :-1]) & (name[:, 1:] == name[:, :-1]), 1)
                    both = np.where(again, -np.inf, both)
                    top = np.lexsort((names, -both), axis=1)
                top = top[:, :k]
                scores[mine], ids[mine] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
                low = scores[mine, -1]
                kth[mine] = np.where(np.isfinite(low), np.sqrt(np.maximum(squared[mine] + self.most - 2 * np.where(np.isfinite(low), low, 0), 0)), np.inf)
            live = live[np.isfinite(bound[live].min(axis=1))]
        for i in range(len(q)):
            n = int(np.isfinite(scores[i]).sum())
            if n:
                yield i, scores[i, :n].astype(np.int64), ids[i, :n]


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = block.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            column = batch.column(1)
            flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            out = []
            for dim in np.unique(sizes):
                pick = [i for i, q in enumerate(queries) if len(q) == dim]
                rows = np.flatnonzero(sizes == dim)
                if not pick or not dim:
                    continue
                at = np.cumsum(sizes) - sizes
                tree = MTree(flat[at[rows][:, None] + np.arange(dim)[None, :]], ids[rows], k)
                q = np.array([queries[i] for i in pick], np.int64)
                for i, score, near in tree.search(q, own[pick], k):
                    out.append((np.full(len(near), own[pick[i]]), near, score))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def whole_vectors(table: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and the vector with each component x as floor(scale * x); vectors that are null, empty, or hold a null or
    non-finite component, and rows without an id, are left out."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0)).where(good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query among all vectors but its own id.

    Both tables have vec_id and v (whole numbers). Queries go in blocks, each a broadcast of bounded size and a pass over
    the vectors; every batch of vectors returns its k best of each query. A query id with several rows is asked once,
    with its smallest vector; vectors of another length than the query's are not compared.
    """
    spark = vectors.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()
        block = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), [np.array(r["v"], np.int64) for r in rows]))
        part = vectors.mapInArrow(_search(block, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

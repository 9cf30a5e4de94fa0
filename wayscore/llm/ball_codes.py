"""Codes of vectors by ball k-means, one codebook for each part position, in exact whole numbers.

Every part lies in the ball of the entry that it had in the round before. A ball's radius, the largest distance of its
parts from the entry as it is now, says which entries are its neighbours: those at most two radii away. A part nearer to
its entry than half the way to the nearest neighbour lies in the stable core and keeps its entry unseen. The others lie
in rings around it, each ring between the half distances of two successive neighbours, and compare with the neighbours
inside their ring only. By the triangle inequality all other entries are farther, so assignments are exact.

A round is one pass over a table in the shared folder: whole numbers of the vectors and their codes. It writes the next
such table and, in the same rows' file, each task's counts and sums, of which the driver takes one row for each entry and
component. The table before is deleted then; a lost executor's tasks read the table again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import forget, stored, stored_at
from wayscore.operators.ordered import salted_join

STATE = "vec_id long, label string, ints binary, codes binary, part int, entry int, n long, sums array<long>"
CODED = "vec_id long, label string, code string, error long"


def gaps(entries: np.ndarray) -> np.ndarray:
    """Squared distances between all entries."""
    return ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def nearest_entries(parts: np.ndarray, entries: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each part (ties to the lower index), its squared distance, and how many distances were taken."""
    gap = gaps(entries)
    dist = ((parts - entries[owner]) ** 2).sum(axis=1)
    code, best, taken = owner.copy(), dist.copy(), len(parts)
    for j in np.unique(owner):
        ball = np.flatnonzero(owner == j)
        ball = ball[np.argsort(-dist[ball], kind="stable")]  # rings are then beginnings of the list
        reach = 4 * dist[ball]
        near = np.flatnonzero(gap[j] <= reach[0])
        near = near[near != j]
        near = near[np.argsort(gap[j, near], kind="stable")]
        for i in near:
            ring = ball[: np.searchsorted(-reach, -gap[j, i], "right")]
            d = ((parts[ring] - entries[i]) ** 2).sum(axis=1)
            taken += len(ring)
            better = (d < best[ring]) | ((d == best[ring]) & (i < code[ring]))
            code[ring[better]], best[ring[better]] = i, d[better]
    return code, best, taken


def _raw(scale: int, kind: str, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ints = np.floor(scale * np.asarray(batch.column(2).flatten(), np.float64)).astype(np.int64)
            yield batch.column(0), batch.column(1), ints.reshape(batch.num_rows, -1), np.zeros((batch.num_rows, n_parts), np.int64)

    return run


def _kept(kind: str, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ints = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).astype(np.int64)
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).astype(np.int64)
            yield batch.column(0), batch.column(1), ints.reshape(batch.num_rows, -1), codes.reshape(batch.num_rows, n_parts)

    return run


def _binary_rows(rows: np.ndarray) -> pa.Array:
    raw, width = np.ascontiguousarray(rows).tobytes(), rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw)])


def _assigned(read, books: np.ndarray):
    """Batches with the codes and errors of the rows under ``books``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ids, labels, ints, codes in read(batches):
            error = np.zeros(len(ints), np.int64)
            out = np.zeros_like(codes)
            for p, part in enumerate(np.split(ints, len(books), axis=1)):
                out[:, p], dist, _ = nearest_entries(part, books[p], codes[:, p])
                error += dist
            yield ids, labels, ints, out, error

    return run


def _round(read, books: np.ndarray, kind: str):
    assigned = _assigned(read, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("ints", pa.binary()), ("codes", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        n_parts, k, d = books.shape
        count, sums = np.zeros((n_parts, k), np.int64), np.zeros((n_parts, k, d), np.int64)
        for ids, labels, ints, codes, _ in assigned(batches):
            for p, part in enumerate(np.split(ints, n_parts, axis=1)):
                count[p] += np.bincount(codes[:, p], minlength=k)
                for j in np.unique(codes[:, p]):
                    sums[p, j] += part[codes[:, p] == j].sum(axis=0)
            none = [pa.nulls(len(ids), f.type) for f in list(schema)[4:]]
            yield pa.RecordBatch.from_arrays([ids, labels, _binary_rows(ints.astype(kind)), _binary_rows(codes.astype(np.uint8)), *none], schema=schema)
        some = np.argwhere(count > 0)
        none = [pa.nulls(len(some), f.type) for f in list(schema)[:4]]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array(some[:, 0], pa.int32()), pa.array(some[:, 1], pa.int32()), pa.array(count[count > 0]), pa.array(sums[count > 0].tolist(), pa.list_(pa.int64()))],
            schema=schema,
        )

    return run


def _coded(read, books: np.ndarray):
    assigned = _assigned(read, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, _, codes, error in assigned(batches):
            code = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _moved(books: np.ndarray, rows: DataFrame) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; entries without parts stay."""
    parts = rows.where("part IS NOT NULL")
    size = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"))
    total = parts.select("part", "entry", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = books.copy()
    for r in total.join(size, ["part", "entry"]).collect():  # one row for each component of the codebooks
        out[r["part"], r["entry"], r["at"]] = int(r["s"]) // int(r["n"])
    return out


def _whole(vectors: Column) -> Column:
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.isNotNull() & (F.size(vectors) > 0) & ~bad


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Per vector kept: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    ``vectors`` has vec_id, embedding and label. Empty vectors and those that are null or hold null or non-finite
    components are dropped. Codebooks start from the ``entries`` smallest distinct ids (fewer if there are fewer; null
    is one id, after all others; of several vectors of an id the smallest). Repeated rows and null ids are coded like
    any other; null labels make one label. No kept rows give no rows; further columns are dropped. Vectors of unlike or
    indivisible length, and components too large for distances in 64 bits, end with a ValueError.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.cast("array<double>").alias("embedding")).where(_whole(v))
    seen = rows.agg(F.min(F.size(v)).alias("a"), F.max(F.size(v)).alias("b"), F.max(F.array_max(F.transform(v, F.abs))).alias("m")).first()
    if seen["a"] is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if seen["a"] != seen["b"] or seen["a"] % parts:
        raise ValueError(f"vectors of {seen['a']} to {seen['b']} components: one length is needed, a multiple of {parts}")
    top, width = int(scale * seen["m"]) + 1, seen["a"] // parts
    if 16 * seen["a"] * top * top >= 1 << 63:
        raise ValueError(f"components up to {seen['m']} make distances of over 63 bits")
    kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)

    ids = [r["vec_id"] for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    first = {r["vec_id"]: r["v"] for r in rows.where(wanted).groupBy("vec_id").agg(F.min(v).alias("v")).collect()}
    books = np.floor(scale * np.array([first[i] for i in ids], np.float64)).astype(np.int64).reshape(len(ids), parts, width).transpose(1, 0, 2)

    read, state, last = _raw(scale, kind, parts), rows, None
    for _ in range(rounds):
        path, table = stored_at(state.mapInArrow(_round(read, books, kind), STATE))
        if last:
            forget(spark, last)
        books = _moved(books, table)
        read, state, last = _kept(kind, parts), table.where("part IS NULL").select("vec_id", "label", "ints", "codes"), path
    coded = stored(state.mapInArrow(_coded(read, books), CODED))
    if last:
        forget(spark, last)

    named = coded.select("vec_id", "code", "error", F.coalesce("label", F.lit("")).alias("_label"), F.col("label").isNull().alias("_none"))
    totals = named.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = salted_join(named, totals, ["_label", "_none"], ["vec_id", "code"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

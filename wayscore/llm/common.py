"""Shared pieces of the text operators: tables in the shared folder, and words as numpy arrays.

Words never become Python objects on the hot paths. A batch of texts stays one UTF-8 buffer with
offsets (as Arrow holds it); words are byte ranges of it, with a 64-bit hash each.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words (fixed values of the contracts): white space, or all ASCII but letters and digits.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Where neither is named, a local session gets a temporary folder; any other ends with one clear error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wayscore-shared-"))
    return context.getCheckpointDir()


def stored_at(df: DataFrame) -> tuple[str, DataFrame]:
    """The rows of ``df``, written to the shared folder once, and where: lineage ends here."""
    path = os.path.join(shared_dir(df.sparkSession), f"llm-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder once and read from there."""
    return stored_at(df)[1]


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges, however small it is: what is broadcast instead goes through the driver,
    with a job, a thread and buffers there for each table."""
    return df.hint("merge")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored_at`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, column: str, mega_bytes: int, least: int = 1) -> int:
    """How many parts of at most about ``mega_bytes`` the column's bytes make; grows with the table."""
    total = df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0
    return max(least, -(-int(total) // (mega_bytes << 20)))


class Texts(NamedTuple):
    """Texts as one buffer; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def slices(self, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of whole texts of about ``limit`` bytes; a longer text has a range of its own."""
        n, i = len(self.offsets) - 1, 0
        while i < n:
            j = int(np.searchsorted(self.offsets, self.offsets[i] + limit, "right")) - 1
            j = min(max(j, i + 1), n)
            yield i, j
            i = j

    def part(self, i: int, j: int) -> Texts:
        return Texts(self.data, self.offsets[i : j + 1])

    def get(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return Texts(np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


class Words(NamedTuple):
    """Words in text order: index of the text, byte range in the buffer, hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def counts(self, n_texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=n_texts).astype(np.int64)


class Alphabet:
    """Which bytes make words, and whether A-Z are lower-cased for hashing."""

    def __init__(self, separators: bytes, lower: bool):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.code = np.arange(1, 257, dtype=np.uint64)
        if lower:
            self.code[65:91] += np.uint64(32)
            self.is_word[65:91] = True

    def scan(self, texts: Texts, piece: int = (1 << 20) - (1 << 12), prefixes: tuple[int, ...] = ()) -> Words | tuple[Words, list[np.ndarray]]:
        """All words. Works through the buffer in pieces that end at a separator, so that a very long
        text costs no more memory for each byte than its words need. ``prefixes``: also the hashes of
        each word's first n bytes (of the whole word where it is shorter)."""
        data, offsets = texts
        at, last = int(offsets[0]), int(offsets[-1])
        out: list[tuple[np.ndarray, ...]] = []
        more: list[list[np.ndarray]] = [[] for _ in prefixes]
        while at < last:
            stop = min(at + piece, last)
            while stop < last:
                gap = np.flatnonzero(~self.is_word[data[stop : min(stop + 4096, last)]])
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(stop + 4096, last)
            b = data[at:stop]
            w = self.is_word[b]
            lo, hi = np.searchsorted(offsets, (at, stop), "left")
            cuts = offsets[lo:hi] - at
            s = w.copy()
            s[1:] &= ~w[:-1]
            s[cuts] = w[cuts]
            e = w.copy()
            e[:-1] &= ~w[1:]
            inner = cuts[cuts > 0] - 1
            e[inner] = w[inner]
            starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
            p, inverse = _powers(len(b))
            c = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(self.code[b] * p[: len(b)], out=c[1:])
            unshift = inverse[starts]
            out.append((starts + at, ends + at, mixed((c[ends] - c[starts]) * unshift)))
            for k, n in enumerate(prefixes):
                more[k].append(mixed((c[np.minimum(starts + n, ends)] - c[starts]) * unshift + np.uint64(n * 0x51ED27)))
            at = stop
        if out:
            start, end, h = (np.concatenate(x) for x in zip(*out, strict=True))
        else:
            start, end, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        words = Words(np.searchsorted(offsets, start, "right") - 1, start, end, h)
        if prefixes:
            return words, [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in more]
        return words


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbours; ``len - n + 1`` values."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + hashes[k : k + m]
    return mixed(h)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int = 0x20) -> bytes:
    """The byte ranges joined by one ``gap`` byte."""
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    took = data[np.minimum(ranges(starts, lengths), len(data) - 1)]
    took[np.cumsum(lengths) - 1] = gap
    return took[:-1].tobytes()


def binary_of(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())

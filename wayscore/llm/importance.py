"""Importance resampling of documents towards the word distribution of a target corpus.

A 256-byte table lower-cases A-Z and blanks the separators of a text in UTF-8, ``bytes.split`` yields its words, and
CRC-32 values seeded with those of shorter runs give the hashes of all runs of words up to ``longest``. Counters reduce
the buckets of both corpora. A bucket's gain is the rounded log ratio of its shares; a document's weight is the sum of
its features' gains, and a keyed Gumbel draw on top of it makes the highest scores a sample by weight without
replacement.

Texts are read twice (counts, then weights) and never shuffled; what moves are ``buckets`` counts from each task and one
narrow row for each document. Gains are broadcast: ``buckets`` numbers, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.llm.common import stored

#: The byte table: letters and digits stay, A-Z become a-z, other ASCII bytes become blanks; bytes from 0x80 on stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and counters of words held before they go into buckets.
PIECE = 1 << 20
HELD = 1 << 18
#: Scores that share a block when ranks are counted.
BLOCK = 128


def word_lists(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, a piece of the text at a time; pieces end at blanks, so memory follows the piece."""
    blanked = text.translate(TABLE)
    at = 0
    while at < len(blanked):
        end = blanked.find(b" ", at + piece)
        end = len(blanked) if end < 0 else end
        yield blanked[at:end].split()
        at = end


def runs(words: list[bytes], longest: int) -> Iterator[Iterator[int]]:
    """CRC-32 of all runs of 1 to ``longest`` words joined by one blank; each length goes on from the one before."""
    seeds = list(map(zlib.crc32, words))
    yield iter(seeds)
    more = [b" " + w for w in words] if longest > 1 else []
    for n in range(1, longest):
        seeds = list(map(zlib.crc32, more[n:], seeds))
        yield iter(seeds)


def _carried(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """Pieces of words, each with the last words of the piece before in front of it, and how many those are."""
    tail: list[bytes] = []
    for words in word_lists(text):
        yield tail + words, len(tail)
        tail = (tail + words)[-(longest - 1) :] if longest > 1 else []


class _Gains(dict):
    """Word to gain; a word that is new here is hashed once. Starts afresh beyond ``HELD`` words."""

    def __init__(self, gains: list[int]):
        super().__init__()
        self.gains = gains

    def __missing__(self, word: bytes) -> int:
        self[word] = g = self.gains[zlib.crc32(word) % len(self.gains)]
        return g


def _counts(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        words: Counter[bytes] = Counter()
        hashes: Counter[int] = Counter()

        def flush() -> None:
            for counter, crc in ((words, zlib.crc32), (hashes, int)):
                if counter:
                    at = np.fromiter(map(crc, counter), np.int64, len(counter)) % buckets
                    np.add.at(total, at, np.fromiter(counter.values(), np.int64, len(counter)))
                    counter.clear()

        for batch in batches:
            for text in batch.column(0):
                for piece, old in _carried(text.as_py() or b"", longest):
                    words.update(piece[old:])
                    if longest > 1:
                        for n, found in enumerate(runs(piece, longest)):
                            if n:  # runs that lie wholly in the words carried over have been counted
                                hashes.update(list(found)[max(0, old - n) :])
                if len(words) + len(hashes) > HELD:
                    flush()
        flush()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10000) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket; null texts have none."""
    some = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_counts(longest, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in some.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets, at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> list[int]:
    """floor(scale * ln of the ratio of shares) for each bucket, one added to every count."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return [math.floor(scale * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)]


def gumbel(key: str, scale: int = 1000) -> int:
    """floor(-scale * ln(-ln u)) of the 32-bit uniform number that SHA-256 gives the key."""
    u = (int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
    return math.floor(-scale * math.log(-math.log(u)))


def _weights(gain, longest: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Gains(gain.value)
        table = np.array(gain.value, np.int64)
        for batch in batches:
            n_words, n_features, weight, score = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found, total = 0, 0, 0
                for piece, old in _carried(text.as_py() or b"", longest):
                    fresh = piece[old:]
                    n += len(fresh)
                    total += sum(map(of.__getitem__, fresh))
                    if longest > 1:
                        for k, crcs in enumerate(runs(piece, longest)):
                            if k:
                                rest = list(crcs)[max(0, old - k) :]
                                found += len(rest)
                                total += int(table[np.array(rest, np.int64) % len(table)].sum())
                if len(of) > HELD:
                    of.clear()
                n_words.append(n)
                n_features.append(n + found)
                weight.append(total)
                score.append(total + gumbel(f"{seed}:{'null' if i is None else i}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def _first_places(rows: DataFrame) -> DataFrame:
    """For each score among ``rows``, how many have a higher one. Scores are counted, then blocks of scores, so that
    the last window sees one row for each ``BLOCK`` possible scores."""
    counts = rows.groupBy("score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("score") / BLOCK))
    inner = W.partitionBy("_block").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_m")).withColumn("_top", F.coalesce(F.sum("_m").over(outer), F.lit(0)))
    return (
        counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
        .join(blocks, "_block")
        .select("score", F.lit(True).alias("_able"), (F.col("_top") + F.col("_in")).alias("_before"))
    )


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (from 1; null where it is not drawn).

    Drawn are the floor(percent * N / 100) highest scores of the N documents with ``least_words`` words or more, ties to
    the smaller doc_id; a null doc_id comes after all others and draws by the key "null". Null and empty texts have no
    features and weight 0; repeated rows count and are drawn one by one; an empty target gives every bucket the count 0;
    an empty table gives no rows; further columns are dropped.
    """
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    scored = stored(rows.mapInArrow(_weights(gain, longest, seed), "doc_id long, n_words long, n_features long, weight long, score long"))
    gain.unpersist()
    able: Column = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    places = _first_places(scored.where(able)).where(F.col("_before") < drawn)
    own = W.partitionBy("score", "_able").orderBy(F.col("doc_id").asc_nulls_last())
    rank = (F.col("_before") + F.row_number().over(own)).cast("long")
    placed = scored.withColumn("_able", able).join(places, ["score", "_able"], "left").withColumn("_rank", rank)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))

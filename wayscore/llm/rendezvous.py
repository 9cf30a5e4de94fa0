"""Weighted rendezvous sharding of stable record keys, in DataFrame functions only.

Every shard draws a number for a record from a hash of (key, shard); the shard whose weighted draw
``-weight / ln(u)`` is highest takes the record. A draw depends on nothing but key, shard and that
shard's weight, so one more shard takes rows only into itself, and a changed weight moves only rows
into or out of that shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids in one counting block, and blocks in one block of blocks.
BLOCK = 4096
SUPER = 1024


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """The weighted draw: 52 bits of MD5 as u in (0, 1), so that any engine gets the same number."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), shard.cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -weight / F.log(u)


def choose(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, shard) of the shard with the highest draw; ties to the higher shard number."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    key = F.coalesce(key.cast("string"), F.lit("null"))
    return F.array_max(F.transform(table, lambda s: F.struct(draw(key, s["i"], s["w"]).alias("score"), s["i"].alias("shard"))))


def assign(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (the shard if one more, of ``grown_weight``, is added).

    Null keys count as one key of their own; repeated keys share a shard. Every weight must be over 0.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    n = len(weights)
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    more = draw(k, F.lit(n), F.lit(float(grown_weight if grown_weight is not None else weights[-1])))
    return (
        df.withColumn("_best", choose(F.col(key), weights))
        .withColumn("shard", F.col("_best.shard").cast("int"))
        .withColumn("grown_shard", F.when(more >= F.col("_best.score"), F.lit(n)).otherwise(F.col("_best.shard")).cast("int"))
        .drop("_best")
    )


def with_slots(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: gapless positions from 0 inside each ``shard``, by ``key`` and then ``order``.

    No shard meets in one task: rows are numbered inside (shard, block of ids), and the counts of the
    blocks before come from two levels of sums, so that even the top level has one row for each
    4 million ids of a shard. Rows with a null key are spread over blocks by ``order``.
    """
    block = F.coalesce(F.floor(F.col(key) / F.lit(BLOCK)), -1 - F.pmod(F.xxhash64(*order), F.lit(BLOCK))).cast("long")
    rows = df.withColumn("_block", block)
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_super", F.floor(F.col("_block") / F.lit(SUPER)).cast("long"))
    inner = W.partitionBy("shard", "_super").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("shard").orderBy("_super").rowsBetween(W.unboundedPreceding, -1)
    tops = counts.groupBy("shard", "_super").agg(F.sum("_n").alias("_m")).withColumn("_top", F.coalesce(F.sum("_m").over(outer), F.lit(0)))
    starts = (
        counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
        .join(tops.drop("_m"), ["shard", "_super"])
        .select("shard", "_block", (F.col("_top") + F.col("_in")).alias("_start"))
    )
    own = W.partitionBy("shard", "_block").orderBy(F.col(key).asc_nulls_first(), *order)
    return (
        rows.join(starts, ["shard", "_block"])
        .withColumn("slot", (F.col("_start") + F.row_number().over(own) - 1).cast("long"))
        .drop("_block", "_start")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard.

    The record key is ``doc_id``; the text is never shuffled. Null text has size 8 and the CRC of no bytes;
    repeated rows get a slot each; an empty table gives no rows; further columns are dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_slots(assign(rows, "doc_id", weights, grown_weight), "doc_id", ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""Questions from buckets of documents to shards of their content, and the answers.

Documents lie in buckets (by a hash of the row), content in shards (by a hash of the content). A bucket
sends each shard one blob of what it has of that shard's content, each thing once; the shard answers
each blob with a blob; the bucket's documents, hashed once and read twice, take the answers. A hot
word or passage is one entry in each bucket's blob, however many of its documents have it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import parts_for, shuffle_partitions

_ZSTD = pa.Codec("zstd", compression_level=3)

#: Megabytes of text in one bucket of documents.
BUCKET_MB = 16


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed one by one, in one blob."""
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(a)
        body = _ZSTD.compress(raw.tobytes(), asbytes=True) if raw.nbytes else b""
        out += [struct.pack("<4sqq", raw.dtype.str.encode(), raw.nbytes, len(body)), body]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<i", blob), 4, []
    for _ in range(n):
        kind, size, length = struct.unpack_from("<4sqq", blob, at)
        at += 20
        raw = _ZSTD.decompress(blob[at : at + length], size, asbytes=True) if size else b""
        out.append(np.frombuffer(raw, kind.rstrip(b"\0").decode()))
        at += length
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers, not negative, in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def in_buckets(docs: DataFrame) -> DataFrame:
    """doc_id, text and bucket, hashed on the bucket; the count of buckets grows with the text bytes."""
    least = shuffle_partitions(docs.sparkSession)
    n = parts_for(docs, "text", BUCKET_MB, 2 * least)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(least, "bucket")


def blobs(bucket: list[int], shard: list[int], blob: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "shard": pa.array(shard, pa.int32()), "blob": pa.array(blob, pa.binary())})


BLOBS = "bucket int, shard int, blob binary"

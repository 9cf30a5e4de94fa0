"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counts of words and of word pairs are gathered over the whole training text: batches send each shard of
the hash space its words and pairs, each once with its count. A pair seen c times goes into the filter as
its levels 1 to 1 + floor(log2 c), so that repeated membership probes give back its count rounded down to a
power of two. The filter has a fixed number of bits for an entry and grows with the input. Its parts, one for
each shard, are broadcast while they are small together; from there on they stay apart, and buckets of documents
ask them for their pairs. Both ways give the same counts.

P(w | v) = (c'(v w) + (c(v) + mu - k(v)) P(w)) / (c(v) + mu), where c' is the count from the filter, k(v) the
number of places in the training text where v is followed by a word that makes a pair of the filter with it,
and P(w) the smoothed share of w. The sum of c'(v .) is at most k(v), so the probabilities of all words add up
to one or a little less (the filter's rare false positives aside).

Word counts and k(v) are exact and are never broadcast: buckets of documents ask the shards for the words
they have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.buckets import BLOBS, in_buckets, narrow, packed, unpacked
from wayscore.llm.common import SPACES, Alphabet, Texts, mixed, parts_for, shuffle_partitions, stored, texts_of

#: Bits and probes of one filter entry, the most megabytes of a filter that is broadcast, and text megabytes behind a shard.
ENTRY_BITS = 12
PROBES = 6
FILTER_MB = 128
SHARD_MB = 24
#: Level 1 stands for 2^LOWEST occurrences.
LOWEST = 0
#: Weight of the single-word distribution.
MU = 50.0

LOWER = Alphabet(SPACES, lower=True)
END = np.uint64(0x45D9F3B3335B369)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def token_stream(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and the count of tokens of each text."""
    n = len(texts.offsets) - 1
    words = LOWER.scan(texts)
    counts = words.counts(n) + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    out[np.arange(len(words.hash)) + words.text] = words.hash
    return out, counts


def pairs_of(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text's first token follows the end of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[:1] = END
    first = np.cumsum(counts) - counts
    before[first] = END
    return mixed(before * _PAIR + tokens)


def contexts_of(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of the token before each; -1 for the end of a text that stands before the first."""
    before = np.arange(-1, len(tokens) - 1)
    before[np.cumsum(counts) - counts] = -1
    return before


def level_of(counts: np.ndarray) -> np.ndarray:
    """floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1] - 1


COUNTED = "shard int, kind int, blob binary"
#: Kinds of blobs: words with counts, pairs with counts, pairs with levels, questions of buckets.
WORDS, PAIRS, LEVELS, ASKED = range(4)


def _split(shard: np.ndarray, n_shards: int) -> Iterator[tuple[int, slice]]:
    """Slices of arrays that are in the order of their shard."""
    edge = np.searchsorted(shard, np.arange(n_shards + 1))
    for s in range(n_shards):
        if edge[s + 1] > edge[s]:
            yield s, slice(edge[s], edge[s + 1])


def _shard(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return (hashes % np.uint64(n_shards)).astype(np.int64)


def _by_shard(n_shards: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    shard = _shard(columns[0], n_shards)
    order = np.argsort(shard, kind="stable")
    return shard[order], *(c[order] for c in columns)


def _count(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for i, j in texts.slices(8 << 20):
                tokens, counts = token_stream(texts.part(i, j))
                rows = []
                w, n = np.unique(tokens, return_counts=True)
                shard, w, n = _by_shard(n_shards, w, n)
                rows += [(s, WORDS, packed(w[k], narrow(n[k]))) for s, k in _split(shard, n_shards)]
                pair, n = np.unique(pairs_of(tokens, counts), return_counts=True)
                shard, pair, n = _by_shard(n_shards, pair, n)
                rows += [(s, PAIRS, packed(pair[k], narrow(n[k]))) for s, k in _split(shard, n_shards)]
                s, k, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], names=["shard", "kind", "blob"])

    return run


def _summed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not blobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = zip(*(unpacked(b) for b in blobs), strict=True)
    keys, counts = np.concatenate(keys), np.concatenate([c.astype(np.int64) for c in counts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


MERGED = "shard int, kind int, blob binary, n_words long, n_tokens long, levels array<long>"


def _merge(table: pa.Table) -> pa.Table:
    kinds = np.array(table.column("kind").to_pylist())
    blobs = [b.as_py() for b in table.column("blob")]
    words, count = _summed([b for b, k in zip(blobs, kinds, strict=True) if k == WORDS])
    pairs, often = _summed([b for b, k in zip(blobs, kinds, strict=True) if k == PAIRS])
    level = level_of(often)
    shard = table.column("shard")[0].as_py()
    return pa.table({
        "shard": pa.array([shard] * 2, pa.int32()), "kind": pa.array([WORDS, LEVELS], pa.int32()),
        "blob": pa.array([packed(words, narrow(count)), packed(pairs, narrow(level))], pa.binary()),
        "n_words": pa.array([len(words), 0]), "n_tokens": pa.array([int(count.sum()), 0]),
        "levels": pa.array([[], np.bincount(level, minlength=1).tolist()], pa.list_(pa.int64())),
    })


def _places(pairs: np.ndarray, level: np.ndarray | int, begin: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit places of (pair, level), which lie in the part of the pair's shard."""
    h = mixed(pairs + np.uint64(0x632BE59BD9B4E019) * np.asarray(level, np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for j in range(PROBES):
        yield ((h + np.uint64(j) * step) % np.asarray(bits, np.uint64)).astype(np.int64) + begin


def _fill(lowest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, bits, bodies = [], [], []
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs, level = unpacked(blob.as_py())
                top = level.astype(np.int64) - (lowest - 1)
                entries = int(np.maximum(top, 0).sum())
                if entries:
                    size = entries * ENTRY_BITS + 64
                    flags = np.zeros(size, bool)
                    for k in range(1, int(top.max()) + 1):
                        for at in _places(pairs[top >= k], k, 0, size):
                            flags[at] = True
                    shards.append(shard)
                    bits.append(size)
                    bodies.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(bits, pa.int64()), pa.array(bodies, pa.binary())], names=["shard", "bits", "body"])

    return run


class LevelFilter:
    """The broadcast filter: one part of bits for each shard of the pair hashes."""

    def __init__(self, parts: list[tuple[int, int, bytes]], n_shards: int, lowest: int):
        self.n_shards, self.lowest = n_shards, lowest
        self.bits, self.begin = np.ones(n_shards, np.int64), np.zeros(n_shards, np.int64)
        bodies, at = [np.zeros(1, np.uint8)], 1
        for shard, bits, body in sorted(parts):
            self.bits[shard], self.begin[shard] = bits, 8 * at
            bodies.append(np.frombuffer(body, np.uint8))
            at += len(body)
        self.body = np.concatenate(bodies)

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """2^(level + lowest - 1) by probes for levels 1, 2, ... until one is not there; 0 where the first is not."""
        out = np.zeros(len(pairs))
        live, k = np.arange(len(pairs)), 1
        while len(live):
            shard = _shard(pairs[live], self.n_shards)
            begin, bits, at = self.begin[shard], self.bits[shard], np.arange(len(live))
            for j, place in enumerate(_places(pairs[live], k, begin, bits)):
                if j:
                    place = place[at]
                at = at[(self.body[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                if not len(at):
                    break
            live = live[at]
            out[live] = 2.0 ** (k + self.lowest - 1)
            k += 1
        return out


class ToldLevels:
    """The pair counts of one bucket, as the filter's parts have told them."""

    def __init__(self, told: pa.Table, n_shards: int):
        self.n_shards = n_shards
        self.told = list(zip(told.column("shard").to_pylist(), told.column("blob"), strict=True))

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        every, place = np.unique(pairs, return_inverse=True)
        shard, _, old = _by_shard_of(self.n_shards, every)
        out = np.zeros(len(every))
        for s, blob in self.told:
            x, y = np.searchsorted(shard, (s, s + 1))
            (log,) = unpacked(blob.as_py())
            out[old[x:y]] = np.where(log > 0, 2.0 ** (log.astype(np.float64) - 1), 0)
        return out[place]


PROBED = "shard int, bucket int, bits long, blob binary"


def _ask_pairs(n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        pairs = np.unique(pairs_of(*token_stream(texts_of(table.column("text")))))
        shard, pairs, _ = _by_shard_of(n_shards, pairs)
        rows = [(s, packed(pairs[k])) for s, k in _split(shard, n_shards)]
        n = len(rows)
        bucket = [table.column("bucket")[0].as_py()] * n
        return pa.table({"shard": pa.array([s for s, _ in rows], pa.int32()), "bucket": pa.array(bucket, pa.int32()), "bits": pa.nulls(n, pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def _probe(n_shards: int, lowest: int):
    """Answers to the pairs asked of a part: 1 + log2 of the count, 0 for a pair that is not there."""

    def run(table: pa.Table) -> pa.Table:
        shard, out, buckets = table.column("shard")[0].as_py(), [], []
        rows = list(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), table.column("blob"), strict=True))
        part = LevelFilter([(shard, bits, blob.as_py()) for _, bits, blob in rows if bits is not None], n_shards, lowest)
        for bucket, bits, blob in rows:
            if bits is None:
                count = part.counts(*unpacked(blob.as_py()))
                out.append(packed(np.where(count > 0, level_of(count) + 1, 0).astype(np.uint8)))
                buckets.append(bucket)
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})

    return run


def _held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids], bool)


class Bucket:
    """The tokens of a bucket of documents, its distinct tokens in shard order, and its pair counts from the filter."""

    def __init__(self, table: pa.Table, levels: LevelFilter | ToldLevels, n_shards: int):
        tokens, self.counts = token_stream(texts_of(table.column("text")))
        self.held_out = _held_out(table.column("doc_id").to_pylist())
        distinct, index = np.unique(tokens, return_inverse=True)
        self.shard, self.words, old = _by_shard_of(n_shards, distinct)
        place = np.empty(len(old), np.int64)
        place[old] = np.arange(len(old))
        self.index = place[index]
        before = contexts_of(tokens, self.counts)
        end = place[np.searchsorted(distinct, END)]
        self.context = np.where(before < 0, end, self.index[before])
        self.paired = levels.counts(pairs_of(tokens, self.counts))
        train = np.repeat(~self.held_out, self.counts)
        self.known_after = np.bincount(self.context[train & (self.paired > 0)], minlength=len(distinct))


def _by_shard_of(n_shards: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shard = _shard(hashes, n_shards)
    order = np.argsort(shard, kind="stable")
    return shard[order], hashes[order], order


ASKING = "shard int, kind int, bucket int, blob binary"


def _asked(table: pa.Table, levels: LevelFilter | ToldLevels, n_shards: int) -> pa.Table:
    rows, bucket = [], None
    if table.num_rows:
        b = Bucket(table, levels, n_shards)
        bucket = table.column("bucket")[0].as_py()
        rows = [(s, packed(b.words[k], narrow(b.known_after[k]))) for s, k in _split(b.shard, n_shards)]
    n = len(rows)
    return pa.table({"shard": pa.array([s for s, _ in rows], pa.int32()), "kind": pa.array([ASKED] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})


def _ask(levels, n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        return _asked(table, levels.value, n_shards)

    return run


def _ask_told(n_shards: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        return _asked(table, ToldLevels(told, n_shards), n_shards)

    return run


def _answer(table: pa.Table) -> pa.Table:
    kinds, shard = table.column("kind").to_pylist(), table.column("shard")[0].as_py()
    asked = [(k, unpacked(x.as_py())) for k, kind, x in zip(table.column("bucket").to_pylist(), kinds, table.column("blob"), strict=True) if kind == ASKED]
    words, count = _summed([x.as_py() for kind, x in zip(kinds, table.column("blob"), strict=True) if kind == WORDS])
    every, place = np.unique(np.concatenate([w for _, (w, _) in asked]), return_inverse=True) if asked else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    after = np.zeros(len(every), np.int64)
    if asked:
        np.add.at(after, place, np.concatenate([k.astype(np.int64) for _, (_, k) in asked]))
    seen = np.zeros(len(every), np.int64)
    at = np.searchsorted(words, every)
    same = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == every) if len(words) else np.zeros(len(every), bool)
    seen[same] = count[at[same]]
    out, k = [], 0
    for _, (w, _) in asked:
        own = place[k : k + len(w)]
        out.append(packed(narrow(seen[own]), narrow(after[own])))
        k += len(w)
    return pa.table({"bucket": pa.array([k for k, _ in asked], pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(levels, n_shards: int, total: int, distinct: int, mu: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCORED.split(", ")]
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()), strict=True)})
        own = np.array(answers.column("told").to_pylist(), bool)
        b = Bucket(docs, levels.value if levels else ToldLevels(answers.filter(pa.array(own)), n_shards), n_shards)
        answers = answers.filter(pa.array(~own))
        count, after = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64)
        for shard, blob in zip(answers.column("shard").to_pylist(), answers.column("blob"), strict=True):
            x, y = np.searchsorted(b.shard, (shard, shard + 1))
            count[x:y], after[x:y] = unpacked(blob.as_py())
        single = (count + 0.5) / (total + 0.5 * (distinct + 1))
        share, seen = single[b.index], count[b.context]
        chance = (b.paired + np.maximum(seen + mu - after[b.context], 0) * share) / (seen + mu)
        chance = np.where(seen > 0, np.minimum(chance, 1.0), share)
        first = np.cumsum(b.counts) - b.counts
        sums = [np.add.reduceat(x, first) for x in (np.log10(share), np.log10(chance), (count[b.index] > 0).astype(np.int64))]
        n = docs.num_rows
        return pa.table(dict(zip(names, (docs.column("doc_id"), pa.array(b.held_out), pa.array(b.counts), pa.array(sums[2]), pa.array([total] * n, pa.int64()), pa.array(sums[0]), pa.array(sums[1])), strict=True)))

    return run


def score_documents(docs: DataFrame, mu: float = MU, filter_mb: int = FILTER_MB) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Learned from the rows whose crc32(doc_id as text) mod 5 is not 1; a null doc_id counts as one of them. Null and
    wordless texts have one token, their end. Repeated rows count as often as they stand. Without training rows every
    token has the same probability; an empty table gives no rows; further columns are dropped.
    """
    spark = docs.sparkSession
    n_shards = parts_for(docs, "text", SHARD_MB, shuffle_partitions(spark))
    train = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5, F.lit(0)) != 1)
    counted = train.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_count(n_shards), COUNTED)
    merged = stored(counted.groupBy("shard").applyInArrow(_merge, MERGED))
    total, distinct = merged.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    bits = merged.select(F.posexplode("levels").alias("pos", "n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("pos") + 1 - LOWEST)), F.lit(0))).first()[0] * ENTRY_BITS
    parts = merged.where(F.col("kind") == LEVELS).select("shard", "blob").mapInArrow(_fill(LOWEST), "shard int, bits long, body binary")
    rows = in_buckets(docs)
    if bits <= filter_mb << 23:
        levels, told = spark.sparkContext.broadcast(LevelFilter([tuple(r) for r in parts.collect()], n_shards, LOWEST)), None
        asked = rows.groupBy("bucket").applyInArrow(_ask(levels, n_shards), ASKING)
    else:
        levels, pairs = None, rows.groupBy("bucket").applyInArrow(_ask_pairs(n_shards), PROBED)
        probed = pairs.union(parts.select("shard", F.lit(None).cast("int").alias("bucket"), "bits", F.col("body").alias("blob")))
        told = stored(probed.groupBy("shard").applyInArrow(_probe(n_shards, LOWEST), BLOBS))
        asked = rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_ask_told(n_shards), ASKING)
    words = merged.where(F.col("kind") == WORDS).select("shard", "kind", F.lit(None).cast("int").alias("bucket"), "blob")
    answers = asked.union(words).groupBy("shard").applyInArrow(_answer, BLOBS).withColumn("told", F.lit(False))
    if told is not None:
        answers = answers.union(told.withColumn("told", F.lit(True)))
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score(levels, n_shards, int(total), int(distinct), mu), SCORED)

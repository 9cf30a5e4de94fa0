"""Removal of repeated passages with compressed FM-indexes.

A window of words that occurs twice must be looked up in one place. So texts are cut into segments:
runs of windows that share their smallest 4-word hash. Equal windows have equal smallest hashes and
so go to the same shard; a shard needs only the segments whose hash comes from several places.

A shard concatenates its distinct segments, builds an FM-index over them (suffixes in the order of
their next words, Burrows-Wheeler transform in a wavelet matrix with bit-packed ranks), and streams the
segments' windows through it by backward search. The search follows the matching statistics of each
window up to the window's length: it ends early when only the window's own place is left. Windows
matched in full report the smallest document of their interval in the document array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayscore.llm.buckets import BLOBS, blobs, in_buckets, narrow, packed, unpacked
from wayscore.llm.common import SPACES, Alphabet, Texts, Words, gathered, mixed, parts_for, ranges, runs_of, shuffle_partitions, texts_of

#: Words of the hash whose smallest value in a window picks the shard, and text megabytes behind one shard.
ANCHOR = 4
SHARD_MB = 12
#: A null doc_id ranks after all others.
LAST = np.iinfo(np.int64).max

PLAIN = Alphabet(SPACES, lower=False)


class WaveletMatrix:
    """Ranks of symbols in a sequence; bits packed 64 to a word with a count before each word."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.n, self.levels = len(values), []
        bits_each = max(1, int(symbols - 1).bit_length())
        self.start = np.arange(symbols, dtype=np.int64)  # becomes where each symbol's run begins on the last level
        origin = np.zeros(symbols, np.int64)
        for level in range(bits_each - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32)
            zeros = int(self.n - bit.sum())
            self.levels.append((level, words, before, zeros))
            origin = self._step(origin, (self.start >> level) & 1, words, before, zeros)
            values = np.concatenate([values[~bit], values[bit]])
        self.start = origin

    @staticmethod
    def _step(at, bit, words, before, zeros):
        block = at >> 6
        ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(bit == 1, zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = self.start[symbol]
        for level, words, before, zeros in self.levels:
            at = self._step(at, (symbol >> level) & 1, words, before, zeros)
        return at - begin


class FMIndex:
    """Index of a sequence of symbols (0 parts its pieces), exact for patterns of up to ``depth`` symbols."""

    def __init__(self, seq: np.ndarray, depth: int):
        symbols = int(seq.max(initial=0)) + 1
        padded = np.concatenate([seq, np.zeros(depth, seq.dtype)])
        per = max(1, int(62 // np.log2(max(symbols, 2))))
        keys = []
        for i in range(0, depth, per):
            key = np.zeros(len(seq), np.int64)
            for k in range(i, min(i + per, depth)):
                key = key * symbols + padded[k : k + len(seq)]
            keys.append(key)
        self.array = np.lexsort(keys[::-1])
        self.bwt = WaveletMatrix(np.where(self.array > 0, seq[self.array - 1], 0), symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])

    def intervals(self, seq: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of the windows ``seq[start : start + length]``, all of which are in the index. A window
        with one place left before it is read in full keeps that interval of one."""
        last = seq[starts + length - 1]
        lo, hi = self.first[last].copy(), self.first[last + 1].copy()
        open_ = np.flatnonzero(hi - lo > 1)
        for k in range(length - 2, -1, -1):
            if not len(open_):
                break
            symbol = seq[starts[open_] + k]
            n = len(open_)
            got = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[open_], hi[open_]])) + np.concatenate([self.first[symbol]] * 2)
            lo[open_], hi[open_] = got[:n], got[n:]
            open_ = open_[hi[open_] - lo[open_] > 1]
        return lo, hi


class Segments:
    """The segments of a bucket of texts, each content once, in the order (shard, content hash)."""

    def __init__(self, words: Words, ids: np.ndarray, window: int, n_shards: int):
        n = len(words.hash) - window + 1
        self.window, self.n_shards = window, n_shards
        none = np.zeros(0, np.int64)
        if n <= 0:
            self.start = self.size = self.owner = self.content = self.place = self.shard = self.low = self.count = none
            self.anchor = np.zeros(0, np.uint64)
            return
        grams = runs_of(words.hash, min(ANCHOR, window))
        least = grams[:n].copy()
        for k in range(1, window - min(ANCHOR, window) + 1):
            np.minimum(least, grams[k : k + n], out=least)
        whole = words.text[:n] == words.text[window - 1 :]
        fresh = whole.copy()
        fresh[1:] &= ~(whole[:-1] & (least[1:] == least[:-1]) & (words.text[1:n] == words.text[: n - 1]))
        self.start = np.flatnonzero(fresh)
        stop = np.flatnonzero(whole & ~np.concatenate([whole[1:] & ~fresh[1:], [False]])) + 1
        self.size = stop - self.start  # windows
        self.owner = words.text[self.start]
        anchor = least[self.start]
        key = content_hash(words.hash, self.start, self.size + window - 1)
        shard = (mixed(anchor) % np.uint64(n_shards)).astype(np.int64)
        order = np.lexsort((key, shard))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        self.content = np.empty(len(order), np.int64)  # of each segment
        self.content[order] = np.cumsum(new) - 1
        self.place = order[new]  # a segment with each content
        begin = np.flatnonzero(new)
        self.low = np.minimum.reduceat(ids[self.owner[order]], begin) if len(begin) else none
        self.shard, self.anchor, self.count = shard[self.place], anchor[self.place], self.size[self.place]


def content_hash(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    from wayscore.llm.common import _powers

    p, inverse = _powers(len(hashes) + 1)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * p[: len(hashes)], dtype=np.uint64)])
    return mixed((c[start + length] - c[start]) * inverse[start] + length.astype(np.uint64))


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _ask(window: int, n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        texts = texts_of(table.column("text"))
        words = PLAIN.scan(texts)
        s = Segments(words, _ids(table), window, n_shards)
        bucket = table.column("bucket")[0].as_py()
        edges = np.flatnonzero(np.concatenate([[True], s.shard[1:] != s.shard[:-1]])) if len(s.shard) else np.zeros(0, np.int64)
        shard_of, out = [], []
        for a, b in zip(edges, [*edges[1:], len(s.shard)], strict=True):
            first, n = s.start[s.place[a:b]], s.count[a:b] + window - 1
            which = ranges(first, n)
            body = gathered(texts.data, words.start[which], words.end[which])
            lengths = np.add.reduceat(words.end[which] - words.start[which] + 1, np.cumsum(n) - n)
            shard_of.append(int(s.shard[a]))
            out.append(packed((s.anchor[a:b] >> np.uint64(32)).astype(np.uint32), narrow(s.count[a:b]), s.low[a:b], narrow(lengths), np.frombuffer(body, np.uint8)))
        return blobs([bucket] * len(out), shard_of, out)

    return run


def _answer(window: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        buckets = table.column("bucket").to_pylist()
        anchors, counts, lows, lengths, bodies = (list(x) for x in zip(*(unpacked(b.as_py()) for b in table.column("blob")), strict=True))
        per = [len(a) for a in anchors]
        anchor, count, low = np.concatenate(anchors), np.concatenate([c.astype(np.int64) for c in counts]), np.concatenate(lows)
        length = np.concatenate([x.astype(np.int64) for x in lengths])
        data = np.concatenate([np.concatenate([b, np.array([0x20], np.uint8)]) for b in bodies])
        begin = np.cumsum(length) - length  # each body ends in the separator it lacks
        del bodies
        bits = np.zeros(int(count.sum()), bool)
        _, back, times = np.unique(anchor, return_inverse=True, return_counts=True)
        often = np.flatnonzero(times[back] > 1)
        if len(often):
            took = data[ranges(begin[often], length[often])]
            del data
            texts = Texts(took, np.concatenate([[0], np.cumsum(length[often])]))
            words = PLAIN.scan(texts)
            n = count[often] + window - 1
            first = np.cumsum(n) - n
            key = content_hash(words.hash, first, n)
            _, one, same = np.unique(key, return_index=True, return_inverse=True)
            least = np.full(len(one), LAST)
            np.minimum.at(least, same, low[often])
            # distinct segments, with a 0 after each
            size = n[one]
            at = ranges(np.cumsum(size + 1) - (size + 1), size)
            seq = np.zeros(int((size + 1).sum()), np.int64)
            _, symbol = np.unique(words.hash[ranges(first[one], size)], return_inverse=True)
            seq[at] = symbol + 1
            piece = np.repeat(np.arange(len(one)), size + 1)
            index = FMIndex(seq, window)
            wins = count[often][one]
            starts = ranges(np.cumsum(size + 1) - (size + 1), wins)
            lo, hi = index.intervals(seq, starts, window)
            found = np.repeat(least, wins)
            several = np.flatnonzero(hi - lo > 1)
            if len(several):
                spans, of = np.unique(lo[several], return_inverse=True)
                stop = np.zeros(len(spans), np.int64)
                stop[of] = hi[several]
                documents = np.append(least[piece[index.array]], LAST)
                found[several] = np.minimum.reduceat(documents, np.stack([spans, stop], axis=1).ravel())[::2][of]
            held = ranges((np.cumsum(wins) - wins)[same], count[often])
            bits[ranges((np.cumsum(count) - count)[often], count[often])] = found[held] < np.repeat(low[often], count[often])
        out, edge = [], np.cumsum([0, *per])
        total = np.concatenate([[0], np.cumsum(count)])
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            out.append(packed(np.packbits(bits[total[a] : total[b]])))
        return blobs(buckets, [shard] * len(out), out)

    return run


def _apply(window: int, n_shards: int, give_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of(docs.column("text")) if docs.num_rows else None
        if texts is None:
            return _result([], [], [], [], [] if give_text else None)
        ids = _ids(docs)
        words = PLAIN.scan(texts)
        s = Segments(words, ids, window, n_shards)
        bits = np.zeros(int(s.count.sum()), bool)
        offset = np.cumsum(s.count) - s.count
        for shard, blob in zip(answers.column("shard").to_pylist(), answers.column("blob"), strict=True):
            a, b = np.searchsorted(s.shard, (shard, shard + 1))
            n = int(s.count[a:b].sum())
            bits[offset[a] : offset[a] + n] = np.unpackbits(unpacked(blob.as_py())[0])[:n].astype(bool)
        gone = np.zeros(len(words.hash) + window + 1, np.int32)
        if len(s.start):
            hit = bits[ranges(offset[s.content], s.size)] | np.repeat(ids[s.owner] > s.low[s.content], s.size)
            where = ranges(s.start, s.size)[hit]
            np.add.at(gone, where, 1)
            np.add.at(gone, where + window, -1)
        kept = np.cumsum(gone)[: len(words.hash)] == 0
        n = docs.num_rows
        counts = words.counts(n)
        left = np.bincount(words.text[kept], minlength=n)
        joined = gathered(texts.data, words.start[kept], words.end[kept])
        ends = np.concatenate([[0], np.cumsum(words.end[kept] - words.start[kept] + 1)])
        edge = np.concatenate([[0], np.cumsum(left)])
        own = [joined[ends[edge[i]] : max(ends[edge[i + 1]] - 1, ends[edge[i]])] for i in range(n)]
        return _result(docs.column("doc_id"), counts, counts - left, [hashlib.sha256(x).hexdigest() for x in own], own if give_text else None)

    return run


def _result(ids, words, removed, sha, own) -> pa.Table:
    cols = {"doc_id": ids if len(ids) else pa.array([], pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
    if own is not None:
        cols["kept_text"] = pa.array([x.decode() for x in own], pa.string())
    return pa.table(cols)


def remove_repeats(docs: DataFrame, window: int = 13, give_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and kept_text on request.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    Null and wordless texts keep nothing and lose nothing; a text of fewer words than the window keeps all; rows of
    one doc_id do not remove each other's words; a null doc_id ranks after all others; an empty table gives no rows;
    further columns are dropped.
    """
    n_shards = parts_for(docs, "text", SHARD_MB, shuffle_partitions(docs.sparkSession))
    rows = in_buckets(docs)
    asked = rows.groupBy("bucket").applyInArrow(_ask(window, n_shards), BLOBS)
    answers = asked.groupBy("shard").applyInArrow(_answer(window), BLOBS)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if give_text else "")
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_apply(window, n_shards, give_text), schema)

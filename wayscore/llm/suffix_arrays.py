"""Benchmark decontamination with suffix arrays of the training documents.

Each Arrow batch of documents is cut into shards of some megabytes of whole texts. A shard's suffix
array orders the word positions of its documents by the words that follow; every suffix of every
benchmark item is found in it by binary search, one word deeper at a time. Matches as long as a
window mark the words they cover.

The longest verbatim match of a text is found in two steps. Up to a window, the deepest range a
place lies in tells its match. Texts with a whole window are then sorted together with the items
they hit, by ranks that double their length; next to a place in that order stand the item suffixes
that share most words with it, and the ranks of all lengths tell how many.

The array is sparse: a position that does not begin with two words that stand side by side in the
benchmark is left out, since no benchmark suffix longer than one word can match there.

The benchmark is read in blocks of bounded size, each a broadcast of its own and a pass of its own
over the documents; so a benchmark of any size is looked for in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayscore.llm.common import NOT_ALNUM, Alphabet, Texts, ranges, stored, texts_of

#: Text bytes of one broadcast block of items, and blocks in one chain of passes.
BLOCK_MB = 32
CHAIN = 4

LETTERS = Alphabet(NOT_ALNUM, lower=True)


class ItemBlock:
    """Benchmark items as word sequences over their own vocabulary (ids from 1; 0 stands for any other word)."""

    def __init__(self, rows: list[tuple[int, str]], window: int):
        rows = sorted({(int(i), t) for i, t in rows if i is not None and t})
        raw = [t.encode() for _, t in rows]
        texts = Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        words = LETTERS.scan(texts)
        self.window = window
        self.vocabulary = np.unique(words.hash)
        counts = words.counts(len(rows))
        self.items = np.array([i for i, _ in rows], np.int64)
        ids = np.searchsorted(self.vocabulary, words.hash) + 1
        # one suffix of each kind: item words, then a 0 after each item
        self.seq = np.zeros(len(ids) + len(rows) + 1, np.int64)
        at = np.arange(len(ids)) + words.text
        self.seq[at] = ids
        begin = np.cumsum(counts + 1) - (counts + 1)
        need = np.where(counts >= window, window, counts)
        self.suffix = at
        left = begin[words.text] + counts[words.text] - at
        self.item = words.text
        self.need = np.where(left >= need[words.text], need[words.text], 0)  # 0: too near the end for a window to start
        self.begin, self.counts = begin, counts
        self._all_suffixes(at, words.text, ids)
        self.single = np.unique(ids[counts[words.text] == 1])
        pairs = self.seq[:-1] * (len(self.vocabulary) + 1) + self.seq[1:]
        self.pairs = np.unique(pairs[(self.seq[:-1] > 0) & (self.seq[1:] > 0)])
        bits = np.zeros(1 << 20, bool)
        bits[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.bits = bits
        self._same_suffixes()

    def _all_suffixes(self, at: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        """``every``: of the suffixes that agree on the words up to a window or their end, the one of the smallest item id
        and place, in this order; ``word_first``: the first suffix that begins with each word."""
        place = at - self.begin[row]
        order = np.lexsort((place, self.items[row]))
        at, row, ids = at[order], row[order], ids[order]
        padded = np.concatenate([self.seq, np.zeros(self.window, np.int64)])
        alive, keys = np.ones(len(at), bool), []
        for k in range(self.window):
            alive = alive & (padded[at + k] > 0)
            keys.append(np.where(alive, padded[at + k], 0))
        by = np.lexsort(keys[::-1])
        first = np.ones(len(at), bool)
        first[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
        chosen = np.sort(by[first])
        self.every, self.every_row = at[chosen], row[chosen]
        begins = np.unique(ids, return_index=True)[1]
        self.word_first, self.word_row = at[begins], row[begins]

    def _same_suffixes(self) -> None:
        """Suffixes that agree on their window are searched once; ``owner_*`` leads back to all their items."""
        width = self.window
        padded = np.concatenate([self.seq, np.zeros(width, np.int64)])
        keys = np.stack([padded[self.suffix + k] for k in range(width)] + [self.need], axis=1) if len(self.suffix) else np.zeros((0, width + 1), np.int64)
        live = self.need > 0
        keys, suffix, item, need = keys[live], self.suffix[live], self.item[live], self.need[live]
        for k in range(width):
            keys[need <= k, k] = 0
        order = np.lexsort(keys.T[::-1]) if len(keys) else np.zeros(0, np.int64)
        keys = keys[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        group = np.cumsum(first) - 1
        self.need, self.suffix = need[order][first], suffix[order][first]
        owners = np.unique(np.stack([group, item[order]], axis=1), axis=0) if len(keys) else np.zeros((0, 2), np.int64)
        self.owner_items = owners[:, 1]
        self.owner_start = np.searchsorted(owners[:, 0], np.arange(len(self.need) + 1))


def _word_ids(block: ItemBlock, hashes: np.ndarray) -> np.ndarray:
    ids = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(block.bits[(hashes >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(block.vocabulary, hashes[maybe])
    at[at == len(block.vocabulary)] = 0
    known = block.vocabulary[at] == hashes[maybe]
    ids[maybe[known]] = at[known] + 1
    return ids


def suffix_array(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in the order of the ``depth`` words from each on (ranks doubled as in prefix doubling)."""
    padded = np.concatenate([seq, np.zeros(depth, seq.dtype)])
    keys = [padded[at + k] for k in range(depth)]
    base = int(seq.max(initial=0)) + 1
    per = max(1, int(62 // np.log2(max(base, 2))))
    packed = []
    for i in range(0, depth, per):
        key = np.zeros(len(at), np.int64)
        for k in keys[i : i + per]:
            key = key * base + k
        packed.append(key)
    return at[np.lexsort(packed[::-1])]


def _narrow(seq: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search, for many ranges at once: the part of each range whose suffixes have ``word`` at ``depth``."""
    ends = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) // 2
            got = seq[array[np.minimum(mid, len(array) - 1)] + depth]
            less = open_ & ((got <= word) if right else (got < word))
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        ends.append(a)
    return ends[0], ends[1]


def _known_words(block: ItemBlock, ids: np.ndarray, text: np.ndarray, first: np.ndarray, best: np.ndarray) -> None:
    """Matches of one word: the first word of a text that an item has."""
    known = np.flatnonzero(ids)
    texts, at = np.unique(text[known], return_index=True)
    word = known[at]
    row = block.word_row[ids[word] - 1]
    best[texts] = np.stack([np.ones(len(texts), np.int64), word - first[texts], row, block.word_first[ids[word] - 1] - block.begin[row]], axis=1)


def _deepest(block: ItemBlock, seq: np.ndarray, array: np.ndarray, text_at: np.ndarray, first: np.ndarray, best: np.ndarray) -> None:
    """Matches of 2 words up to a window: places in the ranges that suffixes of items still have at each depth."""
    lo = np.zeros(len(block.every), np.int64)
    hi = np.full(len(block.every), len(array), np.int64)
    alive = np.arange(len(block.every))
    for deep in range(block.window):
        word = block.seq[block.every[alive] + deep]
        alive, word = alive[word > 0], word[word > 0]
        lo[alive], hi[alive] = _narrow(seq, array, lo[alive], hi[alive], deep, word)
        alive = alive[lo[alive] < hi[alive]]
        if not len(alive):
            break
        if not deep:
            continue
        start, which = np.unique(lo[alive], return_index=True)  # equal beginnings have equal ranges, others have disjoint ones
        size = hi[alive[which]] - start
        at, owner = array[ranges(start, size)], np.repeat(alive[which], size)
        order = np.argsort(at)
        text, one = np.unique(text_at[at[order]], return_index=True)
        at, owner = at[order][one], owner[order][one]
        row = block.every_row[owner]
        best[text] = np.stack([np.full(len(text), deep + 1), at - text - first[text], row, block.every[owner] - block.begin[row]], axis=1)


def _past_windows(block: ItemBlock, seq: np.ndarray, first: np.ndarray, counts: np.ndarray, pair: np.ndarray, best: np.ndarray) -> None:
    """Matches of a window or more: texts and the items they hit in one suffix order."""
    texts = np.flatnonzero(best[:, 0] == block.window)
    if not len(texts):
        return
    rows = np.unique(pair[np.isin(pair[:, 0], texts), 1])
    ours = seq[ranges(first[texts] + texts, counts[texts] + 1)]
    theirs = block.seq[ranges(block.begin[rows], block.counts[rows] + 1)]
    n = len(ours)
    # other words and ends of texts are 0, ends of items a number of their own: neither agrees with the other side
    rank = np.concatenate([ours, np.where(theirs == 0, len(block.vocabulary) + 1, theirs)])
    levels, step = [], 1
    while True:
        held = np.zeros(int(rank.max()) + 1, bool)
        held[rank[n:]] = True
        if not held[rank[:n]].any():
            break
        levels.append((step, rank))
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])
        rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1]
        step *= 2
    order = np.argsort(rank, kind="stable")
    number = np.arange(len(order))
    item = order >= n
    below = np.maximum.accumulate(np.where(item, number, -1))
    above = np.minimum.accumulate(np.where(item, number, len(order))[::-1])[::-1]
    mine = np.flatnonzero(~item)
    place, most, other = order[mine], np.full(len(mine), -1), np.zeros(len(mine), np.int64)
    for side in (below[mine], above[mine]):
        there = (side >= 0) & (side < len(order))
        q = order[np.where(there, side, 0)]
        p, at, length = place.copy(), q.copy(), np.zeros(len(q), np.int64)
        for size, ranks in reversed(levels):
            same = there & (ranks[p] == ranks[at])
            p, at, length = p + same * size, at + same * size, length + same * size
        better = there & (length > most)
        most, other = np.where(better, length, most), np.where(better, q, other)
    owner = np.repeat(np.arange(len(texts)), counts[texts] + 1)[place]
    by = np.lexsort((place, -most, owner))
    by = by[np.unique(owner[by], return_index=True)[1]]
    sizes = block.counts[rows] + 1
    ends, q = np.cumsum(sizes), other[by] - n
    which = np.searchsorted(ends, q, side="right")
    ahead = np.cumsum(counts[texts] + 1) - (counts[texts] + 1)
    best[texts] = np.stack([most[by], place[by] - ahead, rows[which], q - (ends - sizes)[which]], axis=1)


def match_shard(block: ItemBlock, texts: Texts, longest: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a shard of texts: word counts; (text, first word, past last word) of window hits; (text, item) of hits;
    and (length, first word, item row, first word there) of the longest match of each text. Word numbers count within
    a text, and a length of 0 goes with places of -1."""
    n = len(texts.offsets) - 1
    words = LETTERS.scan(texts)
    counts = words.counts(n)
    best = np.tile(np.array([0, -1, -1, -1]), (n, 1))
    nothing = np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
    if not len(words.hash) or not len(block.need):
        return counts, *nothing, best
    first = np.cumsum(counts) - counts
    depth = block.window
    # a 0 after each text, so that no match runs over its end
    at = np.arange(len(words.hash)) + words.text
    seq = np.zeros(len(words.hash) + n + depth + 1, np.int64)
    seq[at] = _word_ids(block, words.hash)
    pair = seq[at] * (len(block.vocabulary) + 1) + seq[at + 1]
    near = (seq[at] > 0) & (seq[at + 1] > 0)
    keep = near.copy()
    spot = np.searchsorted(block.pairs, pair[near])
    keep[near] = block.pairs[np.minimum(spot, len(block.pairs) - 1)] == pair[near] if len(block.pairs) else False
    if len(block.single):
        keep |= np.isin(seq[at], block.single)
    kept = np.flatnonzero(keep)
    if longest:
        _known_words(block, seq[at], words.text, first, best)
    if not len(kept):
        return counts, *nothing, best
    array = suffix_array(seq, at[kept], depth)
    text_at = np.zeros(len(seq), np.int64)
    text_at[at] = words.text
    lo = np.zeros(len(block.need), np.int64)
    hi = np.full(len(block.need), len(array), np.int64)
    alive = np.arange(len(block.need))
    hits, pairs = [], []
    deep = 0
    while len(alive):
        if deep < depth:
            lo[alive], hi[alive] = _narrow(seq, array, lo[alive], hi[alive], deep, block.seq[block.suffix[alive] + deep])
            alive = alive[lo[alive] < hi[alive]]
            deep += 1
            done = alive[block.need[alive] == deep]
            if len(done):
                size = hi[done] - lo[done]
                where = array[ranges(lo[done], size)]
                text = text_at[where]
                word = where - text - first[text]
                hits.append(np.stack([text, word, word + deep], axis=1))
                window = np.repeat(done, size)
                both = np.unique(np.stack([window, text], axis=1), axis=0)
                owners = block.owner_start[both[:, 0] + 1] - block.owner_start[both[:, 0]]
                items = block.owner_items[ranges(block.owner_start[both[:, 0]], owners)]
                pairs.append(np.stack([np.repeat(both[:, 1], owners), items], axis=1))
                alive = alive[block.need[alive] > deep]
        else:
            break
    if longest:
        _deepest(block, seq, array, text_at, first, best)
    if not hits:
        return counts, *nothing, best
    pair = np.unique(np.concatenate(pairs), axis=0)
    if longest:
        _past_windows(block, seq, first, counts, pair, best)
    return counts, np.unique(np.concatenate(hits), axis=0), pair, best


def _covered(hit: np.ndarray) -> np.ndarray:
    """(text, start, end) of the unions of the hits; ``hit`` is sorted."""
    if not len(hit):
        return hit
    reach = np.maximum.accumulate(hit[:, 2] + hit[:, 0] * (1 << 40)) - hit[:, 0] * (1 << 40)
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] > reach[:-1])
    begin = np.flatnonzero(fresh)
    return np.stack([hit[begin, 0], hit[begin, 1], np.maximum.reduceat(hit[:, 2], begin)], axis=1)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ADDED = "n_words long, spans array<struct<start:long,end:long>>, items array<long>, longest long, longest_start long, longest_item long, longest_place long"
LONGEST = ("longest", "longest_start", "longest_item", "longest_place")


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _pass(block, text_column: str, schema: T.StructType, with_longest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = texts_of(batch.column(batch.schema.get_field_index(text_column)))
            n = batch.num_rows
            counts, longest, hits, pairs = [], [], [], []
            for i, j in texts.slices(4 << 20):
                c, hit, pair, most = match_shard(items, texts.part(i, j), with_longest)
                counts.append(c)
                longest.append(most)
                hits.append(hit + np.array([i, 0, 0]))
                pairs.append(pair + np.array([i, 0]))
            hit, pair, most = np.concatenate(hits), np.concatenate(pairs), np.concatenate(longest)
            pair = np.stack([pair[:, 0], items.items[pair[:, 1]]], axis=1) if len(pair) else pair
            found = most[:, 0] > 0
            most[found, 2] = items.items[most[found, 2]]
            if "spans" in batch.schema.names:  # what earlier blocks have found
                old = batch.column(batch.schema.get_field_index("spans"))
                sizes = np.diff(old.offsets.to_numpy())
                flat = old.flatten()
                before = np.stack([np.repeat(np.arange(n), sizes), flat.field("start").to_numpy(), flat.field("end").to_numpy()], axis=1)
                hit = np.concatenate([hit, before])
                had = batch.column(batch.schema.get_field_index("items"))
                pair = np.concatenate([pair, np.stack([np.repeat(np.arange(n), np.diff(had.offsets.to_numpy())), had.flatten().to_numpy()], axis=1)])
                past = np.stack([pc.fill_null(batch.column(batch.schema.get_field_index(c)), -1).to_numpy() for c in LONGEST], axis=1)
                sides = np.stack([past, most])  # a longer one, then the smaller start, item and place
                order = np.lexsort([sides[:, :, 3], sides[:, :, 2], sides[:, :, 1], -sides[:, :, 0]], axis=0)
                most = sides[order[0], np.arange(n)]
            span = _covered(np.unique(hit, axis=0))
            pair = np.unique(pair, axis=0)
            spans = _lists(pa.StructArray.from_arrays([pa.array(span[:, 1]), pa.array(span[:, 2])], ["start", "end"]), span[:, 0], n)
            own = [batch.column(k) for k, f in enumerate(batch.schema) if f.name not in ("n_words", "spans", "items", *LONGEST)]
            cols = [*own, pa.array(np.concatenate(counts)), spans, _lists(pa.array(pair[:, 1]), pair[:, 0], n)]
            cols += [pa.array(most[:, 0]), *(pa.array(most[:, k], mask=most[:, 0] == 0) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return run


def _item_blocks(benchmark: DataFrame, window: int) -> Iterator[ItemBlock]:
    """Items in blocks by the hash of their id. A block is collected alone; its size is what its items have."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-int(total) // (BLOCK_MB << 20)))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield ItemBlock([(r["item_id"], r["text"]) for r in part.toLocalIterator()], window)


def find_benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, keep: tuple[str, ...] = ("doc_id",), longest: bool = True) -> DataFrame:
    """Per document: the columns ``keep``, n_words, n_hit, spans (word ranges covered by windows), items (ids whose
    windows occur); with ``longest`` the words of the longest verbatim match with one item (0: no word in common), and of
    its first place in the document longest_start (word number from 0), longest_item and longest_place (an item that has it
    and the word number there; null without a match).

    A window is ``window`` words in a row of an item; an item of fewer words is one window. Null and wordless texts
    have no words and no hits, null items and items without an id are passed over, repeated rows give a row each,
    empty tables give no rows or no hits, and documents may carry further columns of any name.
    """
    work = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))
    own = work.schema
    for i, block in enumerate(_item_blocks(benchmark, window)):
        if i and i % CHAIN == 0:
            work = stored(work)
        schema = T.StructType(own.fields + T._parse_datatype_string(ADDED).fields)
        work = work.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(block), "_text", schema, longest), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return work.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_words", hit.alias("n_hit"), "spans", "items", *(LONGEST if longest else ()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05) -> DataFrame:
    """The documents, all columns kept, of which less than ``share`` of the words lies in benchmark windows."""
    found = find_benchmark_matches(docs, benchmark, window, keep=tuple(docs.columns), longest=False)
    return found.where((F.col("n_hit") == 0) | (F.col("n_hit") < share * F.col("n_words"))).select(*docs.columns)

"""Packing of token ids into sequences of one capacity by multiway differencing.

A task streams its documents. Whole sequences are cut off the front of long ones; what is left of each is an item.
Groups of items go through Karmarkar-Karp differencing: partial partitions, at first one for each item, wait by the
spread of their sums; the two widest are merged with the largest sums of one on the smallest sums of the other, until
one partition into windows of nearly equal length is left. If a window passes the capacity, there are too few windows,
and the count rises. Near-equal windows leave little room each; the emptiest ones are then cut up to fill the others to
the last token, and less than one window goes on into the next group. At a task's end the rest is cut into sequences whose
lengths are powers of two, which need no padding. So no sequence is padded, and few documents are cut.

Nothing is shuffled, and a task holds one group of items, whatever the table's size or skew. A sequence holds pieces of
one input partition; its id has that partition's number in the upper bits. So ids repeat when a task does, as long as
the partition's rows come in the same order, as those of a file scan do.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.pair_bpe import PATTERN, Encoder, Vocabulary, byte_letters

#: Windows of items in one group.
GROUP = 64
#: Characters of a text that are encoded at a time, and rows of one output batch.
PIECE = 1 << 20
ROWS = 1 << 14
#: Bits of a sequence id that count inside a partition.
COUNT_BITS = 40


class Tokens:
    """Ids as the tokenizer library gives them, from the content of its byte-level BPE file.

    The library's merges come in the order of their ids, so ranks are ids and the faster encoder gives the same ids. A
    file of another kind is refused.
    """

    def __init__(self, content: str):
        spec, letters = json.loads(content), byte_letters()
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(a >= b for a, b in zip(made[:-1], made[1:], strict=True)) or (made and made[0] <= max(vocab[c] for c in letters)):
            raise ValueError("the tokenizer's merges are not in the order of their ids")
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.content = content
        self.slow: Encoder | None = None

    def _part(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:
            # the regex engine gives up on very long runs of one class; the pair index encodes those
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            self.slow = self.slow or Encoder(Vocabulary(self.content))
            return self.slow([text])[0]

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text; a long one is cut where a letter, a blank and a letter meet, which no token crosses."""
        out, at = [], 0
        while len(text) - at > PIECE:
            end = at + PIECE
            while end < len(text) - 1 and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1].isalpha()):
                end += 1
            if end >= len(text) - 1:
                break
            out.append(self._part(text[at:end]))
            at = end
        out.append(self._part(text[at:]))
        return np.concatenate(out).astype("<u4")


@lru_cache(maxsize=1)
def _tokens(content: str) -> Tokens:
    return Tokens(content)


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp differencing into ``k`` parts: (sum, places in ``sizes``) of each, largest sum first."""
    # a partial partition: its parts with items as (sum, tree of places), largest first; the others are empty
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) + len(b) <= k:
            both = a + b
        else:
            first = k - len(b)  # from here on, the large sums of a meet the small ones of b
            met = len(a) - first
            both = a[:first] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[first:], reversed(b[len(b) - met :]), strict=True)] + b[: len(b) - met]
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, ((both[-1][0] if len(both) == k else 0) - both[0][0], n, both))
        n += 1
    out = []
    for total, tree in heap[0][2] if heap else []:
        places, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            else:
                places.append(t)
        out.append((total, sorted(places)))
    return out


def windows_of(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Near-equal windows of whole items; as long as one passes the capacity, the count of windows rises."""
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        over = sum(total > capacity for total, _ in windows)
        if not over:
            return windows
        k += 1 + over // 4


class Document(NamedTuple):
    doc_id: int | None
    ids: np.ndarray


class Item(NamedTuple):
    doc: Document
    start: int
    length: int


def _cut(items: list[Item], at: int) -> tuple[list[Item], list[Item]]:
    """The first ``at`` tokens of the items, and the rest."""
    head: list[Item] = []
    for i, x in enumerate(items):
        if x.length > at:
            cut = [x._replace(length=at)] if at else []
            return head + cut, [Item(x.doc, x.start + at, x.length - at), *items[i + 1 :]]
        head.append(x)
        at -= x.length
    return head, []


class Packer:
    """Takes documents and gives sequences, each a list of items."""

    def __init__(self, capacity: int, group: int = GROUP):
        self.capacity, self.group = capacity, group
        self.items: list[Item] = []
        self.held = 0

    def add(self, doc: Document) -> Iterator[list[Item]]:
        whole = len(doc.ids) // self.capacity
        for i in range(whole):
            yield [Item(doc, i * self.capacity, self.capacity)]
        rest = len(doc.ids) - whole * self.capacity
        if rest:
            self.items.append(Item(Document(doc.doc_id, doc.ids), whole * self.capacity, rest))
            self.held += rest
        if self.held >= self.group * self.capacity:
            yield from self._full()

    def _full(self) -> Iterator[list[Item]]:
        """As many full sequences as the held items make."""
        windows = windows_of([x.length for x in self.items], self.capacity)
        full = self.held // self.capacity
        rest = [self.items[p] for _, places in windows[full:] for p in places]
        for total, places in windows[:full]:
            more, rest = _cut(rest, self.capacity - total)
            yield [self.items[p] for p in places] + more
        self.items, self.held = rest, sum(x.length for x in rest)

    def finish(self) -> Iterator[list[Item]]:
        if self.held >= self.capacity:
            yield from self._full()
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            took, self.items = _cut(self.items, size)
            self.held -= size
            yield took


def _rows(sequences: Iterator[list[Item]], first: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    for n, items in enumerate(sequences):
        offset = 0
        for x in items:
            piece = x.doc.ids[x.start : x.start + x.length]
            rows.append((x.doc.doc_id, x.start, x.length, zlib.crc32(piece.tobytes()), len(x.doc.ids), first + n, offset))
            offset += x.length
        if len(rows) >= ROWS:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def _pack(content, capacity: int, end_id: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = _tokens(content.value), Packer(capacity, group)

        def sequences() -> Iterator[list[Item]]:
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from packer.add(Document(i, np.append(tokens(text.as_py() or ""), np.uint32(end_id))))
            yield from packer.finish()

        yield from _rows(sequences(), TaskContext.get().partitionId() << COUNT_BITS)

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names a byte-level BPE tokenizer file, read by the driver (some megabytes, whatever the corpus). A document
    is its ids and ``end_id``, so null and empty texts are one token long. ``capacity`` must be a power of two. Repeated
    rows and null ids are documents of their own; an empty table gives no rows; further columns are dropped.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(content, capacity, end_id, group), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

"""Byte-level BPE by a pair occurrence index.

The distinct pre-tokens that a partition meets for the first time are laid out as one row of byte symbols.
An index maps each pair of neighbouring symbols to all its positions; ranks with positions are taken in
ascending order, each applied at all its positions from left to right, and every merge enters the two new
pairs around it in their lists. A merged symbol takes part only in later ranks, so each rank comes up once.
Texts are then rows of pre-token numbers, and their ids come from the pre-tokens' ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import ranges

#: How byte-level BPE of this kind parts a text (fixed value). The white space is spelt out, as libraries differ in it.
SPACE = r"\t\n\x0B\x0C\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens kept between batches; beyond it a task starts afresh.
CACHE = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Ids of bytes and merges, and the bytes of each id, from a tokenizer file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = np.array([len(names.get(i, b"")) for i in range(max(names) + 1)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(names.get(i, b"") for i in range(max(names) + 1)), np.uint8)


def encode_all(words: list[bytes], vocabulary: Vocabulary) -> tuple[list[int], list[int]]:
    """Ids of all words one after the other, and how many each word has, by the pair occurrence index."""
    merges, byte_id = vocabulary.merges, vocabulary.byte_id
    symbol: list[int] = []
    for w in words:
        symbol.extend([byte_id[b] for b in w])
        symbol.append(-1)  # no pair reaches over the end of a word
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at: dict[int, list[int]] = {}  # rank to positions
    of: dict[int, tuple[int, int, int]] = {}
    for i in range(n - 1):
        found = merges.get((symbol[i], symbol[i + 1]))
        if found is not None:
            if found[0] in at:
                at[found[0]].append(i)
            else:
                at[found[0]] = [i]
                of[found[0]] = (symbol[i], symbol[i + 1], found[1])
    active = list(at)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, new = of[rank]
        places = at.pop(rank)
        places.sort()
        for i in places:
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has gone into another merge
            symbol[i], symbol[j] = new, -2
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q < n:
                    found = merges.get((symbol[p], symbol[q]))
                    if found is not None:
                        if found[0] in at:
                            at[found[0]].append(p)
                        else:
                            at[found[0]] = [p]
                            of[found[0]] = (symbol[p], symbol[q], found[1])
                            heapq.heappush(active, found[0])
    row = np.array(symbol, np.int64)
    ends = np.flatnonzero(row == -1)
    live = np.concatenate([[0], np.cumsum(row >= 0)])
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return row[row >= 0].tolist(), (live[ends] - live[begins]).tolist()


class _Numbers(dict):
    """Pre-token to number; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Encodes texts; what it has learnt of pre-tokens stays from batch to batch."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.held = np.zeros(1 << 16, np.int32), 0  # grows by doubling
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for content, i in self.vocabulary.special.items():
            self.numbers["\0special " + content]
            self._add([i], [1])
        self.numbers.fresh.clear()

    def _add(self, ids: list[int], sizes: list[int]) -> None:
        size = np.array(sizes, np.int32)
        self.begin = np.concatenate([self.begin, self.held + np.cumsum(size, dtype=np.int64) - size])
        self.size = np.concatenate([self.size, size])
        while self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)

    def _pieces(self, text: str) -> list[int]:
        get = self.numbers.__getitem__
        if self.special is None or not self.special.search(text):
            return list(map(get, self.split.findall(text)))
        out: list[int] = []
        for part in self.special.split(text):
            if part in self.vocabulary.special:
                out.append(get("\0special " + part))
            else:
                out.extend(map(get, self.split.findall(part)))
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if len(self.numbers) > CACHE:
            self._clear()
        rows = [np.array(self._pieces(t), np.int64) for t in texts]
        if self.numbers.fresh:
            self._add(*encode_all([w.encode() for w in self.numbers.fresh], self.vocabulary))
            self.numbers.fresh.clear()
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sizes = self.size[flat]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.cumsum([0, *map(len, rows)])
        return self.ids[ranges(self.begin[flat], sizes)], np.diff(upto[edge])


def decode_ids(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """Texts of rows of ids; bytes that are not UTF-8 become U+FFFD."""
    size = vocabulary.size[ids]
    data = vocabulary.bytes[ranges(vocabulary.start[ids], size)].tobytes()
    at = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *sizes])]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _in_parts(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of parts of about ``limit`` bytes; only one part is held as strings at a time."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + limit, "right")))
        yield i, ["" if t is None else t for t in texts.slice(i, j - i).to_pylist()]
        i = j


def _round_trip(vocabulary, give_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for i, texts in _in_parts(batch.column(1)):
                ids, sizes = encoder(texts)
                raw, at = ids.astype("<u4"), np.cumsum([0, *sizes])
                out = {
                    "doc_id": batch.column(0).slice(i, len(texts)),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decode_ids(ids, sizes, encoder.vocabulary)], pa.string()),
                }
                if give_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return run


def _vocabulary(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))


def encode_documents(docs: DataFrame, path: str, give_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256, and ids on request.

    ``path`` names a byte-level BPE tokenizer file, read by the driver (some megabytes, whatever the corpus).
    Null is the empty text, which has no ids; the strings of added tokens in a text become their ids, as in the
    tokenizer's own library; repeated rows give a row each; an empty table gives no rows; further columns are dropped.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if give_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_round_trip(_vocabulary(docs, path), give_ids), schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ``ids``; null ids give the empty text."""
    vocabulary = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r or [] for r in batch.column(1).to_pylist()]
            flat = np.array([i for r in rows for i in r], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode_ids(flat, np.array([len(r) for r in rows], np.int64), vocabulary.value), pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")

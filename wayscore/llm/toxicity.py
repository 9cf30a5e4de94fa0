"""Toxicity by the nearest labelled examples.

Examples and documents are TF-IDF vectors over all terms of the examples: words, and the first 4, 5 and 6 bytes of longer
words. A term's weight is (1 + ln tf) * idf * strength. Document frequencies are those of all documents; the strength is
a smooth function of how much the label of the examples depends on the term, never 0, so every known word of a text counts.

The examples lie in an inverted index. Blocks of examples are alike: each starts from the first example left and takes
those nearest to it. A term's postings are runs, one for each block that has the term, with the highest weight in that
run. A slice of documents is scored at once: the products with the runs' highest weights bound the cosines in every
block; the ``FIRST`` blocks of highest bound are scored for each document, and its k-th best cosine there says which of
the other blocks can't be left out. Those are scored as well. So the k nearest are exact.

The vote of a neighbour is its squared cosine, weighted by how common its label is in the training labels against the
examples. Votes of the examples themselves, each without itself, are laid against their labels by isotonic steps, which
make votes into probabilities. The nearest examples are given as evidence.

Bounds: the classifier is fitted on at most ``examples`` training rows of each label, those with the smallest hashes
of their id, of at most ``example_mb`` megabytes of whole texts, and so are the terms, the index and its broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import NOT_ALNUM, Alphabet, Texts, ranges, texts_of

PREFIXES = (4, 5, 6)
BLOCK = 64
#: Blocks scored before the bounds decide on the others.
FIRST = 3
#: Bytes and documents scored at a time.
SLICE, SLICE_DOCS = 1 << 20, 128
#: Postings scored in one step.
STEP = 1 << 19
#: A term of this chi-square has half of the full strength; the least strength is that of a term without any relation.
HALF, LEAST = 30.0, 0.01
#: Ranges of terms whose document frequencies are summed together.
RANGES = 64

LETTERS = Alphabet(NOT_ALNUM, lower=True)


def _occurrences(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of every word and of the beginnings of longer words."""
    words, heads = LETTERS.scan(texts, prefixes=PREFIXES)
    rows, terms, length = [words.text], [words.hash], words.end - words.start
    for n, h in zip(PREFIXES, heads, strict=True):
        longer = length > n
        rows.append(words.text[longer])
        terms.append(h[longer])
    return np.concatenate(rows), np.concatenate(terms)


class Terms:
    """The places of known term hashes, by open addressing."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.slots = np.full(1 << max(10, (4 * len(hashes)).bit_length()), -1, np.int32)
        left, at = np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]][::-1]] = left[free][::-1]
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) % len(self.slots)

    def __len__(self) -> int:
        return len(self.hashes)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out, at = np.full(len(hashes), -1, np.int64), self._slot(hashes)
        left = np.arange(len(hashes))
        while len(left):
            place = self.slots[at[left]]
            left, place = left[place >= 0], place[place >= 0]
            same = self.hashes[place] == hashes[left]
            out[left[same]] = place[same]
            left = left[~same]
            at[left] = (at[left] + 1) % len(self.slots)
        return out

    def counted(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, place) in order, with counts; unknown terms are left out."""
        rows, hashes = _occurrences(texts)
        place = self.find(hashes)
        known = place >= 0
        key, count = np.unique(rows[known] * max(len(self), 1) + place[known], return_counts=True)
        return key // max(len(self), 1), key % max(len(self), 1), count


class BlockMaxIndex:
    """Unit vectors of examples, given as entries (example, term, weight), as runs of postings with highest weights."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, ids: np.ndarray, label: np.ndarray):
        order = self._alike(example, term, weight, n_terms, ids)
        self.ids, self.label, self.n_terms = ids[order], label[order], n_terms
        example = np.argsort(order)[example]
        by = np.lexsort((example, term))
        self.example, self.weight, term = example[by], weight[by], term[by]
        self.blocks = -(-len(ids) // BLOCK)
        key = term * max(self.blocks, 1) + self.example // BLOCK
        self.start = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        self.block, self.size = self.example[self.start] // BLOCK, np.diff(np.append(self.start, len(key)))
        self.top = np.maximum.reduceat(self.weight, self.start) if len(key) else np.zeros(0)
        self.runs = np.searchsorted(term[self.start], np.arange(n_terms + 1))

    @staticmethod
    def _alike(example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, ids: np.ndarray) -> np.ndarray:
        """Examples in the order of their blocks: again and again the first one left, by id, and those nearest to it."""
        left, out = np.argsort(ids, kind="stable"), []
        bounds = np.searchsorted(example, np.arange(len(ids) + 1)) if len(ids) else np.zeros(1, np.int64)
        while len(left):
            query = np.zeros(n_terms)
            own = slice(bounds[left[0]], bounds[left[0] + 1])
            query[term[own]] = weight[own]
            near = np.bincount(example, weights=query[term] * weight, minlength=len(ids))[left]
            near[0] = np.inf
            took = np.argsort(-near, kind="stable")[:BLOCK]
            out.append(left[took])
            left = np.delete(left, took)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def nearest(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int) -> list[list[tuple[float, int]]]:
        """For each of ``n`` queries, given as entries, the k highest (cosine, example), ties to the smaller id."""
        k = min(k, len(self.ids))
        if not k or not n:
            return [[] for _ in range(n)]
        many = self.runs[terms + 1] - self.runs[terms]
        run = ranges(self.runs[terms], many)
        row, weight = np.repeat(rows, many), np.repeat(weights, many)
        place = row * self.blocks + self.block[run]
        bound = np.bincount(place, weights=weight * self.top[run], minlength=n * self.blocks).reshape(n, self.blocks)
        scores = np.zeros((n, self.blocks * BLOCK))

        width = self.blocks * BLOCK

        def score(wanted: np.ndarray) -> None:
            took = np.flatnonzero(wanted.ravel()[place])
            upto = np.cumsum(self.size[run[took]])
            i = 0
            while i < len(took):  # rows come in order, so a step fills some rows of the scores
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP, "right")))
                part = took[i:j]
                size, low, high = self.size[run[part]], row[part[0]], row[part[-1]] + 1
                at = ranges(self.start[run[part]], size)
                cell = np.repeat((row[part] - low) * width, size)
                cell += self.example[at]
                product = np.repeat(weight[part], size)
                product *= self.weight[at]
                scores[low:high] += np.bincount(cell, weights=product, minlength=(high - low) * width).reshape(-1, width)
                i = j

        seen = np.zeros(bound.shape, bool)
        first = np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]
        np.put_along_axis(seen, first, True, axis=1)
        score(seen)
        real = np.arange(self.blocks * BLOCK) < len(self.ids)

        def kth() -> np.ndarray:
            open_ = np.where(real & np.repeat(seen, BLOCK, axis=1), scores, -1.0)
            return np.partition(open_, -k, axis=1)[:, -k]

        more = ~seen & (bound >= kth()[:, None] - 1e-9)
        score(more)
        seen |= more
        shown = np.where(real & np.repeat(seen, BLOCK, axis=1), np.round(scores, 12), -1.0)
        least = np.partition(shown, -k, axis=1)[:, -k]
        q, e = np.nonzero(shown >= least[:, None])
        by = np.lexsort((self.ids[e], -shown[q, e], q))
        q, e = q[by], e[by]
        begin = np.searchsorted(q, np.arange(n))
        return [[(float(shown[i, x]), int(x)) for x in e[b : b + k]] for i, b in enumerate(begin)]


def strengths(term: np.ndarray, example: np.ndarray, label: np.ndarray, n_terms: int) -> np.ndarray:
    """From ``LEAST`` to 1: how much the label depends on having the term, by chi-square on the examples."""
    n, n1 = len(label), float(label.sum())
    df = np.bincount(term, minlength=n_terms).astype(float)
    a = np.bincount(term, weights=label[example], minlength=n_terms)
    b, c, d = df - a, n1 - a, (n - n1) - (df - a)
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    return LEAST + (1 - LEAST) * chi / (chi + HALF)


def isotonic(votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of least squares: votes and the probability at each, for interpolation."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted label, weighted vote
    for v, y, w in zip(votes[order].tolist(), label[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([w, w * y, w * v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


class Model:
    def __init__(self, terms: Terms, ids: np.ndarray, label: np.ndarray, share: float, k: int, prior: float):
        self.terms, self.ids, self.label, self.share, self.k, self.prior = terms, ids, label, share, k, prior
        self.index: BlockMaxIndex | None = None

    def entries(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors as entries (text, term, weight)."""
        row, term, count = self.terms.counted(texts)
        weight = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=len(texts.offsets) - 1))
        return row, term, weight / norm[row]

    def fit(self, texts: Texts, df: np.ndarray, n: int) -> None:
        row, term, _ = self.terms.counted(texts)
        self.idf = (np.log((1 + n) / (1 + df)) + 1) * strengths(term, row, self.label, len(self.terms))
        entries = self.entries(texts)
        self.index = BlockMaxIndex(*entries, len(self.terms), self.ids, self.label)
        found = float(self.label.mean())
        self.rate = np.array([(1 - self.share) / max(1 - found, 1e-9), self.share / max(found, 1e-9)])  # by label
        votes = np.zeros(len(self.ids))
        at = np.searchsorted(entries[0], np.arange(len(self.ids) + 1))
        for i in range(0, len(self.ids), SLICE_DOCS):
            j = min(i + SLICE_DOCS, len(self.ids))
            own = slice(at[i], at[j])
            near = self.index.nearest(entries[0][own] - i, entries[1][own], entries[2][own], j - i, self.k + 1)
            for m, x in enumerate(near):
                votes[i + m] = self._vote([(c, e) for c, e in x if self.index.ids[e] != self.ids[i + m]][: self.k])
        self.steps = isotonic(votes, self.label.astype(float), self.rate[self.label])

    def _vote(self, near: list[tuple[float, int]]) -> float:
        label = self.index.label[[e for _, e in near]]
        w = np.array([s for s, _ in near]) ** 2 * self.rate[label]
        return (float(w @ label) + self.prior * self.share) / (float(w.sum()) + self.prior)

    def score(self, texts: Texts) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
        near = self.index.nearest(*self.entries(texts), len(texts.offsets) - 1, self.k)
        votes = np.array([self._vote(x) for x in near])
        return np.clip(np.interp(votes, *self.steps), 0, 1), near


def _text_list(rows: list[str | None]) -> Texts:
    return texts_of(pa.array(rows, pa.string()))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is copied of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _frequencies(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(terms.value), np.int64), 0
        for batch in _small(batches):
            texts = texts_of(batch.column(0))
            n += batch.num_rows
            for i, j in texts.slices(SLICE):
                df += np.bincount(terms.value.counted(texts.part(i, j))[1], minlength=len(df))
        parts = [np.array([n]), *np.array_split(df, RANGES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], names=["part", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(counts), np.int64)
            total[part] = total[part] + x if part in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "counts"])


def document_frequencies(texts: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many rows of the one column each term stands, and how many rows there are. A task sends one compressed
    piece of counts for each range of terms, and what comes back is one number a term."""
    known = texts.sparkSession.sparkContext.broadcast(terms)
    counted = texts.mapInArrow(_frequencies(known), "part int, counts binary").repartition(RANGES + 1, "part").mapInArrow(_summed, "part int, counts binary")
    found = {r["part"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64) for r in counted.collect()}
    known.destroy()
    if not found:
        return np.zeros(len(terms), np.int64), 0
    return np.concatenate([found[p] for p in range(1, RANGES + 1)]), int(found[0][0])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for batch in _small(batches):
            texts = texts_of(batch.column(1))
            for begin, end in texts.slices(SLICE):
                for i in range(begin, end, SLICE_DOCS):
                    j = min(i + SLICE_DOCS, end)
                    score, near = m.score(texts.part(i, j))
                    evidence = [[{"doc_id": int(m.index.ids[e]), "toxic": int(m.index.label[e]), "cosine": c} for c, e in x[:3]] for x in near]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return run


def _clean(model, text: int):
    """The rows as they are, without those predicted toxic by their column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            texts = texts_of(batch.column(text))
            for begin, end in texts.slices(SLICE):
                for i in range(begin, end, SLICE_DOCS):
                    j = min(i + SLICE_DOCS, end)
                    yield batch.slice(i, j - i).filter(pa.array(model.value.score(texts.part(i, j))[0] < 0.5))

    return run


def held_out(ids: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(ids).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, examples: int = 500, example_mb: int = 16, k: int = 15, prior: float = 0.5) -> Model | None:
    """Learn from the labelled rows that are not held out. Labels without a document, null labels and null ids are
    passed over; of several labels of one id the highest counts. Without examples there is no model."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    picked = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect()]
    label = {r["doc_id"]: r["toxic"] for r in picked}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not label:
        return None
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in label], "doc_id long"))
    found = rows.join(wanted, "doc_id").where("text IS NOT NULL")
    took, size = [], 0
    sizes = found.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    for r in sizes.orderBy("h", "doc_id").collect():  # 2 * examples rows at most
        if size + r["n"] <= example_mb << 20:
            size += r["n"]
            took.append(r["doc_id"])
    if not took:
        return None
    own = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in took], "doc_id long")), "doc_id").where("text IS NOT NULL")
    texts = sorted((r["doc_id"], r["text"]) for r in own.groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    ids, body = np.array([i for i, _ in texts], np.int64), _text_list([t for _, t in texts])
    terms = Terms(np.unique(np.concatenate([np.unique(_occurrences(body.part(i, j))[1]) for i, j in body.slices()])))
    model = Model(terms, ids, np.array([label[int(i)] for i in ids], np.int64), float(share), k, prior)
    model.fit(body, *document_frequencies(rows.select("text"), terms))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from 0.5 on), evidence (nearest examples).

    Null and empty texts have the score of a text without any known term, whose cosines are all 0; repeated rows score
    alike; a null doc_id is scored too and not held out; an empty table gives no rows; without examples every score is
    0; further columns are dropped.
    """
    model = fit(docs, labels, **parameters)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    evidence = "array<struct<doc_id:long,toxic:int,cosine:double>>"
    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"), F.array().cast(evidence).alias("evidence"))
    else:
        scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id long, score double, evidence {evidence}")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents, all columns kept whatever their names, that are not predicted toxic."""
    model = fit(docs, labels, **parameters)
    if model is None:
        return docs
    placed = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    kept = placed.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")), placed.schema)
    return kept.toDF(*docs.columns)

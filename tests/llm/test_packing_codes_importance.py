"""Packing, ball codes and importance resampling against brute force, on rows that hold every awkward case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def texts():
    r = random.Random(7)
    words = ["the", "Ångström", "x", "naïve", "don't", "we'll", "漢字", "42", "3.14", "foo_bar", "UPPER", " ", "\u0085", "é"]
    out = [None, "", " ", "\n\n\t  \r\n", "a", "Mail <|endoftext|> it's 'tis", "x" * 60000 + " y", " " * 70000, " \n" * 3000 + "z", "\x00\x1c\x1d\x1e\x1f a b　c", "same " * 9000]
    out += [" ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(r.choice([1, 5, 30, 400, 700, 2500]))) for _ in range(120)]
    return out + [out[20]] * 40


def rows():
    all_texts = texts()
    return [(None if i == 3 else 5 * i - 40, t) for i, t in enumerate(all_texts)] + [(100, all_texts[40]), (100, all_texts[40])]


@pytest.fixture(scope="module")
def docs(spark):
    full = [(i, t, "r", 1, 2, 0.5, True) for i, t in rows()]
    return spark.createDataFrame(full, "doc_id long, text string, rank string, sequence_id int, score int, weight double, _able boolean").repartition(4)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("capacity,group", [(2048, 64), (2048, 3), (256, 8), (1, 4)])
def test_packing(spark, docs, capacity, group):
    from wayscore.llm.packing import pack_documents

    table = docs if capacity > 1 else docs.where("length(text) < 300")
    got = pack_documents(table, PATH, capacity=capacity, group=group).collect()
    tokenizer = library()
    left = Counter()
    for i, t in rows() if capacity > 1 else [(i, t) for i, t in rows() if t is not None and len(t) < 300]:
        left[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    known = defaultdict(list)
    for (i, ids), n in left.items():
        known[i] += [ids] * n
    assert set(pieces) == set(known)
    for i, own in pieces.items():
        assert sum(r.length for r in own) == sum(map(len, known[i]))
        starts = Counter()
        for r in own:
            fits = [ids for ids in known[i] if len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
            assert fits and r.start + r.length <= r.doc_tokens and r.length > 0
            starts[r.start] += 1
        if len(known[i]) == 1:  # gapless from the first id to the last
            assert [r.start for r in sorted(own, key=lambda r: r.start)] == np.cumsum([0, *[r.length for r in sorted(own, key=lambda r: r.start)]])[:-1].tolist()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
        total = sum(n for _, n in own)
        assert total <= capacity and total & (total - 1) == 0  # nothing is padded
    assert pack_documents(empty(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        pack_documents(empty(spark), PATH, capacity=1000)


def test_packing_repeats_itself(docs):
    from wayscore.llm.packing import pack_documents

    a, b = (sorted(map(tuple, pack_documents(docs.coalesce(2), PATH).collect()), key=repr) for _ in range(2))
    assert a == b


def test_token_ids_of_long_texts():
    from wayscore.llm import packing

    tokens, tokenizer = packing.Tokens(open(PATH, encoding="utf-8").read()), library()
    r = random.Random(1)
    for text in ["word  and\n more " * 300000, "x" * 1500000 + " tail", " " * 1200000 + "a b " * 20, "".join(r.choice("ab  \n'sé1.") for _ in range(1300000))]:
        assert tokens(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_differencing():
    from wayscore.llm.packing import differencing, windows_of

    # two-way differencing of 8 7 6 5 4 ends with a difference of 2
    assert [t for t, _ in differencing([8, 7, 6, 5, 4], 2)] == [16, 14]
    r = random.Random(2)
    for _ in range(200):
        sizes = [r.randint(1, 2047) for _ in range(r.randint(1, 40))]
        k = r.randint(1, 12)
        parts = differencing(sizes, k)
        assert sorted(p for _, places in parts for p in places) == list(range(len(sizes)))
        assert all(t == sum(sizes[p] for p in places) for t, places in parts) and len(parts) <= k
        assert max(t for t, _ in parts) <= sum(sizes) / k + max(sizes)
        windows = windows_of(sizes, 2048)
        assert max(t for t, _ in windows) <= 2048 and len(windows) >= math.ceil(sum(sizes) / 2048)
    assert windows_of([], 2048) == [] and [t for t, _ in windows_of([1025, 1025], 2048)] == [1025, 1025]


def brute_codes(vectors, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[v[p * d : (p + 1) * d] for v in list(first.values())[:entries]] for p in range(parts)]

    def assigned():
        out = []
        for _, v, _ in kept:
            own = []
            for p in range(parts):
                own.append(min((sum((a - b) ** 2 for a, b in zip(v[p * d : (p + 1) * d], c, strict=True)), e) for e, c in enumerate(books[p])))
            out.append(own)
        return out

    for _ in range(rounds):
        codes = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p * d : (p + 1) * d] for (_, v, _), c in zip(kept, codes, strict=True) if c[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = assigned()
    errors = [sum(x for x, _ in c) for c in codes]
    by_label = Counter()
    for (_, _, y), x in zip(kept, errors, strict=True):
        by_label[y] += x
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in c), x, by_label[y], digest) for (i, _, y), c, x in zip(kept, codes, errors, strict=True))


def vectors(n, spread, seed=3, width=16):
    r = random.Random(seed)
    centres = [[r.gauss(0, spread) for _ in range(width)] for _ in range(5)]
    out = [(3 * i + 1, [c + r.gauss(0, 0.1) for c in r.choice(centres)], r.choice([None, 0, 1, 2])) for i in range(n)]
    out += [(2, None, 1), (5, [], 1), (8, [None] * width, 1), (11, [0.0] * (width - 1) + [math.nan], 0), (14, [math.inf] + [0.0] * (width - 1), 0)]
    return out + [out[4], out[4], (0, [0.0] * width, None), (None, [0.5] * width, 7), (None, [0.25] * width, 7), (6000, out[7][1], 1)]


@pytest.mark.parametrize("n,spread,width", [(300, 0.2, 16), (300, 5.0, 16), (4, 1.0, 8), (120, 3000.0, 32)])
def test_codes(spark, n, spread, width):
    from wayscore.llm.ball_codes import compress

    data = vectors(n, spread, width=width)
    full = [(i, v, y, "c", 1) for i, v, y in data]
    table = spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, code string, part int").repartition(3)
    assert Counter(tuple(r) for r in compress(table).collect()) == brute_codes(data)


def test_codes_edges(spark):
    from wayscore.llm.ball_codes import compress

    table = lambda data: spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert compress(table([])).count() == 0 and compress(table([(1, None, 1)])).count() == 0
    same = [(None, [1.0] * 8, None)] * 3
    assert Counter(tuple(r) for r in compress(table(same)).collect()) == brute_codes(same)
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(ValueError):
            compress(table(bad))


def test_balls_skip_work_and_are_exact():
    from wayscore.llm.ball_codes import nearest_entries

    r = np.random.default_rng(4)
    for k, spread in ((16, 3000), (16, 50), (3, 0), (1, 10)):
        entries = r.integers(-spread - 1, spread + 1, (k, 8))
        parts = entries[r.integers(0, k, 4000)] + r.integers(-40, 40, (4000, 8))
        all_of = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        want = all_of.argmin(axis=1)
        for owner in (want, np.zeros(4000, np.int64), r.integers(0, k, 4000)):
            code, best, taken = nearest_entries(parts, entries, owner)
            assert (code == want).all() and (best == all_of.min(axis=1)).all()
            if spread == 3000 and owner is want:
                assert taken < 1.2 * len(parts)


def brute_drawn(documents, target, longest, buckets, least, percent, seed):
    def features(t):
        ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())
        return len(ws), [b" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in documents:
        s.update(zlib.crc32(f) % buckets for f in features(x)[1])
    for x in target:
        t.update(zlib.crc32(f) % buckets for f in features(x)[1])
    sn, tn = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sn + buckets) / ((s[b] + 1) * (tn + buckets)))) for b in range(buckets)]
    scored = []
    for i, x in documents:
        n, fs = features(x)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    out = Counter((*r, None) for r in scored)
    for k, r in enumerate(able[: percent * len(able) // 100]):
        out[(*r, None)] -= 1
        out[(*r, k + 1)] += 1
    return +out


@pytest.mark.parametrize("longest,buckets,least,percent", [(1, 10000, 20, 10), (3, 50, 3, 40), (2, 7, 0, 100)])
def test_resampling(spark, docs, longest, buckets, least, percent):
    from wayscore.llm.importance import resample

    goal = ["The naïve Ångström don t", None, "", "foo_bar 42 the the"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(goal)], "item_id long, text string")
    got = Counter(tuple(r) for r in resample(docs, target, longest, buckets, least, percent).collect())
    assert got == brute_drawn(rows(), goal, longest, buckets, least, percent, 2024)
    none = target.where("false")
    assert Counter(tuple(r) for r in resample(docs, none, 1, buckets, least, percent).collect()) == brute_drawn(rows(), [], 1, buckets, least, percent, 2024)
    assert resample(empty(spark), target).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    from wayscore.llm import importance

    r = random.Random(3)
    text = "".join(r.choice("aB 1.é") for _ in range(5000)).encode()
    words = WORD.findall(text.lower())
    assert [w for p in importance.word_lists(text, 7) for w in p] == words
    monkeypatch.setattr(importance.word_lists, "__defaults__", (7,))
    import pyarrow as pa

    out = list(importance._counts(3, 31)(iter([pa.record_batch({"text": pa.array([text], pa.binary())})])))
    want = Counter(zlib.crc32(b" ".join(words[i : i + n])) % 31 for n in (1, 2, 3) for i in range(len(words) - n + 1))
    assert dict(zip(out[0].column(0).to_pylist(), out[0].column(1).to_pylist(), strict=True)) == want


def test_shared_folder_without_a_setting():
    """A fresh session that names no shared folder runs, and one that is not local ends with one clear error."""
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent(
        """
        import os, sys, tempfile
        sys.path.insert(0, sys.argv[1])
        os.environ["SPARK_CONF_DIR"] = tempfile.mkdtemp()
        from wayscore.session import build_session
        spark = build_session("local[2]", spark__sql__shuffle__partitions="2")
        assert not spark.conf.get("spark.checkpoint.dir", None)
        from wayscore.llm.common import shared_dir, stored
        assert stored(spark.range(5)).count() == 5 and shared_dir(spark) == shared_dir(spark)
        from wayscore.llm.bloom_lm import score_documents
        from wayscore.llm.hyperminhash import near_duplicates
        from wayscore.llm.surrogates import replace_entities
        docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
        assert score_documents(docs).count() == 2 and near_duplicates(docs).count() == 2 and replace_entities(docs, b"k").count() == 2
        print("fine")
        """
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]

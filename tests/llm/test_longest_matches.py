"""Longest verbatim matches of documents with benchmark items, against brute force."""

import random
import re

import pytest

from wayscore.llm import suffix_arrays as sa

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    """Length and first place of the longest run of words that some item has too."""
    a, best = words(text), (0, None)
    for _, t in items:
        b = words(t)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if k > best[0] or (k and k == best[0] and i < best[1]):
                    best = (k, i)
    return best


def cases():
    rng = random.Random(5)
    draw = lambda n, kinds: [f"w{rng.randrange(kinds)}" for _ in range(n)]
    long = draw(120, 1000)
    items = [(1, " ".join(long)), (2, " ".join(long[20:60] + draw(10, 9))), (3, "ja " * 30), (4, "nur kurz"), (5, ""), (6, None),
             (7, " ".join(draw(40, 4))), (8, " ".join(draw(13, 50) + ["tail"])), (2, " ".join(long[50:90])), (None, "w1 w2")]
    docs = [" ".join(draw(5, 9) + long[k : k + n] + draw(6, 9)) for k, n in ((0, 120), (0, 3), (7, 10), (60, 13), (30, 14), (100, 20), (45, 60))]
    docs += [" ".join(long[10:30] + ["x"] + long[30:75] + ["y"] + long[75:100]), "JA " * 50, "ja, ja!", "nur kurz", "kurz nur", "", None, "nichts davon",
             " ".join(draw(80, 4)), " ".join(draw(15, 4)), items[7][1], items[7][1][:-3], " ".join(long), " ".join(long)]
    return items, docs


@pytest.mark.parametrize("blocks", [False, True])
def test_longest_matches(spark, blocks, monkeypatch):
    items, docs = cases()
    if blocks:  # each item a block of its own
        monkeypatch.setattr(sa, "_item_blocks", lambda b, w: (sa.ItemBlock([x], w) for x in items))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sa.find_benchmark_matches(table, benchmark).collect()}
    assert len(got) == len(docs)
    usable = [(i, t) for i, t in items if i is not None]
    for i, t in enumerate(docs):
        r = got[i]
        assert (r.longest, r.longest_start) == brute(t, usable), t
        if r.longest:
            run = words(t)[r.longest_start : r.longest_start + r.longest]
            assert any(words(x)[r.longest_place : r.longest_place + r.longest] == run for k, x in usable if k == r.longest_item)
        else:
            assert (r.longest_item, r.longest_place) == (None, None)


def test_a_long_text_in_common(spark):
    """A match of many thousand words, in a text that repeats itself, is found whole."""
    text = " ".join(f"w{(k * k) % 997}" for k in range(30000))
    benchmark = spark.createDataFrame([(1, text), (2, "w1 " * 40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 10 + text), (2, "w1 " * 20000), (3, text[: len(text) // 2])], "doc_id long, text string")
    got = {r.doc_id: (r.longest, r.longest_start, r.longest_item) for r in sa.find_benchmark_matches(docs, benchmark).collect()}
    assert got[1] == (30000, 10, 1) and got[2] == (40, 0, 2) and got[3][0] >= 14900

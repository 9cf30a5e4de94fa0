"""Cases of the near-duplicate operator: rows without an id, clashing column names, shared class numbers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F


def chain():
    """Three texts: the first two and the last two are alike, the first and the last are not enough so."""
    base = [f"w{i}" for i in range(300)]
    change = lambda at: [f"x{i}" if i in at else w for i, w in enumerate(base)]
    return " ".join(base), " ".join(change({10, 60, 110})), " ".join(change({10, 60, 110, 160, 210, 250}))


def brute(rows, percent=85):
    sets = []
    for _, t in rows:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    out = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None and sets[i]] or [d]
        out[d, len(sets[i]), min(ids) if d is not None or ids != [None] else None, d is not None and d == min(ids)] += 1
    return out


def test_links_through_rows_without_an_id(spark):
    from wayscore.llm.hyperminhash import keep_one, near_duplicates

    a, b, c = chain()
    rows = [(1, a), (None, b), (3, c), (None, None), (None, ""), (None, "lone text of quite another kind here"), (None, "lone text of quite another kind here"), (7, None), (8, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in near_duplicates(table).collect())
    assert got == brute(rows)
    assert got[3, 296, 1, False] == 1 and got[None, 296, 1, False] == 1
    apart = [r for r in rows if r[1] != b]
    assert Counter(tuple(r) for r in near_duplicates(spark.createDataFrame(apart, "doc_id long, text string")).collect()) == brute(apart)
    kept = Counter(tuple(r) for r in keep_one(table).collect())
    assert kept == Counter({(1, a): 1, (7, None): 1, (None, None): 1, (None, ""): 1, (None, "lone text of quite another kind here"): 1})


def test_columns_of_any_name_stay_as_they_are(spark):
    from wayscore.llm.hyperminhash import keep_one

    a, _, _ = chain()
    names = ["_rank", "_key", "rank", "key", "doc_id", "n_shingles", "cid", "text", "_0", "kept"]
    rows = [("mine", 7, 1.5, "k", 1, 2, "c", a, "z", True), ("mine too", 8, 2.5, "k", 2, 2, "c", a, "z", False), ("other", 9, 3.5, "k", 3, 2, "c", "x", "z", None)]
    kinds = "string, int, double, string, long, int, string, string, string, boolean".split(", ")
    table = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))
    got = keep_one(table)
    assert got.columns == names and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_unlike_sets_with_one_class_number_stay_apart(spark, monkeypatch):
    from wayscore.llm import hyperminhash as h

    plain = F.xxhash64

    def few(*columns):  # all class numbers of the first kind are equal
        return F.lit(5).cast("long") if all(isinstance(c, str) for c in columns) and columns == ("s1", "s2", "n_shingles") else plain(*columns)

    monkeypatch.setattr(h.F, "xxhash64", few)
    a, b, _ = chain()
    rows = [(1, a), (2, b), (3, "quite another text of five words"), (4, a), (5, "short"), (6, "short"), (7, "shorter")]
    got = {r.doc_id: r.component_id for r in h.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5, 7: 7}

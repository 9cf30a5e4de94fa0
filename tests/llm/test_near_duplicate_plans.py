"""What the driver plans at one time for near duplicates: rounds of components and the last step are small plans."""

from __future__ import annotations

from wayscore.llm import components as c
from wayscore.llm.hyperminhash import keep_one


def operators(df):
    return df._jdf.queryExecution().executedPlan().toString().strip().split("\n")


def test_a_round_of_components_is_small_plans_without_broadcasts(spark, monkeypatch):
    plans, plain = [], c.stored
    monkeypatch.setattr(c, "stored", lambda df: plans.append(operators(df)) or plain(df))
    chain = [(i, i + 1) for i in range(10, 30)] + [(9, 8), (8, 9), (7, 7)]
    star = [(100, i) for i in range(101, 140)] + [(50, 139), (139, 50)]
    found = c.components(spark.createDataFrame([*chain, *star], "a long, b long"))
    expected = {8: 8, 9: 8} | dict.fromkeys(range(10, 31), 10) | dict.fromkeys([50, *range(100, 140)], 50)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(expected) and dict(got) == expected
    assert max(map(len, plans)) <= 30
    assert not [x for plan in plans for x in plan if "Broadcast" in x]


def test_components_of_no_edges(spark):
    none = spark.createDataFrame([(3, 3)], "a long, b long")
    assert c.components(none).count() == 0


def test_the_rows_kept_are_one_small_plan(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (4, None)], "doc_id long, text string")
    kept = keep_one(docs)
    assert len(operators(kept)) <= 20
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]

"""Claims are lowered once and stripped at their ends only."""

from wayscore.functions import text as tx
from wayscore.operators import captions as cp
from wayscore.plans import caption_queries


def test_text_is_lowered_once_for_all_key_words(spark):
    d = spark.createDataFrame([(1, " A car waits. The Sky is wet! \n")], "i long, t string")
    raw = cp.fallback_claims(d, "i", "t")
    lowered = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lower(")
    assert lowered(raw.select("i", "category")) == 1
    clean = cp.clean_claims(raw.select("i", "claim", "category", "preferred_verifier", "importance").localCheckpoint())
    assert lowered(clean) == 1
    assert [(r.claim, r.preferred_verifier) for r in clean.collect()] == [("A car waits.", "qwen_vl"), ("The Sky is wet!", "qwen_vl")]


def test_strip_takes_all_white_space_of_both_ends_only(spark):
    d = spark.createDataFrame([("　\x85 a b\t \n",), (" \x1c\x1f",), ("",), ("​x​",), (None,)], "s string")
    assert [r[0] for r in d.select(tx.strip(d.s)).collect()] == ["a b", "", "", "​x​", None]


def test_verdicts_read_one_shuffle_of_the_captions_and_keep_none(spark, tmp_path):
    rows = [(i, f"A car waits {i}. The sky is wet! Two people walk.", i % 9) for i in range(40)] + [(7, "A car. Again!", None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for made in (caption_queries.verdicts, caption_queries.fused):
        d = made(spark, str(tmp_path))
        d = d.select("doc_id", "pos", "verdicts", "language_score", *[c for c in d.columns if c == "final_score"])
        found = d.collect()
        plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "InMemoryTableScan" not in plan and plan.count("Scan parquet") == 1 and plan.count("ReusedExchange") == 1
        assert sorted((r.pos, r.verdicts) for r in found if r.doc_id == 7) == [(1, 2), (1, 2), (2, 2), (2, 2), (3, 1)]  # an id that comes twice
        assert sorted((r.pos, r.verdicts) for r in found if r.doc_id == 8) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 1)]

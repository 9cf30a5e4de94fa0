"""From raw documents to token ids: reject toxic texts, keep one of near duplicates, drop benchmark texts, replace
personal data, encode.

Each stage takes all that the one before has kept and is written as Parquet before the next reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore.llm.common import stored
from wayscore.llm.hyperminhash import keep_one
from wayscore.llm.pair_bpe import encode_documents
from wayscore.llm.queries import SURROGATE_KEY
from wayscore.llm.suffix_arrays import decontaminate
from wayscore.llm.surrogates import replace_entities
from wayscore.llm.toxicity import reject_toxic

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples vote for toxic go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity from 0.85 on."""
    return keep_one(docs, size=5, percent=85)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 5 % or more of their words in benchmark windows of 13 words go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=0.05)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars, where there is one, follows the new text."""
    out = replace_entities(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and digests of the ids and of the text decoded from them."""
    return encode_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte pairs", tokens),
]

#: Nearest neighbours, sketches and byte pairs have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op8_rendezvous_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of equal weight by doc_id, and the shard of each row if there were 25."""
    from wayscore.llm.rendezvous import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), [1.0] * 24)


@query("op10_suffix_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words found in the documents' suffix arrays; contaminated at a hit share of 5 %."""
    from wayscore.llm.suffix_arrays import find_benchmark_matches

    found = find_benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "longest",
        "longest_start",
        "longest_item",
        "longest_place",
    )


@query("op9_fm_index_repeats")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that also start in a document of smaller id are removed."""
    from wayscore.llm.fm_index import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), window=13)


@query("op4_hyperminhash_near_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.85 or more."""
    from wayscore.llm.hyperminhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=5, percent=85)


@query("op7_bloom_filter_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and log-frequency Bloom filter score of every document."""
    from wayscore.llm.bloom_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


@query("op6_pair_index_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and the decoded text of every document, as digests."""
    import public_tokenizers

    from wayscore.llm.pair_bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), give_ids=False)


@query("op5_nearest_example_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    from wayscore.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_mtree_top_k", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    from wayscore.llm.mtree import top_k, whole_vectors

    vectors = whole_vectors(_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


#: The key of the registered queries; a deployment passes its own secret.
SURROGATE_KEY = b"wayscore surrogate key"


@query("op3_surrogate_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with keyed surrogates for the personal data in them."""
    from wayscore.llm.surrogates import replace_entities

    return replace_entities(_table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_replaced")


@query("op1_nearest_url_differencing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from wayscore.llm.page_diff import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


@query("op11_differencing_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences of 2,048 tokens without padding."""
    import public_tokenizers

    from wayscore.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Plain rounds over all parts and entries: what the balls leave out is compared here."""
    out = [
        f"""v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS x
  FROM v, (SELECT unnest(range({parts})) AS part)
), b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
)"""
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part, any_value(x) AS x, min(struct_pack(d := CAST({distance} AS BIGINT), e := entry)) AS best
  FROM p JOIN b{r} USING (part) GROUP BY vec_id, part
)""")
        if r < rounds:
            out.append(f"""m{r} AS (
  SELECT part, best.e AS entry, i, sum(x[i]) AS s, count(*) AS n
  FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL
), b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(any_value(l.c), any_value(b.c)) AS c
  FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY part, entry
  ) l ON b.part = l.part AND b.entry = l.entry GROUP BY b.part, b.entry
)""")
    return (
        "WITH "
        + ", ".join(out)
        + f""", codes AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN v USING (vec_id), books"""
    )


@query("op12_ball_codes", op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 8 parts by codebooks of 16 entries after 6 rounds of ball k-means."""
    from wayscore.llm.ball_codes import compress

    return compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


#: CRC-32 byte by byte over the hexadecimal digits of each distinct word; the table follows from the polynomial.
OP13_SQL = r"""
WITH RECURSIVE poly(i, step, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE step < 8
), tab AS (
  SELECT list(c ORDER BY i) AS crc FROM poly WHERE step = 8
), docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), goal AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), words AS (
  SELECT row, unnest(words) AS word FROM docs
), counted AS (
  SELECT word, sum(s) AS s, sum(t) AS t
  FROM (SELECT word, count(*) AS s, 0 AS t FROM words GROUP BY word UNION ALL SELECT word, 0, count(*) FROM goal GROUP BY word)
  GROUP BY word
), letters AS (
  SELECT word, s, t, hex(encode(word)) AS h FROM counted
), hashed AS (
  SELECT word, s, t, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM letters, tab
), buckets AS (
  SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY bucket
), sums AS (
  SELECT sum(s) AS s, sum(t) AS t FROM buckets
), gains AS (
  SELECT word, CAST(floor(1000 * ln((b.t + 1) * (sums.s + 10000) / ((b.s + 1) * (sums.t + 10000)))) AS BIGINT) AS gain
  FROM hashed JOIN buckets b USING (bucket), sums
), weights AS (
  SELECT row, count(*) AS n, sum(gain) AS weight FROM words JOIN gains USING (word) GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (row)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n >= 20) AS able FROM scored
)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
  CAST(CASE WHEN n >= 20 AND r <= 10 * able // 100 THEN r END AS BIGINT) AS rank
FROM ranked
"""


@query("op13_importance_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the words of the benchmark: a tenth of those with 20 words or more."""
    from wayscore.llm.importance import resample

    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1, buckets=10000, least_words=20, percent=10, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")

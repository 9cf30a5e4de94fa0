"""Evaluation tables derived from the driver tables, in Spark and as SQL.

Event streams are cut into clips of a fixed number of frames, the way the
benchmark scores fixed-length videos. A clip is therefore bounded however many
events one user has, and every later window or fold works inside one clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayscore.operators.ordered import by_key, number_rows, shared

CLIP = 41
TRACK_CLIP = 40
LUMA_CLIP = 64

SQL_VIEWS: dict[str, str] = {}
VIEW_DEPS: dict[str, tuple[str, ...]] = {}


def _sql(name: str, text: str, *deps: str) -> None:
    SQL_VIEWS[name] = text.strip()
    VIEW_DEPS[name] = deps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a, n):
    """Integer floor division of a non-negative Column."""
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / n).cast("long")


_sql("ev", """
SELECT user_id, event_id, ts, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n
FROM events
""")


def ev(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
    )
    return number_rows(e, ["user_id"], {"hour": F.date_trunc("hour", "ts")}, ["ts", "event_id"], "n")


_sql("traj_all", f"""
SELECT user_id // 7 AS scene_id, n // {CLIP} AS clip,
       CASE WHEN user_id % 7 = 0 THEN 'gt' ELSE 'm' || CAST(user_id % 7 AS VARCHAR) END AS model,
       n % {CLIP} AS frame,
       CASE WHEN user_id % 7 = 6 AND (user_id // 7) % 5 = 4 THEN 0.0
            ELSE CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / 10000 END AS x,
       CASE WHEN user_id % 7 = 6 AND (user_id // 7) % 5 = 4 THEN 0.0
            ELSE CAST(sum(k - 50) OVER w AS DOUBLE) / 200 END AS y
FROM ev WINDOW w AS (PARTITION BY user_id, n // {CLIP} ORDER BY n)
""", "ev")
_sql("pred", "SELECT * FROM traj_all WHERE model <> 'gt'", "traj_all")
_sql("gt", "SELECT scene_id, clip, frame, x, y FROM traj_all WHERE model = 'gt'", "traj_all")
_sql("pair", """
SELECT p.model, p.scene_id, p.clip, p.frame, p.x AS px, p.y AS py, g.x AS gx, g.y AS gy
FROM pred p JOIN gt g USING (scene_id, clip, frame)
""", "pred", "gt")

TRAJ_KEY = ["model", "scene_id", "clip"]
SCENE_KEY = ["scene_id", "clip"]


def traj_all(spark, sf_dir) -> DataFrame:
    e = ev(spark, sf_dir).withColumn("clip", div("n", CLIP))
    w = W.partitionBy("user_id", "clip").orderBy("n")
    scene = div("user_id", 7)
    static = (F.col("user_id") % 7 == 6) & (scene % 5 == 4)
    t = e.select(
        scene.alias("scene_id"),
        "clip",
        F.when(F.col("user_id") % 7 == 0, F.lit("gt"))
        .otherwise(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string"))).alias("model"),
        (F.col("n") % CLIP).alias("frame"),
        F.when(static, 0.0)
        .otherwise(F.sum(F.round(F.col("value") * 100).cast("long")).over(w).cast("double") / 10000).alias("x"),
        F.when(static, 0.0)
        .otherwise(F.sum(F.col("k") - 50).over(w).cast("double") / 200).alias("y"),
    )
    return by_key(t, "scene_id", "clip")


def pred(spark, sf_dir) -> DataFrame:
    return traj_all(spark, sf_dir).where("model <> 'gt'")


def gt(spark, sf_dir) -> DataFrame:
    return traj_all(spark, sf_dir).where("model = 'gt'").drop("model")


_sql("tracks", f"""
SELECT user_id // 4 AS video_id, n // {TRACK_CLIP} AS clip, user_id AS track_id, n % {TRACK_CLIP} AS frame,
       event_type AS class_name, value AS cx, CAST(k AS DOUBLE) AS cy, CAST((k * 7 + n * 13) % 97 AS DOUBLE) / 97 AS conf, ts, k,
       n % {TRACK_CLIP} + 12 * sum(CASE WHEN k >= 95 THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id, n // {TRACK_CLIP} ORDER BY n) AS gframe
FROM ev
""", "ev")


def tracks(spark, sf_dir) -> DataFrame:
    e = ev(spark, sf_dir).withColumn("clip", div("n", TRACK_CLIP))
    w = W.partitionBy("user_id", "clip").orderBy("n")
    return e.select(
        div("user_id", 4).alias("video_id"), "clip", F.col("user_id").alias("track_id"),
        (F.col("n") % TRACK_CLIP).alias("frame"), F.col("event_type").alias("class_name"),
        F.col("value").alias("cx"), F.col("k").cast("double").alias("cy"),
        (((F.col("k") * 7 + F.col("n") * 13) % 97).cast("double") / 97).alias("conf"), "ts", "k",
        (F.col("n") % TRACK_CLIP + 12 * F.sum(F.when(F.col("k") >= 95, 1).otherwise(0)).over(w)).alias("gframe"),
    )


_sql("luma", f"""
SELECT user_id AS video_id, n // {LUMA_CLIP} AS clip, n % {LUMA_CLIP} AS frame, least(255.0, value) AS luma, k FROM ev
""", "ev")


def luma(spark, sf_dir) -> DataFrame:
    return ev(spark, sf_dir).select(
        F.col("user_id").alias("video_id"), div("n", LUMA_CLIP).alias("clip"),
        (F.col("n") % LUMA_CLIP).alias("frame"), F.least(F.lit(255.0), F.col("value")).alias("luma"), "k",
    )


_sql("boxes", """
SELECT l_orderkey // 4 AS image_id,
       row_number() OVER (PARTITION BY l_orderkey // 4
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS det_id,
       CASE WHEN l_linenumber % 2 = 0 THEN 'label' ELSE 'pred' END AS role,
       l_suppkey % 3 AS cls, CAST((l_partkey * 7 + l_linenumber * 13) % 100 AS DOUBLE) / 100 AS conf,
       CAST(l_partkey % 4 * 10 AS DOUBLE) AS x1, CAST(l_suppkey % 3 * 10 AS DOUBLE) AS y1,
       CAST(l_partkey % 4 * 10 + 20 AS DOUBLE) + l_quantity AS x2, CAST(l_suppkey % 3 * 10 + 40 AS DOUBLE) AS y2
FROM lineitem
""")
_sql("dets", "SELECT image_id, det_id, cls, conf, x1, y1, x2, y2 FROM boxes WHERE role = 'pred'", "boxes")
_sql("lbls", "SELECT image_id, det_id AS label_id, cls, x1, y1, x2, y2 FROM boxes WHERE role = 'label'", "boxes")


def boxes(spark, sf_dir, kept: bool = False) -> DataFrame:
    """Boxes with their numbers; with ``kept`` all readers share one copy of the six columns that boxes are made of."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate", div("l_orderkey", 4).alias("image_id"),
    )
    numbered = number_rows(
        li, ["image_id"],
        {"o": F.col("l_orderkey"), "l": F.col("l_linenumber"), "p": div("l_partkey", 65536)},
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_shipdate"],
        "det_id", 1,
    )
    if kept:
        numbered = shared(numbered.select("image_id", "det_id", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return numbered.select(
        "image_id", "det_id",
        F.when(F.col("l_linenumber") % 2 == 0, "label").otherwise("pred").alias("role"),
        (F.col("l_suppkey") % 3).alias("cls"),
        (((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 100).cast("double") / 100).alias("conf"),
        (F.col("l_partkey") % 4 * 10).cast("double").alias("x1"),
        (F.col("l_suppkey") % 3 * 10).cast("double").alias("y1"),
        ((F.col("l_partkey") % 4 * 10 + 20).cast("double") + F.col("l_quantity")).alias("x2"),
        (F.col("l_suppkey") % 3 * 10 + 40).cast("double").alias("y2"),
    )


def dets(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir, kept=True).where("role = 'pred'").drop("role")


def lbls(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir, kept=True).where("role = 'label'").drop("role", "conf").withColumnRenamed("det_id", "label_id")


_sql("scores", """
SELECT o.o_orderpriority AS model, n.n_name AS scene_id, o.o_orderkey AS run_id, o.o_totalprice / 1000 AS score,
       1 + o.o_orderkey % 5 AS importance, c.c_mktsegment AS category
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
""")


def scores(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderpriority").alias("model"), F.col("n_name").alias("scene_id"),
            F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") / 1000).alias("score"),
            (1 + F.col("o_orderkey") % 5).alias("importance"), F.col("c_mktsegment").alias("category"),
        )
    )


_sql("depth", """
SELECT p.p_partkey AS image_id, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity, l.l_extendedprice,
       p.p_retailprice * (0.5 + l.l_discount * 5) / 97 AS gt,
       p.p_retailprice * (0.5 + l.l_discount * 5) / 97 * (0.7 + l.l_quantity / 79) AS pred,
       CASE WHEN l.l_suppkey % 11 = 0 THEN 0 ELSE 1 END AS valid
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey
""")


def depth(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    base = F.col("p_retailprice") * (0.5 + F.col("l_discount") * 5) / 97
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("image_id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
        "l_extendedprice", base.alias("gt"), (base * (0.7 + F.col("l_quantity") / 79)).alias("pred"),
        F.when(F.col("l_suppkey") % 11 == 0, 0).otherwise(1).alias("valid"),
    )


_sql("features", """
SELECT vec_id, label, CASE WHEN label < 5 THEN 'real' ELSE 'gen' END AS set_name, i - 1 AS pos,
       CAST(embedding[i] AS DOUBLE) AS v
FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
""")
_sql("pixels", """
SELECT vec_id AS image_id, pos // 8 AS y, pos % 8 AS x,
       floor(least(greatest((v + 0.5) * 255, 0), 255) + 0.5) AS luma
FROM features
""", "features")


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn(
        "set_name", F.when(F.col("label") < 5, "real").otherwise("gen"))


def features(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", "label", "set_name", F.posexplode("embedding").alias("pos", "v")) \
        .withColumn("v", F.col("v").cast("double"))


def pixels(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).select(
        F.col("vec_id").alias("image_id"), div("pos", 8).alias("y"), (F.col("pos") % 8).cast("long").alias("x"),
        F.floor(F.least(F.greatest((F.col("v") + 0.5) * 255, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("double").alias("luma"),
    )

"""Result sinks: partitioned tables, append-only logs and submission files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, fmt: str = "csv", by: str | None = "model") -> None:
    """Ranking or scene rows as CSV, JSON or Parquet, one folder per model."""
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def append_metric(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """One JSON line per metric run, added to the log.

    A named run has a folder of its own in the log, written as a whole: a job that is repeated after a failure, or by a
    scheduler, replaces its own lines and leaves those of all other runs. Without a name lines are only added.
    """
    if run_id is None:
        df.write.mode("append").json(path)
        return
    named = df.withColumn("run", F.lit(run_id))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def append_result_line(df: DataFrame, path: str, model: str = "model") -> None:
    """One ``model: {...}`` line per model, added to the results file."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != model]))
    df.select(F.concat(F.col(model), F.lit(": "), body).alias("value")).write.mode("append").text(path)


def box_line(cols: tuple[str, ...] = ("x", "y", "w", "h"), sep: str = ",", integers: bool = True) -> Column:
    parts = [(F.col(c).cast("long") if integers else F.col(c)).cast("string") for c in cols]
    return F.concat_ws(sep, *parts)


def write_submission(df: DataFrame, path: str, key: str = "seq", integers: bool = True) -> None:
    """Tracker boxes per sequence in comma form, in frame order, one folder per sequence.

    Aggregate rows (sequence names that start with an underscore) stay out.
    """
    d = df.where(~F.col(key).startswith("_"))
    lines = d.select(key, "frame", box_line(integers=integers).alias("line"))
    lines.repartition(key).sortWithinPartitions(key, "frame").select(key, "line").write.mode("overwrite").partitionBy(key).text(path)

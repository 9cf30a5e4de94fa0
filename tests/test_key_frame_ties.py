"""Key frames where a target lies halfway between two frames."""

from pyspark.sql import functions as F

from wayscore.operators import distribution as ds

LUMA = (23.54, 13.08, 45.06, 57.24, 6.22, 81.31, 79.42, 135.35, 65.52, 66.78, 120.49)


def test_a_target_halfway_between_two_frames_takes_the_later_one(spark):
    """Half of all motion is reached between frames 35 and 36, equally far from both; still clips spread evenly."""
    frames = [LUMA[i // 6] for i in range(64)]
    moving = [(0, i, abs(x - frames[i - 1]) / 8 if i else None) for i, x in enumerate(frames)]
    df = spark.createDataFrame(moving + [(1, i, 0.0 if i else None) for i in range(6)], "clip long, frame long, m double")
    got = {r.clip: list(r.idx) for r in ds.key_frames(df, ["clip"], "m").select("clip", F.col("idx")).collect()}
    assert got == {0: [0, 36, 63], 1: [0, 2, 5]}

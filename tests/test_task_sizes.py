"""Tasks get more, not larger, as the tables grow."""

from pyspark.sql import functions as F

from chunkline.operators import notes as N
from chunkline.operators import scores as S


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_notes_in_windows(spark, monkeypatch):
    monkeypatch.setattr(N, "NOTES_PER_TASK", 50, raising=False)
    notes = spark.range(4000).select((F.col("id") % 400).alias("clip"), (F.col("id") / 400 * 4.0).alias("onset")).withColumn("offset", F.col("onset") + 1)
    windows = spark.range(400).select(F.col("id").alias("clip"), F.explode(F.array(F.lit(0.0), F.lit(20.0))).alias("t0"))
    met = N.notes_in_windows(notes, windows, "clip", 20.0)
    assert met.count() >= 4000
    assert most_in_a_task(met) < 400


def test_rolls(spark, monkeypatch):
    """Spread cells stay where their clips are: the largest task has a few clips of a hundred."""
    monkeypatch.setattr(S, "CLIPS_PER_TASK", 5, raising=False)
    cells = spark.range(100 * 40).select((F.col("id") % 100).alias("clip"), (F.col("id") / 100).cast("long").alias("frame"), F.lit(90).alias("slot"))
    seen = []
    monkeypatch.setattr(S, "gaussian_spread", lambda both, *a: seen.append(both) or N.gaussian_spread(both, *a), raising=False)
    got = S.roll_fidelity(cells, cells, cells.select("clip"), ["clip"], 40)
    assert {(r["clip"], round(r["onset_corr"], 6)) for r in got.collect()} == {(i, 1.0) for i in range(100)}
    assert seen and most_in_a_task(seen[0]) <= 20 * 80

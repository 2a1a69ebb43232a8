"""Tables that end within a clip, and values that round to zero."""

import math

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chunkline.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def cut_off(spark, path, n):
    """The given tables with the first ``n`` embeddings only."""
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.where(f"vec_id < {n}") if t == "embeddings" else df).write.parquet(f"{path}/{t}.parquet")
    return str(path)


@pytest.mark.parametrize("n", [492, 386, 331, 391])
@pytest.mark.parametrize("name", ["a5_chunk_sink", "c8_condition_validity", "c8_lenient_fill"])
def test_last_clip_is_shorter(spark, tmp_path, name, n):
    """Two frames of a sound clip; one of clips that are at fault in each way (77, 66, 78)."""
    compare(spark, cut_off(spark, tmp_path / "sf", n), entry.queries()[name], entry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["a9_training_shards", "c8_lenient_fill"])
def test_zeros_have_the_sign_of_the_sql(spark, tmp_path, name):
    """Values just below zero round to -0.0 there; ``compare`` takes both zeros for one."""
    sf = tmp_path / "sf"
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "embeddings":
            near = F.when(F.col("vec_id") % 3 == 0, -4e-7).otherwise(4e-7).cast("float")
            df = df.withColumn("embedding", F.concat(F.array(near), F.slice("embedding", 2, 63)))
        df.write.parquet(f"{sf}/{t}.parquet")

    def signs(v):
        return [signs(x) for x in v] if isinstance(v, list) else math.copysign(1, v)

    df, cur = entry.queries()[name](spark, str(sf)), duck(str(sf)).execute(entry.oracle_sql()[name])
    at = [d[0] for d in cur.description].index("v")
    mine, theirs = sorted(map(repr, (signs(r["v"]) for r in df.collect()))), sorted(map(repr, (signs(r[at]) for r in cur.fetchall())))
    assert mine == theirs

"""Leak-safe splits of sources that grow without moving anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkline.functions.ranking import hash_rank
from chunkline.functions.text import chunk_group

SPLITS = ("train", "val", "test")


def ratio_status(*ratios: Column) -> Column:
    """missing, negative, sum (not 1 within 1e-6) or ok, for three columns of split ratios."""
    lost = F.greatest(*[F.when(r.isNull() | F.isnan(r), 1).otherwise(0) for r in ratios]) == 1
    return F.when(lost, "missing").when(F.least(*ratios) < 0, "negative").when(F.abs(sum(ratios[1:], ratios[0]) - 1) > 1e-6, "sum").otherwise("ok")


def check_ratios(ratios: tuple[float, ...]) -> tuple[float, float, float]:
    """Three numbers of 0 or more that sum to 1 (within 1e-6)."""
    if len(ratios) != 3 or any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"ratios must be three numbers >= 0 that sum to 1: {ratios}")
    return tuple(ratios)


def allocate_three(n: Column, ratios: tuple[float, float, float]) -> dict[str, Column]:
    """How many of n go to train, val and test. Halves round to even; val and test get one if they can."""
    _, r_val, r_test = check_ratios(ratios)
    test = F.rint(n * r_test).cast("long")
    test = F.greatest(test, F.lit(1)) if r_test > 0 else test
    val = F.rint(n * r_val).cast("long")
    val = F.when(n - test >= 2, F.greatest(val, F.lit(1))).otherwise(val) if r_val > 0 else val
    over = F.greatest(val + test - n, F.lit(0))
    val_cut = F.least(over, val)
    val, test = val - val_cut, test - (over - val_cut)
    few = n <= 1
    out = {"train": n - val - test, "val": val, "test": test}
    return {k: F.when(few, F.when((n == 1) & F.lit(k == "train"), 1).otherwise(0)).otherwise(c).cast("long") for k, c in out.items()}


def assign_splits(sources: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, existing: DataFrame | None = None) -> DataFrame:
    """(group_key, split) for sources (group_key, bucket) and for keys that only ``existing`` still has.

    A bucket without earlier keys is dealt in the order of sha1("seed:bucket:key"): train, val, test. In a
    bucket that has grown, earlier keys stay and new ones fill what test, then val, lack of the targets for
    the whole bucket; the rest is train.
    """
    src = sources.select("group_key", "bucket").distinct()
    was = existing.select("group_key", F.col("split").alias("was")) if existing is not None else None
    src = src.join(was, "group_key", "left") if was is not None else src.withColumn("was", F.lit(None).cast("string"))
    have = src.groupBy("bucket").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("was") == s, 1)).alias(f"n_{s}") for s in SPLITS])
    target = allocate_three(F.col("n"), ratios)
    have = have.select(
        F.col("bucket").alias("b"), (F.col("n_train") + F.col("n_val") + F.col("n_test") == 0).alias("fresh"), target["train"].alias("t_train"), target["val"].alias("t_val"),
        F.greatest(target["test"] - F.col("n_test"), F.lit(0)).alias("d_test"), F.greatest(target["val"] - F.col("n_val"), F.lit(0)).alias("d_val"),
    )
    new = hash_rank(src.where("was is null"), ["bucket"], F.sha1(F.concat_ws(":", F.lit(str(seed)), "bucket", "group_key")), "group_key")
    new = new.join(have, F.col("bucket").eqNullSafe(F.col("b")))
    r = F.col("rank")
    fresh = F.when(r <= F.col("t_train"), "train").when(r <= F.col("t_train") + F.col("t_val"), "val").otherwise("test")
    grown = F.when(r <= F.col("d_test"), "test").when(r <= F.col("d_test") + F.col("d_val"), "val").otherwise("train")
    new = new.select("group_key", F.when(F.col("fresh"), fresh).otherwise(grown).alias("split"))
    return new if existing is None else existing.select("group_key", "split").unionByName(new)


def split_counts(splits: DataFrame) -> DataFrame:
    """(split, n) with a row for each of the three splits."""
    names = splits.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return names.join(splits.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def class_histogram(sources: DataFrame, max_shown: int = 24) -> DataFrame:
    """(class_name, n) of the largest classes, and one row (null, rest) with what the others hold."""
    counts = sources.groupBy("class_name").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "class_name").limit(max_shown)
    tail = counts.join(top.select("class_name"), "class_name", "left_anti").agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top.select("class_name", "n", F.lit(1).cast("long").alias("classes")).unionByName(tail.select(F.lit(None).cast("string").alias("class_name"), "n", "classes"))


def with_split(chunks: DataFrame, splits: DataFrame) -> DataFrame:
    """Chunks (rel_chunk, ...) with the split of their group; null where the group has none."""
    keyed = chunks.withColumn("group_key", chunk_group(F.col("rel_chunk")))
    return keyed.join(splits.select("group_key", "split"), "group_key", "left")


def require_assigned(chunks: DataFrame) -> DataFrame:
    """Stops with the number of unassigned chunks and the first of them, if there are any."""
    bad = chunks.where("split is null").agg(F.count("*").alias("n"), F.min("rel_chunk").alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} chunks belong to no split, first {bad['first']}")
    return chunks


def chunk_counts(chunks: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, n) of chunks; those of no group are counted as unassigned."""
    return with_split(chunks, splits).groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count("*").alias("n"))


def scoped(sources: DataFrame, splits: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Sources (group_key, ...) whose split is one of ``wanted``."""
    return sources.join(splits.where(F.col("split").isin(*wanted)).select("group_key"), "group_key", "left_semi")


def require_same_params(old: dict[str, str], new: dict[str, str]) -> None:
    """Stops if a parameter of the recorded split differs: a split is never recomputed in silence."""
    diff = {k: (old[k], new[k]) for k in old.keys() & new.keys() if old[k] != new[k]}
    if diff:
        raise ValueError(f"split parameters differ from the recorded ones: {diff}")


def linspace_positions(n: int, total: Column, rounded: bool = False) -> Column:
    """Positions of ``n`` evenly spaced items of ``total`` (all, if there are fewer)."""
    k = F.least(F.lit(n), total)
    step = lambda i: i * (total - 1) / F.greatest(k - 1, F.lit(1))
    at = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: (F.rint(step(i)) if rounded else F.floor(step(i))).cast("long"))
    return F.when(k > 0, at).otherwise(F.array().cast("array<bigint>"))


def capped_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows by the order of a seeded hash, the same at any parallelism; sorted by key."""
    picked = rows.withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("_h", key).limit(n)
    return picked.drop("_h").orderBy(key)


def round_robin(indexed: DataFrame, shards: int) -> DataFrame:
    """A shard number for rows with a dense ``idx``."""
    return indexed.withColumn("shard", F.col("idx") % shards)

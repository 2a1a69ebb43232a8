"""Training samples and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkline.functions.ranking import hash_rank


def clips_with_conditions(clips: DataFrame, conditions: DataFrame, size: int, names: list[str]) -> DataFrame:
    """Clips (rel_chunk, start, ...) with an array column of ``size`` frames for each condition; null where a frame is missing.

    ``conditions``: (rel_chunk, name, frame, v). Frames are dealt to the clip that holds them by arithmetic.
    """
    rows = conditions.where(F.col("name").isin(*names)).select("rel_chunk", "name", (F.floor(F.col("frame") / size) * size).alias("start"), (F.col("frame") % size).alias("at"), "v")
    per = rows.groupBy("rel_chunk", "start", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("a"))
    per = per.withColumn("a", F.when(F.size("a") == size, F.col("a")))
    wide = per.groupBy("rel_chunk", "start").pivot("name", names).agg(F.first("a"))
    return clips.join(wide, ["rel_chunk", "start"], "left")


def clip_samples(clips: DataFrame, conditions: DataFrame, dims: DataFrame, size: int, names: list[str], *, strict: bool = True) -> DataFrame:
    """Clips (rel_chunk, start, ...) with the conditions that they need, at any start and however they overlap.

    ``conditions``: (rel_chunk, name, frame, v), frame null for those of whole chunks; ``dims``: (name, dim, per_frame), the
    registry. Per frame: ``name``, ``size`` vectors, and ``name_mask``, which of them are there. Per chunk:
    ``name``, a vector, and ``name_given``. What is missing is zeros, or with ``strict`` the whole column is null. Two
    vectors of one frame stop the run.
    """
    known = {r["name"]: (r["dim"], r["per_frame"]) for r in dims.where(F.col("name").isin(*names)).collect()}  # a row for each name
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown conditions {unknown}")
    framed = [n for n in names if known[n][1]]
    zero = lambda n: F.array_repeat(F.lit(0.0).cast("float"), known[n][0])
    # a clip lies in the block of its start and the next, so a frame meets the clips of two blocks
    block = lambda c: F.floor(c / size)
    rows = conditions.where(F.col("name").isin(*framed) & F.col("frame").isNotNull()).select("rel_chunk", "name", "frame", "v")
    rows = rows.withColumn("_b", F.explode(F.array(block(F.col("frame")), block(F.col("frame")) - 1)))
    at = F.col("frame") - F.col("start")
    met = clips.select("rel_chunk", "start").distinct().withColumn("_b", block(F.col("start"))).join(rows, ["rel_chunk", "_b"]).where((at >= 0) & (at < size))
    per = met.groupBy("rel_chunk", "start", "name").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("at"), "v"))).alias("m"))
    out = clips
    if framed:
        wide = per.groupBy("rel_chunk", "start").pivot("name", framed).agg(F.first("m"))
        out = out.join(wide.withColumnsRenamed({n: f"_{n}" for n in framed}), ["rel_chunk", "start"], "left")
    places = F.sequence(F.lit(0), F.lit(size - 1))

    def there(n: str, k: Column) -> Column:
        return F.when(F.col(f"_{n}").isNotNull(), F.try_element_at(f"_{n}", k))

    def dense(n: str) -> Column:
        return F.transform(places, lambda k: F.coalesce(there(n, k), zero(n)))

    def mask(n: str) -> Column:
        return F.transform(places, lambda k: there(n, k).isNotNull())

    for n in framed:
        out = out.withColumn(f"{n}_mask", mask(n))
        out = out.withColumn(n, F.when(F.forall(f"{n}_mask", lambda x: x), dense(n)) if strict else dense(n)).drop(f"_{n}")
    whole = [n for n in names if not known[n][1]]
    if whole:
        each = conditions.where(F.col("name").isin(*whole) & F.col("frame").isNull()).groupBy("rel_chunk").pivot("name", whole).agg(F.first("v"))
        out = out.join(each, "rel_chunk", "left")
        for n in whole:
            out = out.withColumn(f"{n}_given", F.col(n).isNotNull())
            out = out if strict else out.withColumn(n, F.coalesce(n, zero(n)))
    return out


def seeded_batches(rows: DataFrame, key: str, size: int, seed: int, limit: int | None = None, drop_last: bool = False) -> DataFrame:
    """Adds ``batch`` and ``place`` in the order of a seeded hash; ``limit`` keeps the first batches."""
    ranked = hash_rank(rows.withColumn("_all", F.lit(0)), ["_all"], F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    out = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size)).withColumn("place", (F.col("rank") - 1) % size)
    if limit is not None:
        out = out.where(F.col("batch") < limit)
    if drop_last:
        out = out.where((F.col("batch") + 1) * size <= F.col("bucket_n"))
    return out.drop("_all", "rank", "bucket_n")


def training_shards(batched: DataFrame, *columns: str) -> DataFrame:
    """One row for each batch, with an array for each column in the order of places."""
    s = F.array_sort(F.collect_list(F.struct("place", *columns)))
    return batched.groupBy("batch").agg(s.alias("s")).select("batch", *[F.col(f"s.{c}").alias(c) for c in columns])


def write_shards(shards: DataFrame, path: str, per_file: int = 1000) -> None:
    """Batches in order, a bounded number in a file."""
    shards.repartitionByRange("batch").sortWithinPartitions("batch").write.option("maxRecordsPerFile", per_file).parquet(path)


def write_chunks(chunks: DataFrame, status: DataFrame, path: str) -> None:
    """Valid chunks (rel_chunk, split, class_name, ...) by split and class. The committer puts files in place whole."""
    good = chunks.join(status.where("status = 'ok'").select("rel_chunk"), "rel_chunk", "left_semi")
    good.write.partitionBy("split", "class_name").parquet(path)

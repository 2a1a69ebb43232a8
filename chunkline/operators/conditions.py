"""Annotations of chunks: a registry of extractors, validity, coverage and incremental merging.

The long table is (rel_chunk, name, frame, v): one row a frame, or frame null for a vector of the whole chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.operators.stats import not_finite

LONG = "rel_chunk string, name string, frame int, v array<float>"


@dataclass
class Condition:
    """``extract`` takes a list of equally long signals and gives arrays (T, dim), or (dim,) with per_frame False."""

    name: str
    dim: int
    extract: Callable[[np.ndarray], list[np.ndarray]]
    per_frame: bool = True


@dataclass
class Registry:
    known: dict[str, Condition] = field(default_factory=dict)

    def add(self, condition: Condition) -> Registry:
        self.known[condition.name] = condition
        return self

    def enabled(self, names: list[str]) -> list[Condition]:
        if unknown := [n for n in names if n not in self.known]:
            raise ValueError(f"unknown conditions {unknown}; there are {sorted(self.known)}")
        return [self.known[n] for n in names]

    def dims(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.name, c.dim, c.per_frame) for c in self.known.values()], "name string, dim int, per_frame boolean")


def extract(chunks: DataFrame, conditions: list[Condition]) -> DataFrame:
    """The long table for ``chunks`` (rel_chunk, x array, names array): each chunk gets the conditions it names.

    Signals of one length are given to an extractor together. A wrong shape or a value that is not finite
    stops the run.
    """
    of = {c.name: c for c in conditions}

    def rows_of(c: Condition, chunk: np.ndarray, got: list[np.ndarray]) -> pa.RecordBatch:
        """The rows of all signals of one length together: a batch for each chunk costs more than its values."""
        got = [np.asarray(a, np.float32) for a in got]
        for k, a in zip(chunk, got, strict=True):
            if a.ndim != 1 + c.per_frame or a.shape[-1] != c.dim or not np.isfinite(a).all():
                raise ValueError(f"{c.name}: unusable values for {k}")
        n = np.array([len(a) if c.per_frame else 1 for a in got])
        frame = pa.array(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), pa.int32()) if c.per_frame else pa.nulls(len(n), pa.int32())
        v = pa.ListArray.from_arrays(pa.array(np.arange(n.sum() + 1) * c.dim, pa.int32()), pa.array(np.concatenate([a.ravel() for a in got])))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(chunk, n), pa.string()), pa.array(np.repeat(c.name, n.sum()), pa.string()), frame, v], ["rel_chunk", "name", "frame", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.to_pandas()
            for name, c in of.items():
                rows = b[[name in list(n) for n in b["names"]]]
                for _, g in rows.groupby(rows["x"].map(len)):
                    yield rows_of(c, g["rel_chunk"].to_numpy(object), c.extract(np.stack([np.asarray(x, float) for x in g["x"]])))

    return chunks.select("rel_chunk", "x", "names").mapInArrow(run, LONG)


def missing_names(chunks: DataFrame, stored: DataFrame, names: list[str], force: bool = False) -> DataFrame:
    """(rel_chunk, names) still to be computed; with ``force`` all of them."""
    want = F.array(*[F.lit(n) for n in names])
    if force:
        return chunks.select("rel_chunk", want.alias("names"))
    have = stored.groupBy("rel_chunk").agg(F.collect_set("name").alias("have"))
    left = F.array_except(want, F.coalesce("have", F.array().cast("array<string>")))
    return chunks.select("rel_chunk").join(have, "rel_chunk", "left").select("rel_chunk", left.alias("names")).where(F.size("names") > 0)


def add_conditions(chunks: DataFrame, stored: DataFrame, conditions: list[Condition], force: bool = False) -> DataFrame:
    """The stored table with what was missing (or, with ``force``, with fresh values); other rows are not touched."""
    todo = missing_names(chunks, stored, [c.name for c in conditions], force)
    fresh = extract(chunks.join(todo, "rel_chunk"), conditions)
    if force:
        stored = stored.where(~F.col("name").isin(*[c.name for c in conditions]))
    return stored.unionByName(fresh)


def condition_status(stored: DataFrame, dims: DataFrame, frames: int | DataFrame) -> DataFrame:
    """(rel_chunk, name, status): ok, unknown, bad_shape or non_finite.

    ``frames`` is how many frames every chunk has, or a table (rel_chunk, frames) with the numbers of each chunk's own, as
    the last chunk of a source may be shorter.
    """
    per = stored.groupBy("rel_chunk", "name").agg(
        F.count("*").alias("n"), F.count("frame").alias("n_frames"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"), F.bool_or(F.exists("v", not_finite)).alias("bad")
    )
    if isinstance(frames, int):
        per = per.withColumn("wanted", F.lit(frames))
    else:
        per = per.join(frames.select("rel_chunk", F.size("frames").alias("wanted")), "rel_chunk", "left").fillna(0, ["wanted"])
    shape = (F.col("lo") == F.col("dim")) & (F.col("hi") == F.col("dim")) & F.when(F.col("per_frame"), F.col("n_frames") == F.col("wanted")).otherwise((F.col("n") == 1) & (F.col("n_frames") == 0))
    status = F.when(F.col("dim").isNull(), "unknown").when(~shape, "bad_shape").when(F.col("bad"), "non_finite").otherwise("ok")
    return per.join(F.broadcast(dims), "name", "left").select("rel_chunk", "name", status.alias("status"))


def require_valid(status: DataFrame) -> DataFrame:
    """Strict reading: stops with the count and the first of the unusable annotations."""
    r = status.where("status <> 'ok'").agg(F.count("*").alias("n"), F.min(F.struct("rel_chunk", "name", "status")).alias("first")).first()
    if r["n"]:
        raise ValueError(f"{r['n']} unusable annotations, first {tuple(r['first'])}")
    return status


def zero_filled(chunks: DataFrame, stored: DataFrame, status: DataFrame, dims: DataFrame, frames: int | None = None) -> DataFrame:
    """Lenient reading: every chunk and known condition, with zeros (and ``filled``) where there is nothing usable.

    Without ``frames``, ``chunks`` has a column of that name with the numbers of each chunk's own.
    """
    good = stored.join(status.where("status = 'ok'").select("rel_chunk", "name"), ["rel_chunk", "name"])
    own = F.col("frames") if frames is None else F.sequence(F.lit(0), F.lit(frames - 1))
    at = F.when(F.col("per_frame"), own).otherwise(F.array(F.lit(None).cast("int")))
    grid = chunks.crossJoin(F.broadcast(dims)).select("rel_chunk", "name", "dim", F.explode(at).alias("frame"))
    g = good.select(F.col("rel_chunk").alias("c"), F.col("name").alias("m"), F.col("frame").alias("f"), "v")
    met = grid.join(g, (F.col("rel_chunk") == F.col("c")) & (F.col("name") == F.col("m")) & F.col("frame").eqNullSafe(F.col("f")), "left")
    zeros = F.transform(F.sequence(F.lit(1), F.col("dim")), lambda _: F.lit(0.0).cast("float"))
    return met.select("rel_chunk", "name", "frame", F.coalesce("v", zeros).alias("v"), F.col("v").isNull().alias("filled"))


def coverage(chunks: DataFrame, stored: DataFrame, known: list[str]) -> DataFrame:
    """(name, present, total, enabled): enabled are the known ones that every chunk has."""
    total = chunks.agg(F.countDistinct("rel_chunk").alias("total"))
    per = stored.groupBy("name").agg(F.countDistinct("rel_chunk").alias("present"))
    return per.crossJoin(F.broadcast(total)).select("name", "present", "total", ((F.col("present") == F.col("total")) & F.col("name").isin(*known)).alias("enabled"))


def present_in_all(chunks: DataFrame, stored: DataFrame, known: list[str]) -> DataFrame:
    return coverage(chunks, stored, known).where("enabled").select("name")

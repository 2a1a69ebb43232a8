"""What the operators share: the folder all executors see, staged tables, digests."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.sources.storage import new_path

#: Code points of texts that a task works on at once.
AT_ONCE = 1_000_000
#: Bits of a broadcast filter (16 MB, at every size of input).
BITS = 1 << 27


#: Spark's setting that removes the shuffle files of a query when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


_owned: list[list[str]] = []


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Removes in the end what is staged meanwhile, but for the folders that are taken from the list."""
    own: list[str] = []
    _owned.append(own)
    try:
        yield own
    finally:
        _owned.remove(own)
        for path in own:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    The shuffle files behind it go as soon as it is written.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    for own in _owned:
        own.append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with setting(spark, TIDY, "true"):
        writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for t in tables:
        # a staged table is one folder
        if files := t.inputFiles():
            _remove(spark, files[0].rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_text(c: Column) -> Column:
    """Lowercase hex digest of a string's UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def in_parts(rows: pd.DataFrame, sizes: pd.Series, most: int = AT_ONCE) -> Iterator[pd.DataFrame]:
    """Runs of rows whose sizes come to about ``most``."""
    part = (sizes.cumsum() // most).to_numpy()
    for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
        if len(at):
            yield rows.iloc[at]


def slices(batch: pa.RecordBatch, text_col: str, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same for an Arrow batch, by the code points of a text column."""
    sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(text_col)), 0), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, z in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if a < z:
            yield batch.slice(a, z - a)


def bits_of(keys: DataFrame) -> np.ndarray:
    """BITS bits (a fixed size), those of the keys set. They only spare rows a shuffle; the join that follows decides."""
    words = keys.selectExpr(f"cast((key & {BITS - 1}) >> 6 AS int) AS w", "shiftleft(1L, cast(key & 63 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(BITS - 1)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)

"""Digests of tables as trees over ranges of hashed keys, and tables kept in versions that such digests compare."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.sources.log import Marks


def row_digest(*columns: Column) -> Column:
    """sha256 of the values, each as `-` if null, else its byte count, a colon and itself: no two rows are written alike."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def key_hash(key: Column) -> Column:
    return F.sha1(F.coalesce(key.cast("string"), F.lit("")))


def leaves(rows: DataFrame, key: str, columns: list[str], digits: int) -> DataFrame:
    """(path, n, digest) of each range: the rows whose key's sha1 begins with ``path``.

    Rows are put in order within their range only; equal rows are counted, not listed. A range should hold some thousand
    rows: two digits for a million rows, one more for each sixteen times as many.
    """
    each = rows.select(key_hash(F.col(key)).alias("k"), row_digest(F.col(key), *[F.col(c) for c in columns]).alias("h")).groupBy("k", "h").agg(F.count("*").alias("n"))
    line = F.struct("k", "h", F.concat_ws(" ", "k", "h", F.col("n").cast("string")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    return each.groupBy(F.substring("k", 1, digits).alias("path")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest"))


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes one digit above."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat_ws(" ", x["path"], x["digest"])), "\n")
    return nodes.groupBy(F.substring("path", F.lit(1), F.length("path") - 1).alias("path")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest"))


def digest_tree(rows: DataFrame, key: str, *columns: str, digits: int = 2) -> DataFrame:
    """(path, n, digest) of all nodes, from the ranges of ``digits`` hex digits up to the root, whose path is empty.

    An empty table has no nodes.
    """
    levels = [leaves(rows, key, list(columns), digits)]
    for _ in range(digits):
        levels.append(parents(levels[-1]))
    return reduce(DataFrame.unionByName, levels)


def changed_ranges(old: DataFrame, new: DataFrame, digits: int) -> DataFrame:
    """(path, was, now): the ranges that differ between two trees, found from the root down; a range that one lacks has null."""
    met = old.select("path", F.col("digest").alias("was")).join(new.select("path", F.col("digest").alias("now")), "path", "full_outer")
    open_ = met.where(~F.col("was").eqNullSafe(F.col("now")))
    found = open_.where("path = ''")
    for d in range(1, digits + 1):
        below = open_.where(F.length("path") == d).withColumn("up", F.substring("path", F.lit(1), F.length("path") - 1))
        found = below.join(found.select(F.col("path").alias("up")), "up", "left_semi").drop("up")
    return found


def fingerprint(rows: DataFrame, key: str, *columns: str, digits: int = 2) -> DataFrame:
    """(digest, n): the root of the table's tree, whatever the order and parts of its rows."""
    return digest_tree(rows, key, *columns, digits=digits).where("path = ''").select("digest", "n")


def require_same(recorded: DataFrame, now: DataFrame, digits: int = 2) -> None:
    """Stops if a stored tree is not that of the table at hand, with the number of ranges that differ and the first few."""
    paths = changed_ranges(recorded, now, digits).select("path")
    first = [r["path"] for r in paths.orderBy("path").limit(5).collect()]
    if first:
        raise ValueError(f"another table than the recorded one: {paths.count()} ranges differ, first {', '.join(first)}")


class Conflict(RuntimeError):
    """Another writer has put the next version in place first."""


class VersionedTable:
    """A table in versions. A version is a mark that names a folder for each of 16 ranges of the key; a range is written only if its digest is new.

    Readers hold on to the folders of one version. A writer prepares its folders and then puts its mark in place, which
    only one of several can: the others get ``Conflict`` and leave nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key, self.marks = spark, path, schema, key, Marks(spark, path)

    def version(self) -> int | None:
        ids = self.marks.ids()
        return ids[-1] if ids else None

    def ranges(self, version: int | None = None) -> dict[str, list[str]]:
        """{range: [folder, digest]} of a version, the newest by default."""
        version = self.version() if version is None else version
        return {} if version is None else self.marks.read(version)

    def read(self, version: int | None = None) -> DataFrame:
        paths = [f"{folder}/_range={r}" for r, (folder, _) in self.ranges(version).items()]
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def write(self, rows: DataFrame, base: int | None = None) -> int:
        """The version that holds ``rows``: that at hand if nothing differs, else the one after ``base`` (the newest)."""
        base = self.version() if base is None else base
        was = {} if base is None else self.marks.read(base)
        columns = [c for c in rows.columns if c != self.key]
        now = {r["path"]: r["digest"] for r in leaves(rows, self.key, columns, 1).collect()}  # up to 16
        if base is not None and now == {r: digest for r, (_, digest) in was.items()}:
            return base
        changed = [r for r, digest in now.items() if was.get(r, [None, None])[1] != digest]
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        if changed:
            dealt = rows.withColumn("_range", F.substring(key_hash(F.col(self.key)), 1, 1)).where(F.col("_range").isin(*changed))
            dealt.write.partitionBy("_range").parquet(folder)
        version = 0 if base is None else base + 1
        try:
            self.marks.write(version, {r: [folder if r in changed else was[r][0], digest] for r, digest in now.items()})
        except OSError as e:
            gone = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            self.marks._fs.delete(gone, True)
            raise Conflict(f"version {version} of {self.path} is there already") from e
        return version

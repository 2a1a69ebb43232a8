"""Incremental ingestion with Structured Streaming.

What a batch must know of earlier ones is keyed state in the state store: the version of each source, the counts of each
bucket. So a batch reads its own rows only. What it leaves goes to folders of its own (written anew if the batch is run
again) and is shown by the mark of a log. With the stream's checkpoint each source counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from chunkline.functions.text import group_key
from chunkline.operators.chunks import chunk_levels, cut_chunks, numbered_chunks, source_gates, window_starts
from chunkline.operators.conditions import LONG, Condition, extract
from chunkline.operators.splits import SPLITS as NAMES
from chunkline.operators.splits import check_ratios
from chunkline.operators.stats import merge_moments, partial_moments
from chunkline.sources.log import RunLog
from chunkline.sources.storage import setting, staged

#: Spark's setting and class of the state store that keyed state needs.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Each = Callable[[DataFrame, int], None]


def batch_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the batches below ``path`` hold; empty if there are none yet."""
    schema = f"{schema}, batch_id long"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def put(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_stream(spark: SparkSession, source: str, schema: StructType, checkpoint: str, each: Each, files_per_batch: int = 1, through: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Hands every new file below ``source`` to ``each``, once, in batches, and ends when there are no more."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    with setting(spark, STORE, ROCKS):
        stream = through(rows).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()


# ingestion

VERSION = "rel_path string, size_bytes long, mtime_ns long"
MANIFEST = f"{VERSION}, n_chunks long, batch_id long"
CHUNKS = "rel_path string, rel_chunk string, idx int, start long"


class NewVersions(StatefulProcessor):
    """Passes a source on if its size or time is not that of the version seen last; of several in a batch the latest counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "size_bytes long, mtime_ns long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        now = max((int(m), int(s)) for part in rows for s, m in zip(part["size_bytes"], part["mtime_ns"], strict=True))
        version = (now[1], now[0])
        seen = self.seen.get()  # one call to the store a source; None if there is nothing
        if seen is None or tuple(seen) != version:
            self.seen.update(version)
            yield pd.DataFrame({"rel_path": [key[0]], "size_bytes": [version[0]], "mtime_ns": [version[1]]})

    def close(self) -> None:
        pass


def new_versions(rows: DataFrame) -> DataFrame:
    """The new and changed sources of a stream of listings."""
    return rows.groupBy("rel_path").transformWithStateInPandas(NewVersions(), VERSION, "Append", "None")


@dataclass
class Cutting:
    """How sources become chunks. ``load`` gives (rel_path, seq, x) of sources; without it chunks follow from sizes alone.

    ``source_gates`` and ``chunk_gates`` are the options of the functions of that name and of ``numbered_chunks``.
    """

    size: int
    overlap: int = 0
    load: Callable[[DataFrame], DataFrame] | None = None
    source_gates: dict[str, Any] = field(default_factory=dict)
    chunk_gates: dict[str, Any] = field(default_factory=dict)
    conditions: list[Condition] = field(default_factory=list)

    def chunks(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(CHUNKS rows, annotations in the long form)."""
        name = F.concat(group_key(F.col("rel_path")), F.lit("__c"), F.format_string("%04d", "idx")).alias("rel_chunk")
        if self.load is None:
            cut = fresh.select("rel_path", F.posexplode(window_starts(F.col("size_bytes"), self.size, self.overlap)).alias("idx", "start"))
            return cut.select("rel_path", name, "idx", "start"), None
        # both are read several times: gates, lengths, levels and signals; numbers and names
        samples = staged(self.load(fresh), "samples")
        if self.source_gates:
            samples = samples.join(source_gates(samples, "rel_path", **self.source_gates), "rel_path", "left_semi")
        rows = cut_chunks(samples, "rel_path", self.size, self.overlap)
        kept = numbered_chunks(chunk_levels(rows, "rel_path"), "rel_path", **self.chunk_gates)
        kept = kept.select("rel_path", name, F.col("idx").cast("int").alias("idx"), F.col("start").cast("long").alias("start"))
        kept = staged(kept, "kept-chunks")
        signal = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"])
        signals = rows.join(kept, ["rel_path", "start"]).groupBy("rel_chunk").agg(signal.alias("x"))
        names = F.array(*[F.lit(c.name) for c in self.conditions])
        return kept, extract(signals.withColumn("names", names), self.conditions) if self.conditions else None


def newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rel_path").agg(F.max_by(F.struct("size_bytes", "mtime_ns", "n_chunks", "batch_id"), "batch_id").alias("m")).select("rel_path", "m.*")


def manifest_log(spark: SparkSession, out: str) -> RunLog:
    return RunLog(spark, f"{out}/manifest", MANIFEST, newest)


def ingest(out: str, cutting: Cutting) -> Each:
    """A batch function for ``new_versions``: chunks and annotations are written, then the manifest, then the mark.

    A batch that has its mark is left as it is; one that was broken off is written anew.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        log = manifest_log(batch.sparkSession, out)
        if log.done(batch_id):
            return
        fresh = batch.persist()
        chunks, annotations = cutting.chunks(fresh)
        put(chunks, f"{out}/chunks", batch_id)
        if annotations is not None:
            put(annotations, f"{out}/annotations", batch_id)
        n = batch.sparkSession.read.schema(CHUNKS).parquet(f"{out}/chunks/batch_id={batch_id}").groupBy("rel_path").agg(F.count("*").alias("n_chunks"))
        rows = fresh.join(n, "rel_path", "left").select("rel_path", "size_bytes", "mtime_ns", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), F.lit(batch_id).cast("long").alias("batch_id"))
        log.write(rows, batch_id)
        log.commit(batch_id)
        fresh.unpersist()

    return each


def run_ingest(spark: SparkSession, source: str, out: str, cutting: Cutting, files_per_batch: int = 1) -> None:
    """Ingests the listings (VERSION) below ``source`` that are new since the last run."""
    schema = spark.createDataFrame([], VERSION).schema
    run_stream(spark, source, schema, f"{out}/checkpoint", ingest(out, cutting), files_per_batch, new_versions)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each source, as of the last whole batch."""
    return manifest_log(spark, out).table()


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the newest version of each source."""
    return batch_log(spark, f"{out}/chunks", CHUNKS).join(manifest(spark, out).select("rel_path", "batch_id"), ["rel_path", "batch_id"]).drop("batch_id")


def annotations(spark: SparkSession, out: str) -> DataFrame:
    """Their annotations."""
    now = batch_log(spark, f"{out}/chunks", CHUNKS).join(manifest(spark, out).select("rel_path", "batch_id"), ["rel_path", "batch_id"])
    return batch_log(spark, f"{out}/annotations", LONG).join(now.select("rel_chunk", "batch_id"), ["rel_chunk", "batch_id"], "left_semi").drop("batch_id")


# splits that grow

SPLITS = "group_key string, split string"


def room(n: int, had: dict[str, int], ratios: tuple[float, float, float]) -> dict[str, int]:
    """How many new keys of a bucket of ``n`` keys, ``had`` of which have a split, go to each: the rule of ``allocate_three``."""
    test = max(round(n * ratios[2]), 1) if ratios[2] > 0 else round(n * ratios[2])
    val = round(n * ratios[1])
    if ratios[1] > 0 and n - test >= 2:
        val = max(val, 1)
    over = max(val + test - n, 0)
    cut = min(over, val)
    val, test = val - cut, test - (over - cut)
    if n <= 1:
        val = test = 0
    new = n - sum(had.values())
    test = min(max(test - had["test"], 0), new)
    val = min(max(val - had["val"], 0), new - test)
    return {"train": new - test - val, "val": val, "test": test}


class GrowingSplits(StatefulProcessor):
    """State of a bucket: how many of its keys are in each split. Rows: keys of one batch that are in no split yet, with their hash ``h``."""

    def __init__(self, ratios: tuple[float, float, float]):
        self.ratios = ratios

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", ", ".join(f"{s} long" for s in NAMES))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        had = dict(zip(NAMES, self.counts.get() if self.counts.exists() else (0, 0, 0), strict=True))
        new = pd.concat([part[["h", "group_key"]] for part in rows]).sort_values(["h", "group_key"])
        get = room(sum(had.values()) + len(new), had, self.ratios)
        order = NAMES if not any(had.values()) else NAMES[::-1]  # a bucket that has grown first fills what lacks
        split = [s for s in order for _ in range(get[s])]
        self.counts.update(tuple(had[s] + get[s] for s in NAMES))
        yield pd.DataFrame({"group_key": new["group_key"].to_numpy(), "split": split, "bucket": key[0]})

    def close(self) -> None:
        pass


def grown_splits(keys: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """(group_key, split, bucket) of the keys (group_key, bucket) of a stream that are new; earlier ones keep theirs.

    Keys that have come before are dropped by the state store's own rows; a batch ranks its new keys of a bucket only.
    """
    new = keys.select("group_key", "bucket").dropDuplicates(["group_key", "bucket"])
    new = new.withColumn("h", F.sha1(F.concat_ws(":", F.lit(str(seed)), "bucket", "group_key")))
    return new.groupBy("bucket").transformWithStateInPandas(GrowingSplits(check_ratios(ratios)), f"{SPLITS}, bucket string", "Append", "None")


def run_splits(spark: SparkSession, source: str, out: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, files_per_batch: int = 1) -> None:
    """Splits the keys below ``source`` that are new since the last run."""
    schema = spark.createDataFrame([], "group_key string, bucket string").schema
    run_stream(spark, source, schema, f"{out}-checkpoint", lambda batch, i: put(batch, out, i), files_per_batch, lambda keys: grown_splits(keys, ratios, seed))


# moments and counts


def moments_of_batches(out: str, key: str, value: str) -> Each:
    """A batch function: the batch's partial sums; readers add up what all batches left."""
    return lambda batch, batch_id: put(partial_moments(batch, key, value), out, batch_id)


def running_moments(spark: SparkSession, out: str, key: str, kind: str) -> DataFrame:
    return merge_moments(batch_log(spark, out, f"{key} {kind}, n long, sx array<double>, sxx array<double>").drop("batch_id"), key)


def running_counts(spark: SparkSession, source: str, schema: StructType, checkpoint: str, out: str, keys: list[str]) -> None:
    """Counts by key over a stream, whole after every batch (the state is a row for each key)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    each = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

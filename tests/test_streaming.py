"""Ingestion and growing splits over many batches, with restarts and broken batches."""

import pytest
from pyspark.sql import functions as F

from chunkline.operators import splits as S
from chunkline.plans.datasets import registry
from chunkline.sources.log import FAN, KEPT_MARKS, RunLog
from chunkline.sources.storage import new_path
from chunkline.streaming import ingest as I


def test_splits_of_ten_batches_and_a_restart(spark):
    """The same as assigning batch after batch, each with all earlier keys at hand."""
    src, out = new_path(spark, "keys"), new_path(spark, "splits")
    known = spark.createDataFrame([], "group_key string, bucket string")
    existing = None
    for i in range(10):
        # buckets of many, few and one key; some keys come again
        rows = [(f"k{j:04d}", f"b{j % 4 if j % 7 else 'x' + str(j % 13)}") for j in range(i * 23 - (5 if i else 0), i * 23 + 23)]
        batch = spark.createDataFrame(rows, known.schema)
        batch.coalesce(1).write.mode("append").parquet(src)
        known = known.unionByName(batch).distinct()
        done = {(r["group_key"], r["split"]) for r in S.assign_splits(known, existing=existing).collect()}
        existing = spark.createDataFrame(sorted(done), "group_key string, split string")
        if i in (4, 9):
            # five files a batch each, in two runs of the stream
            I.run_splits(spark, src, out)
    got = I.batch_log(spark, out, f"{I.SPLITS}, bucket string")
    assert got.agg(F.countDistinct("batch_id")).first()[0] == 10
    assert {(r["group_key"], r["split"]) for r in got.collect()} == done
    assert got.count() == len(done) == known.select("group_key").distinct().count()


@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.1), (1.0, 0.0, 0.0), (0.5, 0.5, 0.0), (0.0, 0.5, 0.5)])
def test_room_is_the_rule_of_whole_buckets(spark, ratios):
    n = spark.range(0, 40).select("id", *[c.alias(k) for k, c in S.allocate_three(F.col("id"), ratios).items()])
    none = dict.fromkeys(S.SPLITS, 0)
    for r in n.collect():
        assert I.room(r["id"], none, ratios) == {s: r[s] for s in S.SPLITS}


def listing(spark, rows):
    return spark.createDataFrame(rows, I.VERSION)


def cutting(spark):
    wave = lambda fresh: fresh.select("rel_path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1)).alias("seq")).withColumn("x", F.sin(F.col("seq") * F.length("rel_path")))
    return I.Cutting(8, 0, wave, {"min_len": 8}, {"rms": 0.1}, registry().enabled(["energy", "range"]))


def seen(spark, out):
    rows = lambda d: sorted(map(repr, d.collect()))
    return rows(I.manifest(spark, out)), rows(I.chunks(spark, out)), rows(I.annotations(spark, out))


def test_broken_batches_leave_nothing(spark, monkeypatch):
    out, each = new_path(spark, "ingested"), None
    each = I.ingest(out, cutting(spark))
    each(listing(spark, [("a/x", 20, 1), ("a/y", 5, 1)]), 0)
    before = seen(spark, out)
    assert len(before[1]) == 2 and len(before[0]) == 2
    second = listing(spark, [("a/x", 30, 2), ("b/z", 9, 1)])
    # broken off after the sinks and the manifest's run, before the mark
    with monkeypatch.context() as m:
        m.setattr(RunLog, "commit", lambda self, batch_id: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            each(second, 1)
    assert seen(spark, out) == before
    each(second, 1)
    after = seen(spark, out)
    assert len(after[0]) == 3 and len(after[1]) == 3 + 1
    each(second, 1)  # a batch with its mark is left as it is
    assert seen(spark, out) == after


def test_versions_and_restarts(spark):
    """Changed and restored sources are cut again, the same version is not."""
    src, out = new_path(spark, "listing"), new_path(spark, "ingested")
    for rows, n in (([("a", 20, 1), ("b", 9, 1)], 2), ([("a", 20, 1), ("b", 10, 2)], 1), ([("b", 9, 1), ("c", 3, 1)], 2)):
        listing(spark, rows).coalesce(1).write.mode("append").parquet(src)
        before = I.manifest_log(spark, out).runs()
        I.run_ingest(spark, src, out, I.Cutting(8))
        log = I.manifest_log(spark, out)
        new = [r for r in log.runs() if r not in before]
        assert log._read(new).count() == n
    assert {r["rel_path"]: (r["size_bytes"], r["n_chunks"]) for r in I.manifest(spark, out).collect()} == {"a": (20, 2), "b": (9, 1), "c": (3, 0)}


def test_runs_are_merged_by_levels(spark):
    path = new_path(spark, "log")
    log = RunLog(spark, path, I.MANIFEST, I.newest)
    read = []
    for i in range(FAN * FAN + 3):
        log.write(spark.createDataFrame([(f"s{i % 10}", i, i, 0, i), (f"t{i}", 1, 1, 1, i)], I.MANIFEST).coalesce(1), i)
        log._read, original = (lambda runs: (read.append((i, runs)), original(runs))[1]), log._read  # noqa: B023
        log.commit(i)
        log._read = original
    assert log.runs() == [[2, 63], [0, 64], [0, 65], [0, 66]]
    got = {r["rel_path"]: r["batch_id"] for r in log.table().collect()}
    assert got == {f"t{i}": i for i in range(67)} | {f"s{i % 10}": i for i in range(57, 67)}
    # a batch reads the runs it merges and no others
    assert [i for i, _ in read] == sorted([*range(7, 67, 8), 63]) and all(len(runs) == FAN for _, runs in read)
    assert len(log.marks.ids()) == KEPT_MARKS
    with pytest.raises(OSError):
        log.marks.write(66, [])


def test_a_batch_loads_its_sources_once(spark):
    """Gates, lengths, levels and signals need the samples; loading them again for each would grow with all sources."""
    loaded = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            loaded.add(len(p))
            yield p

    plain = cutting(spark)
    once = I.Cutting(8, 0, lambda fresh: plain.load(fresh).mapInPandas(counted, "rel_path string, seq long, x double"), plain.source_gates, plain.chunk_gates, plain.conditions)
    rows, (a, b) = [("a/x", 20, 1), ("a/y", 33, 1), ("a/z", 5, 1)], (new_path(spark, "ingested"), new_path(spark, "ingested"))
    I.ingest(a, once)(listing(spark, rows), 0)
    I.ingest(b, plain)(listing(spark, rows), 0)
    assert loaded.value == 58
    assert seen(spark, a) == seen(spark, b)

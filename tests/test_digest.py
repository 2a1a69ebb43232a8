"""Digest trees, versioned tables, and statistics with their rejects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkline.operators import stats as S
from chunkline.operators import strings as T
from chunkline.sources import digest as G
from chunkline.sources.storage import new_path


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k string, a string, b string")


def root(df):
    return G.fingerprint(df, "k", "a", "b").first()


def test_values_are_not_run_together(spark):
    tables = [[("x", "a|b", "c")], [("x", "a", "b|c")], [("x", None, "")], [("x", "", None)], [("x", "", "")], [("x", "1:a", "")], [("x", "a", "1:")], [("x", "a", "b")] * 2, [("x", "a", "b")], [(None, "a", "b")], [("", "a", "b")]]
    found = [root(rows_of(spark, t))["digest"] for t in tables]
    assert len(set(found)) == len(tables)
    assert G.fingerprint(rows_of(spark, []), "k", "a", "b").count() == 0


def test_one_changed_row_changes_one_leaf(spark):
    d = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("string").alias("a"), F.lit("b").alias("b"))
    tree = G.digest_tree(d, "k", "a", "b")
    assert root(d.repartition(13).orderBy("a"))["digest"] == root(d)["digest"] and root(d)["n"] == 3000
    other = d.withColumn("a", F.when(F.col("k") == "17", "new").otherwise(F.col("a")))
    (r,) = G.changed_ranges(tree, G.digest_tree(other, "k", "a", "b"), 2).where("length(path) = 2").collect()
    assert r["path"] == spark.sql("SELECT substr(sha1('17'), 1, 2)").first()[0]
    assert G.changed_ranges(tree, tree, 2).count() == 0
    G.require_same(tree, G.digest_tree(d.coalesce(1), "k", "a", "b"))
    with pytest.raises(ValueError, match=f"1 ranges differ, first {r['path']}"):
        G.require_same(tree, G.digest_tree(other, "k", "a", "b"))
    gone = d.where(f"substr(sha1(k), 1, 2) <> '{r['path']}'")
    assert [(x["path"], x["now"]) for x in G.changed_ranges(tree, G.digest_tree(gone, "k", "a", "b"), 2).collect()] == [(r["path"], None)]


def files(table):
    return {f for i in table.marks.ids() for f in table.read(i).inputFiles()}


def test_versions(spark):
    schema = "k string, a string, b string"
    table = G.VersionedTable(spark, new_path(spark, "versioned"), schema, "k")
    assert table.version() is None and table.read().count() == 0
    d = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("a"), F.lit(None).cast("string").alias("b"))
    assert table.write(d) == 0 and table.read().count() == 500
    first = files(table)
    assert table.write(d.repartition(3)) == 0 and files(table) == first  # nothing is written again
    pinned = table.read(0)
    one = d.withColumn("a", F.when(F.col("k") == "3", "z").otherwise(F.col("a")))
    assert table.write(one) == 1
    new = files(table) - first
    assert len({f.split("_range=")[1][0] for f in new}) == 1  # one of 16 ranges
    assert pinned.where("a = 'z'").count() == 0 and table.read().where("a = 'z'").count() == 1 and table.read().count() == 500
    assert table.write(d.limit(0)) == 2 and table.read().count() == 0 and table.read(1).count() == 500


def test_two_writers_one_wins(spark):
    table = G.VersionedTable(spark, new_path(spark, "versioned"), "k string, a string, b string", "k")
    table.write(rows_of(spark, [("x", "1", "")]))
    base = table.version()
    assert table.write(rows_of(spark, [("x", "2", "")]), base) == 1
    with pytest.raises(G.Conflict):
        table.write(rows_of(spark, [("x", "3", "")]), base)
    assert [r["a"] for r in table.read().collect()] == ["2"]
    folders = {f.rsplit("/", 2)[0] for f in files(table)}
    fs, path = table.marks._fs, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.path)
    there = {s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("data-")}
    assert there == {f.rsplit("/", 1)[1] for f in folders}  # the loser left nothing


def test_text_tables_are_written_when_they_change(spark):
    path = new_path(spark, "texts")
    d = spark.createDataFrame([("a", ["x", "y"], ["t"]), ("b", ["x"], [])], "rel_path string, labels array<string>, texts array<string>")
    assert T.write_text_table(d, path) == T.write_text_table(d.coalesce(1), path) == (0, 0)
    more = d.unionByName(d.limit(1).withColumn("rel_path", F.lit("c")))
    assert T.write_text_table(more, path) == (0, 1)  # the strings are the same
    assert sorted((r["rel_path"], r["kind"], r["ids"]) for r in T.text_tables(spark, path)[1].read().where("rel_path = 'a'").collect()) == [("a", "label", [0, 1]), ("a", "text", [0])]


def frames(spark, clips):
    return spark.createDataFrame([(k, i, v) for k, vs in clips.items() for i, v in enumerate(vs)], "clip string, frame int, v array<double>")


def test_valid_channel_stats(spark):
    rng = np.random.default_rng(4)
    clips = {f"c{i:03d}": (rng.normal(size=(4, 3)) * 10 + 1e6).tolist() for i in range(30)}
    bad = {"b1": [[1.0, 2.0]] * 4, "b2": [[1.0, 2.0, 3.0]] * 3, "b3": [[1.0, float("inf"), 3.0]] * 4, "b4": [[1.0, 2.0, 3.0], None, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]}
    bad |= {f"s{i:02d}": [[0.0] * 3] for i in range(12)}
    stats, report = S.valid_channel_stats(frames(spark, clips | bad).repartition(5), "clip", "frame", "v", 3, 4)
    x = np.array(list(clips.values())).reshape(-1, 3)
    for r in stats.collect():
        assert r["n"] == 120 and r["mean"] == pytest.approx(x[:, r["d"]].mean(), rel=1e-12) and r["std"] == pytest.approx(np.sqrt(x[:, r["d"]].var() + 1e-6), rel=1e-9)
    assert report["counts"] == {"ok": 30, "unreadable": 1, "bad_shape": 1, "short": 13, "non_finite": 1}
    assert report["first"] == sorted([("b1", "bad_shape"), ("b2", "short"), ("b3", "non_finite"), ("b4", "unreadable"), *((f"s{i:02d}", "short") for i in range(6))])
    with pytest.raises(ValueError, match="no valid clip"):
        S.valid_channel_stats(frames(spark, bad), "clip", "frame", "v", 3, 4)
    with pytest.raises(ValueError, match="no valid clip"):
        S.valid_channel_stats(frames(spark, clips).limit(0), "clip", "frame", "v", 3, 4)

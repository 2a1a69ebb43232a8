"""Queries that run streams over files derived from the given tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkline.functions.series import signed_round
from chunkline.operators.scores import ledger
from chunkline.operators.stats import covariances
from chunkline.plans.catalog import GROWN_SQL, keyed, sources, sql
from chunkline.plans.datasets import registry
from chunkline.plans.fixtures import view
from chunkline.plans.frames import CUT
from chunkline.plans.registry import Family
from chunkline.sources.sidecar import sidecar_scan
from chunkline.sources.storage import new_path, setting, staged
from chunkline.streaming import ingest as I

family = Family()
query = family.query


def in_files(df, path, n):
    """``df`` dealt over ``n`` files below ``path``."""
    df.repartition(n).write.parquet(path)
    return path


@query("j1_ingest_stream", "SELECT rel_path, count(*) AS n FROM (SELECT rel_path, unnest(range((size_bytes - 512) // 448 + 1)) FROM fx_sources WHERE size_bytes >= 512) GROUP BY rel_path")
def j1(spark, sf):
    listing = sources(spark, sf).select("rel_path", "size_bytes", "mtime_ns")
    src, out = in_files(listing, new_path(spark, "listing"), 4), new_path(spark, "ingested")
    for _ in range(2):  # the second run finds nothing to do
        I.run_ingest(spark, src, out, I.Cutting(512, 64))
    return I.chunks(spark, out).groupBy("rel_path").agg(F.count("*").alias("n"))


GATED = CUT + """, ok AS (SELECT clip_id FROM fx_samples GROUP BY clip_id HAVING count(*) >= 20 AND avg((abs(x) >= 0.2)::INT) <= 0.45 AND avg((abs(x) < 0.05)::INT) < 0.45),
num AS (SELECT *, 'clips/clip_' || clip_id AS rel_path, row_number() OVER (PARTITION BY clip_id ORDER BY start) - 1 AS idx FROM lv WHERE (rms > 0.13 OR peak > 0.4) AND clip_id IN (SELECT clip_id FROM ok)),
kept AS (SELECT clip_id, start, idx, rel_path, [G] || '__c' || lpad(idx::VARCHAR, 4, '0') AS rel_chunk FROM num WHERE dbfs >= -21)"""
GATED = sql(GATED, G="GROUP@rel_path")


def ingested(spark, sf):
    """Clips in four files of listings, gated, cut, numbered and annotated; a fifth has other times for some."""
    # the sources stand as they are: a batch reads them without numbering all samples anew
    clips = staged(view(spark, sf, "fx_samples").select(F.concat(F.lit("clips/clip_"), "clip_id").alias("rel_path"), "seq", "x"), "clips")
    listing = clips.groupBy("rel_path").agg(F.count("*").alias("size_bytes")).withColumn("mtime_ns", F.lit(1).cast("long"))
    src, out = in_files(listing, new_path(spark, "listing"), 4), new_path(spark, "ingested")
    load = lambda fresh: clips.join(fresh.select("rel_path"), "rel_path", "left_semi")
    cutting = I.Cutting(16, 4, load, {"min_len": 20, "peak": 0.2, "max_peak_ratio": 0.45, "silence": 0.05, "max_silence_ratio": 0.45}, {"rms": 0.13, "peak": 0.4, "min_dbfs": -21.0}, registry().enabled(["energy", "range"]))
    I.run_ingest(spark, src, out, cutting, 2)
    again = listing.where("rel_path like '%7'").withColumn("mtime_ns", F.lit(2).cast("long"))
    again.write.mode("append").parquet(src)
    I.run_ingest(spark, src, out, cutting, 2)
    return out


@query("j1_gated_chunks", f"WITH {GATED} SELECT rel_path, rel_chunk, idx::INT AS idx, start FROM kept")
def j1_gated(spark, sf):
    return I.chunks(spark, ingested(spark, sf)).select("rel_path", "rel_chunk", "idx", "start")


@query("j1_annotations", f"""WITH {GATED}, s AS (SELECT rel_chunk, seq, x FROM kept JOIN cut USING (clip_id, start))
SELECT rel_chunk, 'range' AS name, NULL::INT AS frame, round(min(x)::FLOAT::DOUBLE, 5) AS a, round(max(x)::FLOAT::DOUBLE, 5) AS b FROM s GROUP BY rel_chunk
UNION ALL SELECT rel_chunk, 'energy', (seq // 4)::INT, round(avg(x)::FLOAT::DOUBLE, 5), round(max(x)::FLOAT::DOUBLE, 5) FROM s GROUP BY rel_chunk, seq // 4""")
def j1_annotations(spark, sf):
    v = lambda i: F.round(F.get("v", F.lit(i)).cast("double"), 5)
    return I.annotations(spark, ingested(spark, sf)).select("rel_chunk", "name", "frame", v(0).alias("a"), v(1).alias("b"))


@query("j1_manifest", f"WITH {GATED}, n AS (SELECT clip_id, count(*) AS n FROM kept GROUP BY 1) SELECT 'clips/clip_' || clip_id AS rel_path, count(*) AS size_bytes, CASE WHEN clip_id % 10 = 7 THEN 2 ELSE 1 END AS mtime_ns, coalesce(max(n), 0) AS n_chunks FROM fx_samples LEFT JOIN n USING (clip_id) GROUP BY clip_id")
def j1_manifest(spark, sf):
    return I.manifest(spark, ingested(spark, sf)).drop("batch_id")


@query("j2_grow_splits_stream", "WITH " + sql(GROWN_SQL, G="GROUP@rel_path"))
def j2(spark, sf):
    every = keyed(spark, sf).select("doc_id", "group_key", F.col("class_name").alias("bucket"))
    src, out = new_path(spark, "keys"), new_path(spark, "splits")
    for part in ("doc_id % 10 <> 3", "doc_id % 10 = 3"):
        # keys of the first part come again with the second
        every.where(part if "<>" in part else "doc_id % 10 in (3, 4)").select("group_key", "bucket").coalesce(1).write.mode("append").parquet(src)
        I.run_splits(spark, src, out)
    return I.batch_log(spark, out, f"{I.SPLITS}, bucket string").select("group_key", "split")


@query("j3_running_moments", "SELECT a.side, (a.d)::INT AS i, (b.d)::INT AS j, round(covar_samp(a.v::DOUBLE, b.v::DOUBLE), 6) AS cov FROM fx_latent_dims a JOIN fx_latent_dims b ON a.clip_id = b.clip_id AND a.frame = b.frame GROUP BY ALL")
def j3(spark, sf):
    rows = view(spark, sf, "fx_clips").select("side", F.col("embedding").alias("v"))
    src, out = in_files(rows, new_path(spark, "latents"), 4), new_path(spark, "moments")
    I.run_stream(spark, src, rows.schema, f"{out}-checkpoint", I.moments_of_batches(out, "side", "v"))
    c = covariances(I.running_moments(spark, out, "side", "string"), "side")
    return c.select("side", "i", "j", signed_round(F.col("cov"), 6).alias("cov"))


@query("j4_running_coverage", "SELECT arm, metric_key AS cond, CASE WHEN isnan(score) THEN 'non_finite' ELSE 'ok' END AS status, count(*) AS n FROM fx_scores GROUP BY ALL")
def j4(spark, sf):
    s = view(spark, sf, "fx_scores").select("arm", F.col("metric_key").alias("cond"), F.lit("level").alias("metric"), "sample_id", F.col("score").alias("value"))
    rows = ledger(s).select("arm", "cond", "status")
    src, out = in_files(rows, new_path(spark, "scores"), 4), new_path(spark, "coverage")
    I.running_counts(spark, src, rows.schema, f"{out}-checkpoint", out, ["arm", "cond", "status"])
    return spark.read.parquet(out)


@query("a2_sidecar_scan", "SELECT file, [label] AS labels, [text] AS texts FROM fx_sidecar WHERE pos % 2 = 0 UNION ALL SELECT file, [label], [] FROM fx_sidecar WHERE pos % 2 = 1")
def a2(spark, sf):
    s = view(spark, sf, "fx_sidecar").withColumn("text", F.regexp_replace("text", " ", "_"))
    root = new_path(spark, "sidecars")
    named = s.where("pos % 2 = 0").select(F.col("file").alias(" File "), F.col("label").alias("Class"), F.col("text").alias("caption"))
    named.write.option("header", "true").csv(f"{root}/a")
    s.where("pos % 2 = 1").select(F.col("label"), F.col("pos").alias("other"), F.col("file").alias("filename")).write.option("header", "true").csv(f"{root}/b")
    s.select(F.col("pos").alias("number")).write.option("header", "true").csv(f"{root}/c")
    back = F.transform("texts", lambda t: F.regexp_replace(t, "_", " "))
    return sidecar_scan(spark, root).select("file", "labels", back.alias("texts"))


@query("a2_sidecar_rows", "SELECT row_number() OVER (ORDER BY pos) AS row_pos, file, [label || ', \"' || text || '\"'] AS labels, [text || chr(10) || label] AS texts FROM fx_sidecar")
def a2_rows(spark, sf):
    """One file read in many parts, with quotes, commas and line ends in its fields: rows keep their place."""
    s = view(spark, sf, "fx_sidecar").select("pos", "file", F.concat("label", F.lit(', "'), "text", F.lit('"')).alias("label"), F.concat("text", F.lit("\n"), "label").alias("text"))
    root = new_path(spark, "sidecar")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    # the header is the first row of the one file
    head = spark.createDataFrame([(-1, "file,label,text")], "pos long, line string")
    rows = s.select("pos", F.concat_ws(",", quoted(F.col("file")), quoted(F.col("label")), quoted(F.col("text"))).alias("line"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("pos").select("line").write.text(f"{root}/text")
    name = spark.read.text(f"{root}/text").select("_metadata.file_path").first()[0]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(f"{root}/csv"))
    fs.rename(hadoop.Path(name), hadoop.Path(f"{root}/csv/one.csv"))
    with setting(spark, "spark.sql.files.maxPartitionBytes", "4k"):
        return sidecar_scan(spark, f"{root}/csv").select("row_pos", "file", "labels", "texts")

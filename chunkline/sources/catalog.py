"""Source listings, sidecar tables and the manifest of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.functions.text import parent, path_key, source_id
from chunkline.sources.storage import staged

#: Suffixes of sound files.
SOUND = ("mp3", "wav", "flac", "ogg", "m4a", "wma", "mpc", "oma", "ape", "aac")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size_bytes, mtime_ns) of all files below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    rel = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1)
    return found.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def source_catalog(listing: DataFrame, *, extensions: tuple[str, ...] = SOUND, single_class: bool = False, class_name: str = "unknown", recorded: DataFrame | None = None) -> DataFrame:
    """(rel_path, rel_parent, class_name, src_id, size_bytes, mtime_ns) of the sources in a listing.

    The class is the leaf of the parent folder, or ``class_name`` for files at the root (with
    ``single_class``, for all). ``recorded`` (rel_path, rel_parent) keeps the folder of known sources.
    """
    kept = listing.where(F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)).isin(*extensions))
    folder: Column = parent(F.col("rel_path"))
    if single_class:
        folder = F.lit(class_name)
    folder = F.when(folder == "", class_name).otherwise(folder)
    if recorded is not None:
        kept = kept.join(recorded.select("rel_path", F.col("rel_parent").alias("_was")), "rel_path", "left")
        folder = F.coalesce("_was", folder)
    out = kept.withColumn("rel_parent", folder)
    return out.select("rel_path", "rel_parent", F.substring_index("rel_parent", "/", -1).alias("class_name"), source_id(F.col("rel_path")).alias("src_id"), "size_bytes", "mtime_ns")


def attach_sidecar(sources: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rel_path, labels, texts) of every source, unmatched rows).

    ``rows``: (pos, file, label, text). A row belongs to the source with its path key, else to every source
    with its file name. Values keep the order in which they are first seen, without repeats.
    """
    src = sources.select("rel_path", path_key(F.col("rel_path")).alias("key"))
    src = src.withColumn("name", F.substring_index("key", "/", -1))
    keyed = rows.select("pos", "label", "text", path_key(F.col("file")).alias("key"))
    by_key = staged(keyed.join(src.select("key", "rel_path"), "key", "left"), "sidecar-by-key")
    exact = by_key.where("rel_path is not null").select("rel_path", "pos", "label", "text")
    rest = by_key.where("rel_path is null").withColumn("name", F.substring_index("key", "/", -1)).drop("rel_path", "key").join(src.select("name", "rel_path"), "name", "left")
    met = exact.unionByName(rest.where("rel_path is not null").select("rel_path", "pos", "label", "text"))

    # both columns in one pass
    each = met.select("rel_path", "pos", F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("label", "text")])))
    first = each.where("value is not null").groupBy("rel_path", "kind", "value").agg(F.min("pos").alias("pos"))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("pos", "value")))), lambda x: x["value"]).alias(f"{c}s")
    none = F.array().cast("array<string>")
    out = sources.select("rel_path").join(first.groupBy("rel_path").agg(of("label"), of("text")), "rel_path", "left")
    return out.select("rel_path", F.coalesce("labels", none).alias("labels"), F.coalesce("texts", none).alias("texts")), rest.where("rel_path is null").select("pos", "label", "text")


def manifest_diff(prev: DataFrame, now: DataFrame) -> DataFrame:
    """(rel_path, change) with change added, removed, changed or same."""
    a = prev.select("rel_path", F.struct("size_bytes", "mtime_ns").alias("was"))
    b = now.select("rel_path", F.struct("size_bytes", "mtime_ns").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed").otherwise("same")
    return a.join(b, "rel_path", "full_outer").select("rel_path", change.alias("change"))


def manifest_merge(prev: DataFrame, produced: DataFrame, *, live: DataFrame | None = None) -> DataFrame:
    """``prev`` with ``produced`` rows over it; with ``live``, rows of sources that are gone are left out."""
    if live is not None:
        prev = prev.join(live.select("rel_path"), "rel_path", "left_semi")
    names = [c for c in prev.columns if c != "rel_path"]
    a = prev.select("rel_path", F.struct(*names).alias("a"))
    b = produced.select("rel_path", F.struct(*names).alias("b"))
    return a.join(b, "rel_path", "full_outer").select("rel_path", F.coalesce("b", "a").alias("m")).select("rel_path", "m.*")


def orphans(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks whose source is gone; to prune is to write the others."""
    return chunks.join(sources.select("rel_path"), "rel_path", "left_anti")


def pending_sources(sources: DataFrame, manifest: DataFrame, done: DataFrame, needed: DataFrame) -> DataFrame:
    """Sources that are new, changed, without chunks, or have a chunk that lacks an output.

    ``manifest``: (rel_path, size_bytes, mtime_ns, chunks array). ``done``: (rel_chunk, output).
    ``needed``: (output), a small table of the outputs that every chunk must have.
    """
    same = sources.join(manifest, ["rel_path", "size_bytes", "mtime_ns"]).select("rel_path", F.explode("chunks").alias("rel_chunk"))
    have = done.join(needed, "output", "left_semi").groupBy("rel_chunk").agg(F.countDistinct("output").alias("n"))
    want = needed.agg(F.countDistinct("output").alias("want"))
    full = same.join(have, "rel_chunk", "left").join(F.broadcast(want)).groupBy("rel_path").agg(F.bool_and(F.coalesce("n", F.lit(0)) >= F.col("want")).alias("ok"))
    return sources.join(full.where("ok"), "rel_path", "left_anti")


def companion_match(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, status, found) by folder and stem; ``files``: (rel_path) of files that may accompany sources.

    status is found (one), missing (none) or ambiguous (several); ``found`` is sorted.
    """
    from chunkline.functions.text import stem

    keyed = lambda d: d.select("rel_path", parent(F.col("rel_path")).alias("folder"), stem(F.col("rel_path")).alias("stem"))
    got = keyed(files).withColumnRenamed("rel_path", "file").groupBy("folder", "stem").agg(F.array_sort(F.collect_list("file")).alias("found"))
    n = F.size(F.col("found"))
    status = F.when(F.col("found").isNull(), "missing").when(n == 1, "found").otherwise("ambiguous")
    return keyed(sources).join(got, ["folder", "stem"], "left").select("rel_path", status.alias("status"), F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def meta_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, was, now) of the keys that both maps hold with different values; each table has one MAP column ``meta``."""
    a, b = (d.select(F.explode("meta").alias("key", v)) for d, v in ((old, "was"), (new, "now")))
    return a.join(b, "key").where(~F.col("was").eqNullSafe(F.col("now")))

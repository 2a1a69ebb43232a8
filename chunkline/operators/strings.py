"""Labels and texts of sources as dictionaries of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.functions.ranking import dense_index
from chunkline.functions.text import clean_text, parent
from chunkline.sources.digest import VersionedTable
from chunkline.sources.storage import staged


def resolve_strings(sources: DataFrame, attached: DataFrame, texts: DataFrame | None = None, root_class: str | None = None) -> DataFrame:
    """(rel_path, labels, texts): sidecar values, else the folder's name and the cleaned text beside the file.

    ``texts``: (rel_path, text). A file at the root has no folder label unless ``root_class`` is given.
    """
    d = sources.select("rel_path").join(attached, "rel_path", "left")
    d = d.join(texts, "rel_path", "left") if texts is not None else d.withColumn("text", F.lit(None).cast("string"))
    folder = F.substring_index(parent(F.col("rel_path")), "/", -1)
    label = F.when(folder == "", F.lit(root_class)).otherwise(folder)
    some = lambda c, other: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array_compact(F.array(other)))
    return d.select("rel_path", some("labels", label).alias("labels"), some("texts", clean_text(F.col("text"))).alias("texts"))


def dictionary(resolved: DataFrame, column: str) -> DataFrame:
    """(value, id) of the distinct values of an array column, numbered in code-point order."""
    values = resolved.select(F.explode(column).alias("value")).distinct()
    return dense_index(values, "value", name="id").select("value", "id")


def encode_ids(resolved: DataFrame, column: str, values: DataFrame, key: str = "rel_path") -> DataFrame:
    """(key, ids) in the order of the values."""
    each = resolved.select(key, F.posexplode(column).alias("pos", "value")).join(values, "value")
    ids = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    return resolved.select(key).join(ids, key, "left").select(key, F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def text_coverage(resolved: DataFrame) -> DataFrame:
    """Sources, those with labels and texts, distinct labels and texts, and sources with several of either."""
    has = lambda c, n: F.count(F.when(F.size(c) >= n, 1))
    counts = resolved.agg(F.count("*").alias("sources"), has("labels", 1).alias("labelled"), has("texts", 1).alias("with_text"), F.count(F.when((F.size("labels") > 1) | (F.size("texts") > 1), 1)).alias("several"))
    distinct = lambda c: resolved.select(F.explode(c).alias("v")).agg(F.countDistinct("v").alias(f"distinct_{c}"))
    return counts.crossJoin(distinct("labels")).crossJoin(distinct("texts"))


def text_table(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strings (kind, id, value), source_strings (rel_path, kind, ids))."""
    strings = sources = None
    for column, kind in (("labels", "label"), ("texts", "text")):
        values = dictionary(resolved, column)
        s = values.select(F.lit(kind).alias("kind"), "id", "value")
        r = encode_ids(resolved, column, values).select("rel_path", F.lit(kind).alias("kind"), "ids")
        strings, sources = (s, r) if strings is None else (strings.unionByName(s), sources.unionByName(r))
    return strings, sources


def write_text_table(resolved: DataFrame, path: str) -> tuple[int, int]:
    """The versions below ``path`` that hold the two tables of ``resolved``. What has not changed is not written again."""
    out = []
    for rows, table in zip(text_table(resolved), text_tables(resolved.sparkSession, path), strict=True):
        out.append(table.write(staged(rows, "text-table")))
    return tuple(out)


def text_tables(spark: SparkSession, path: str) -> tuple[VersionedTable, VersionedTable]:
    return VersionedTable(spark, f"{path}/strings", "kind string, id long, value string", "value"), VersionedTable(spark, f"{path}/sources", "rel_path string, kind string, ids array<long>", "rel_path")


def pick_string(ids: Column, idx: Column, split: Column, seed: int, epoch: int = 0) -> Column:
    """The id for a clip: null if there is none; val and test go round; train draws by a seeded hash each epoch."""
    n = F.size(ids)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), idx), n)
    at = F.when(split == "train", draw).otherwise(F.pmod(idx, n)).cast("int")
    return F.when(n > 0, F.get(ids, at))

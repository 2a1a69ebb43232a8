"""Sidecar tables: CSV files of differing columns, read as lines and put together to records by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.functions.ranking import dense_index
from chunkline.sources.storage import staged

#: Header names (trimmed, case-folded) of sidecar tables.
FILE_NAMES, LABEL_NAMES, TEXT_NAMES = ("file", "filename", "file_name"), ("label", "class"), ("text", "description", "caption")


def _quotes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def csv_records(spark: SparkSession, root: str) -> DataFrame:
    """(path, record, text) of the CSV files below ``root``, records numbered from 0 in each file.

    A line begins a record if the quotes before it in its file are even. Lines are counted in the part of a file that
    a task reads, for both cases; sums over the parts tell which holds and where a part's records begin. So a file may
    be split over many tasks, and no text of a whole file is built.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    part = Window.partitionBy("path", "block").orderBy("at")
    before = F.coalesce(F.sum(_quotes(F.col("line"))).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = staged(lines.withColumn("before", before), "csv-lines")
    starts = lambda odd: F.count(F.when(F.col("before") % 2 == odd, 1))
    parts = lines.groupBy("path", "block").agg(F.sum(_quotes(F.col("line"))).alias("quotes"), starts(0).alias("even"), starts(1).alias("odd"))
    # a row for each part of a file
    of = Window.partitionBy("path").orderBy("block")
    parts = parts.withColumn("odd_in", F.coalesce(F.sum("quotes").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    own = F.when(F.col("odd_in") == 1, F.col("odd")).otherwise(F.col("even"))
    parts = parts.select("path", "block", "odd_in", (F.sum(own).over(of) - own).alias("first"))
    d = lines.join(parts, ["path", "block"]).withColumn("new", (F.col("before") % 2 == F.col("odd_in")).cast("int"))
    d = d.withColumn("record", F.col("first") + F.sum("new").over(part) - 1)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n")
    one = d.groupBy("path", "record").agg(F.count("*").alias("n"), whole.alias("text"))
    return one.select("path", "record", "text")


def fields(record: Column) -> Column:
    """The fields of a record; a quoted field may hold commas, line ends and doubled quotes, an empty unquoted one is null."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.rtrim(record, F.lit("\r"))), F.lit(r'(?s),("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = lambda f: F.when(f == "", F.lit(None)).when(F.startswith(f, F.lit('"')), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(found, bare)


def sidecar_scan(spark: SparkSession, root: str) -> DataFrame:
    """(file_pos, row_pos, file, labels, texts) of every usable CSV below ``root``; files in order of their paths, rows as in their file.

    A table is used if it has a file column and a label or text column; the first file column counts, and all
    value columns.
    """
    rows = staged(csv_records(spark, root).select("path", "record", fields(F.col("text")).alias("f")), "sidecar-rows")
    names = F.transform("f", lambda n: F.lower(F.trim(F.ltrim(F.coalesce(n, F.lit("")), F.lit("﻿")))))
    heads = rows.where("record = 0").select("path", names.alias("names"))
    at = lambda known: F.filter(F.transform("names", lambda n, i: F.when(n.isin(*known), i)), lambda i: i.isNotNull())
    heads = dense_index(heads.select("path", F.get(at(FILE_NAMES), F.lit(0)).alias("file_at"), at(LABEL_NAMES).alias("label_at"), at(TEXT_NAMES).alias("text_at")), "path", name="file_pos")
    heads = heads.where(F.col("file_at").isNotNull() & (F.size("label_at") + F.size("text_at") > 0))
    d = rows.where((F.col("record") > 0) & (F.size(F.array_compact("f")) > 0)).join(heads, "path")
    pick = lambda c: F.array_compact(F.transform(c, lambda i: F.get("f", i)))
    return d.select("file_pos", F.col("record").alias("row_pos"), F.get("f", F.col("file_at")).alias("file"), pick("label_at").alias("labels"), pick("text_at").alias("texts"))

"""Small tables with everything odd in them."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

LONG = "the quick brown fox jumps over lazy dogs and counts to " + " ".join(f"number{i}" for i in range(30_000))
#: Columns that operators use themselves.
CLASH = ("id", "key", "ctx", "h", "n", "rid", "sig", "band", "node", "comp", "pos", "drop", "kept_text", "n_lines", "score", "lines", "r", "c", "j")
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def docs(spark):
    """doc_id, text and clashing columns: nulls, empty and very long texts, ties, repeated rows."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, LONG), (None, COPY), (6, COPY), (7, COPY + " more"), (7, COPY + " more"), (8, "héllo\x00wörld 你好"), (9, "!!! ???"), (10, "a"), (2**40, COPY.upper() + "\n" + COPY)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for i, name in enumerate(CLASH):
        d = d.withColumn(name, F.lit(f"x{i}"))
    return d


def no_docs(spark):
    return docs(spark).limit(0)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")

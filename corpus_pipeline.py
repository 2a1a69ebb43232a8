"""A training corpus in five stages: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``; columns beyond these are left out. Null
and empty texts, repeated rows and empty tables are handled as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm import bpe, decontaminate, langid, line_dedup, minhash
from chunkline.llm.common import owned_tables, release, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and texts no language gets half the probability of.

    Repeated rows each stay or go.
    """
    docs = docs.select(*COLUMNS)
    return langid.identified(docs, langid.fit(docs.where(~langid.held_out()), langid.default_vocab()))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document that loses all of its lines goes. Null texts stay null; repeated rows each lose theirs."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("n_dropped < n_lines or n_dropped = 0")
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", size.cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Of rows with one id the one with the text that ``near_duplicates`` judged stays, of several with that text the
    least by lang, source and n_chars (nulls first). Null and empty texts are near nothing and stay.
    """
    classes = minhash.near_duplicates(docs.select("doc_id", "text"))
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("first"), "judged").distinct()
    judged = F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("judged")
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("first")) & judged)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    return kept.groupBy("doc_id").agg(F.min(F.struct(*rest, "text")).alias("m")).select("doc_id", "m.*").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, all rows of their ids. Null and empty texts stay."""
    found = decontaminate.find_leaks(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = staged(found.select(F.col("doc_id").alias("leaky")).distinct(), "leaks")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("leaky")), "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digest of the text that they decode to. Null texts have none of either length."""
    done = bpe.encode_documents(docs.select("doc_id", "text"), bpe.default_vocab(), digests=True)
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", leaks),
    ("BPE encoding and decoding", tokens),
]

#: The first, third and last stage can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        # what a stage has staged goes when its rows are written, and then what it has read
        with owned_tables(spark) as own:
            docs = staged(stage(spark, docs, sf_dir), "corpus")
            own.pop()
        if before is not None:
            release(spark, before)
        before = docs
    return docs

"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

``LineRuns`` keeps every line key that has been seen, with the document where it was first met, in sorted runs
in the shared folder. A batch is merge-anti-joined with the runs; the keys that are left are fresh and become a
run of their own. Batches and runs are bucketed and sorted by the key, so these joins neither shuffle nor sort.
When a level has ``fanout`` runs they are compacted into one run of the next level. Batches come in descending
order of doc_id, so the document in which a key is fresh is the largest that holds it; how many documents hold
it is summed over the batches.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm.common import TIDY, new_path, release, setting, sha256_text, staged

BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Keys that may be broadcast are fewer than this.
HOT = 10_000
#: Spark's setting by which bucketed tables with one file a bucket are read in their order.
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


class LineRuns:
    """Runs of (h1, h2, keeper), in which each key stands once, and batches of (h1, h2, n_docs, keeper)."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[str] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row (h1, h2, n_docs, keeper) for each key."""
        self.batches.append(self._sorted(batch, "line_batch"))
        fresh = self.spark.table(self.batches[-1]).select(*KEY, "keeper")
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        self._put(0, fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, _union([self.spark.table(name) for name in full]).repartition(self.buckets, *KEY))
            self._drop(full)
            level += 1

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._sorted(run, f"line_run_{level}"))

    def _sorted(self, rows: DataFrame, kind: str) -> str:
        path = new_path(self.spark, kind)
        name = path.rsplit("/", 1)[1].replace("-", "_")
        # with one file a bucket, as rows dealt by the key give, a scan knows that it is sorted
        with setting(self.spark, TIDY, "true"), setting(self.spark, IN_ORDER, "true"):
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        release(self.spark, *[self.spark.table(name) for name in names])
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self, least: int = 1) -> DataFrame:
        """(h1, h2, n_docs, keeper) of the keys in ``least`` documents or more; gives up the runs."""
        counts = _union([self.spark.table(name).withColumn("keeper", F.lit(None).cast("long")) for name in self.batches])
        first = _union([self.spark.table(name) for name in self.runs()]).select(*KEY, F.lit(0).cast("long").alias("n_docs"), "keeper")
        sums = counts.unionByName(first).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.first("keeper", True).alias("keeper"))
        out = staged(sums.where(F.col("n_docs") >= least), "line-keys")
        self._drop(self.batches + self.runs())
        self.levels, self.batches = [], []
        return out


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def lines_with(marks: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``marks`` whose key is in ``keys``, with its keeper.

    Keys that hold more than a share of 1 in ``HOT`` of what all keys hold, so fewer than ``HOT``, are broadcast;
    the rest, of which none is common, is joined by a shuffle.
    """
    held = keys.agg(F.sum("n_docs")).first()[0] or 0
    common = F.col("n_docs") > held / HOT
    hot, rest = F.broadcast(keys.where(common).select(*KEY, "keeper")), keys.where(~common).select(*KEY, "keeper")
    return marks.join(hot, KEY).unionByName(marks.join(hot.drop("keeper"), KEY, "left_anti").join(rest, KEY))


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added; every row comes back.

    A key (line stripped of blanks, A-Z lower-cased) of at least ``min_chars`` code points in at least
    ``min_docs`` documents loses all its lines except in the largest id that holds it. A null id counts as
    the smallest document. Rows that share an id are one document. A null text is one empty line. An empty
    table gives an empty table. Added names replace columns of the same name.
    """
    spark = docs.sparkSession
    rid, sig = F.coalesce(F.col(id_col), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = F.transform(lines_of(F.col(text_col)), lambda x: line_key(x))
    marks = docs.select(
        rid.alias("rid"),
        sig.alias("sig"),
        F.posexplode(F.transform(keyed, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))).alias("pos", "h"),
    ).where("h is not null")
    cuts = docs.select(F.percentile_approx(rid, F.lit([i / batches for i in range(1, batches)]), 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    step = sum((F.when(F.col("rid") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    marks = staged(marks.select("rid", "sig", "pos", "h.h1", "h.h2", step.alias("batch")), "line-hashes", "batch")

    runs = LineRuns(spark, fanout)
    for b in range(len(cuts), -1, -1):
        per_doc = marks.where(F.col("batch") == b).groupBy(*KEY, "rid").agg(F.lit(1).alias("one"))
        runs.add(per_doc.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("rid").alias("keeper")))
    drops = (
        lines_with(marks.drop("batch"), runs.close(min_docs))
        .where("rid < keeper")
        .groupBy("rid", "sig")
        .agg(F.collect_set("pos").alias("drop"))
    )
    # the rows as structs: their columns may have any names
    rows = docs.select(F.struct(*docs.columns).alias("row"), rid.alias("rid"), sig.alias("sig"))
    joined = rows.join(drops, ["rid", "sig"], "left").withColumn("lines", lines_of(F.col("row")[text_col]))
    lines, gone = F.col("lines"), F.col("drop").isNotNull()
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.when(gone, F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")).otherwise(F.coalesce(F.col("row")[text_col], F.lit("")))
    added = {"kept_text": kept, "n_lines": F.size(lines).cast("long"), "n_dropped": F.when(gone, F.size("drop")).otherwise(0).cast("long")}
    done = joined.select("row", *[c.alias(n) for n, c in added.items()])
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("kept_text")).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, u.pos, u.line,
    translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
    LATERAL (SELECT unnest(a) AS line, unnest(range(len(a))) AS pos) u
), k AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.pos, l.line, k.keeper IS NOT NULL AND l.doc_id < k.keeper AS gone
  FROM l LEFT JOIN k ON l.k = k.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

"""Pairing of arms, influence tables, windows and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def pair_arms(scores: DataFrame, keys: list[str], sample: str = "sample_id", value: str = "score", arms: tuple[str, str] = ("cond", "null")) -> DataFrame:
    """(keys, cond, null, delta, valid, unpaired): means over the samples that both arms have a finite score of."""
    rows = scores.where(_finite(F.col(value)) & F.col("arm").isin(*arms))
    pick = lambda a: F.max(F.when(F.col("arm") == a, F.col(value)))
    per = rows.groupBy(*keys, sample).agg(pick(arms[0]).alias("c"), pick(arms[1]).alias("n"))
    both = F.col("c").isNotNull() & F.col("n").isNotNull()
    out = per.groupBy(*keys).agg(F.avg(F.when(both, F.col("c"))).alias("cond"), F.avg(F.when(both, F.col("n"))).alias("null"), F.count(F.when(both, 1)).alias("valid"), F.count(F.when(~both, 1)).alias("unpaired"))
    return out.select(*keys, "cond", "null", (F.col("cond") - F.col("null")).alias("delta"), "valid", "unpaired")


def single_arm(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """The same columns without a null arm: the mean of all finite scores."""
    out = scores.where((F.col("arm") == "cond") & _finite(F.col(value))).groupBy(*keys).agg(F.avg(value).alias("cond"), F.count("*").alias("valid"))
    none = F.lit(None).cast("double")
    return out.select(*keys, "cond", none.alias("null"), none.alias("delta"), "valid", F.lit(0).cast("long").alias("unpaired"))


def influence_table(scores: DataFrame, keys: list[str], lower_is_better: tuple[str, ...] = (), value: str = "score") -> DataFrame:
    """Pairs with what was attempted, not finite, and which way is better. A key's attempts: samples of the cond arm, else the larger arm."""
    count = lambda a, c=F.lit(True): F.countDistinct(F.when((F.col("arm") == a) & c, F.col("sample_id")))
    seen = scores.groupBy(*keys).agg(count("cond").alias("a_cond"), count("null").alias("a_null"), F.count(F.when((F.col("arm") == "cond") & ~_finite(F.col(value)), 1)).alias("non_finite"))
    seen = seen.select(*keys, F.when(F.col("a_cond") > 0, F.col("a_cond")).otherwise(F.col("a_null")).alias("attempted"), "non_finite")
    better = F.when(F.col(keys[-1]).isin(*lower_is_better), "lower").otherwise("higher") if lower_is_better else F.lit("higher")
    pairs = pair_arms(scores, keys, value=value)
    return seen.join(pairs, keys, "left").withColumn("better", better).fillna(0, ["valid", "unpaired"])


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows in exactly one of two tables."""
    both = a.distinct().withColumn("_a", F.lit(1)).unionByName(b.distinct().withColumn("_a", F.lit(2)))
    names = [c for c in both.columns if c != "_a"]
    return both.groupBy(*names).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


# Labels of subsets (all, only_x, no_x, names joined by +), keywords (all, loo, leave_one_out, singletons,
# each) and labels of windows (number, _, spans a-b joined by +) are those that users of such reports know.
def subset_label(members: list[str], active: list[str]) -> str:
    """``all``, ``only_x``, ``no_x`` for the one that is left out, else the names with ``+`` between."""
    left_out = [a for a in active if a not in members]
    if not left_out:
        return "all"
    if len(members) == 1:
        return f"only_{members[0]}"
    return f"no_{left_out[0]}" if len(left_out) == 1 else "+".join(members)


def condition_subsets(spark: SparkSession, spec: list[str | list[str]], active: list[str]) -> DataFrame:
    """(label, members) for each entry: ``all``, ``loo`` (each left out), ``singletons``, or a list of names.

    Keywords may be in any case, ``leave_one_out`` and ``each`` are ``loo`` and ``singletons``. Empty subsets are
    skipped, and a label counts once.
    """
    words = {"all": [active], "loo": [[b for b in active if b != a] for a in active], "singletons": [[a] for a in active]}
    words |= {"leave_one_out": words["loo"], "each": words["singletons"]}
    out: dict[str, list[str]] = {}
    for entry in spec:
        if isinstance(entry, str) and entry.strip().lower() not in words:
            raise ValueError(f"unknown keyword {entry!r}; there are {sorted(words)} and lists of names")
        if not isinstance(entry, str) and (unknown := [m for m in entry if m not in active]):
            raise ValueError(f"unknown conditions {unknown}; there are {active}")
        for names in words[entry.strip().lower()] if isinstance(entry, str) else [entry]:
            if members := [a for a in active if a in names]:
                one = isinstance(entry, str) and len(names) == 1 and entry.strip().lower() in ("singletons", "each")
                out.setdefault(f"only_{members[0]}" if one else subset_label(members, active), members)
    return spark.createDataFrame([(k, v) for k, v in out.items()], "label string, members array<string>")


def influence_matrix(deltas: DataFrame, subsets: DataFrame, conds: list[str]) -> DataFrame:
    """One row for each subset, one column for each condition: the delta, and whether the condition was given."""
    joined = deltas.join(F.broadcast(subsets), "label")
    wide = joined.groupBy("label", "members").pivot("cond", conds).agg(F.first("delta", ignorenulls=True))
    return wide.select("label", *[F.col(c) for c in conds], *[F.array_contains("members", c).alias(f"{c}_given") for c in conds])


def window_spans(spark: SparkSession, spec: list[list[tuple[float, float]]], frames: int) -> DataFrame:
    """(window, lo, hi) in frames, windows numbered from 1, for spans given as fractions; spans grow, do not overlap and lie in 0..1."""
    rows = []
    for k, spans in enumerate(spec, 1):
        edges = [x for s in spans for x in s]
        if not spans or edges[0] < 0 or edges[-1] > 1 or any(a >= b for a, b in spans) or any(x > y for x, y in zip(edges[1::2], edges[2::2], strict=False)):
            raise ValueError(f"window {k}: spans must grow within 0..1 and not overlap: {spans}")
        name = f"{k}_" + "+".join(f"{a:g}-{b:g}" for a, b in spans)
        rows += [(name, round(a * frames), round(b * frames)) for a, b in spans]
    return spark.createDataFrame(rows, "window string, lo int, hi int")


def sample_spans(clips: DataFrame, frames: int, hop_length: int, codec_rate: int, rate: str = "rate") -> DataFrame:
    """Clips (start in frames, their source's sample rate) with ``lo`` and ``hi`` in samples of the source, halves to even."""
    per_frame = F.lit(hop_length) * F.col(rate) / F.lit(codec_rate)
    at = lambda c: F.rint(c * per_frame).cast("long")
    return clips.withColumn("lo", at(F.col("start"))).withColumn("hi", at(F.col("start") + frames))


def in_windows(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Frames with each window that holds them. The spans are a handful of configured rows."""
    return frames.join(F.broadcast(spans), (F.col("frame") >= F.col("lo")) & (F.col("frame") < F.col("hi"))).drop("lo", "hi")


def examples(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, n, first): the count beside at most ``k`` examples, the smallest values. A window keeps k rows a key before any are gathered."""
    w = Window.partitionBy(*keys).orderBy(value)
    top = rows.select(*keys, value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    first = top.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("first"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(first, keys)


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def long_report(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(part, entry, metric, value) from metric tables: the first column names the entry, numbers are metrics."""
    out = None
    for name, df in parts:
        numbers = [c for c, t in df.dtypes[1:] if t in ("double", "float", "bigint", "int")]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("m")
        rows = df.select(F.lit(name).alias("part"), F.col(df.columns[0]).cast("string").alias("entry"), pairs).select("part", "entry", "m.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object for each row."""
    report.write.mode("overwrite").json(path)

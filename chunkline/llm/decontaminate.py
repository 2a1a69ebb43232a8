"""Benchmark decontamination by template windows. DataFrame functions only.

Numbers, names (capitalised words) and units become typed placeholders, so a question with other numbers or
names has the same template. Windows of ``window`` template tokens are joined by hash. The windows of an item
that are found in a document are parted into occurrences by the place at which the item would begin there.
An occurrence counts when enough of the item's windows are in it and the values in the slots fit together:
within it, each value of the item stands for one value of the document throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.llm.common import staged

#: Unit words, after a number.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi ft in yd l ml s ms h hr hrs min mins sec secs kmh mph usd eur gbp percent "
    "gram grams kilogram kilograms pound pounds ounce ounces meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards "
    "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros degree degrees"
).split()
#: A name token begins with the first mark, a unit with the second, a number with a digit, a plain word with a letter.
NAME, UNIT, LETTERS_FROM = "\u0001", "\u0002", ":"
#: Item windows that are broadcast at once (three numbers each); more are joined in blocks of whole items.
BROADCAST_WINDOWS = 500_000
#: Tokens by which windows of one occurrence may be out of step with each other.
SLACK = 8


def values(text: Column) -> Column:
    """The lower-case tokens of a text, with marks before names and units. The first and last may be empty."""
    t = F.translate(F.coalesce(text, F.lit("")), NAME + UNIT, "  ")
    t = F.regexp_replace(t, r"([0-9])[.,](?=[0-9])", "$1")
    t = F.regexp_replace(t, rf"([0-9])[ -]*((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    t = F.regexp_replace(t, r"([0-9])(?=\p{L})", "$1 ")
    t = F.regexp_replace(t, r"(\p{Lu})(?=\p{Ll})", NAME + "$1")
    return F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}{NAME}{UNIT}]+")


def is_plain(token: Column) -> Column:
    return token >= LETTERS_FROM


def plain_value(token: Column) -> Column:
    return F.translate(token, NAME + UNIT, "")


def typed(token: Column) -> Column:
    """The token of the template."""
    return F.when(is_plain(token), token).when(token < UNIT, NAME).when(token < "\u0003", UNIT).otherwise("0")


def typed_uncapitalised(token: Column) -> Column:
    """The same where a text has its names in another case."""
    return F.when(token.between(NAME, UNIT), plain_value(token)).otherwise(typed(token))


def with_windows(rows: DataFrame, token_form, size: int) -> DataFrame:
    """``w`` added: a hash for each run of ``size`` of ``toks``; none in a shorter text.

    Explode it with an outer explode: of an inner one the optimizer makes a filter that computes all of this again.
    """
    rows = rows.withColumn("w", F.transform("toks", lambda t: F.xxhash64(token_form(t))))
    n = 1
    while n < size:
        # two runs of n tokens, some apart, make a longer run
        step = min(n, size - n)
        cut = lambda at: F.slice("w", at, F.greatest(F.size("w") - step, F.lit(0)))  # noqa: B023, E731
        rows = rows.withColumn("w", F.zip_with(cut(1), cut(1 + step), lambda a, b: F.xxhash64(a, b)))
        n += step
    return rows


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, size, exact, form, ipos, h, vals): an item's windows; ``vals`` has the values of slots and null elsewhere.

    An item's own windows are those with two plain words or more. An item without any (a short one, a table of
    numbers) says too little for a template: it is looked for by its values, in windows of its length at most.
    """
    toks = F.filter("toks", lambda t: t != "")
    items = items.select("item", toks.alias("toks")).where(F.size("toks") > 0)
    at = F.slice("toks", F.col("ipos") + 1, F.col("size"))

    def cut(rows: DataFrame, token_form, size: int, form: int, exact: bool) -> DataFrame:
        kept = lambda t: F.when(~is_plain(t), t) if form == 0 else F.when(~is_plain(t) & ~t.between(NAME, UNIT), t)
        vals = F.transform(at, lambda t: F.lit(None).cast("string")) if exact else F.transform(at, kept)
        rows = with_windows(rows, token_form, size).select("item", "toks", F.posexplode_outer("w").alias("ipos", "h"), F.lit(size).alias("size")).where("h is not null")
        if not exact:
            rows = rows.where(F.size(F.filter(at, is_plain)) >= 2)
        if form:
            rows = rows.where(F.exists(at, lambda t: t.between(NAME, UNIT)))
        return rows.select("item", "size", F.lit(exact).alias("exact"), F.lit(form).alias("form"), "ipos", "h", vals.alias("vals"))

    templates = staged(cut(items, typed, window, 0, False).unionByName(cut(items, typed_uncapitalised, window, 1, False)), "item-templates")
    rest = items.join(templates.select("item").distinct(), "item", "left_anti").withColumn("n", F.least(F.size("toks"), F.lit(window)))
    for size in sorted(r["n"] for r in rest.select("n").distinct().collect()):  # up to ``window`` numbers
        templates = templates.unionByName(cut(rest.where(F.col("n") == size), plain_value, size, 0, True))
    return staged(templates, "item-windows")


def find_leaks(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(id_col, item_col, n_windows, n_found, containment) of each document that holds an item.

    ``containment`` is the share of the item's windows that one occurrence has with fitting slots. Null and
    empty texts hold nothing and are held nowhere. Repeated rows (one id and text, or one item and text) count
    once; rows of one id and several texts are looked at one by one. A null id comes back as null. Empty tables
    give an empty table. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(item_text), F.lit(""))
    item = items.select(F.struct(F.col(item_col).alias("id"), F.xxhash64(text).alias("sig")).alias("item"), values(text).alias("toks")).distinct()
    item = item_windows(item, window)
    total = item.groupBy("item").agg(F.countDistinct("ipos").alias("n_windows"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("sig")).alias("row"), values(text).alias("toks"))
    met = None
    kinds = item.groupBy("size", "exact").agg(F.count("*").alias("n")).orderBy("exact", "size").collect()
    for k in kinds:
        probe = with_windows(doc, plain_value if k["exact"] else typed, k["size"]).select("row", "toks", F.posexplode_outer("w").alias("dpos", "h"))
        blocks = -(-k["n"] // BROADCAST_WINDOWS)
        for b in range(blocks):
            block = item.where((F.col("size") == k["size"]) & (F.col("exact") == k["exact"]) & (F.pmod(F.xxhash64("item"), F.lit(blocks)) == b))
            found = probe.join(F.broadcast(block.select("item", "form", "ipos", "h")), "h")
            found = found.select("row", "item", "form", "ipos", "dpos", F.slice("toks", F.col("dpos") + 1, k["size"]).alias("dvals"))
            met = found if met is None else met.unionByName(found)
    if met is None:  # no item has a token
        kinds = {id_col: docs.schema[id_col].dataType, item_col: items.schema[item_col].dataType}
        shape = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds.items())
        return docs.sparkSession.createDataFrame([], f"{shape}, n_windows long, n_found long, containment double")

    pair = Window.partitionBy("row", "item")
    in_order = pair.orderBy("start", "dpos")
    met = staged(met, "met-windows").distinct().join(total, "item").withColumn("start", F.col("dpos") - F.col("ipos"))
    met = met.withColumn("n", F.size(F.collect_set("ipos").over(pair))).where(F.col("n") >= similarity * F.col("n_windows") - 1e-9)
    slack = F.least(F.lit(SLACK), F.col("n_windows"))
    met = met.withColumn("new", F.coalesce(F.col("start") - F.lag("start").over(in_order) > slack, F.lit(True)).cast("int"))
    met = met.withColumn("occ", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.join(item.select("item", "form", "ipos", "vals"), ["item", "form", "ipos"])
    slots = F.filter(F.arrays_zip(F.col("vals").alias("a"), F.col("dvals").alias("b")), lambda z: z["a"].isNotNull())
    met = staged(met.select("row", "item", "occ", "n_windows", "ipos", slots.alias("slots")), "occurrences")
    # the value that an item's value stands for in an occurrence: the one met most often
    key = ["row", "item", "occ"]
    pairs = met.select(*key, F.explode("slots").alias("s")).groupBy(*key, "s").agg(F.count("*").alias("n"))
    usual = pairs.groupBy(*key, F.col("s.a").alias("a")).agg(F.max(F.struct("n", F.col("s.b").alias("b"))).alias("m"))
    usual = usual.groupBy(*key).agg(F.collect_list(F.struct("a", "m.b")).alias("usual"))
    fits = F.size(F.array_except("slots", F.coalesce("usual", F.array().cast("array<struct<a:string,b:string>>")))) == 0
    counted = met.join(usual, key, "left").where(fits).groupBy(*key, "n_windows").agg(F.countDistinct("ipos").alias("n_found"))
    out = counted.groupBy("row", "item", "n_windows").agg(F.max("n_found").alias("n_found"))
    out = out.withColumn("containment", F.col("n_found") / F.col("n_windows")).where(F.col("n_found") >= similarity * F.col("n_windows") - 1e-9)
    out = out.select("row.id", F.col("item.id").alias("item"), "n_windows", "n_found", "containment")
    best = F.max(F.struct("containment", "n_windows", "n_found")).alias("m")
    out = out.groupBy("id", "item").agg(best)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "m.n_windows", "m.n_found", "m.containment")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_leaks(docs, items)

"""Per-class banks of items and their vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.functions.ranking import hash_rank
from chunkline.functions.series import dot
from chunkline.functions.text import hash_decile_split
from chunkline.sources.storage import staged


def bank_positions(bank: DataFrame) -> DataFrame:
    """Adds ``pos`` by file name in each class. A bank is the pictures of one class."""
    return bank.withColumn("pos", F.row_number().over(Window.partitionBy("class_name").orderBy("file_name")) - 1)


def pick_bank_item(clips: DataFrame, bank: DataFrame) -> DataFrame:
    """Clips (class_name, split, idx) with ``file_name``: idx goes round the split's share of the bank, or the whole bank if that is empty.

    ``whole`` tells the latter; a class without a bank gets null.
    """
    # each item by its place in the bank and in its split's share, so that a clip meets one row and not a list
    split = hash_decile_split(F.col("file_name"))
    in_bank, in_share = ["class_name"], ["class_name", "split"]
    items = bank.select("class_name", "file_name", split.alias("split"))
    placed = lambda keys: items.select(*keys, "file_name", (F.row_number().over(Window.partitionBy(*keys).orderBy("file_name")) - 1).cast("long").alias("place"))
    n = items.groupBy(*in_bank).agg(F.count("*").alias("n_bank"))
    n_share = items.groupBy(*in_share).agg(F.count("*").alias("n_share"))
    d = clips.join(n, in_bank, "left").join(n_share, in_share, "left")
    d = d.withColumn("place", F.pmod(F.col("idx").cast("long"), F.coalesce("n_share", "n_bank"))).withColumn("whole", F.col("n_share").isNull() & F.col("n_bank").isNotNull())
    share = d.where(~F.col("whole")).join(placed(in_share), [*in_share, "place"], "left")
    every = d.where("whole").join(placed(in_bank), [*in_bank, "place"], "left")
    return share.select(*clips.columns, "file_name", "whole").unionByName(every.select(*clips.columns, "file_name", "whole"))


def distinct_items(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class_name, pos, u) of items unlike all earlier ones of their bank, (class_name, pos, repeats) of the others).

    ``u`` is the unit vector, null for a zero vector.
    """
    b = bank_positions(bank).select("class_name", "pos", "embedding")
    first = b.withColumn("first", F.min("pos").over(Window.partitionBy("class_name", "embedding")))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    unit = F.when(norm > 0, F.transform("embedding", lambda x: x.cast("double") / F.col("norm")))
    items = first.where("pos = first").withColumn("norm", norm).select("class_name", "pos", unit.alias("u"))
    return items, first.where("pos <> first").select("class_name", "pos", F.col("first").alias("repeats"))


#: Pivots of a bank, width of a ring round a pivot (radians), items of a tile.
PIVOTS, RING, TILE = 8, 0.1, 1024
BEST = "class_name {kind}, pos int, other int, cos double"


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.least(dot(a, b), F.lit(1.0)), F.lit(-1.0)))


def tiles(items: DataFrame, pivots: int = PIVOTS, ring: float = RING, size: int = TILE) -> DataFrame:
    """(class_name, tile, pos, u, away): items dealt to tiles by their nearest pivot and the ring round it; ``away`` are the angles to all pivots.

    A ring with more than about ``size`` items is cut into several tiles.
    """
    drawn = [F.min_by("u", F.xxhash64(F.lit(j), "pos")) for j in range(pivots)]
    chosen = items.groupBy("class_name").agg(F.array(*drawn).alias("pivots"))
    d = items.join(chosen, "class_name").withColumn("away", F.transform("pivots", lambda p: angle(F.col("u"), p)))
    least = F.array_min("away")
    d = d.select("class_name", "pos", "u", "away", F.array_position("away", least).alias("at"), F.floor(least / ring).alias("ring"))
    cell = ["class_name", "at", "ring"]
    cuts = d.groupBy(*cell).agg(F.ceil(F.count("*") / size).alias("cuts"))
    return d.join(cuts, cell).select("class_name", F.xxhash64("at", "ring", F.pmod(F.xxhash64("pos"), F.col("cuts"))).alias("tile"), "pos", "u", "away")


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows["u"].combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, -1)


def _best(rows: pa.Table, others: pa.Table, cos: np.ndarray) -> pa.Table:
    at = cos.argmax(1)
    return pa.table({"class_name": rows["class_name"], "pos": rows["pos"], "other": others["pos"].take(pa.array(at)), "cos": cos[np.arange(len(at)), at]})


def nearest_within(tiled: DataFrame, *keys: str) -> DataFrame:
    """(class_name, pos, other, cos): the most alike item of the same tile, for items that are not alone in theirs."""

    def search(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("pos")
        u = _matrix(tile)
        cos = u @ u.T
        np.fill_diagonal(cos, -np.inf)
        return _best(tile, tile, cos) if len(u) > 1 else _best(tile, tile, cos).slice(0, 0)

    kind = tiled.schema["class_name"].dataType.simpleString()
    return tiled.select(*keys, "pos", "u").groupBy(*keys).applyInArrow(search, BEST.format(kind=kind))


def nearest_across(tiled: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same between the tiles of each pair (class_name, a, b), for the items of both."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("pos"), right.sort_by("pos")
        cos = _matrix(left) @ _matrix(right).T
        return pa.concat_tables([_best(left, right, cos), _best(right, left, cos.T)])

    key = ["class_name", "a", "b"]

    def side(c: str):
        met = tiled.select("class_name", F.col("tile").alias(c), "pos", "u").join(pairs, ["class_name", c])
        # under names of its own, since both sides come from one table
        return met.select(*[F.col(x).alias(x) for x in (*key, "pos", "u")]).groupBy(*key)

    kind = tiled.schema["class_name"].dataType.simpleString()
    return side("a").cogroup(side("b")).applyInArrow(search, BEST.format(kind=kind))


def open_pairs(tiled: DataFrame, found: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(class_name, a, b): pairs of tiles that may hold an item nearer than the nearest found so far.

    By the triangle inequality two items are at least as far apart as their angles to any pivot differ.
    """
    r = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0)))
    far = tiled.join(found.select("class_name", "pos", r.alias("r")), ["class_name", "pos"], "left")
    lo, hi = (F.array(*[f(F.get("away", F.lit(j))) for j in range(pivots)]) for f in (F.min, F.max))
    of = staged(far.groupBy("class_name", "tile").agg(F.max(F.coalesce("r", F.lit(math.pi))).alias("r"), lo.alias("lo"), hi.alias("hi")), "bank-tile-bounds")
    named = lambda d, t: d.select("class_name", F.col("tile").alias(t), *[F.col(c).alias(f"{c}_{t}") for c in ("r", "lo", "hi")])
    # over a pivot, any item of another tile is within the sum of the two largest angles to it
    over = F.array_min(F.zip_with("hi_a", "hi_b", lambda p, q: p + q))
    other = named(of, "a").join(named(of, "b"), "class_name").where("a <> b").groupBy("class_name", F.col("a").alias("tile")).agg(F.min(over).alias("over"))
    of = of.join(other, ["class_name", "tile"], "left").withColumn("r", F.least("r", "over"))
    gap = lambda x, y: F.array_max(F.zip_with(f"lo_{x}", f"hi_{y}", lambda p, q: p - q))
    pairs = named(of, "a").join(named(of, "b"), "class_name").where("a < b")
    # rounding must not close a pair
    return pairs.where(F.greatest(gap("a", "b"), gap("b", "a")) <= F.greatest("r_a", "r_b") + 1e-7).select("class_name", "a", "b")


def nearest_items(items: DataFrame, pivots: int = PIVOTS, ring: float = RING, size: int = TILE) -> DataFrame:
    """(class_name, pos, other, cos): each item's most alike other item of its bank (ties: the smallest pos), exactly.

    ``items``: (class_name, pos, u) as from ``distinct_items``. Items are compared a tile with a tile, first within tiles;
    a pair of tiles is compared only if its pivots leave room for a nearer item. Zero vectors and lone items have none.
    """
    tiled = staged(tiles(items.where("u is not null"), pivots, ring, size), "bank-tiles")
    own = staged(nearest_within(tiled, "class_name", "tile"), "bank-nearest")
    across = nearest_across(tiled, staged(open_pairs(tiled, own, pivots), "bank-tile-pairs"))
    return _nearest(own.unionByName(across))


def _nearest(found: DataFrame) -> DataFrame:
    best = found.groupBy("class_name", "pos").agg(F.max(F.struct("cos", -F.col("other"))).alias("m"))
    return best.select("class_name", "pos", (-F.col("m.col2")).alias("other"), "m.cos")


def nearest_items_roughly(items: DataFrame, *, bands: int = 12, bits: int = 6, seed: int = 1, size: int = TILE) -> DataFrame:
    """The same by random projections: items are compared with those on the same side of ``bits`` random planes, ``bands`` times.

    Approximate: a nearest item that shares no band is missed, and a crowded side is cut into tiles of about ``size``. An item at
    angle t shares a band with probability 1 - (1 - (1 - t / pi) ** bits) ** bands.
    """

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _matrix(pa.Table.from_batches([b])) if b.num_rows else np.zeros((0, 1))
            planes = np.random.default_rng(seed).standard_normal((u.shape[1], bands * bits))
            keys = ((u @ planes > 0).reshape(len(u), bands, bits) @ (1 << np.arange(bits))).astype(np.int64) + (np.arange(bands) << bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*b.schema.names, "sides"])

    kind = items.schema["class_name"].dataType.simpleString()
    keyed = items.where("u is not null").select("class_name", "pos", "u").mapInArrow(sides, f"class_name {kind}, pos int, u array<double>, sides array<long>")
    keyed = staged(keyed.select("class_name", "pos", "u", F.explode("sides").alias("side")), "bank-sides")
    cuts = keyed.groupBy("class_name", "side").agg(F.ceil(F.count("*") / size).alias("cuts"))
    tiled = keyed.join(cuts, ["class_name", "side"]).withColumn("tile", F.xxhash64("side", F.pmod(F.xxhash64("pos"), F.col("cuts"))))
    return _nearest(nearest_within(tiled, "class_name", "tile"))


def bank_spread(bank: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((class_name, pairs, mean, largest, close), (class_name, pos, other, cos), (class_name, pos, repeats)) of banks.

    Cosines of pairs of distinct items, each item's most alike one, and the items equal to an earlier one, which are not
    paired. Zero vectors count as items but have no cosines. The mean comes from the length of the sum of unit
    vectors, without pairs.
    """
    items, repeats = distinct_items(bank)
    items = staged(items, "bank-items")
    nearest = staged(nearest_items(items), "bank-neighbours")
    n = items.groupBy("class_name").agg(F.count("*").alias("k"), F.count("u").alias("m"))
    sums = items.select("class_name", F.posexplode("u").alias("i", "x")).groupBy("class_name", "i").agg(F.sum("x").alias("x"))
    square = sums.groupBy("class_name").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    top = nearest.groupBy("class_name").agg(F.max("cos").alias("largest"))
    mean = F.when(F.col("m") > 1, (F.col("square") - F.col("m")) / (F.col("m") * (F.col("m") - 1)))
    spread = n.where("k > 1").join(square, "class_name", "left").join(top, "class_name", "left")
    pairs = F.floor(F.col("k") * (F.col("k") - 1) / 2).cast("long")
    spread = spread.select("class_name", pairs.alias("pairs"), mean.alias("mean"), "largest", (F.col("largest") > 0.95).alias("close"))
    return spread, nearest, repeats


def classes_without_bank(classes: DataFrame, folders: DataFrame, bank: DataFrame) -> DataFrame:
    """(class_name, reason): missing (no bank folder), empty (a folder without items); classes with a bank are not listed."""
    have = bank.select("class_name").distinct()
    f = folders.select("class_name").distinct().withColumn("_f", F.lit(1))
    rest = classes.select("class_name").distinct().join(have, "class_name", "left_anti").join(f, "class_name", "left")
    return rest.select("class_name", F.when(F.col("_f").isNull(), "missing").otherwise("empty").alias("reason"))


def refresh_plan(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(class_name, action) from recorded (class_name, files, n) and current (class_name, file_name).

    reuse: same files and as many rows; keep: the folder is gone; encode: all others.
    """
    now = current.groupBy("class_name").agg(F.array_sort(F.collect_list("file_name")).alias("now"))
    same = F.col("files").eqNullSafe(F.col("now")) & (F.col("n") == F.size("now"))
    action = F.when(F.col("now").isNull(), "keep").when(same, "reuse").otherwise("encode")
    return recorded.join(now, "class_name", "full_outer").select("class_name", F.coalesce(action, F.lit("encode")).alias("action"))


def fixed_subset(bank: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` items of each bank by a seeded hash, the same every time."""
    ranked = hash_rank(bank, ["class_name"], F.sha1(F.concat(F.lit(f"{seed}:"), "file_name")), "file_name")
    return ranked.where(F.col("rank") <= n).drop("rank", "bucket_n")


def cycle_to_n(values: DataFrame, n: int) -> DataFrame:
    """``n`` rows going round ``values`` (idx 0..k-1, ...); k is taken from a count."""
    spark = values.sparkSession
    k = values.agg(F.count("*").alias("k"))
    rows = spark.range(n).select(F.col("id").alias("i")).crossJoin(F.broadcast(k)).select("i", F.when(F.col("k") > 0, F.col("i") % F.col("k")).alias("idx"))
    return rows.join(values, "idx")

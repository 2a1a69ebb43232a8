"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, and verified multiset overlap.

A text is the multiset of its word shingles; the weight of a shingle is its count. Each shingle runs Poisson
processes over dyadic ranges of weight ((0,1], (1,2], (2,4], ...), seeded by its hash alone; a point has a
time, a component of the signature and a level of weight, and counts where the level is within the
shingle's weight. A component keeps its earliest point: two texts agree in a component with the probability
of their weighted Jaccard likeness. Times beyond what a text of that weight needs are never drawn.

Texts with equal multisets are one node. Nodes that share a band are candidates. In each bucket all nodes
are first verified against one leader, the node with the most candidates of its own (in a group of edited
copies, most often the original), then, where a bucket still holds several components, those of other
components against a few drawn members. Where components are left after that, the rest is exact: the nodes of
such buckets meet by their rarest shingles (of two multisets with a likeness of s, each holds one of the
other's rarest ``n - ceil(s n) + 1``), and every such pair of two components is verified. So no pair that shares
a band stays untested, whatever the size of a bucket. Pairs are cut before verification only where
they cannot be alike: by their lengths, and by parity bitmaps of their shingles, in which two texts differ in
at most as many bits as in shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm.common import bits_of, has_bit, in_parts, staged
from chunkline.llm.wordhash import chained, mix, words_hashed

SHINGLE, SIZE, ROWS = 5, 64, 4
#: Members of a bucket that those of other components meet before the exact rest.
DRAWN = 6
#: Nodes that share a rare shingle meet in parts of so many.
DEAL = 1024
#: Words of a parity bitmap.
WORDS = 8


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word shingle; a shorter text with words is one shingle."""
    words, doc = words_hashed(texts)
    n = len(words)
    if not n:
        return words, doc
    first = np.searchsorted(doc, doc, "left")
    last = np.searchsorted(doc, doc, "right") - 1
    at = np.flatnonzero((np.arange(n) + size - 1 <= last) | ((np.arange(n) == first) & (last - first + 1 < size)))
    parts = [np.where(at + k <= last[at], words[np.minimum(at + k, n - 1)], 0) for k in range(size)]
    return chained(parts), doc[at]


def counted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, hash) with their counts."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    return d[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def bag_minhash(doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """(n_docs, size) signatures of uint64; a text without elements gets zeros."""
    weight = np.bincount(doc, counts, minlength=n_docs)
    sig = np.zeros((n_docs, size), np.uint64)
    todo, reach = weight > 0, np.log(size) + 4
    while todo.any():
        sel = np.flatnonzero(todo[doc])
        # one process for each element and dyadic range below its count
        steps = 1 + np.ceil(np.log2(np.maximum(counts[sel], 1))).astype(np.int64)
        el = np.repeat(sel, steps)
        j = np.arange(len(el)) - np.repeat(np.cumsum(steps) - steps, steps)
        width = np.where(j > 0, 1 << np.maximum(j - 1, 0), 1)
        low = np.where(j > 0, width, 0)
        seed = mix(hashes[el] + mix(j.astype(np.uint64) + np.uint64(77)))
        limit, rate, time = reach / weight[doc[el]], float(size) * width, np.zeros(len(el))
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        k = 0
        while len(el):
            point = mix(seed + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64)))
            time = time - np.log(uniform(point)) / rate
            on = time <= limit
            el, seed, limit, rate, time, width, low, point = (x[on] for x in (el, seed, limit, rate, time, width, low, point))
            draw = mix(point ^ np.uint64(0xD1B54A32D192ED03))
            level = low + 1 + ((draw >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)
            ok = level <= counts[el]
            slot = doc[el] * size + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
            kept.append((slot[ok], time[ok], point[ok]))
            k += 1
        slot, at, point = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((at, slot))
        slot, point = slot[order], point[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        got = np.zeros((n_docs, size), np.uint64)
        got.reshape(-1)[slot[first]] = point[first]
        filled = np.bincount(slot[first] // size, minlength=n_docs) == size
        sig[todo & filled] = got[todo & filled]
        todo &= ~filled
        reach *= 2
    return sig


def each_counted(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each shingle and its how-manieth occurrence."""
    kth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return (mix(np.repeat(hashes, counts) + kth.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def parity(doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, WORDS) bitmaps of int64: a bit is set where an odd number of a text's elements falls on it."""
    wide = WORDS * 64
    on = np.bincount(np.repeat(doc, counts) * wide + each_counted(hashes, counts) % wide, minlength=n_docs * wide) & 1
    return np.packbits(on.astype(np.uint8).reshape(n_docs, wide), axis=1).view(np.int64)


def signatures(docs: DataFrame, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """(id, h, n, k1, k2, bands) for (id, h, text): shingles, a hash of their multiset in two halves, a hash for each band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in in_parts(batch, batch["text"].str.len().fillna(0)):
                h, doc = shingles(list(b["text"]))
                n = np.bincount(doc, minlength=len(b))
                k1, k2 = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
                np.add.at(k1, doc, mix(h))
                np.add.at(k2, doc, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                sig = bag_minhash(*counted(h, doc), len(b), size)
                bands = np.stack([chained([np.full(len(b), i, np.uint64), *(sig[:, i + r] for r in range(rows))]) for i in range(0, size - rows + 1, rows)], 1).view(np.int64)
                yield pd.DataFrame({"id": b["id"].to_numpy(), "h": b["h"].to_numpy(), "n": n, "k1": k1.view(np.int64), "k2": k2.view(np.int64), "bands": list(bands)})

    return docs.mapInPandas(run, "id long, h long, n long, k1 long, k2 long, bands array<long>")


def elements(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, bits, els) of the wanted (id, k1): a 32-bit hash for each shingle and its how-manieth occurrence.

    A filter of fixed size spares the other texts the work, not the join that decides; no text is shuffled.
    """
    filter_ = docs.sparkSession.sparkContext.broadcast(bits_of(wanted.select(F.col("id").alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.filter(pa.array(has_bit(filter_.value, batch.column("id").to_numpy().view(np.uint64)))).to_pandas()
            for b in in_parts(picked, picked["text"].str.len().fillna(0)):
                h, doc = shingles(list(b["text"]))
                k1 = np.zeros(len(b), np.uint64)
                np.add.at(k1, doc, mix(h))
                d, h, c = counted(h, doc)
                els = np.unique(np.repeat(d, c).astype(np.uint64) << np.uint64(32) | each_counted(h, c).astype(np.uint64))
                n = np.bincount((els >> np.uint64(32)).astype(np.int64), minlength=len(b))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(els.astype(np.uint32).view(np.int32)))
                bits = pa.array(list(parity(d, h, c, len(b))), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(b["id"].to_numpy(np.int64)), pa.array(k1.view(np.int64)), pa.array(n, pa.int64()), bits, lists], ["id", "k1", "n", "bits", "els"])

    made = docs.mapInArrow(run, "id long, k1 long, n long, bits array<long>, els array<int>")
    return made.join(wanted, ["id", "k1"], "left_semi").dropDuplicates(["id"]).drop("k1")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for links (a, b): the smallest node that can be reached, by label passing and jumping."""
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("seen"))
        better = staged(labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("comp", "seen").alias("comp"), F.col("comp").alias("was")), "labels")
        roots = better.select(F.col("node").alias("root"), F.col("comp").alias("top"))
        jumped = staged(better.join(roots, F.col("comp") == F.col("root")).select("node", F.col("top").alias("comp"), "was"), "labels")
        moved = jumped.where("comp <> was").limit(1).count()
        labels = jumped.select("node", "comp")
        if not moved:
            return labels


def may_be_alike(a: str, b: str, similarity: float) -> Column:
    """False only of two rows (n, bits) whose multisets are less alike."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.get(f"{a}bits", F.lit(i)).bitwiseXOR(F.get(f"{b}bits", F.lit(i)))) for i in range(WORDS)), F.lit(0))
    return (F.least(n, m) >= similarity * F.greatest(n, m)) & (apart <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6)


def verified(pairs: DataFrame, els: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets have the likeness, by their elements."""
    a, b = (els.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}{c}") for c in ("n", "bits", "els")]) for x in "ab")
    met = pairs.join(a, "a").join(b, "b").where(may_be_alike("a", "b", similarity))
    both = F.size(F.array_intersect("aels", "bels"))
    return met.withColumn("both", both).where(F.col("both") >= similarity * (F.col("an") + F.col("bn") - F.col("both")) - 1e-9).select("a", "b")


def apart_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of two components that share an ``el`` and can have the likeness.

    ``rows``: (el, node, comp, size, n, bits, early), staged; ``size`` is the component's, and of a pair the shorter must be ``early``.
    The nodes outside the largest component of an ``el`` meet all others; a crowded one is dealt in parts.
    """
    met = rows.groupBy("el").agg(F.count("*").alias("m"), F.max(F.struct("size", "comp")).alias("big"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    met = met.where("lo <> hi").select("el", F.col("big.comp").alias("big"), F.ceil(F.col("m") / DEAL).cast("int").alias("parts"))
    rows = rows.drop("size").join(met, "el")
    some = rows.where("comp <> big").select("el", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.struct("node", "comp", "n", "bits", "early").alias("l"))
    every = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # of two nodes outside the largest component, one order is enough
    apart = (F.col("comp") != F.col("l.comp")) & ((F.col("comp") == F.col("big")) | (F.col("node") < F.col("l.node")))
    early = F.when(F.col("n") < F.col("l.n"), F.col("early")).when(F.col("n") > F.col("l.n"), F.col("l.early")).otherwise(F.col("early") & F.col("l.early"))
    pairs = every.join(some, ["el", "part"]).where(apart & early & may_be_alike("", "l.", similarity))
    return pairs.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def rare_pairs(nodes: DataFrame, els: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of ``nodes`` (node, comp) of two components that can have the likeness, by prefix filter.

    The elements of a node are ordered by the number of nodes that hold them. Those of one node alone only
    take places in its prefix.
    """
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"))
    own = staged(nodes.join(sizes, "comp").join(els.select(F.col("id").alias("node"), "n", "bits", "els"), "node"), "own-elements")
    each = own.select("node", F.explode("els").alias("el"))
    shared = each.groupBy("el").agg(F.count("*").alias("df")).where("df > 1")
    prefix = each.join(shared, "el").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "el"))).alias("rare"))
    # the shorter of two needs even fewer: its share of the overlap that the likeness asks for is larger
    places = lambda share: F.size("rare") - F.ceil(F.col("n") * share - 1e-6).cast("int") + 1
    rows = own.drop("els").join(prefix, "node").where(places(similarity) > 0)
    rows = rows.select("node", "comp", "size", "n", "bits", places(2 * similarity / (1 + similarity)).alias("few"), F.posexplode(F.slice(F.col("rare.el"), F.lit(1), places(similarity))).alias("pos", "el"))
    rows = staged(rows.select("node", "comp", "size", "n", "bits", (F.col("pos") < F.col("few")).alias("early"), "el"), "rare-elements")
    return apart_pairs(rows, similarity)


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, comp) with the components of links (a, b) between nodes made one."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    met = links.join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()
    met = staged(met, "links")
    if not met.limit(1).count():
        return labels
    tops = components(met).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return staged(labels.join(tops, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")


def grouped(banded: DataFrame, wanted: DataFrame, els: DataFrame, similarity: float, verify=verified, by_prefix: bool = False) -> DataFrame:
    """(node, comp) for the nodes of buckets: the components of all pairs in a bucket that have the likeness.

    ``banded``: (node, h), a row for each bucket of a node. ``wanted``: (node, degree), the number of its candidates.
    ``els``: (id, n, bits, els) as of ``elements``. All three are staged.
    ``verify`` returns the pairs (a, b) of its first argument that have the likeness. ``by_prefix``: the buckets are those of
    a prefix filter already, so what is left apart in them needs no other.
    """
    # each node of a bucket against its leader
    ranked = banded.select("node", "h").join(wanted.select("node", "degree"), "node")
    leaders = ranked.groupBy("h").agg(F.min(F.struct((-F.col("degree")).alias("degree"), "node")).alias("top")).select("h", F.col("top.node").alias("b"))
    stars = banded.select(F.col("node").alias("a"), "h").join(leaders, "h").where("a <> b").select("a", "b").distinct()
    labels = joined(wanted.select("node", F.col("node").alias("comp")), verify(stars, els, similarity))

    def of_several(labels: DataFrame) -> DataFrame:
        """(node, h, comp) of the buckets that hold several components."""
        held = banded.select("node", "h").join(labels, "node")
        several = held.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
        return staged(held.join(several, "h"), "open-buckets")

    # the rest of a bucket against a few of its members
    open_ = of_several(labels)
    draw = [F.min(F.struct(F.xxhash64(F.lit(k), "h", "node").alias("x"), "node", "comp")).alias(f"d{k}") for k in range(DRAWN)]
    drawn = open_.groupBy("h").agg(*draw).select("h", F.explode(F.array(*[F.struct(f"d{k}.node", f"d{k}.comp") for k in range(DRAWN)])).alias("d"))
    pairs = open_.join(drawn, "h").where("comp <> d.comp").select(F.least("node", "d.node").alias("a"), F.greatest("node", "d.node").alias("b")).distinct()
    labels = joined(labels, verify(pairs, els, similarity))
    # what may still be alike and apart
    open_ = of_several(labels)
    nodes = staged(open_.select("node", "comp").distinct(), "open-nodes")
    if by_prefix:
        sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"))
        light = staged(nodes.join(sizes, "comp").join(els.select(F.col("id").alias("node"), "n", "bits"), "node"), "open-lengths")
        rest = apart_pairs(open_.select(F.col("h").alias("el"), "node").join(light.withColumn("early", F.lit(True)), "node"), similarity)
    else:
        rest = rare_pairs(nodes, els, similarity)
    return joined(labels, verify(rest, els, similarity))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id_col, class_id, judged) for each row: the smallest id of its class of near-duplicates.

    Null and empty texts (and texts without words) are near nothing: each is a class of its own. Rows that
    share an id are one document (of several texts, that with the least hash of shingles, then of its own); each comes
    back. ``judged`` is the xxhash64 of the text that stands for the id (null texts as empty). A null id
    counts as the smallest and comes back as null. An empty table gives an empty table. Other columns are
    ignored, whatever their names.
    """
    no_id = -(2**63)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(no_id)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    sigs = signatures(docs).groupBy("id").agg(F.count("*").cast("int").alias("rows"), F.min(F.struct("k1", "k2", "n", "h", "bands")).alias("s"))
    sigs = staged(sigs.select("id", "rows", "s.*"), "signatures")
    nodes = sigs.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "bands")).alias("s"))
    nodes = staged(nodes.select("k1", "k2", F.col("s.id").alias("node"), "s.bands"), "nodes")
    banded = nodes.select("node", "k1", F.explode("bands").alias("h"))
    crowds = banded.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    banded = staged(banded.join(crowds, "h"), "shared-bands")
    wanted = banded.groupBy("node").agg(F.min("k1").alias("k1"), F.sum("m").alias("degree"))
    wanted = staged(wanted, "candidates")
    els = staged(elements(docs.drop("h"), wanted.select(F.col("node").alias("id"), "k1")), "elements")

    labels = grouped(banded, wanted, els, similarity)
    out = sigs.select("id", "rows", "h", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left").withColumn("node", F.coalesce("node", "id"))
    out = out.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    value = lambda c: F.when(F.col(c) != no_id, F.col(c))
    out = out.select(value("id").alias(id_col), value("comp").alias("class_id"), F.col("h").alias("judged"), F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("row"))
    return out.drop("row")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id")

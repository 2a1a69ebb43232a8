"""Document fingerprints from spot signatures.

A signature is a common word (the anchor) with the chain of content words that follow it. The multiset of a
text's signatures, as sorted 32-bit hashes in base64, is its fingerprint; they are compared by Jaccard
likeness.

Near pairs: fingerprints are parted by set length so that two that can be alike lie in one part or in
neighbouring parts. In a part they meet by their rarest signatures (of two sets with a likeness of s, each
holds one of the other's rarest ``n - ceil(s n) + 1``). Rounds of one leader a bucket and one pair a node make large
groups one component first; of the components that are left all pairs that meet are taken. Pairs are pruned by their
lengths and by parity bitmaps, and the others are compared by their sets.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm.common import AT_ONCE, TIDY, bits_of, has_bit, in_parts, owned_tables, release, setting, staged
from chunkline.llm.minhash import DEAL, WORDS, joined, may_be_alike, verified
from chunkline.llm.wordhash import chained, mix, word_hash, words_hashed

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and a to in is was it for on with as be by this that are from at or an "
    "le la les de des un une et du en que qui dans pour par sur est au aux avec pas "
    "der die das und ist von mit den dem ein eine zu im für auf sich nicht des "
    "el los las y del una por para con se su lo como al es"
).split()
CHAIN = 2
#: Words between which an anchor looks for its chain, and without a common word for which any word is an anchor.
REACH = 8
#: Signatures are counted by cells of their hash, so many to a cell up to 16 MB of cells; the counts only put signatures in order.
LOAD, SEGMENT, MOST_CELLS = 128, 1 << 14, 1 << 24
#: Rounds in which a node is held against one leader before all pairs of components that are left.
ROUNDS = 2
#: Ranges of ids are as many as shuffle tasks; their cuts (two numbers each) are known to the driver.
MOST_RANGES = 100_000
#: Stands for a null id.
NO_ID = -(2**63)


def anchors() -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in ANCHORS], np.uint64))


def signature_keys(texts: list[str | None], marks: np.ndarray) -> np.ndarray:
    """Sorted distinct (text number << 32 | signature) of all texts."""
    words, doc = words_hashed(texts)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.minimum(np.searchsorted(marks, words), len(marks) - 1)
    common = marks[place] == words
    content, n, all_ = np.flatnonzero(~common), len(words), np.arange(len(words))
    start = np.searchsorted(doc, doc, "left")
    last = np.searchsorted(doc, doc, "right") - 1
    # where common words are wanting (lists, tables), every word is an anchor
    latest = np.concatenate([[-1], np.maximum.accumulate(np.where(common, all_, -1))[:-1]])
    anchor = common | (np.where(latest >= start, all_ - latest, REACH + 1) > REACH)
    at = np.flatnonzero(anchor)
    nxt = np.searchsorted(content, at, "right")
    far = np.concatenate([content, np.full(CHAIN, n + REACH + 1)])[nxt + CHAIN - 1] > np.minimum(at + REACH, last[at])
    # a chain of content words, or of plain words where content words are too far or the text ends
    chain = [np.where(far, np.minimum(at + k + 1, last[at]), np.concatenate([content, np.zeros(CHAIN, np.int64)])[nxt + k]) for k in range(CHAIN)]
    sigs, docs = chained([words[at], *(words[c] for c in chain)]), doc[at]
    # repeated signatures count as often as they stand: the k-th gets a hash of its own
    doc, sig = docs.astype(np.uint64), sigs
    order = np.lexsort((sig, doc))
    doc, sig = doc[order], sig[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])])
    kth = np.arange(len(sig)) - np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
    return np.unique((doc << np.uint64(32)) | (mix(sig + kth.astype(np.uint64)) >> np.uint64(32)))


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard likeness of the sets of text i in ``a`` and ``b``, for i below n. Two empty sets are alike (1)."""
    na, nb = (np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n) for x in (a, b))
    both = np.bincount((np.intersect1d(a, b, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=n)
    return np.where((na == 0) & (nb == 0), 1.0, both / np.maximum(na + nb - both, 1))


def printed(keys: np.ndarray, n: int) -> list[str]:
    cuts = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [base64.b64encode(low[a:z].tobytes()).decode() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) for each row; a text without words has the empty fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = anchors()
        for b in batches:
            for part in in_parts(b, b["text"].str.len().fillna(0)):
                yield pd.DataFrame({"id": part["id"], "fingerprint": printed(signature_keys(list(part["text"]), marks), len(part))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def signature_sets(docs: DataFrame) -> DataFrame:
    """(id, h, n, k1, k2, bits, els) for (id, h, text): the signatures, a hash of their set in two halves, and its parity bitmap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, wide = anchors(), WORDS * 64
        for batch in batches:
            for b in in_parts(batch, batch["text"].str.len().fillna(0)):
                keys = signature_keys(list(b["text"]), marks)
                doc, el = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
                n = np.bincount(doc, minlength=len(b))
                k1, k2 = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
                np.add.at(k1, doc, mix(el))
                np.add.at(k2, doc, mix(el ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                odd = np.bincount(doc * wide + (el % np.uint64(wide)).astype(np.int64), minlength=len(b) * wide) & 1
                bits = np.packbits(odd.astype(np.uint8).reshape(len(b), wide), axis=1).view(np.int64)
                els = np.split(el.astype(np.uint32).view(np.int32), np.cumsum(n)[:-1])
                yield pd.DataFrame({"id": b["id"].to_numpy(), "h": b["h"].to_numpy(), "n": n, "k1": k1.view(np.int64), "k2": k2.view(np.int64), "bits": list(bits), "els": els})

    return docs.select("id", "h", "text").mapInPandas(run, "id long, h long, n long, k1 long, k2 long, bits array<long>, els array<int>")


def cells_for(signatures: int) -> int:
    """Cells of the tally: a power of two that grows with the signatures, from SEGMENT to MOST_CELLS."""
    return min(MOST_CELLS, max(SEGMENT, 1 << (signatures // LOAD).bit_length()))


def tally(sets: DataFrame) -> np.ndarray:
    """A coarse logarithm of the number of signatures in each cell ``hash % cells``, a byte each."""
    cells = cells_for(sets.agg(F.sum("n")).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int32)
        for b in batches:
            at, some = np.unique(b.column("els").flatten().to_numpy().view(np.uint32) & np.uint32(cells - 1), return_counts=True)
            n[at] += some.astype(np.int32)
        parts = n.reshape(-1, SEGMENT)
        held = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in held], pa.binary())], ["at", "n"])

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(SEGMENT, np.int64)
        for x in parts["n"]:
            n += np.frombuffer(zlib.decompress(x), np.int32)
        return pd.DataFrame({"at": parts["at"].iloc[:1], "n": [np.rint(8 * np.log2(n + 1.0)).clip(0, 255).astype(np.uint8).tobytes()]})

    with setting(sets.sparkSession, TIDY, "true"):
        got = sets.select("els").mapInArrow(run, "at int, n binary").groupBy("at").applyInPandas(added, "at int, n binary").toArrow()
    out = np.zeros((cells // SEGMENT, SEGMENT), np.uint8)
    for at, n in zip(got["at"].to_pylist(), got["n"].to_pylist(), strict=True):
        out[at] = np.frombuffer(n, np.uint8)
    return out.reshape(-1)


def prefixes(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(row, n, bits, rare) of sets: ``rare`` are the rarest signatures, one of which a set with the likeness must hold among its own."""
    known = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = np.flatnonzero(np.diff(np.cumsum(batch.column("n").to_numpy()) // AT_ONCE)) + 1
            for i, z in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                b = batch.slice(i, z - i)
                n, el = b.column("n").to_numpy(), b.column("els").flatten().to_numpy()
                cell, doc = known.value[el.view(np.uint32) & np.uint32(len(known.value) - 1)], np.repeat(np.arange(len(n)), n)
                order = np.lexsort((el, cell, doc))
                few = (n - np.ceil(n * similarity - 1e-6) + 1).astype(np.int64).clip(0, n)
                first = np.arange(len(el)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(few, n)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]), pa.int32()), pa.array(el[order][first]))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), b.column("bits"), rare], ["row", "n", "bits", "rare"])

    return sets.select("row", "n", "bits", "els").mapInArrow(run, "row long, n long, bits array<long>, rare array<int>")


def length_part(n: Column, similarity: float) -> Column:
    """Part of a set length: of two lengths with a ratio of ``similarity`` or more, the parts are the same or neighbours."""
    return F.floor(F.log(n.cast("double")) / (float(-np.log(similarity)) * (1 + 1e-9)))


def buckets(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, n, h, early, own, m), staged: the rows of nodes in the buckets where they meet others.

    A bucket is a signature and a part of lengths; a node stands in its own part's and in the next one's. Of two nodes one must
    be ``own``; ``m`` rows are in the bucket. The shorter of two must be ``early``: its share of the overlap that the
    likeness asks for is larger, so even fewer of its signatures will do.
    """
    most = F.col("n") - F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6) + 1
    rare = nodes.select("node", "n", length_part(F.col("n"), similarity).alias("part"), most.alias("most"), F.posexplode("rare").alias("pos", "el"))
    rare = rare.select("node", F.col("n").cast("int").alias("n"), F.col("part").cast("short").alias("part"), (F.col("pos") < F.col("most")).alias("early"), "el")
    # signatures of one node alone go first
    shared = rare.groupBy("el").agg(F.count("*").alias("m")).where("m > 1").select("el")
    rare = staged(rare.join(shared, "el"), "rare-signatures")
    places = F.explode(F.array(F.struct(F.col("part").cast("long").alias("to"), F.lit(True).alias("own")), F.struct((F.col("part") + 1).cast("long").alias("to"), F.lit(False).alias("own"))))
    rows = rare.withColumn("at", places).select("node", "n", (F.col("el") * F.lit(65536).cast("long") + F.col("at.to")).alias("h"), "early", "at.own")
    crowds = rows.groupBy("h").agg(F.count("*").alias("m"), F.max("own").alias("any")).where("m > 1 and any").select("h", "m")
    out = staged(rows.join(crowds, "h"), "shared-signatures")
    release(nodes.sparkSession, rare)
    return out


def can_meet(x: str, y: str, similarity: float) -> Column:
    """Whether two rows of a bucket can be a pair: by component, by lengths, and as ``buckets`` says."""
    c = lambda side, name: F.col(f"{side}{name}")
    n, m = c(x, "n"), c(y, "n")
    early = F.when(n < m, c(x, "early")).when(n > m, c(y, "early")).otherwise(c(x, "early") & c(y, "early"))
    return (c(x, "comp") != c(y, "comp")) & (c(x, "own") | c(y, "own")) & (F.least(n, m) >= similarity * F.greatest(n, m)) & early


def alike(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes with the likeness, staged: by lengths and bitmaps first, then by the sets of those left only.

    A filter of fixed size spares the other sets the shuffle, not the join that decides.
    """
    spark = pairs.sparkSession
    a, b = (nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}{c}") for c in ("n", "bits")]) for x in "ab")
    met = staged(pairs.join(a, "a").join(b, "b").where(may_be_alike("a", "b", similarity)).select("a", "b"), "open-pairs")
    wanted = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = staged(wanted.join(nodes.select("node", "row"), "node"), "open-nodes")
    filter_ = spark.sparkContext.broadcast(bits_of(wanted.select(F.col("node").alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(has_bit(filter_.value, b.column("id").to_numpy().view(np.uint64))))

    picked = sets.select("id", "row", "n", "bits", "els").mapInArrow(run, "id long, row long, n long, bits array<long>, els array<int>")
    els = staged(picked.join(wanted.select("row"), "row", "left_semi").drop("row"), "open-sets")
    filter_.destroy()
    out = staged(verified(met, els, similarity), "near-pairs")
    release(spark, met, wanted, els)
    return out


def rest_pairs(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of two components that meet in a bucket of ``rows`` (node, n, h, early, own, comp) and can be alike.

    The nodes outside the largest component of a bucket meet all others; a crowded one is dealt in parts. Bitmaps are
    folded to two words here: texts differ in no more bits of these.
    """
    fold = [reduce(lambda x, y: x.bitwiseXOR(y), [F.get("bits", F.lit(i)) for i in range(k, WORDS, 2)]).alias(f"f{k}") for k in (0, 1)]
    sizes = rows.select("node", "comp").distinct().groupBy("comp").agg(F.count("*").alias("size"))
    rows = rows.join(sizes, "comp").join(nodes.select("node", *fold), "node")
    met = rows.groupBy("h").agg(F.count("*").alias("m"), F.max(F.struct("size", "comp")).alias("big"))
    met = met.select("h", F.col("big.comp").alias("big"), F.ceil(F.col("m") / DEAL).cast("int").alias("parts"))
    rows = rows.drop("size").join(met, "h")
    some = rows.where("comp <> big").select("h", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("deal"), F.struct("node", "comp", "n", "early", "own", "f0", "f1").alias("l"))
    every = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # of two nodes outside the largest component, one order is enough
    once = (F.col("comp") == F.col("big")) | (F.col("node") < F.col("l.node"))
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"l.{f}"))) for f in ("f0", "f1")), F.lit(0))
    near = apart <= (F.col("n") + F.col("l.n")) * (1 - similarity) / (1 + similarity) + 1e-6
    pairs = every.join(some, ["h", "deal"]).where(once & can_meet("", "l.", similarity) & near)
    return pairs.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def near_groups(rows: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, comp): the components of all pairs that meet in a bucket and have the likeness.

    In each of ROUNDS rounds a bucket has one leader, and a node is held against one only, the one that leads most of its buckets:
    so many copies of one text become one component by a pair each. First the nodes with the most candidates lead, later nodes
    drawn by a hash. Then all pairs of components that are left in a bucket are compared.
    """
    degrees = staged(rows.groupBy("node").agg(F.sum("m").alias("weight")), "candidates")
    labels, weights = degrees.select("node", F.col("node").alias("comp")), degrees

    def still_open(rows: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
        """The rows of the buckets that hold several components, with their component and the bucket's leader ``l``."""
        held = rows.select("node", "n", "h", "early", "own").join(labels.join(weights, "node"), "node")
        lead = held.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("weight", "node", "comp", "n", "early", "own")).alias("l"))
        return staged(held.drop("weight").join(lead.where("lo <> hi").select("h", "l"), "h"), "open-buckets")

    for k in range(ROUNDS):
        rows = still_open(rows, labels, weights)
        led = rows.where(can_meet("", "l.", similarity)).groupBy(F.col("node").alias("a"), F.col("l.node").alias("b")).agg(F.count("*").alias("m"))
        best = led.groupBy("a").agg(F.max(F.struct("m", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
        pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = joined(labels, alike(pairs, nodes, sets, similarity))
        weights = degrees.select("node", F.xxhash64(F.lit(k), "node").alias("weight"))
    rows = still_open(rows, labels, weights).drop("l")
    return joined(labels, alike(rest_pairs(rows, nodes, similarity), nodes, sets, similarity))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(key, h, class_key): class of each text, the smallest id that near pairs of fingerprints lead to.

    ``key`` is the id and ``h`` the xxhash64 of the text (null as empty); there is one row for each distinct
    (id, text). Rows that share an id are one document: its class is found with the text of least ``h``. Texts
    without signatures are near nothing. A null id counts as the smallest and is NO_ID here. An empty table gives
    an empty table. Other columns are ignored, whatever their names. ``similarity`` is above 0 and below 1.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    with owned_tables(docs.sparkSession) as own:
        sets = staged(signature_sets(docs).withColumn("row", F.monotonically_increasing_id()), "signature-sets")
        firsts = staged(sets.groupBy("id").agg(F.min(F.struct("h", "row", "k1", "k2", "n")).alias("s")).select("id", "s.*"), "first-texts")
        names = staged(firsts.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "row")).alias("s")).select("k1", "k2", F.col("s.id").alias("node"), "s.row"), "set-nodes")
        nodes = staged(prefixes(sets, tally(sets), similarity).join(names.select("node", "row"), "row"), "node-prefixes")
        labels = near_groups(buckets(nodes, similarity), nodes, sets, similarity)
        out = firsts.select("id", "k1", "k2").join(names.drop("row"), ["k1", "k2"], "left").select("id", F.coalesce("node", "id").alias("node")).join(labels, "node", "left")
        out = sets.select("id", "h").distinct().join(out, "id").select(F.col("id").alias("key"), "h", F.coalesce("comp", "node").alias("class_key"))
        out = staged(out, "near-classes")
        own.pop()
    return out


def id_cuts(rows: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The least (key, h) of each of about ``ranges`` ranges of rows."""
    dealt = rows.select("key", "h").repartitionByRange(ranges, "key", "h")
    with setting(rows.sparkSession, TIDY, "true"):
        least = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "h")).alias("m")).select("m.*").orderBy("key", "h").toArrow()
    return least["key"].to_numpy(), least["h"].to_numpy()


def range_of(cuts: tuple[np.ndarray, np.ndarray], key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (key, h) the number of the range that holds it, and whether it is that range's least."""
    keys, hs = cuts
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    at = low - 1
    # rows of an id that cuts fall on lie on either side by their texts
    for i in np.unique(low[low < high]):
        on = np.flatnonzero((low == i) & (low < high))
        at[on] = i + np.searchsorted(hs[i : high[on[0]]], h[on], "right") - 1
    held = np.maximum(at, 0)
    return held, (keys[held] == key) & (hs[held] == h)


def with_next(docs: DataFrame, classes: DataFrame, *, rows_per_range: int = 1000) -> DataFrame:
    """(key, text, class_key, tail) dealt by ranges of doc_id and sorted, for work on neighbours in id order.

    Each partition is a range. The first row of a range is also sent, with ``tail`` 1, to
    the end of the range before it (that of the first range to the last): every row with ``tail`` 0 is
    followed by its successor. Equal ids are ordered by a hash of their texts; a null id comes first.
    ``classes`` (key, h, class_key) go the same way, so texts are shuffled once: a row of theirs, with a null text, stands
    before the texts that it is for.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"), F.lit(0).cast("long").alias("class_key"))
    ranges = max(1, min(MOST_RANGES, docs.count() // rows_per_range))
    known = docs.sparkSession.sparkContext.broadcast(id_cuts(docs, ranges))

    @F.pandas_udf("to int, first boolean")
    def placed(key: pd.Series, h: pd.Series) -> pd.DataFrame:
        to, first = range_of(known.value, key.to_numpy(), h.to_numpy())
        return pd.DataFrame({"to": to, "first": first})

    n = max(1, len(known.value[0]))
    rows = docs.unionByName(classes.select("key", "h", F.lit(None).cast("string").alias("text"), "class_key"))
    rows = rows.withColumn("at", placed("key", "h"))
    here = F.struct(F.col("at.to").alias("to"), F.lit(0).alias("tail"))
    before = F.struct(F.pmod(F.col("at.to") - 1, F.lit(n)).alias("to"), F.lit(1).alias("tail"))
    sent = F.when(F.col("at.first") & F.col("text").isNotNull(), F.array(here, before)).otherwise(F.array(here))
    rows = rows.select("key", "h", "text", "class_key", F.inline(sent))
    return rows.repartitionById(n, "to").sortWithinPartitions("to", "tail", "key", "h", F.col("text").isNotNull()).select("key", "text", "class_key", "tail")


def known_ids(keys: pd.Series) -> pd.Series:
    return keys.astype("Int64").mask(keys == NO_ID)


def compare_edited(docs: DataFrame, *, similarity: float = 0.8, rows_per_range: int = 1000) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, their likeness, and the text's class.

    The edited text has the last quarter of the code points (rounded down) replaced by as many from the
    start of the next document in id order (all, if that is shorter; after the last comes the first). Null
    texts are empty. ``class_id`` is the smallest id that pairs with a likeness of ``similarity`` lead to; rows of one id
    are one class, a null id counts as the smallest and comes back as null. Repeated rows each come back, and follow each
    other. An empty table gives an empty table; a single document is its own successor. Other columns are ignored,
    whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, held, last = anchors(), None, NO_ID
        for b in batches:
            # the class of a text stands before it
            of_class = b["text"].isna().to_numpy()
            at = np.maximum.accumulate(np.where(of_class, np.arange(1, len(b) + 1), 0))
            known = np.concatenate([[last], b["class_key"].to_numpy(np.int64)])[at]
            b = b.assign(class_key=known)[~of_class]
            last = known[-1] if len(known) else last
            if b.empty:
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            held = b.iloc[-1:]
            for at in in_parts(pd.DataFrame({"i": np.arange(len(b) - 1)}), b["text"].str.len().iloc[:-1]):
                i, z = int(at["i"].iloc[0]), int(at["i"].iloc[-1]) + 1
                texts, own = list(b["text"].iloc[i : z + 1]), b["tail"].to_numpy()[i:z] == 0
                n = z - i
                edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts[:-1], texts[1:], strict=True)]
                keys, edits = signature_keys(texts, marks), signature_keys(edited, marks)
                one = np.uint64(1) << np.uint64(32)
                mine, following = keys[: np.searchsorted(keys, np.uint64(n) << np.uint64(32))], keys[np.searchsorted(keys, one) :] - one
                yield pd.DataFrame({
                    "doc_id": known_ids(b["key"].iloc[i:z]), "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                    "fingerprint": printed(mine, n), "edited_fingerprint": printed(edits, n), "near_edited": likeness(mine, edits, n), "near_next": likeness(mine, following, n),
                    "class_id": known_ids(b["class_key"].iloc[i:z]),
                })[own]

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = with_next(docs, near_classes(docs, similarity=similarity), rows_per_range=rows_per_range)
    return dealt.mapInPandas(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

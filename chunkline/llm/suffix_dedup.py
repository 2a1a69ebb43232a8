"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are only told apart through their first ``length`` bytes, by passes over one digit at a time; a
group that lies in one document drops out after each pass, and the groups equal in all digits are exactly
the repeated strings. To sort runs of neighbouring suffixes together, a string's first digit is not taken
at its start but at its minimizer (the 16 bytes with the least hash, leftmost of equals), which equal
strings share at the same place: one row stands for all strings with that minimizer (its context).

1. digit: the 16 bytes; groups in one document drop out.
2. digit: whole contexts; copies of a context are settled at once, by the least document that holds it.
   Of contexts that differ, two can only share a string if they share 17 bytes left or right of the first
   digit; the others drop out.
3. digit: runs of 46 bytes, each common to five neighbouring strings of a remaining context.
4. digit: the strings of ``length`` bytes of the runs that are left, one by one.

Digits are compared by hashes. Where a digit only spares work (the first, the sides and the runs) 64 bits are
enough, since a meeting by chance or design only leaves more rows to the next digit. What settles a string is
compared by 128 bits: equal contexts by 48 bits of the first digit's hash and 80 of hashes of all their bytes with
multipliers drawn anew for each run, equal strings of the last digit by two hashes with different seeds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm.common import bits_of, has_bit, release, staged
from chunkline.llm.wordhash import mix

DIGIT, STEP = 16, 5
#: Bytes that are worked on at once.
SEGMENT = 1 << 17
#: Parts in which the spans are gathered.
SLICES = 3
NO_ID = -(2**63)


def words_at(part: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number."""
    return np.ndarray((len(part) - 7,), "<u8", np.ascontiguousarray(part), strides=(1,)).copy()


def digits(words: np.ndarray) -> np.ndarray:
    """A hash of the DIGIT bytes from each place."""
    h = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8:]
    return mix(h * np.uint64(0xBF58476D1CE4E5B9))


def least_of(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` values in a row."""
    out, size, n = h, 1, len(h) - w + 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[w - size : w - size + n])


def slice_digest(words: np.ndarray, at: np.ndarray, size: np.ndarray, shape: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``size`` bytes (8 or more) from each place and of ``shape``, by four drawn numbers."""
    last = at + size - 8
    (s1, m1), (s2, m2) = seeds.reshape(2, 2) | np.array([0, 1], np.uint64)
    h1, h2 = mix(shape.astype(np.uint64) + s1), mix(shape.astype(np.uint64) + s2)
    for k in range(0, int(size.max(initial=0)), 8):
        # each step is one to one in the word; past the end the last word comes again
        w = words[np.minimum(at + k, last)]
        for h, m in ((h1, m1), (h2, m2)):
            h ^= w
            h *= m
            h ^= h >> np.uint64(32)
    return mix(h1 ^ s1), mix(h2 ^ s2)


def contexts(buf: np.ndarray, begin: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, key, start, n, offset, place, words): strings start .. start+n-1 of a text share a first digit at start+offset.

    ``words`` has the 8 bytes from each place of a segment, ``place`` that of the start.

    Text i is ``buf[begin[i] : begin[i + 1]]``. The bytes are cut into segments; a string belongs to the
    segment of its start.
    """
    w = length - DIGIT + 1
    for a in range(int(begin[0]), int(begin[-1]) - length + 1, SEGMENT):
        part = buf[a : min(a + SEGMENT + length - 1, int(begin[-1]))]
        words = words_at(part)
        h = digits(words)
        least = least_of(h, w)
        n = len(least)
        # a run of strings ends where the least hash changes, and with its text
        texts = begin[np.searchsorted(begin, a) : np.searchsorted(begin, a + n)] - a
        lo = np.unique(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, texts]))
        doc = np.searchsorted(begin, a + lo, "right") - 1
        hi = np.minimum(np.append(lo[1:], n) - 1, begin[doc + 1] - length - a)
        lo, hi, doc = (x[hi >= lo] for x in (lo, hi, doc))
        off = (sliding_window_view(h, w)[lo] == least[lo][:, None]).argmax(1)
        # equal hashes within a window: the leftmost holds until it is left behind
        tied = np.flatnonzero(hi > lo + off)
        if len(tied):
            more = []
            for i in tied:
                at = lo[i] + np.flatnonzero(h[lo[i] : hi[i] + w] == least[lo[i]])
                first = np.concatenate([[lo[i]], at[:-1] + 1])
                last = np.minimum(at, hi[i])
                keep = first <= last
                more.append((first[keep], last[keep], np.full(keep.sum(), doc[i]), (at - first)[keep]))
            rest = np.ones(len(lo), bool)
            rest[tied] = False
            lo, hi, doc, off = (np.concatenate([x[rest], *m]) for x, m in zip((lo, hi, doc, off), zip(*more, strict=True), strict=True))
        if len(lo):
            yield doc, h[lo + off], lo + a - begin[doc], hi - lo + 1, off, lo, words


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts, and where each begins (null texts are empty)."""
    if column.null_count:
        column = column.fill_null("")
    offsets, data = column.buffers()[1:]
    begin = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), begin


def _met_again(rows: DataFrame) -> DataFrame:
    """The rows (c1, c2, h, ...) whose h occurs in several contexts."""
    twice = rows.groupBy("h").agg(*[f(c).alias(f"{n}{c}") for c in ("c1", "c2") for f, n in ((F.min, "a"), (F.max, "z"))]).where("ac1 <> zc1 or ac2 <> zc2").select("h")
    return rows.join(twice, "h").drop("h")


def span(start: Column, end: Column) -> Column:
    """[start, end) in one number that sorts by the start."""
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(end.cast("long"))


def removed_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """(id, sig, spans: array of start << 32 | end, in bytes) of what a string of ``length`` bytes that also starts in a smaller id covers.

    ``docs``: (id, sig, text); sig tells texts of one id apart.
    """
    spark, ctx = docs.sparkSession, ["c1", "c2"]
    seeds = np.random.SeedSequence().generate_state(4, np.uint64)

    def kept(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
        """Written; the tables that are done with go."""
        out = staged(df, name)
        release(spark, *done)
        return out

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for doc, key, *_ in contexts(*text_bytes(b.column("text")), length):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc])], ["key", "id"])

    # 1. digit
    met = docs.mapInArrow(keys, "key long, id long").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    met = kept(met.select("key"), "digits")
    wanted_bits = spark.sparkContext.broadcast(bits_of(met))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sigs = b.column("id").to_numpy(), b.column("sig").to_numpy()
            for *found, words in contexts(*text_bytes(b.column("text")), length):
                on = has_bit(wanted_bits.value, found[1])
                doc, key, lo, n, off, at = (x[on] for x in found)
                shape = n << 8 | off
                whole = slice_digest(words, at, n + (length - 1), shape, seeds)
                # start, shape and 16 bits of the first hash in one number
                place = lo.astype(np.uint64) << np.uint64(32) | shape.astype(np.uint64) << np.uint64(16) | whole[0] >> np.uint64(48)
                columns = [ids[doc], sigs[doc], *(x.view(np.int64) for x in (key, whole[1], place))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "sig", "key", "c2", "place"])

    low = lambda c, bits: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    c1 = F.col("key").bitwiseAND(F.lit(-1 << 16)).bitwiseOR(low("place", 16))
    shape = F.shiftrightunsigned("place", 16).bitwiseAND(F.lit((1 << 16) - 1)).cast("int")
    rows = docs.mapInArrow(find, "id long, sig long, key long, c2 long, place long").join(met, "key")
    rows = rows.select("id", "sig", c1.alias("c1"), "c2", F.shiftrightunsigned("place", 32).cast("int").alias("lo"), shape.alias("shape"))
    rows = kept(rows, "shared-digits", met)
    # 2. digit
    # both go by the same comparisons, so they are of one row
    first = [F.min("id").alias("id"), F.min_by("sig", "id").alias("sig"), F.min_by("lo", "id").alias("lo")]
    held = rows.groupBy(*ctx).agg(*first, F.min("shape").alias("shape"), F.count("*").alias("m"))
    held = kept(held.withColumn("key", F.shiftright("c1", 16)), "contexts")
    several = held.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    n, off = F.shiftright(F.col("shape").cast("int"), 8), F.col("shape").cast("int").bitwiseAND(F.lit(255))
    wanted = held.join(several, "key").groupBy("id", "sig").agg(F.collect_list(F.struct(*ctx, "lo", n.alias("n"), off.alias("off"))).alias("c"))
    wanted = kept(wanted, "wanted-contexts")
    whole = docs.join(wanted, ["id", "sig"]).select("id", "sig", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), "c")
    # rows of one id and text give their contexts once each
    cut = whole.select("id", "text", F.inline("c")).select("id", *ctx, "n", "off", F.substring("text", F.col("lo") + 1, F.col("n") + (length - 1)).alias("data"))
    bytes_ = kept(cut, "context-bytes", wanted)
    side = (length - DIGIT) // 2
    digit = F.substring("data", F.col("off") + 1, F.lit(DIGIT))
    reach = F.length("data") - F.col("off") - DIGIT
    left = F.when(F.col("off") >= side, F.xxhash64(digit, F.lit("l"), F.substring("data", F.col("off") - (side - 1), F.lit(side))))
    right = F.when(reach >= side, F.xxhash64(digit, F.lit("r"), F.substring("data", F.col("off") + (DIGIT + 1), F.lit(side))))
    open_ = kept(_met_again(bytes_.select(*ctx, F.explode(F.array_compact(F.array(left, right))).alias("h"))).distinct(), "open-keys")
    near = kept(bytes_.join(open_, ctx).dropDuplicates(ctx), "open-contexts", bytes_, open_)
    # 3. digit: strings whose offsets lie in one run of STEP share all but STEP - 1 of their bytes
    first, last = F.greatest(F.ceil((F.col("off") - F.col("n") + 2 - STEP) / STEP), F.lit(0)).cast("int"), F.floor(F.col("off") / STEP).cast("int")
    cores = near.select(*ctx, "data", "off", F.explode(F.sequence(first, last)).alias("k"))
    cores = cores.select(*ctx, "k", F.xxhash64("k", F.substring("data", F.col("off") - F.col("k") * STEP + 1, F.lit(length - STEP + 1))).alias("h"))
    runs = near.join(_met_again(cores).groupBy(*ctx).agg(F.collect_set("k").alias("ks")), ctx)
    # 4. digit: the strings
    strings = runs.select(*ctx, "id", "data", "off", "n", F.explode("ks").alias("k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(STEP - 1))))
    strings = strings.withColumn("j", F.col("off") - F.col("k") * STEP - F.col("i")).where("j >= 0 and j < n")
    text = F.substring("data", F.col("j") + 1, F.lit(length))
    strings = kept(strings.select(*ctx, "id", "j", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")), "strings", near)
    equal = strings.groupBy("h1", "h2").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("h1", "h2", "a")
    equal = kept(equal, "equal-strings")
    later = strings.join(equal, ["h1", "h2"]).where("a < id").groupBy(*ctx).agg(F.collect_list("j").alias("js"))
    later = kept(later, "later-strings", strings, equal)
    # contexts that take something away
    verdict = held.join(later, ctx, "left").where("m > 1 or js is not null").select(*ctx, F.col("id").alias("least"), "js")
    verdict = kept(verdict, "verdicts", held, later)
    # a slice of the keys at a time, so that the shuffle files of one slice are on disk
    parts = []
    for k in range(SLICES):
        mine = F.pmod("c1", F.lit(SLICES)) == k
        found = rows.where(mine).join(verdict.where(mine), ctx).where("id > least or js is not null")
        lo = F.col("lo")
        all_ = F.array(span(lo, lo + n + (length - 1)))
        some = F.transform("js", lambda j: span(lo + j, lo + j + length))  # noqa: B023
        spans = found.select("id", "sig", F.explode(F.when(F.col("id") > F.col("least"), all_).otherwise(some)).alias("span"))
        parts.append(kept(spans.groupBy("id", "sig").agg(F.collect_list("span").alias("spans")), "spans"))
    release(spark, rows, verdict)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("id", "sig").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans cover."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.minimum(np.maximum.accumulate(spans & ((1 << 32) - 1)), size)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(spans) else np.zeros(0, np.int64)
    return start[new], end[np.append(new[1:], len(spans)) - 1] if len(new) else end


def dedup_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, digests: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept) for each row; ``digests`` gives kept_sha256 in place of the kept bytes.

    Null texts are empty. A null id counts as the smallest. Rows that share an id do not repeat each other;
    each loses what smaller ids hold. An empty table gives an empty table. Other columns are ignored, whatever
    their names. ``length`` is 32 to 100 bytes.
    """
    if not 2 * DIGIT <= length <= 100:
        raise ValueError(f"length: {length}")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    sig = F.xxhash64(F.coalesce(text, F.lit("")))
    picked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), sig.alias("sig"), text.alias("text"))
    spans = removed_spans(picked, length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, begin = text_bytes(b.column("text"))
            lists = b.column("spans").fill_null([])
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            count = []
            kept = []
            for i in range(b.num_rows):
                data = buf[begin[i] : begin[i + 1]]
                start, end = merged(values[ends[i] : ends[i + 1]], len(data))
                if len(start):
                    cuts = np.stack([np.append(0, end), np.append(start, len(data))], 1)
                    data = b"".join(data[a:z].tobytes() for a, z in cuts)
                else:
                    data = data.tobytes()
                count.append((begin[i + 1] - begin[i], begin[i + 1] - begin[i] - len(data), len(start)))
                kept.append(hashlib.sha256(data).hexdigest() if digests else data)
            numbers = np.array(count, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(numbers[:, k].copy()) for k in range(3)), pa.array(kept, pa.string() if digests else pa.binary())], names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"]
    done = picked.join(spans, ["id", "sig"], "left").select("id", "text", "spans")
    done = done.mapInArrow(remove, f"id long, n_bytes long, n_removed long, n_spans long, {names[-1]} {'string' if digests else 'binary'}")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias(id_col), *names[1:])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)

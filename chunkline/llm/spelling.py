"""Spelling variants by a trie of letter counts.

A word is known by its length and by how many letters it has of each of 16 groups. Words are arranged in a trie by
these counts, one group after the other. Words that differ by one inserted, deleted or replaced letter have counts
that differ by one surplus and one deficit at most, so a depth-first search that may spend one of each meets all
near words; the words at its leaves are verified letter by letter.

The upper levels of the trie are Spark keys: a node is (length, depth, counts so far), four levels deeper each
time it holds more than ``limit`` words. A word is sent to the nodes that it can reach with its budget; the levels
below are searched in the tasks, for many words and nodes at once. Each pair is found once: from the longer
word, or, of words of one length, from the one with the smaller counts (of equal ones the smaller word).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm.common import release, slices, staged

#: Letters of the groups in the order of the levels; the other letters are in the last two, by their code points.
GROUPS = ("e", "nr", "at", "is", "o", "hl", "du", "cm", "gp", "bf", "vy", "kw", "xj", "qz")
LEVELS, STEP, MOST = 16, 4, 15
#: Words in a node of the trie that is not divided further, and visitors that a task takes for one node.
LIMIT, VISITORS = 4000, 100_000
#: Rows that a task works on at once, and words that search the trie together.
ROWS, TOGETHER = 150_000, 20_000
#: Letters up to which words are verified as one matrix.
WIDTH = 48

GROUP_OF = np.where(np.arange(256) % 2 == 0, LEVELS - 2, LEVELS - 1).astype(np.uint8)
for _g, _letters in enumerate(GROUPS):
    GROUP_OF[[ord(c) for c in _letters]] = _g


# words


def runs_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct runs, number of the run at each place, number of its row) of the lower-cased texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), "[^a-zÀ-ÿ]+")
    coded = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return coded.dictionary, coded.indices.to_numpy(), row


def crc_of_each(row: np.ndarray, word: np.ndarray, prefixes: list[bytes], words: list[bytes]) -> np.ndarray:
    """crc32 of prefix + word for each place: that of the prefix carried on over the word's length, xor that of the word."""
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    start = [zlib.crc32(p) for p in prefixes]
    pairs, at = np.unique(row.astype(np.int64) << 32 | size[word], return_inverse=True)
    carried = np.array([zlib.crc32(z := bytes(int(p & 0xFFFFFFFF)), start[p >> 32]) ^ zlib.crc32(z) for p in pairs], np.uint32)
    return carried[at] ^ own[word]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5) -> DataFrame:
    """(word, n): runs of letters, lower-cased; a run whose crc32 with its document's id is divisible by ``every`` loses a letter.

    Null texts have no words. A null id is written as nothing before the colon.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 4_000_000):
                words, at, row = runs_of(b)
                letters = np.asarray(pc.utf8_length(words), np.int64)
                kept = letters[at] >= shortest
                at, row = at[kept], row[kept]
                if not len(at):
                    continue
                used, at = np.unique(at, return_inverse=True)
                words = words.take(pa.array(used))
                texts = words.to_pylist()
                prefixes = [b"" if i is None else b"%d" % i for i in b.column("id").to_pylist()]
                h = crc_of_each(row, at, [p + b":" for p in prefixes], [w.encode() for w in texts])
                cut = h % every == 0
                n = np.bincount(at[~cut], minlength=len(texts))
                changed: dict[str, int] = {}
                for i, k in zip(at[cut].tolist(), h[cut].tolist(), strict=True):
                    w = texts[i]
                    k %= len(w)
                    w = w[:k] + w[k + 1 :]
                    if len(w) >= shortest:
                        changed[w] = changed.get(w, 0) + 1
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some])], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# counts of letters


def letter_matrix(words: list[str]) -> np.ndarray:
    """The letters of words of at most WIDTH letters (0 after the end); longer words are cut."""
    return np.array([w[:WIDTH].encode("latin-1") for w in words], f"S{WIDTH}").view(np.uint8).reshape(len(words), WIDTH)


def packed_counts(words: list[str]) -> np.ndarray:
    """Counts by group in four bits each, the first level highest; 15 stands for 15 or more."""
    m = letter_matrix(words)
    group = np.where(m > 0, GROUP_OF[m], 255)
    out = np.zeros(len(words), np.uint64)
    counts = np.stack([(group == g).sum(1) for g in range(LEVELS)], 1) if len(words) else np.zeros((0, LEVELS), int)
    for i, w in enumerate(words):
        if len(w) > WIDTH:
            counts[i] = np.bincount(GROUP_OF[np.frombuffer(w.encode("latin-1"), np.uint8)], minlength=LEVELS)
    for g in range(LEVELS):
        out |= np.minimum(counts[:, g], MOST).astype(np.uint64) << np.uint64(4 * (LEVELS - 1 - g))
    return out


def with_counts(words: DataFrame) -> DataFrame:
    """(word, n, len, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = packed_counts(b.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pc.utf8_length(b.column("word")), pa.array(vec.view(np.int64))], ["word", "n", "len", "vec"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, len int, vec long")


#: Changes of four successive counts: (surplus at, deficit at), None for none.
CHANGES = [(None, None), *((i, None) for i in range(STEP)), *((None, j) for j in range(STEP)), *((i, j) for i in range(STEP) for j in range(STEP) if i != j)]


def reached(same: np.ndarray, vec: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the nodes four levels below ``node`` (at ``depth``) that words with counts ``vec`` reach.

    ``same``: the node has words of the same length, else of one letter less.
    """
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(64 - 4 * depth) if depth else np.uint64(0)
    own = vec & keep
    more, less = np.zeros(len(vec), bool), np.zeros(len(vec), bool)
    for g in range(depth):
        at = np.uint64(4 * (LEVELS - 1 - g))
        a, b = (own >> at) & np.uint64(15), (node >> at) & np.uint64(15)
        more |= b > a
        less |= b < a
    rows, nodes = [], []
    level = vec & ~keep & (np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(64 - 4 * depth - 4 * STEP) if depth + STEP < LEVELS else np.uint64(0xFFFFFFFFFFFFFFFF))
    for up, down in CHANGES:
        ok = np.ones(len(vec), bool)
        child = node | level
        if up is not None:
            at = np.uint64(4 * (LEVELS - 1 - depth - up))
            # of one length, the first difference is a surplus
            ok &= same & ~more & ~less & ((level >> at) & np.uint64(15) < MOST)
            child = child + (np.uint64(1) << at)
        if down is not None:
            at = np.uint64(4 * (LEVELS - 1 - depth - down))
            ok &= ~less & ((level >> at) & np.uint64(15) > 0)
            ok &= ~same | more if up is None else np.full(len(vec), up < down)
            child = child - (np.uint64(1) << at)
        at = np.flatnonzero(ok)
        rows.append(at)
        nodes.append(child[at])
    return np.concatenate(rows), np.concatenate(nodes)


def sent_on(visits: DataFrame, depth: int) -> DataFrame:
    """``visits`` (tlen, node, len, vec, ...) at nodes of ``depth``, sent to the nodes below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, node = (b.column(c).to_numpy().view(np.uint64) for c in ("vec", "node"))
            row, below = reached(b.column("tlen").to_numpy() == b.column("len").to_numpy(), vec, node, depth)
            for a in range(0, len(row), 100_000):
                part = b.take(pa.array(row[a : a + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(below[a : a + 100_000].view(np.int64)) if n == "node" else c for n, c in zip(part.schema.names, part.columns, strict=True)], part.schema.names)

    return visits.mapInArrow(run, visits.schema)


# the search within nodes


def near_counts(node_of_word: np.ndarray, word_vec: np.ndarray, node_of_visit: np.ndarray, visit_vec: np.ndarray, same: np.ndarray, n_nodes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visit, word) of all words in the node of a visit that its budget reaches, for TOGETHER visits at a time."""
    order = np.lexsort((word_vec, node_of_word))
    vec, at = word_vec[order], node_of_word[order].astype(np.int64)
    children, n = [], n_nodes
    for g in range(LEVELS):
        key = at * 16 + ((vec >> np.uint64(4 * (LEVELS - 1 - g))) & np.uint64(15)).astype(np.int64)
        there, at = np.unique(key, return_inverse=True)
        child = np.full(n * 16, -1, np.int32)
        child[there] = np.arange(len(there))
        children.append(child)
        n = len(there)
    first = np.searchsorted(at, np.arange(n + 1))
    for a in range(0, len(visit_vec), TOGETHER):
        who = np.arange(a, min(a + TOGETHER, len(visit_vec)))
        here = node_of_visit[who].astype(np.int64)
        more, less = np.zeros(len(who), bool), np.zeros(len(who), bool)
        for g in range(LEVELS):
            count = ((visit_vec[who] >> np.uint64(4 * (LEVELS - 1 - g))) & np.uint64(15)).astype(np.int64)
            steps = []
            for change in (0, 1, -1):
                if change > 0:
                    ok = same[who] & ~more & ~less & (count < MOST)
                elif change < 0:
                    ok = ~less & (count > 0) & (~same[who] | more)
                else:
                    ok = np.ones(len(who), bool)
                i = np.flatnonzero(ok)
                below = children[g][here[i] * 16 + count[i] + change]
                i, below = i[below >= 0], below[below >= 0]
                steps.append((who[i], below, more[i] | (change > 0), less[i] | (change < 0)))
            who, here, more, less = (np.concatenate(x) for x in zip(*steps, strict=True))
            here = here.astype(np.int64)
        size = first[here + 1] - first[here]
        visit = np.repeat(who, size)
        place = np.repeat(first[here] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        yield visit, order[place]


def one_edit(a: str, b: str) -> bool:
    """a differs from b by one replaced letter, or has one more."""
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:])


def verified(words: list[str], others: list[str], m: np.ndarray, w: np.ndarray, visit: np.ndarray, word: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether words[visit] and others[word] are one edit apart; m and w are their letters."""
    out = np.zeros(len(visit), bool)
    for a in range(0, len(visit), 200_000):
        v, x = visit[a : a + 200_000], word[a : a + 200_000]
        equal = m[v] == w[x]
        one = (~equal).sum(1) == 1
        shifted = np.concatenate([m[v][:, 1:], np.zeros((len(v), 1), np.uint8)], 1) == w[x]
        # letters before the first difference are in place, those from it on are one later
        before = np.where(equal.all(1), WIDTH, (~equal).argmax(1))
        after = np.where(shifted.all(1), 0, WIDTH - (~shifted)[:, ::-1].argmax(1))
        out[a : a + 200_000] = np.where(same[v], one, after <= before)
    for i in np.flatnonzero([len(words[v]) >= WIDTH for v in visit.tolist()] if m.shape[0] and max(map(len, words)) >= WIDTH else []):
        out[i] = one_edit(words[visit[i]], others[word[i]])
    return out


def pairs_in(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near pairs of the nodes in ``rows`` (whole nodes, sorted), each in both directions."""
    keys = [rows.column(c).to_numpy() for c in ("tlen", "depth", "node", "side", "salt")]
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    node = np.cumsum(new) - 1
    visits, held = np.flatnonzero(rows.column("visit").to_numpy() == 1), np.flatnonzero(rows.column("visit").to_numpy() == 0)
    if not len(visits) or not len(held):
        return
    vec = rows.column("vec").to_numpy().view(np.uint64)
    v, w = rows.take(pa.array(visits)), rows.take(pa.array(held))
    texts, others = v.column("word").to_pylist(), w.column("word").to_pylist()
    m, o = letter_matrix(texts), letter_matrix(others)
    same = v.column("tlen").to_numpy() == v.column("len").to_numpy()
    tail = v.column("side").to_numpy() == 2
    for a, b in near_counts(node[held], vec[held], node[visits], vec[visits], same, int(node[-1]) + 1):
        ok = verified(texts, others, m, o, a, b, same)
        a, b = a[ok], b[ok]
        # equal counts: once, from the smaller word; equal in both halves: once, by the first
        once = [(not same[i] or vec[visits[i]] != vec[held[j]] or texts[i] < others[j]) and not (tail[i] and texts[i][: len(others[j]) // 2] == others[j][: len(others[j]) // 2]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        a, b = pa.array(a[once]), pa.array(b[once])
        x, y = v.select(["word", "n"]).take(a).combine_chunks(), w.select(["word", "n"]).take(b).combine_chunks()
        both = pa.table({"word": pa.chunked_array([*x["word"].chunks, *y["word"].chunks], pa.string()), "other": pa.chunked_array([*y["word"].chunks, *x["word"].chunks], pa.string()), "other_n": pa.chunked_array([*y["n"].chunks, *x["n"].chunks], pa.int64())})
        yield from both.combine_chunks().to_batches(max_chunksize=100_000)


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes whole nodes from sorted batches, about ROWS rows at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < ROWS:
            continue
        rows = pa.Table.from_batches(held)
        key = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in ("tlen", "depth", "node", "side", "salt")], ["a", "b", "c", "d", "e"])
        last = rows.num_rows - 1
        differs = np.zeros(rows.num_rows, bool)
        for c in range(5):
            col = key.field(c).to_numpy()
            differs |= col != col[last]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield from pairs_in(rows.slice(0, cut))
        held = rows.slice(cut).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield from pairs_in(pa.Table.from_batches(held))


NODE = ["tlen", "depth", "node", "side"]


def near_pairs(words: DataFrame, *, limit: int = LIMIT, visitors: int = VISITORS) -> tuple[DataFrame, list[DataFrame]]:
    """((word, other, other_n) of all words one edit apart, in both directions, the tables that this reads).

    ``words``: (word, n, len, vec), distinct and staged.
    """
    index = words.select("word", "n", "len", "vec", F.col("len").alias("tlen"))
    visits = words.select("word", "n", "len", "vec", F.explode(F.array("len", F.col("len") - 1)).alias("tlen"), F.lit(0).cast("long").alias("node"))
    parts, used = [], []

    def placed(df: DataFrame, depth: int, side, visit: int) -> DataFrame:
        return df.select("tlen", F.lit(depth).alias("depth"), "node", side.alias("side"), F.lit(visit).alias("visit"), "word", "n", "len", "vec")

    for depth in range(0, LEVELS + 1, STEP):
        mask = -1 << (64 - 4 * depth) if depth else 0
        index = index.drop("node").withColumn("node", F.col("vec").bitwiseAND(F.lit(mask if depth < LEVELS else -1).cast("long")))
        if depth:
            visits = sent_on(visits, depth - STEP)
        sizes = staged(index.groupBy("tlen", "node").agg(F.count("*").alias("words")), "trie-nodes")
        used.append(sizes)
        large = sizes.where(F.col("words") > limit).select("tlen", "node", F.lit(True).alias("large"))
        none = large.isEmpty()
        known = (lambda df: df.withColumn("large", F.lit(False))) if none else (lambda df: df.join(large, ["tlen", "node"], "left").withColumn("large", F.coalesce("large", F.lit(False))))  # noqa: B023
        index, visits = known(index), known(visits)
        n = F.lit(0)
        parts += [placed(index.where(~F.col("large")), depth, n, 0), placed(visits.where(~F.col("large")), depth, n, 1)]
        if none:
            break
        index, visits = index.where("large").drop("large"), visits.where("large").drop("large")
    else:
        # words with equal counts: an edit leaves the first or the second half as it is
        half = F.floor(F.col("tlen") / 2).cast("int")
        sides = F.inline(F.array(F.struct(F.lit(1).alias("side"), F.xxhash64("node", F.substring("word", F.lit(1), half)).alias("part")), F.struct(F.lit(2).alias("side"), F.xxhash64("node", F.substring("word", F.length("word") - half + 1, half)).alias("part"))))
        for df, visit in ((index, 0), (visits, 1)):
            df = df.select("tlen", "word", "n", "len", "vec", "node", sides).drop("node").withColumnRenamed("part", "node")
            parts.append(placed(df, LEVELS + 1, F.col("side"), visit))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # nodes with very many visitors are dealt over several tasks, their words to each
    rows = staged(rows, "trie-rows")
    release(words.sparkSession, *used)
    hot = rows.where("visit = 1").groupBy(*NODE).agg(F.ceil(F.count("*") / visitors).cast("int").alias("salts")).where("salts > 1")
    hot, dealt = staged(hot, "trie-hot"), rows
    rows = rows.join(hot, NODE, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.when(F.col("visit") == 1, F.array(F.pmod(F.xxhash64("word"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    rows = rows.select(*NODE, F.explode(salt).alias("salt"), "visit", "word", "n", "len", "vec")
    rows = rows.repartition(*NODE, "salt").sortWithinPartitions(*NODE, "salt", "visit")
    return rows.mapInArrow(search, "word string, other string, other_n long"), [dealt, hot]


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, at_least: int = 3, times: int = 2, limit: int = LIMIT, visitors: int = VISITORS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs``.

    Words have ``shortest`` letters and ``at_least`` places or more. A word's form is the near word with the largest
    n (ties: the smallest word), if that is at least ``times`` (2 or more) its own n; root follows forms to the last.
    Null and empty texts have no words; a repeated row counts again; ids may be null (see ``word_counts``). Empty
    tables give an empty table. Other columns are ignored, whatever their names.
    """
    if times < 2:
        raise ValueError(f"times: {times}")
    spark = docs.sparkSession
    counted = word_counts(docs, id_col=id_col, text_col=text_col, every=every, shortest=shortest).where(F.col("n") >= at_least)
    words = staged(with_counts(counted), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other"))
    pairs, read = near_pairs(words, limit=limit, visitors=visitors)
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.select("word", "n").join(near, "word", "left")
    has = -F.col("best.m") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"))
    found = staged(found, "forms")
    release(spark, words, *read)
    # from the roots down: a form is near its words, so few words have one form. n doubles on the way, so ways are short
    level = found.where("form is null").select("word", F.col("word").alias("root"))
    links, done = found.where("form is not null").select("word", "form"), [level]
    while True:
        level = staged(links.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "roots")
        if level.isEmpty():
            break
        done.append(level)
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return found.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: crc32 of ``s``, bit by bit.
CRC_SQL = """list_reduce(flatten([[4294967295::BIGINT], flatten([[b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN s])]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"""

OP11_SQL = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
many AS (SELECT doc_id, w, count(*) AS n, encode(concat(doc_id, ':', w)) AS s FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, w, n, [('0x' || substr(hex(s), (2 * i - 1)::INT, 2))::INT FOR i IN range(1, octet_length(s) + 1)] AS s FROM many),
hashed AS (SELECT w, n, xor(CRC, 4294967295) AS h FROM bytes),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (SELECT DISTINCT * FROM (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, o := other)) AS b FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.m >= 2 * w.n THEN b.o END AS form, CASE WHEN -b.m >= 2 * w.n THEN -b.m END::BIGINT AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, k.root FROM forms f JOIN walk k ON f.form = k.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN walk USING (word)""".replace("CRC", CRC_SQL)

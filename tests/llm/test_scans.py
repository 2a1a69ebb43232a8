"""Spelling variants, license scans and the Merkle manifest: odd tables, hot groups, brute force."""

import hashlib
import random
import re
import zlib

import pytest
from compare import compare
from pyspark.sql import functions as F

from chunkline.llm import licenses, merkle, spelling
from llm_edge import SF, docs, no_docs, table

# 11


def variants_by_force(rows, every=97):
    count = {}
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] = count.get(w, 0) + 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and spelling.one_edit(*sorted((w, x), key=len, reverse=True))] for w in words}
    form = {w: min((x for x in near[w]), key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def found_variants(df, **options):
    return sorted((tuple(r) for r in spelling.spelling_variants(df, **options).collect()))


def by_word(rows):
    return {r[0]: r[1:] for r in rows}


def test_variants_odd(spark):
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).select("doc_id", "text").collect()]
    assert by_word(found_variants(docs(spark))) == by_word(variants_by_force(rows))
    assert spelling.spelling_variants(no_docs(spark)).count() == 0


@pytest.mark.parametrize("limit, visitors", [(4000, 100_000), (2, 3)])
def test_variants_of_crowded_nodes(spark, limit, visitors):
    """Anagrams, words of one letter, very long words, accents, chains: with small nodes, all go down to their halves."""
    rng = random.Random(3)
    words = ["".join(rng.sample("abcdef", 6)) for _ in range(60)]
    words += ["a" * n for n in range(5, 24)] + ["x" * 60 + "y" * n for n in range(4)] + ["é" * 5, "é" * 6, "éèéèé", "éèéèè", "abcde×", "abcde÷"]
    words += ["z" * k + "yz" + "z" * (50 - k) for k in range(0, 50, 7)]
    text = [" ".join(w for w in words for _ in range(rng.choice((3, 6, 12, 25)))) for _ in range(2)]
    rows = list(enumerate(text))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = found_variants(d, limit=limit, visitors=visitors)
    assert by_word(got) == by_word(variants_by_force(rows)) and len(got) > 90


def test_crc_is_carried_on():
    words, prefixes = [b"abc", "é".encode(), b"q" * 300], [b"12:", b":"]
    import numpy as np

    row, word = np.array([0, 0, 1, 1]), np.array([0, 2, 1, 2])
    want = [zlib.crc32(prefixes[r] + words[w]) for r, w in zip(row, word, strict=True)]
    assert spelling.crc_of_each(row, word, prefixes, words).tolist() == want


# 12


def scan(df, **options):
    return licenses.scan_licenses(df, **options)


def test_license_spans(spark):
    mit = licenses.PASSAGES[0][1]
    changed = mit.split()
    changed[10:10] = ["very", "own"]  # words put in: the rest is on a neighbouring diagonal
    del changed[30]
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    rows = [
        (1, "x " * 40 + " ".join(changed) + " tail"),
        (2, half),
        (3, "Under the MIT-License; CC BY-NC, cc by nc. under the mit, the license"),
        (4, "Apache License, Version 2.0 and apache license version 20"),
        (5, "(cc)by\tnc"),
    ]
    done, spans = scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in done.collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and got[1]["base_labels"] == "" and 0.8 <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and 0.4 < got[2]["score"] < 0.6
    assert got[3]["base_labels"] == "cc-by-nc,mit" and (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["score"]) == (3, 0, 7, 1.0)
    assert got[4]["base_labels"] == "apache-2" and (got[4]["n_base"], got[4]["first_word"], got[4]["n_words"]) == (1, 0, 10)
    assert got[5]["n_base"] == 1 and got[5]["n_words"] == 3
    (span,) = [r for r in spans.where("doc_id = 1 and score >= 0.8").collect() if r["start"] == 40]
    assert span["end"] == 40 + len(changed)


def test_licenses_odd(spark):
    d = docs(spark)
    rows = scan(d)[0].collect()
    assert len(rows) == d.count() and sum(r["doc_id"] is None for r in rows) == 1
    count = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode()))
    assert sorted(r["n_words"] for r in rows) == sorted(count(r["text"]) for r in d.select("text").collect())
    assert {r["labels"] for r in rows} == {""} and {r["score"] for r in rows} == {0.0}
    assert scan(no_docs(spark))[0].count() == 0
    twice = spark.createDataFrame([(1, "cc by nc")] * 2 + [(1, "cc by nc x cc by nc"), (None, "under the mit license")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in scan(twice)[0].collect()) == [(0, 1), (1, 1), (1, 1), (1, 2)]
    with pytest.raises(ValueError):
        scan(d, base={"mit license": "mit"})


def test_many_licenses_in_one_text(spark):
    """Hits grow with the text, not with its square."""
    text = "this is under the mit license here " * 3000
    row = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    assert row["n_base"] == 3000 and row["first_word"] == 2 and row["last_word"] == 7 * 2999 + 2


# 13


def root_by_force(leaves):
    """(root, witnesses) of a list of digests."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 8 * 8 : k // 8 * 8 + 8]
            steps[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        level = [hashlib.sha256("".join(level[i : i + 8]).encode()).hexdigest() for i in range(0, len(level), 8)]
        at = [k // 8 for k in at]
    return level[0], steps


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512])
def test_appended_tree(n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    tree = merkle.Tree()
    for h in leaves:
        tree.append(h)
    assert (tree.close(merkle.height_of(n)), tree.witness) == root_by_force(leaves)


def leaf(r):
    part = lambda v: b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode())
    return hashlib.sha256(b"".join(part(r[c]) for c in merkle.LEAF)).hexdigest()


def manifest_by_force(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    out, subs = [], []
    for name in names:
        own = sorted(trees[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subroot, steps = root_by_force([leaf(r) for r in own])
        subs.append(subroot)
        out.append([(r, s) for r, s in zip(own, steps, strict=True)])
    root, upper = root_by_force(subs)
    for sub, rows_, more in zip(subs, out, upper, strict=True):
        for r, s in rows_:
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = text.encode().lower().decode()
            folded = leaf({**r, "text": text})
            for a, b in s + more:
                folded = hashlib.sha256((a + folded + b).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + b for a, b in s + more).encode()).hexdigest()
            yield (r["doc_id"], leaf(r), sub, root, proof, folded, folded == root)


def same_rows(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


def odd_table(spark):
    d = docs(spark).withColumn("lang", F.when(F.col("doc_id") < 4, None).when(F.col("doc_id") < 7, "").when(F.col("doc_id") == 8, "é").otherwise("z"))
    return d.withColumn("source", F.when(F.col("doc_id") != 5, "web")).withColumn("n_chars", F.length("text").cast("long")).withColumn("tree", F.lit(1)).withColumn("row", F.lit(2))


def test_manifest_odd(spark):
    rows = [r.asDict() for r in odd_table(spark).select(*merkle.LEAF).collect()]
    assert same_rows([tuple(r) for r in merkle.verified(odd_table(spark)).collect()], manifest_by_force(rows))
    assert merkle.verified(odd_table(spark).limit(0)).count() == 0
    one = odd_table(spark).where("doc_id = 10")
    (r,) = merkle.verified(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_manifest_of_many_languages_and_a_hot_one(spark):
    """More subroots than a block has leaves, and a tree of several blocks that lies in several ranges."""
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") < 3000, F.lit("hot")).otherwise(F.concat(F.lit("l"), F.col("id") % 700)).alias("lang"), F.lit(None).cast("long").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    rows = [r.asDict() for r in d.collect()]
    want = list(manifest_by_force(rows))
    got = [tuple(r) for r in merkle.verified(d.repartition(13)).collect()]
    assert same_rows(got, want)
    assert not all(r[-1] for r in got)


def test_one_changed_row_changes_all_above_it(spark):
    d = table(spark, "documents")
    a = {r["doc_id"]: r for r in merkle.verified(d).collect()}
    b = {r["doc_id"]: r for r in merkle.verified(d.withColumn("text", F.when(F.col("doc_id") == 5, F.lit("other")).otherwise(F.col("text")))).collect()}
    assert [i for i in a if a[i]["leaf"] != b[i]["leaf"]] == [5]
    assert {r["root"] for r in a.values()} != {r["root"] for r in b.values()}
    lang = {r["doc_id"]: r["lang"] for r in d.collect()}
    assert all((a[i]["subroot"] != b[i]["subroot"]) == (lang[i] == lang[5]) for i in a)


def test_small_nodes_against_duckdb(spark):
    """The trie with small nodes, over a given table."""
    run = lambda s, sf: spelling.spelling_variants(s.read.parquet(f"{sf}/documents.parquet"), limit=3, visitors=20)
    compare(spark, SF, run, spelling.OP11_SQL)

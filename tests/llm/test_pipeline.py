"""The pipeline against the same stages by brute force."""

import collections
import hashlib

from llm_edge import SF
from test_operators import classes_by_force

import corpus_pipeline


def test_pipeline(spark):
    from tokenizers import Tokenizer

    from chunkline.llm import bpe

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {int(i): t for i, t in zip(d.doc_id, d.text, strict=True) if t and any(map(str.isalpha, t))}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            held[key(line)].add(i)
    kept = {}
    for i, t in texts.items():
        lines = t.split("\n")
        rest = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and i < max(held[key(x)]))]
        if rest or not lines:
            kept[i] = "\n".join(rest)
    ids = sorted(kept)
    near = classes_by_force([kept[i] for i in ids])
    kept = {i: kept[i] for n, i in enumerate(ids) if near[n] == n}
    kept = {i: t for i, t in kept.items() if not any(x in t for x in items)}
    reference = Tokenizer.from_file(bpe.default_vocab())
    want = {i: (reference.encode(t, add_special_tokens=False).ids, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept.items()}
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_stages_on_odd_rows(spark):
    """Nulls, clashing columns, repeated rows and several texts of one id: defined rows, the columns of documents."""
    from llm_edge import docs
    from pyspark.sql import functions as F

    d = docs(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long"))
    d = d.unionByName(d.where("doc_id = 6").withColumn("text", F.lit("another text of document six, of more than eight words")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, SF).columns == corpus_pipeline.COLUMNS, name
    near = [tuple(r) for r in corpus_pipeline.near_copies(spark, d, SF).select("doc_id", "text").collect()]
    assert len(near) == len({i for i, _ in near}) and {1, 2, 3, 4, 8, 9, 10} <= {i for i, _ in near}
    assert all(sorted(map(str, corpus_pipeline.near_copies(spark, d.repartition(n), SF).select("doc_id", "text").collect())) == sorted(map(str, corpus_pipeline.near_copies(spark, d, SF).select("doc_id", "text").collect())) for n in (1, 5))
    assert corpus_pipeline.leaks(spark, d, SF).count() == d.count()
    assert corpus_pipeline.language(spark, d, SF).where("text is null or text = ''").count() == 0


def test_no_tables_are_left(spark):
    import os

    from chunkline.sources.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SF).count()
    assert len([x for x in set(os.listdir(folder)) - before if not x.startswith(".")]) == 1

"""Toxicity by weak supervision.

Voters are lexicons and patterns: fixed lists of insults by language, shouting, exclaiming, and words or word
beginnings that stand more in toxic rows of a bounded training sample than in others. A generative label model
finds from the votes how often each voter fires on either side, and which voters depend on each other: a tree
joins the pairs that tell most about each other on either side, and a voter is judged given its parent in the
tree. Gold labels choose the words, tell which side is the toxic one, and are one voter among the others, as right
as it is found to be. A linear classifier is trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm.common import in_parts, staged

WORDS = re.compile(r"[^\W\d_]+")
#: Plain insults by language, a voter for each.
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic disgusting worthless clown fool jerk creep bastard imbecile",
    "fr": "crétin abruti salaud connard",
    "de": "dumm trottel arschloch idiotisch",
    "es": "estúpido imbécil basura tonto",
}
INSULTING = {w: i for i, words in enumerate(INSULTS.values()) for w in words.split()}
#: Letters of the word beginnings that may be voters.
STEMS = (4, 5, 6, 7, 8)
FIXED = [*(f"lexicon:{k}" for k in INSULTS), "pattern:shouting", "pattern:exclaiming", "pattern:doubled"]


def terms_of(word: str) -> list[str]:
    return [word] + [f"{word[:k]}*" for k in STEMS if len(word) > k]


class Voters:
    def __init__(self, terms: list[str]):
        self.names = FIXED + terms
        self.at = {t: i for i, t in enumerate(terms, len(FIXED))}

    def votes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, voters) of 0 or 1, and the number of firing words with the number of words."""
        words = [WORDS.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        votes, fired = np.zeros((len(texts), len(self.names)), np.uint8), np.zeros(len(texts))
        if sizes.sum():
            codes, known = pd.factorize(np.array([w for ws in words for w in ws], object))
            hits = [[INSULTING[w]] if w in INSULTING else [] for w in known]
            hits = [h + [self.at[t] for t in terms_of(w) if t in self.at] for h, w in zip(hits, known, strict=True)]
            doc = np.repeat(np.arange(len(texts)), sizes)
            for n in np.flatnonzero(np.array([bool(h) for h in hits], bool)[codes]):
                votes[doc[n], hits[codes[n]]] = 1
                fired[doc[n]] += 1
        for i, t in enumerate(texts):
            if t:
                up = sum(map(str.isupper, t))
                votes[i, len(INSULTS) : len(FIXED)] = up > 0.5 * len(t) and len(t) > 20, t.count("!") > 3 + len(t) / 200, "!!" in t
        return votes, np.stack([fired, sizes], 1)


def features(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.hstack([votes, np.log1p(counts[:, :1]), np.log1p(100 * counts[:, :1] / np.maximum(counts[:, 1:], 1)), np.log1p(votes.sum(1, keepdims=True)), np.ones((len(votes), 1))]).astype(float)


#: Rounds of the label model after which its tree is sought anew; voters are apart before.
TREES = (3, 7, 11)


def blocks(votes: np.ndarray, step: int = 2048) -> Iterator[tuple[slice, np.ndarray]]:
    """The votes as numbers, some rows at once: the driver holds them as bytes."""
    for a in range(0, len(votes), step):
        yield slice(a, a + step), votes[a : a + step].astype(float)


def dependence(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters on a known side, weighted over the sides of posterior ``p``."""
    out = np.zeros((votes.shape[1], votes.shape[1]))
    for w in (p, 1 - p):
        both = sum(((v * w[at, None]).T @ v for at, v in blocks(votes)), 0.25 + np.zeros_like(out))
        n, one = w.sum() + 1, w @ votes + 0.5
        for joint, a, b in ((both, one, one), (one[:, None] - both, one, n - one), (one[None] - both, n - one, one), (n - one[:, None] - one[None] + both, n - one, n - one)):
            joint = np.maximum(joint, 1e-9)
            out += joint / len(votes) * np.log(joint * n / (a[:, None] * b[None]))
    return out


def parents(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each voter the one it is judged with, -1 for none: a tree of most dependence (Chow and Liu).

    A pair that tells less than its two more numbers cost (by the Bayesian criterion) is no edge.
    """
    tells = dependence(votes, p) - np.log(max(len(votes), 2)) / max(len(votes), 1)
    n = len(tells)
    out, best, frm, left = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        at = int(np.argmax(np.where(left, best, -np.inf))) if (left & (best > 0)).any() else int(np.argmax(left))
        out[at], left[at] = frm[at] if best[at] > 0 else -1, False
        near = left & (tells[at] > best)
        best[near], frm[near] = tells[at][near], at
    return out


def log_odds(votes: np.ndarray, p: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """What the votes say for side 1, with the accuracies that ``p`` gives each voter beside each vote of its parent."""
    sides, n = np.stack([p, 1 - p]), votes.shape[1]
    # weights of the rows by side and vote of the parent: all of them, and those in which the voter fires
    rows, fired = np.zeros((2, 2, n)), np.zeros((2, 2, n))
    for at, v in blocks(votes):
        given = np.where(parent >= 0, v[:, parent], 0)
        for a, here in enumerate((1 - given, given)):
            rows[:, a] += sides[:, at] @ here
            fired[:, a] += sides[:, at] @ (here * v)
    prior = (votes.sum(0) + 0.5) / (len(votes) + 1)
    rate = (fired + prior) / (rows + 1)
    yes, no = np.log(rate[0]) - np.log(rate[1]), np.log1p(-rate[0]) - np.log1p(-rate[1])
    out = np.zeros(len(votes))
    for at, v in blocks(votes):
        given = np.where(parent >= 0, v[:, parent], 0)
        out[at] = np.where(given > 0, np.where(v > 0, yes[1], no[1]), np.where(v > 0, yes[0], no[0])).sum(1)
    return out


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row, and the parent of each voter.

    Expectation maximisation over the votes. It starts at ``gold``, which names the sides and is the last voter, with
    an accuracy and dependences that are estimated like those of any other.
    """
    v, p = np.hstack([votes, gold[:, None].astype(np.uint8)]), 0.05 + 0.9 * gold
    parent = np.full(v.shape[1], -1)
    for i in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        was, p = p, 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + log_odds(v, p, parent), -30, 30)))
        if i in TREES:
            parent = parents(v, p)
        elif i > max(TREES) and np.abs(p - was).max() < 1e-4:
            break
    return p, parent


def linear_fit(x: np.ndarray, p: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights on soft labels, by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], l2)
    keep[-1] = 1e-6
    for _ in range(rounds):
        y = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (y * (1 - y))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    def __init__(self, voters: Voters, weights: np.ndarray, parent: np.ndarray):
        self.voters, self.weights, self.parent = voters, weights, parent

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = features(*self.voters.votes(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 12_000, max_terms: int = 600, min_rows: int = 5) -> ToxicityModel:
    """Learns from at most about ``per_class`` labelled rows of either label, chosen by a hash of the id.

    Several labels of one id count as toxic if one does; null ids and labels are passed over. Rows whose
    texts share their smallest five-word shingle hash count once, so a copied text is no proof by number. Null
    texts teach nothing. At most ``max_terms`` words or word beginnings become voters, each in ``min_rows`` toxic
    rows or more. With one label or none the score is constant; other columns are not read.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = {y: sum(v for k, v in sizes.items() if (k > 0) == bool(y)) for y in (0, 1)}
    share = F.when(F.col("y") > 0, per_class / max(n[1], 1)).otherwise(per_class / max(n[0], 1))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    shingle = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)])
    sketch = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 5, F.lit(0))), shingle))
    # the sample is bounded by 2 * per_class rows of two numbers
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    train = train.withColumn("words", F.split(F.lower("text"), r"\s+")).select("id", "text", F.col("y").cast("int").alias("y"), sketch.alias("sketch"))
    train = staged(train.where("text is not null").groupBy("sketch").agg(F.min(F.struct("id", "text", "y")).alias("r")).select("r.*"), "toxicity-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(b["text"], b["y"], strict=True):
                c[int(y > 0)].update({x for w in set(WORDS.findall(t.lower())) for x in terms_of(w)})
            for y in (0, 1):
                yield pd.DataFrame({"term": list(c[y]), "y": y, "n": list(c[y].values())})

    seen = {r["y"]: r["n"] for r in train.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = seen.get(1, 0), seen.get(0, 0)
    if not pos or not neg:  # one label or none: a constant score
        w = np.zeros(len(FIXED) + 4)
        w[-1] = 4.0 if pos else -4.0
        return ToxicityModel(Voters([]), w, np.full(len(FIXED), -1))
    counts = train.mapInPandas(count, "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
    best = counts.where(F.col("a") >= min_rows).select("term", (odds * F.sqrt("a")).alias("weight"), odds.alias("odds")).where("odds > 2.3").orderBy(F.col("weight").desc(), "term").limit(max_terms)
    voters = Voters([r["term"] for r in best.collect()])

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            votes, c = voters.votes(list(b["text"]))
            yield pd.DataFrame({"votes": [np.packbits(v).tobytes() for v in votes], "fired": c[:, 0], "size": c[:, 1], "y": b["y"]})

    # the bounded sample's votes come to the driver, a bit for each row and voter
    got = train.mapInPandas(vote, "votes binary, fired double, size double, y int").toPandas()
    votes = np.unpackbits(np.frombuffer(b"".join(got["votes"]), np.uint8).reshape(len(got), -1), axis=1)[:, : len(voters.names)]
    posterior, parent = label_model(votes, (got["y"].to_numpy() > 0).astype(float))
    return ToxicityModel(voters, linear_fit(features(votes, got[["fired", "size"]].to_numpy(float)), posterior), parent)


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for each row, over whole texts; null and empty texts get the score of no vote.

    Rows are judged one by one, repeated or not; other columns do not come back; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in in_parts(batch, batch["text"].str.len().fillna(0)):
                yield pd.DataFrame({"id": b["id"].to_numpy(), "score": shared.value.score(list(b["text"]))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out_of_reach = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, labels.where(~out_of_reach))
    scored = score(docs, model)
    return scored.select("doc_id", out_of_reach.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

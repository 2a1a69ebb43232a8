"""Language ID by unigram pieces summed over all segmentations.

A fixed public vocabulary gives the pieces; each language has a probability for every piece. The
probability of a word is the sum over all ways to cut it into pieces (a forward pass), that of a text the
product over its words. Piece probabilities are learned by expectation maximisation on a bounded sample of
labelled documents (``train_per_lang`` for each language), counting and scoring in Spark tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm.common import in_parts, slices, staged

WORDS, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
START = "▁"
#: Places of a word that are summed between two rescalings.
BLOCK = 32
#: Numbers of the alpha values are kept near 1 by this factor a letter.
SCALE = 16.0
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; numerals such as ² or Ⅷ are no letters."""
    found = WORDS.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [x for w in found for x in LETTERS.findall(w)]


class Pieces:
    """The pieces of letters in a sentencepiece vocabulary, found by the hash of their code points."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
        kept = sorted(p for p in every if p and (p.removeprefix(START) or "a").isalpha() and p == p.lower())
        self.longest = max(map(len, kept), default=1)
        self.n = len(kept) + 1  # the last stands for any letter that is no piece
        by_len: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(kept):
            h = self.roll(np.array([[ord(c) for c in p]], np.uint64), len(p))[-1][0, 0]
            by_len.setdefault(len(p), []).append((int(h), i))
        self.table = {k: tuple(np.array(x, t) for x, t in zip(zip(*sorted(v), strict=True), (np.uint64, np.int64), strict=True)) for k, v in by_len.items()}

    @staticmethod
    def roll(codes: np.ndarray, most: int) -> list[np.ndarray]:
        """Hashes of the runs of 1 to ``most`` letters from each place."""
        out = [(codes + np.uint64(1)) * MIX]
        for k in range(1, min(most, codes.shape[1])):
            out.append((out[-1][:, :-1] ^ codes[:, k:]) * MIX + (out[-1][:, :-1] >> np.uint64(29)))
        return out

    def ids(self, codes: np.ndarray) -> list[np.ndarray]:
        """For code points (words, places): ids of the pieces of k letters from each place, -1 where there is none."""
        out = []
        for k, h in enumerate(self.roll(codes.astype(np.uint64), self.longest), 1):
            hashes, at = self.table.get(k, (np.zeros(1, np.uint64), np.full(1, -1)))
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = np.where(hashes[place] == h, at[place], -1)
            out.append(np.where(found < 0, self.n - 1, found) if k == 1 else found)
        return out


def places(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length behind the mark of a word's start, a row for each word."""
    return np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), length + 1)


def forward(ids: list[np.ndarray], prob: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """alpha (places, words, languages), scaled by SCALE a letter; ``prob`` (pieces + 1, languages), last row 0.

    ``before`` holds the alpha values of the places already summed, the latest last; ``ids`` start at the first of them.
    """
    n, size = ids[0].shape
    before = np.ones((1, n, prob.shape[1])) if before is None else before
    alpha = np.concatenate([before, np.zeros((size + 1 - len(before), *before.shape[1:]))])
    for i in range(len(before), size + 1):
        for k in range(1, min(i, len(ids)) + 1):
            got = ids[k - 1][:, i - k]
            if k == 1:
                alpha[i] += alpha[i - 1] * (prob[got] * SCALE)
            elif len(has := np.flatnonzero(got >= 0)):
                alpha[i][has] += alpha[i - k][has] * (prob[got[has]] * SCALE**k)
    return alpha


def word_scores(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """log P(word | language), a row for each word, over all its segmentations, block by block of its letters."""
    out = np.zeros((len(words), prob.shape[1]))
    by_len: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_len.setdefault(len(w), []).append(i)
    for size, every in by_len.items():
        step = max(1, 4_000_000 // ((min(size, BLOCK) + 2) * prob.shape[1] * 8))
        for a in range(0, len(every), step):
            at = every[a : a + step]
            codes, alpha, logs = places([words[i] for i in at], size), None, 0.0
            for done in range(0, size + 1, BLOCK):
                held = 0 if alpha is None else len(alpha) - 1
                alpha = forward(pieces.ids(codes[:, done - held : done + BLOCK]), prob, alpha)
                if done + BLOCK <= size:  # what a piece of the next block may start at
                    alpha = alpha[-pieces.longest :]
                    most = alpha.max(0)
                    alpha, logs = alpha / most, logs + np.log(most)
            out[at] = np.log(np.maximum(alpha[-1], 1e-300)) + logs - (size + 1) * np.log(SCALE)
    return out


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of the words, in one language (``prob``: pieces).

    Sums from the start and from the end of a word go block by block of its letters, each with a scale of its own.
    """
    total, column, longest = np.zeros(pieces.n), prob[:, None], pieces.longest
    by_len: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_len.setdefault(len(w), []).append(i)
    for size, every in by_len.items():
        end = size + 1
        step = min(20_000, max(1, 4_000_000 // end))
        for first in range(0, len(every), step):
            at = every[first : first + step]
            codes, n = places([words[i] for i in at], size), len(at)
            alpha, log_a = np.ones((end + 1, n)), np.zeros((end + 1, n))
            tail, logs = None, np.zeros(n)
            for a in range(0, end, BLOCK):
                held, z = 0 if tail is None else len(tail) - 1, min(a + BLOCK, end)
                rows = forward(pieces.ids(codes[:, a - held : z]), column, tail)
                alpha[a + 1 : z + 1], log_a[a + 1 : z + 1] = rows[held + 1 :, :, 0], logs
                most = rows[-longest:].max(0)
                tail, logs = rows[-longest:] / most, logs + np.log(most[:, 0])
            after, log_b = np.zeros((longest, n)), np.zeros(n)
            after[0] = 1
            for a in range(0, end, BLOCK)[::-1]:
                z = min(a + BLOCK, end)
                ids = pieces.ids(codes[:, a : z + longest - 1])
                beta = np.concatenate([np.zeros((z - a, n)), after])
                share = weights[at] / alpha[end] * np.exp(log_a[a:z] + log_b - log_a[end])
                for i in range(z - a - 1, -1, -1):
                    for k in range(1, min(end - a - i, len(ids)) + 1):
                        got = ids[k - 1][:, i]
                        has = np.flatnonzero(got >= 0)
                        p = prob[got[has]] * SCALE**k * beta[i + k][has]
                        beta[i][has] += p
                        total += np.bincount(got[has], alpha[a + i][has] * p * share[i][has], minlength=pieces.n)
                most = beta[:longest].max(0)
                after, log_b = beta[:longest] / most, log_b + np.log(most)
    return total


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class LanguageModel:
    def __init__(self, vocab_path: str, langs: list[str], prob: np.ndarray):
        self.vocab_path, self.langs, self.prob = vocab_path, langs, prob


def fit(labelled: DataFrame, vocab_path: str, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_per_lang: int = 4000, rounds: int = 3) -> LanguageModel:
    """Learns from about ``train_per_lang`` rows of each language, chosen by a hash of the id.

    Words of any length are learned from whole. Rows without text or language are passed over, repeated rows count
    as often as they stand. A table without any gives a model that knows no language. Other columns are not read.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel(vocab_path, [], np.zeros((loaded(vocab_path).n + 1, 0)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_per_lang / sizes[k]))])
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                c = Counter(w for t in texts for w in words_of(t))
                if c:
                    yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    words = staged(picked.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    pieces = loaded(vocab_path)
    prob = np.full((len(langs), pieces.n), 1.0 / pieces.n)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            known, total = loaded(vocab_path), {}
            for b in batches:
                for lang, g in b.groupby("lang"):
                    k = langs.index(lang)
                    total[lang] = total.get(lang, 0) + expected_counts(list(g["word"]), g["n"].to_numpy(float), known, now.value[k])
            for lang, c in total.items():
                at = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "piece": at, "c": c[at]})

        # one number for each language and piece comes back: bounded by the vocabulary
        got = words.mapInPandas(expect, "lang string, piece long, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toPandas()
        counts = np.full((len(langs), pieces.n), 0.05)
        if len(got):
            np.add.at(counts, (got["lang"].map(langs.index).to_numpy(int), got["piece"].to_numpy(int)), got["c"].to_numpy(float))
        prob = counts / counts.sum(1, keepdims=True)
    return LanguageModel(vocab_path, langs, np.vstack([prob.T, np.zeros((1, len(langs)))]))


class Scorer:
    """Predicts in a task, one batch of texts at a time."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, loaded(model.vocab_path)

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        m, words = self.model, [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        has = np.flatnonzero(sizes) if m.langs else []
        if len(has):
            codes, known = pd.factorize(np.array([w for ws in words for w in ws], object))
            each = word_scores(list(known), self.pieces, m.prob)[codes]
            total = np.add.reduceat(each, np.concatenate([[0], np.cumsum(sizes[has])[:-1]]))
            # by the mean word: sums over a long text would make every score 1
            odds = np.exp((total - total.max(1, keepdims=True)) / sizes[has][:, None])
            best = total.argmax(1)
            pred[has] = np.array(m.langs, object)[best]
            score[has] = 1 / odds.sum(1)
        return pred, score


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row, over whole texts.

    ``und`` with score 0 if the text is null or holds no letter (or nothing was learned); else the language
    of the largest posterior under equal priors, ties to the first name, and its posterior by the geometric mean
    of the words' probabilities. Words of any length are summed whole. Each row is judged by itself, repeated or
    not; other columns do not come back. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for b in in_parts(batch, batch["text"].str.len().fillna(0)):
                pred, score = scorer.predict(list(b["text"]))
                yield pd.DataFrame({"id": b["id"].to_numpy(), "lang_pred": pred, "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def identified(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language with a score of ``least`` or more.

    Null texts and texts without letters go; repeated rows stay or go together; columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for b in slices(batch, text_col):
                pred, score = scorer.predict(b.column(text_col).to_pylist())
                yield b.filter(pa.array((pred != "und") & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()), default_vocab())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

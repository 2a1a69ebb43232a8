"""Byte-level BPE with a backtracking encoder and an offset-table decoder.

Encoding: at each place take the longest token (an Aho-Corasick automaton over the vocabulary gives the
longest match), check it against the token before it in the table of compatible pairs, and step back when
the pair could not stand side by side in a merged text. The result is that of the merges in rank order, in
time linear in the text. Decoding gathers byte ranges of one buffer through a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkline.llm.common import slices

#: Fixed value: the pattern by which the byte-level vocabulary splits texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids, and pairs of tokens whose fit, are remembered in a worker before that memory is emptied.
REMEMBERED, PAIRS = 150_000, 500_000
#: Code points that a task encodes before it passes rows on, and ids that are decoded at once.
PART, IDS = 500_000, 1 << 16


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {}, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class ByteBpe:
    """A vocabulary file (the tokenizers library's JSON) with byte-level pieces and merges in rank order."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the two halves of each token (a single byte is its own halves), and the token that two halves make
        self.left, self.right, self.pair, self.rank = list(range(size)), list(range(size)), {}, list(range(size))
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.pair:
                self.pair[x, y] = z
            if self.left[z] == z:
                self.left[z], self.right[z], self.rank[z] = x, y, 256 + r
        self.by_bytes = {self.bytes_of[i]: i for i in vocab.values()}
        for i, b in enumerate(self.bytes_of):
            if len(b) == 1:
                self.rank[i] = i if self.left[i] != i else min(i, 255)
        self.longest = max(map(len, self.by_bytes))
        # the next shorter token that starts a token
        self.shorter = [-1] * size
        for b, i in self.by_bytes.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := self.by_bytes.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for b, i in self.by_bytes.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT)
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.buffer = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a in a merged text: no merge along their border comes first."""
        key = a << 32 | b
        if (ok := self.compatible.get(key)) is not None:
            return ok
        x, y, limit = a, b, 1 << 60
        rank, single = self.rank, lambda t: self.left[t] == t
        while ok is None:
            made = self.pair.get((x, y))
            if made is not None and rank[made] < limit:
                ok = False
            elif single(x) and single(y):
                ok = True
            elif not single(x) and (single(y) or rank[x] > rank[y]):
                limit = rank[x]
                x = self.right[x]
            else:
                limit = rank[y] + 1
                y = self.left[y]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def longest_at(self, piece: str) -> list[int]:
        """The longest token that starts at each byte (bytes as latin-1), by one pass of the automaton."""
        best = [-1] * len(piece)
        size = [0] * len(piece)
        for end, i in self.automaton.iter(piece):
            n = len(self.bytes_of[i])
            at = end - n + 1
            if n > size[at]:
                size[at], best[at] = n, i
        return best

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.by_bytes.get(data)
        first = self.longest_at(data.decode("latin-1"))
        if whole is not None and len(data) == 1:
            return (whole,)
        n, pos, out = len(data), 0, []
        open_at = bytearray([1]) * (n + 1)
        token = first[0]
        while True:
            after = pos + len(self.bytes_of[token])
            if open_at[after] and (not out or self.fits(out[-1], token)):
                out.append(token)
                pos = after
                if pos == n:
                    return tuple(out)
                token = first[pos]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[pos] = 0
                token = out.pop()
                pos -= len(self.bytes_of[token])
                # the place is closed now: the same token fails its check and gives way to a shorter one

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, as little-endian unsigned 32-bit integers."""
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
        ids: list[int] = []
        known = self.known
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in self.split.findall(part):
                got = known.get(piece)
                if got is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    got = self.encode_piece(piece.encode())
                    if len(piece) <= 64:
                        known[piece] = got
                ids += got
        return np.array(ids, "<u4")

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(ids), IDS):
            at = ids[a : a + IDS].astype(np.int64)
            start, n = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
            place = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            out.append(self.buffer[place].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return self.decoded_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One encoder a worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _encoded(docs: DataFrame, vocab_path: str, id_col: str, text_col: str, shape: str, columns) -> DataFrame:
    """``columns`` makes the columns after the id of a run of texts: from the ids of each, and the encoder."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocab_path)
        for batch in batches:
            for b in slices(batch, "text", PART):
                made = columns([bpe.encode(t or "") for t in b.column("text").to_pylist()], bpe)
                yield pa.RecordBatch.from_arrays([b.column("id"), *made.values()], ["id", *made])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, {shape}").withColumnRenamed("id", id_col)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).view("<i4")))


def _text_digests(ids: list[np.ndarray], bpe: ByteBpe) -> pa.Array:
    return pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string())


def encode_documents(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id_col, ids array<int>, decoded string) for each row; ``digests`` gives decoded_sha256 in place of the text.

    Null and empty texts have no ids. Repeated rows each come back. An empty table gives an empty table; other
    columns are ignored, whatever their names. Texts of any length are encoded whole; tasks pass rows on in
    runs of about PART code points.
    """

    def columns(ids: list[np.ndarray], bpe: ByteBpe) -> dict:
        if digests:
            return {"ids": _lists(ids), "decoded_sha256": _text_digests(ids, bpe)}
        return {"ids": _lists(ids), "decoded": pa.array([bpe.decode(x) for x in ids], pa.string())}

    return _encoded(docs, vocab_path, id_col, text_col, f"ids array<int>, {'decoded_sha256' if digests else 'decoded'} string", columns)


def encode_digests(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same work, with digests of ids and decoded text in place of both (made where the ids are)."""

    def columns(ids: list[np.ndarray], bpe: ByteBpe) -> dict:
        return {
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": _text_digests(ids, bpe),
        }

    return _encoded(docs, vocab_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_digests(docs, default_vocab())

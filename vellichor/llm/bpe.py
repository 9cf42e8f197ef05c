"""Byte-level BPE encoding of whole tables with a public vocabulary.

Each pre-token is merged through a segment tree over the ranks of its adjacent
pairs: the root is the leftmost pair of lowest rank, a merge is a handful of
logarithmic point updates, and encoding ends when the root holds no rank.

Two exact shortcuts keep the tree off the hot path. A text is cut at every
single space that stands between two other characters, where a pre-token always
begins, and a pre-token is cut between two bytes which stand side by side in no
vocabulary entry, as no merge can span them. Both kinds of piece recur, so a
worker remembers their ids (up to ``CACHE_ENTRIES``, then it starts afresh).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-token pattern of the 50k byte-level vocabularies (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 400_000
DEFAULT_VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
NO_PAIR = 1 << 62


class PairTree:
    """Minimum segment tree over the slots of a token sequence; a slot holds (rank, position) of the pair it begins."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        self.shift = self.size.bit_length()
        leaves = [(r << self.shift) | i if r < NO_PAIR else NO_PAIR for i, r in enumerate(ranks)]
        self.node = [NO_PAIR] * self.size + leaves + [NO_PAIR] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            left, right = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = left if left < right else right

    def put(self, position: int, rank: int) -> None:
        """Set a slot's pair rank; NO_PAIR removes it."""
        node = self.node
        i = position + self.size
        node[i] = (rank << self.shift) | position if rank < NO_PAIR else NO_PAIR
        i >>= 1
        while i:
            left, right = node[2 * i], node[2 * i + 1]
            least = left if left < right else right
            if node[i] == least:
                return
            node[i] = least
            i >>= 1

    def best(self) -> int:
        """Position of the leftmost pair of lowest rank, or -1."""
        root = self.node[1]
        return -1 if root >= NO_PAIR else root & ((1 << self.shift) - 1)


class BytePairEncoder:
    """Encoder over a rank file (one base64 token and its rank per line)."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        joined = np.zeros((256, 256), dtype=bool)
        for token in self.ranks:
            raw = np.frombuffer(token, dtype=np.uint8)
            joined[raw[:-1], raw[1:]] = True
        self.joined = joined
        self.pre = regex.compile(PATTERN)
        self.uneven_space = regex.compile(r" \s|\s |^ | $")
        self.even_space = regex.compile(r"(?<=\S) (?=\S)")
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.first_chunks = _Memo(self._chunk)
        self.spaced_chunks = _Memo(lambda chunk: self._chunk(" " + chunk))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        n = len(word)
        if n == 1 or word in ranks:
            return [ranks[word]]
        parts: list[bytes] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = PairTree([ranks.get(word[i : i + 2], NO_PAIR) for i in range(n - 1)])
        while (i := tree.best()) >= 0:
            j = after[i]
            parts[i] += parts[j]
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, NO_PAIR)
            if k < n:
                before[k] = i
                tree.put(i, ranks.get(parts[i] + parts[k], NO_PAIR))
            else:
                tree.put(i, NO_PAIR)
            if (h := before[i]) >= 0:
                tree.put(h, ranks.get(parts[h] + parts[i], NO_PAIR))
        out, i = [], 0
        while i < n:
            out.append(ranks[parts[i]])
            i = after[i]
        return out

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for token in self.pre.findall(chunk):
            word = token.encode("utf-8", "surrogatepass")
            if len(word) > 3 and not word.isascii():
                raw = np.frombuffer(word, dtype=np.uint8)
                cuts = (np.flatnonzero(~self.joined[raw[:-1], raw[1:]]) + 1).tolist()
                bounds = [0, *cuts, len(word)]
                words = [word[a:b] for a, b in zip(bounds, bounds[1:])]
            else:
                words = [word]
            for piece in words:
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = self.pieces[piece] = tuple(self.merge(piece))
                out.extend(ids)
        return tuple(out)

    def chunks(self, text: str) -> Iterator[tuple[int, ...]]:
        """Id tuples of a text's chunks, in order."""
        parts = self.even_space.split(text) if self.uneven_space.search(text) else text.split(" ")
        return chain((self.first_chunks[parts[0]],), map(self.spaced_chunks.__getitem__, parts[1:]))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts have none."""
        return list(chain.from_iterable(self.chunks(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.chunks(text))) if text else 0

    def trim(self) -> None:
        """Bound the worker's memory."""
        for memo in (self.pieces, self.first_chunks, self.spaced_chunks):
            if len(memo) > CACHE_ENTRIES:
                memo.clear()


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary."""
    return BytePairEncoder(path)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, ids)`` of every row: the ids of ``text`` without special tokens.

    Null and empty texts give an empty list, blank texts their white-space ids.
    Repeated rows come out repeated, null keys stay null, other columns (also of
    the name ``ids``) are not read. Texts of any length are encoded whole.
    Narrow: no shuffle, and the text column is the only wide one read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                lengths, flat = [], []
                for value in batch.column(1).to_pylist():
                    ids = bpe.encode(value)
                    lengths.append(len(ids))
                    flat.append(np.array(ids, dtype=np.int32))
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), type=pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["k", "ids"])
                bpe.trim()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Replace column ``text`` by its token count ``out`` (0 for null and empty texts); the other columns are kept.

    The text leaves the plan here, so what follows shuffles numbers only. A
    column that is already called ``out`` raises ``ValueError``.
    """
    keep = [c for c in df.columns if c != text]
    if out in keep:
        raise ValueError(f"column {out!r} exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            counts = [bpe.count(v) for v in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, type=pa.int64())], [*keep, out])
            bpe.trim()

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(run, schema)

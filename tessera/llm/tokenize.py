"""Byte-level BPE encoding of a text column with a public vocabulary, merges chosen by a segment tree."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a worker remembers; the memory is cleared when it is full.
CACHE_PIECES = 400_000
_NONE = 1 << 62
_LOADED: dict[str, "BpeEncoder"] = {}


class BpeEncoder:
    """Encodes pieces by always merging the leftmost pair of lowest rank.

    A segment tree of fan-out 16 over the positions of a piece holds rank * 2**32 + position of
    each pair of neighbours. Its root is the next merge; a merge updates at most three leaves and
    their ancestors, up to the first that keeps its minimum.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = {k: v << 32 for k, v in self.ranks.items() if len(k) == 2}
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, first = len(piece), self.first
        end = list(range(1, n + 1))  # a part that begins at i ends before end[i]
        before = list(range(-1, n - 1))  # where the part to the left of i begins
        leaf = [first.get(piece[i : i + 2], _NONE) + i for i in range(n - 1)]
        levels = [leaf]
        while len(levels[-1]) > 16:
            low = levels[-1]
            levels.append([min(low[k : k + 16]) for k in range(0, len(low), 16)])
        upper, root = levels[1:], levels[-1]

        def climb(i: int) -> None:
            low = leaf
            for level in upper:
                i >>= 4
                m = min(low[i << 4 : (i << 4) + 16])
                if level[i] == m:
                    return
                level[i] = m
                low = level

        while (top := min(root)) < _NONE:
            i = top & 0xFFFFFFFF
            j = end[i]
            k = end[i] = end[j]
            leaf_i = _NONE
            if k < n:
                before[k] = i
                r = ranks.get(piece[i : end[k]])
                if r is not None:
                    leaf_i = r << 32 | i
                leaf[j] = _NONE
                if upper:
                    climb(j)
            elif j < n - 1:
                leaf[j] = _NONE
                if upper:
                    climb(j)
            leaf[i] = leaf_i
            if upper:
                climb(i)
            h = before[i]
            if h >= 0:
                r = ranks.get(piece[h:k])
                leaf[h] = _NONE if r is None else r << 32 | h
                if upper:
                    climb(h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; null and empty texts give an empty list."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8", "replace")))
                if len(piece) <= 64:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


def encoder(vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> BpeEncoder:
    """The encoder of a rank file; folder defaults to that of the installed public tokenizers."""
    key = f"{folder}/{vocabulary}"
    if key not in _LOADED:
        import public_tokenizers as p

        _LOADED[key] = BpeEncoder(f"{folder}/{vocabulary}" if folder else str(p.path(vocabulary)), p.PATTERN)
    return _LOADED[key]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row of df.

    Null and empty texts both have the empty list; every other text, of any length, its whole
    encoding. Repeated rows stay repeated. One narrow pass: no shuffle, whatever the input's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, folder)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_column(df: DataFrame, keys: list[str], text: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """keys and n_tokens of every row of df; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, folder)
        for b in batches:
            n = pa.array([len(e.encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keys, "n_tokens"])

    kinds = dict(df.dtypes)
    return df.select(*keys, F.col(text).alias("__t")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tokens long")

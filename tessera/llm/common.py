"""Word sets, fingerprints and components used by several operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize

#: Bytes of a word's hash in a packed word set.
WORD_BYTES = 5
_words = re.compile(r"[^\W_]+").findall
#: Separates words at ASCII characters that are no letters or digits; others stay within their token.
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


class _Hashes(dict):
    """The packed hashes of the words in each token seen, emptied when it holds too many."""

    def __missing__(self, token: bytes) -> bytes:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        words = [token] if token.isascii() else [w.encode("utf-8", "surrogatepass") for w in _words(token.decode("utf-8", "surrogatepass"))]
        h = self[token] = b"".join(xxhash.xxh3_64_digest(w)[:WORD_BYTES] for w in words)
        return h


_hash = _Hashes().__getitem__


def packed_words(text: str) -> bytes:
    """The distinct words (maximal runs of letters and digits of the lower-cased text) as WORD_BYTES bytes each, in any order.

    Two different words of a pair of 60-word texts share a hash with probability 2e-9.
    """
    packed = b"".join(map(_hash, set(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split())))
    if text.isascii():
        return packed
    return b"".join({packed[i : i + WORD_BYTES] for i in range(0, len(packed), WORD_BYTES)})


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets one after the other as 64-bit integers, size of each set) of packed word sets."""
    flat = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, WORD_BYTES)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :WORD_BYTES] = flat
    return wide.view("<u8").reshape(-1).astype(np.uint64), np.fromiter(map(len, blobs), np.int64, len(blobs)) // WORD_BYTES


def shared_words(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many words the packed sets a[i] and b[i] share, for each i (at most 2^24 pairs)."""
    x, nx = unpack(a)
    y, ny = unpack(b)
    row = np.concatenate([np.repeat(np.arange(len(a)), nx), np.repeat(np.arange(len(b)), ny)]).astype(np.uint64)
    keys = np.sort((row << np.uint64(8 * WORD_BYTES)) | np.concatenate([x, y]))
    twice = keys[:-1][keys[1:] == keys[:-1]] >> np.uint64(8 * WORD_BYTES)
    return np.bincount(twice.astype(np.int64), minlength=len(a))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def fingerprints(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each (non-empty) set that don't depend on the order of its words."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(mix(flat ^ np.uint64(0x5851F42D4C957F2D))), starts)


def joined_text(title: Column, sentences: Column) -> Column:
    """Title and all sentences joined by spaces; nulls are left out."""
    return F.concat_ws(" ", title, F.array_join(sentences, " "))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component) of an undirected edge table: smallest node of each component.

    Alternates large-star and small-star steps until no edge changes; each step is one or two
    aggregations, so no group is ever collected, and each result is written to the shared folder.
    The number of rounds grows with the logarithm of the largest component; components that
    haven't settled after `rounds` rounds are an error, never a partial result.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

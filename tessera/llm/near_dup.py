"""Near-duplicate records by HyperMinHash registers: band, estimate with collision correction, verify."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_BYTES, fingerprints, mix, packed_words, shared_words, unpack
from tessera.runtime import counted_broadcast, materialize

#: Registers of one band: four of 16 bits fill a 64-bit band key, each from a hash function of its own.
ROWS = 4
#: Mantissa bits kept of a register beside its 6 bits of leading zeros.
MANTISSA = 10
#: A band bucket with more members is paired in blocks of about as many, by many tasks.
HOT_BUCKET = 1024
#: One text in so many is looked at for buckets that are hot beyond doubt; the others are noticed while pairing.
HOT_SAMPLE = 64
#: Sets with fewer words are verified without an estimate, as registers of few words aren't independent.
FEW_WORDS = 24
_NONE = np.uint64(2**64 - 1)


def _clz(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit values (64 for zero)."""
    out = np.zeros(x.shape, np.uint64)
    x = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < (np.uint64(1) << np.uint64(64 - step))
        out[low] += np.uint64(step)
        x[low] <<= np.uint64(step)
    out[x == 0] = 64
    return out


def registers(words: np.ndarray, sizes: np.ndarray, bands: int, seed: int = 7) -> np.ndarray:
    """(sets, ROWS, bands) registers of 16 bits: leading zeros and mantissa bits of the smallest hash in each bucket.

    words: 64-bit word hashes of all (non-empty) sets, one set after the other. Each of ROWS hash
    functions sends every word to one of `bands` buckets; an empty bucket takes the register of the
    first filled one in an order that is the same for all sets, so equal sets stay equal and the
    chance that two sets agree in a register is their overlap.
    """
    rng = np.random.default_rng(seed)
    turn = np.array([rng.permutation(bands) for _ in range(bands)])
    first = np.repeat(np.arange(len(sizes), dtype=np.int64) * bands, sizes)
    out = np.empty((len(sizes), ROWS, bands), np.uint16)
    for r in range(ROWS):
        salt, odd = rng.integers(0, 2**63, 2, dtype=np.uint64)
        h = mix((words ^ salt) * (odd | np.uint64(1)))
        low = np.full(len(sizes) * bands, _NONE)
        np.minimum.at(low, first + (((h >> np.uint64(32)) * np.uint64(bands)) >> np.uint64(32)).astype(np.int64), mix(h) >> np.uint64(1))
        low = low.reshape(-1, bands)
        filled = low.copy()
        for j in range(bands):
            rows = np.flatnonzero(low[:, j] == _NONE)
            for p in turn[j]:
                if not len(rows):
                    break
                filled[rows, j] = low[rows, p]
                rows = rows[low[rows, p] == _NONE]
        filled <<= np.uint64(1)
        zeros = np.minimum(_clz(filled), np.uint64(63))
        after = (filled << zeros) << np.uint64(1)  # the bits after the first one
        out[:, r] = ((zeros << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(sets, bands) 64-bit keys: the ROWS registers of each band, told apart by band."""
    key = np.zeros((regs.shape[0], regs.shape[2]), np.uint64)
    for r in range(ROWS):
        key = (key << np.uint64(16)) | regs[:, r].astype(np.uint64)
    return mix(key + np.arange(regs.shape[2], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def signatures(regs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, 2) 64-bit words: the lowest bit of each register (of the first 28 bands), and in the last 16 bits the number of words."""
    n = len(regs)
    bits = np.zeros((n, 128), np.uint8)
    low = (regs & 1).astype(np.uint8).reshape(n, -1)[:, :112]
    bits[:, : low.shape[1]] = low
    s = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
    s[:, 1] |= np.minimum(sizes, 65535).astype(np.uint64)
    return s


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def word_sets(df: DataFrame, key: str, text) -> DataFrame:
    """(k, fp1, fp2, words) of each row whose key isn't null and whose text has a word: set fingerprints and the packed word set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                packed = pa.array([packed_words(t) if t else b"" for t in part.column(1).to_pylist()], pa.binary())
                keep = pa.array([len(x) > 0 for x in packed.to_pylist()], pa.bool_())
                packed = packed.filter(keep)
                fp1, fp2 = fingerprints(*unpack(packed.to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), _longs(fp1), _longs(fp2), packed], names=["k", "fp1", "fp2", "words"])

    rows = df.select(F.col(key).cast("string").alias("k"), text.alias("t")).where("k is not null and t is not null")
    return rows.mapInArrow(run, "k string, fp1 long, fp2 long, words binary")


def banded(sets: DataFrame, bands: int) -> DataFrame:
    """(bk, id, s1, s2): one row for each band of each row of sets (id, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                flat, sizes = unpack(part.column(1).to_pylist())
                regs = registers(flat, sizes, bands)
                sig = np.repeat(signatures(regs, sizes), bands, axis=0)
                ids = np.repeat(part.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([_longs(band_keys(regs).reshape(-1)), pa.array(ids), _longs(sig[:, 0]), _longs(sig[:, 1])], names=["bk", "id", "s1", "s2"])

    return sets.select("id", "words").mapInArrow(run, "bk long, id long, s1 long, s2 long")


def _most_differing(threshold: float, registers_used: int, width: float = 4.0) -> int:
    """Differing low bits that a pair may have: its corrected estimate, 2 x agreeing share - 1, is at least the threshold less width standard errors."""
    p = (1 + threshold) / 2
    floor = threshold - width * 2 * (p * (1 - p) / registers_used) ** 0.5
    return int(registers_used * (1 - (1 + floor) / 2))


def _likely(a1, a2, b1, b2, most: int, threshold: float) -> np.ndarray:
    """Places of the pairs of signatures that may reach the threshold, by the collision-corrected estimate of their overlap and by their sizes."""
    differ = np.bitwise_count(a1 ^ b1) + np.bitwise_count((a2 ^ b2) >> np.uint64(16))
    at = np.flatnonzero((differ <= most) | (np.minimum(a2 & np.uint64(65535), b2 & np.uint64(65535)) < FEW_WORDS))
    na, nb = (a2[at] & np.uint64(65535)).astype(np.int64), (b2[at] & np.uint64(65535)).astype(np.int64)
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return at[(low >= threshold * high - 1e-9) | (low == 65535)]


def _pairing(most: int, threshold: float, hot: int):
    """A pass over rows (bk, id, s1, s2) sorted by bk: likely pairs of each bucket (a < b); rows of buckets over `hot` members come out as they are, with b null."""

    def emit(a, b, bk, s1, s2, paired: bool) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        cols = [pa.array(a), pa.array(b), none, none, none] if paired else [pa.array(a), none, pa.array(bk), pa.array(s1), pa.array(s2)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "bk", "s1", "s2"])

    def pairs(k, i, s1, s2) -> Iterator[pa.RecordBatch]:
        u1, u2 = s1.view(np.uint64), s2.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        large = np.repeat(sizes > hot, sizes)
        if large.any():
            yield emit(i[large], None, k[large], s1[large], s2[large], False)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(k)) - 1  # members after this one in its bucket
        at = np.flatnonzero((left > 0) & ~large)
        step, found, n = 0, [], 0
        while len(at):
            step += 1
            at = at[left[at] >= step]
            for lo in range(0, len(at), 1 << 17):
                x = at[lo : lo + (1 << 17)]
                ok = _likely(u1[x], u2[x], u1[x + step], u2[x + step], most, threshold)
                if len(ok):
                    a, b = i[x[ok]], i[x[ok] + step]
                    found.append((a, b))
                    n += len(a)
            if n > 1 << 18 or n and not len(at):
                a, b = (np.concatenate(c) for c in zip(*found))
                ok = a != b
                yield emit(np.minimum(a, b)[ok], np.maximum(a, b)[ok], None, None, None, True)
                found, n = [], 0

    def large_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns bk, id, s1, s2 of about 2^17 rows at a time, as small batches would make a loop over buckets slow."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 1 << 17:
                yield [np.concatenate([x.column(j).to_numpy() for x in held]) for j in range(4)]
                held, n = [], 0
        if held:
            yield [np.concatenate([x.column(j).to_numpy() for x in held]) for j in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4
        flowing = None  # the bucket that is known to be hot and goes on
        for new in large_batches(batches):
            cols = [np.concatenate(c) for c in zip(rest, new)]
            if flowing is not None:
                n = int(np.searchsorted(cols[0], flowing, "right"))
                yield emit(cols[1][:n], None, cols[0][:n], cols[2][:n], cols[3][:n], False)
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                rest = cols
                continue
            flowing = None
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield from pairs(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
            if len(rest[0]) > hot:
                flowing = rest[0][0]
                yield emit(rest[1], None, rest[0], rest[2], rest[3], False)
                rest = [c[:0] for c in rest]
        if len(rest[0]):
            yield from pairs(*rest)

    return run


def _hot_pairs(rows: DataFrame, most: int, threshold: float) -> DataFrame:
    """Likely pairs of hot buckets' rows (bk, id, s1, s2): each pair of blocks of a bucket meets in a join key of its own.

    A pair that shares several hot buckets comes from the smallest of them only.
    """
    sizes = rows.groupBy("bk").agg(F.ceil(F.count("*") / HOT_BUCKET).cast("int").alias("blocks"))
    mine = rows.groupBy("id").agg(F.sort_array(F.collect_set("bk")).alias("hot"))  # at most one for each band
    rows = rows.join(sizes, "bk").join(mine, "id").withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("id", "s1", "s2", "hot")]
    left = rows.select("bk", *side("a"), F.col("own").alias("p"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("q"))
    right = rows.select("bk", *side("b"), F.col("own").alias("q"), F.explode(F.expr("sequence(0, own)")).alias("p"))
    low, high = "least(a_s2 & 65535, b_s2 & 65535)", "greatest(a_s2 & 65535, b_s2 & 65535)"
    near = F.expr(f"(p < q or a_id < b_id) and a_id <> b_id and ({low} >= {threshold} * {high} - 1e-9D or {low} = 65535)") & F.expr(f"bit_count(a_s1 ^ b_s1) + bit_count(shiftrightunsigned(a_s2 ^ b_s2, 16)) <= {most} or {low} < {FEW_WORDS}")
    found = left.join(right, ["bk", "p", "q"]).where(near).where(F.expr("array_intersect(a_hot, b_hot)[0] = bk"))
    return found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


@dataclass
class NearDuplicates:
    """What near_duplicates found.

    classes: (id, k, rep) of the rows whose word set occurs in several rows; rep names the class.
    found: (ra, rb, ka, kb, overlap) of linked word sets; ra, rb are ids (reps of classes), ka, kb their own keys.
    members: (key, class) of every row with words; links: (a, b, overlap) by class name, a < b.
    """

    classes: DataFrame
    found: DataFrame
    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(x, y) of all pairs of different keys that the classes and links stand for, x < y, each once."""
        own = self.classes.select("rep", "k").distinct()
        within = own.withColumnRenamed("k", "x").join(own.withColumnRenamed("k", "y"), "rep").where("x < y").select("x", "y")
        across = self.found.join(own.select(F.col("rep").alias("ra"), F.col("k").alias("xa")), "ra", "left").join(own.select(F.col("rep").alias("rb"), F.col("k").alias("xb")), "rb", "left")
        across = across.select(F.coalesce("xa", "ka").alias("x"), F.coalesce("xb", "kb").alias("y")).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        return within.unionByName(across).distinct()


def near_duplicates(df: DataFrame, key: str, text, threshold: float = 0.7, bands: int = 28) -> NearDuplicates:
    """Near duplicates among the rows of df: members and links between classes of equal word sets.

    A class holds the keys with the same word set; its name is its smallest key. Two classes are
    linked if their overlap (words in both by words in either) is at least threshold; each link
    once. Repeated rows count once; a key with several texts belongs to the class of each. Null or
    wordless texts and null keys are in no class. text is a Column over df.

    Steps: the packed word set of every row, in one pass; one representative a class; registers of
    ROWS hash functions with one bucket a band, banded ROWS at a time; one shuffle and sort by band
    key, after which a single pass pairs the members of each bucket and keeps the pairs whose
    sizes and collision-corrected estimate (low bits of all registers) allow the threshold; the
    word sets of these are intersected. A pair at the threshold 0.7 is missed with probability
    (1 - 0.7^4)^28 = 0.0005, one at 0.8 with 5e-7. Buckets over HOT_BUCKET members are paired whole
    too, in blocks over many tasks; that takes time by the square of the bucket.
    """
    df = df.select(F.col(key).cast("string").alias("__key"), text.alias("__text"))
    sets = materialize(word_sets(df, "__key", F.col("__text")).withColumn("id", F.monotonically_increasing_id()), "sets")

    # Classes of equal sets: rep, the smallest id, stands for them all.
    several = sets.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("fp1", "fp2", "rep")
    copies = materialize(sets.select("id", "k", "fp1", "fp2").join(several, ["fp1", "fp2"]).select("id", "k", "rep"), "copies")
    names = copies.groupBy("rep").agg(F.min("k").alias("name"))
    members = sets.select("id", "k").join(copies.select("id", "rep"), "id", "left").join(names, "rep", "left").select(F.col("k").alias(key), F.coalesce("name", "k").alias("class")).distinct()
    repeated = copies.where("id <> rep").select("id")
    ones = sets.join(counted_broadcast(repeated), "id", "left_anti")

    used = min(bands, 28) * ROWS
    most = _most_differing(threshold, used)
    rows = banded(ones, bands)
    sample = banded(ones.where(f"pmod(fp1, {HOT_SAMPLE}) = 0"), bands).groupBy("bk").count().where(F.col("count") >= max(8, 4 * HOT_BUCKET // HOT_SAMPLE)).select("bk")
    sample = materialize(sample, "hot")
    n_hot = sample.count()
    cold = rows.join(counted_broadcast(sample, n_hot), "bk", "left_anti") if n_hot else rows
    passed = materialize(cold.repartition("bk").sortWithinPartitions("bk").mapInArrow(_pairing(most, threshold, HOT_BUCKET), "a long, b long, bk long, s1 long, s2 long"), "passed")
    pairs = passed.where("b is not null").select("a", "b")
    hot = passed.where("b is null").select("bk", F.col("a").alias("id"), "s1", "s2")
    if n_hot or not hot.isEmpty():
        if n_hot:
            hot = hot.unionByName(rows.join(counted_broadcast(sample, n_hot), "bk", "left_semi"))
        pairs = pairs.unionByName(_hot_pairs(materialize(hot, "hot_rows"), most, threshold))
    pairs = materialize(pairs.distinct(), "pairs")

    # Verification: intersect the word sets of both sides.
    need = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "to_verify")
    side = ones.join(counted_broadcast(need), "id", "left_semi").select("id", "k", "words")
    both = pairs.join(side.select(F.col("id").alias("a"), F.col("k").alias("ka"), F.col("words").alias("wa")), "a").join(side.select(F.col("id").alias("b"), F.col("k").alias("kb"), F.col("words").alias("wb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x, y = part.column(4).to_pylist(), part.column(5).to_pylist()
                same = shared_words(x, y)
                total = np.fromiter(map(len, x), np.int64, len(x)) // WORD_BYTES + np.fromiter(map(len, y), np.int64, len(y)) // WORD_BYTES - same
                overlap = same / np.maximum(total, 1)
                keep = pa.array(overlap >= threshold)
                yield pa.RecordBatch.from_arrays([*(part.column(i).filter(keep) for i in range(4)), pa.array(overlap).filter(keep)], names=["ra", "rb", "ka", "kb", "overlap"])

    hit = materialize(both.select("a", "b", "ka", "kb", "wa", "wb").mapInArrow(verify, "ra long, rb long, ka string, kb string, overlap double"), "links")
    named = hit.join(names.select(F.col("rep").alias("ra"), F.col("name").alias("na")), "ra", "left").join(names.select(F.col("rep").alias("rb"), F.col("name").alias("nb")), "rb", "left")
    named = named.select(F.coalesce("na", "ka").alias("x"), F.coalesce("nb", "kb").alias("y"), "overlap")
    links = named.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")
    return NearDuplicates(copies, hit, members, links.groupBy("a", "b").agg(F.max("overlap").alias("overlap")))

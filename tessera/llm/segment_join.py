"""Overlaps between splits by an edit-distance segment join over canonical word strings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fingerprints, mix, packed_words, unpack
from tessera.runtime import counted_broadcast, materialize

#: A word that makes up at least this part of all question words is ranked by its count, after all rarer words. Bounds what is sent to the tasks.
RANKED_SHARE = 1 / 16_384
#: Bits of the context bitmap that is compared inside the join.
BITMAP_BITS = 512
#: Train records of one word that share a join key; a word with more is spread over several keys.
PER_KEY = 4096


def losses(n, threshold: float):
    """Words of an n-word set that a set with overlap of at least threshold may lack."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64)


def banded_distances(a: list[np.ndarray], b: list[np.ndarray], bands: np.ndarray) -> np.ndarray:
    """Insertions and deletions that turn a[i] into b[i], by dynamic programming within bands[i]; bands[i] + 1 if there are more.

    Pairs of similar length go along together: a row of the table holds the diagonals within the
    widest band, for all pairs at once.
    """
    n, m = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    out = np.asarray(bands, np.int64) + 1
    todo = np.flatnonzero(np.abs(n - m) <= bands)
    todo = todo[np.argsort(np.maximum(n, m)[todo], kind="stable")]
    at = 0
    while at < len(todo):
        size = max(1, min(256, (1 << 21) // (int(n[todo[at : at + 256]].max() + m[todo[at : at + 256]].max()) + 1)))
        rows = todo[at : at + size]
        at += size
        width, longest = int(bands[rows].max()), int(n[rows].max())
        span = 2 * width + 1
        x = np.full((len(rows), longest), -1, np.int64)
        y = np.full((len(rows), max(longest, int(m[rows].max())) + span), -2, np.int64)
        for i, r in enumerate(rows):
            x[i, : n[r]] = a[r]
            y[i, width : width + m[r]] = b[r]
        step = np.arange(span, dtype=np.int32)
        cost = np.broadcast_to(np.where(step >= width, step - width, 1 << 20).astype(np.int32), (len(rows), span)).copy()
        last = (m[rows] - n[rows] + width).clip(0, span - 1)
        for i in range(longest + 1):
            done = np.flatnonzero(n[rows] == i)
            out[rows[done]] = np.minimum(cost[done, last[done]], out[rows[done]])
            if i == longest:
                break
            new = np.where(x[:, i : i + 1] == y[:, i : i + span], cost, 1 << 20)
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - step, axis=1) + step
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def word_sets(df: DataFrame, key: str, split: str, question, context) -> DataFrame:
    """(k, s, fp1, fp2, q, c): key, split, fingerprints of both word sets together, and the packed sets of question and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                q, c = ([packed_words(t) if t else b"" for t in part.column(i).to_pylist()] for i in (2, 3))
                keep = [i for i in range(len(q)) if q[i] and c[i]]
                q, c = [q[i] for i in keep], [c[i] for i in keep]
                (q1, q2), (c1, c2) = fingerprints(*unpack(q)), fingerprints(*unpack(c))
                k = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([k.column(0), k.column(1), _longs(mix(q1) + c1), _longs(mix(q2) + c2), pa.array(q, pa.binary()), pa.array(c, pa.binary())], names=["k", "s", "fp1", "fp2", "q", "c"])

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(split).cast("string").alias("s"), question.alias("q"), context.alias("c")).where("k is not null and s is not null and q is not null and c is not null")
    return rows.mapInArrow(run, "k string, s string, fp1 long, fp2 long, q binary, c binary")


def frequent_words(sets: DataFrame) -> dict[int, int]:
    """Question words that make up at least RANKED_SHARE of all, with their counts: at most 1 / RANKED_SHARE words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = np.unique(unpack(b.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(w), pa.array(n.astype(np.int64))], names=["w", "n"])

    counts = materialize(sets.select("q").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {r["w"]: r["n"] for r in counts.where(F.col("n") >= max(2, total * RANKED_SHARE)).collect()}


def segments(sets: DataFrame, top: dict[int, int], threshold: float, queries: bool) -> DataFrame:
    """(w, salt, pos, id, qn, cn, qm, m0, ...): a row for each segment of each record of sets (id, q, c).

    The question's canonical string is its distinct words, rare ones first. Its first k + 1 words,
    k the words it may lose, are a segment each. salt: with queries, a row for each of the keys over
    which the word's train records are spread; else the record's own.
    """
    lanes = BITMAP_BITS // 64
    words = np.array(sorted(top), np.int64)
    count = np.array([top[w] for w in sorted(top)], np.int64)
    keys = -(-count // PER_KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield one(b.slice(at, 1000))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = b.column(0).to_numpy(), b.num_rows
        w, qn = unpack(b.column(1).to_pylist())
        w = w.astype(np.int64)
        doc = np.repeat(np.arange(n), qn)
        often, spread = np.zeros(len(w), np.int64), np.ones(len(w), np.int64)
        if len(words):
            i = np.minimum(np.searchsorted(words, w), len(words) - 1)
            found = words[i] == w
            often, spread = np.where(found, count[i], 0), np.where(found, keys[i], 1)
        order = np.lexsort((w, often, doc))
        w, spread = w[order], spread[order]
        pos = np.arange(len(w)) - np.repeat(np.cumsum(qn) - qn, qn)
        qbits = np.zeros((n, 64), np.uint8)
        qbits[doc, w % 61] = 1
        cw, cn = unpack(b.column(2).to_pylist())
        bits = np.zeros((n, BITMAP_BITS), np.uint8)
        bits[np.repeat(np.arange(n), cn), (mix(cw) >> np.uint64(32)).astype(np.int64) % BITMAP_BITS] = 1
        maps = [np.packbits(x, axis=1).view(">u8").astype(np.uint64).view(np.int64) for x in (qbits, bits)]
        keep = np.flatnonzero(pos <= np.repeat(losses(qn, threshold), qn))
        if queries:
            salt = np.arange(spread[keep].sum()) - np.repeat(np.cumsum(spread[keep]) - spread[keep], spread[keep])
            keep = np.repeat(keep, spread[keep])
        else:
            salt = ((mix(ids.astype(np.uint64))[doc[keep]] >> np.uint64(33)).astype(np.int64)) % spread[keep]
        d = doc[keep]
        cols = [w[keep], salt.astype(np.int64), pos[keep], ids[d], qn[d], cn[d], maps[0][d, 0], *(maps[1][d, x] for x in range(lanes))]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=names)

    names = ["w", "salt", "pos", "id", "qn", "cn", "qm", *[f"m{x}" for x in range(lanes)]]
    return sets.select("id", "q", "c").mapInArrow(run, ", ".join(f"{x} long" for x in names))


@dataclass
class SplitOverlaps:
    """copies: (rep, k) of the records of one split whose texts have equal word sets; links: (a, b, ka, kb, eval_split), a and b ids (reps)."""

    copies: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(x, y, eval_split) of every key pair of an evaluation record and a train record that overlap, each once."""
        side = lambda i, k: self.copies.select(F.col("rep").alias(i), F.col("k").alias(k))
        p = self.links.join(side("a", "xa"), "a", "left").join(side("b", "xb"), "b", "left")
        return p.select(F.coalesce("xa", "ka").alias("x"), F.coalesce("xb", "kb").alias("y"), "eval_split").distinct()


def cross_split_pairs(df: DataFrame, key: str, split: str, question, context, train: str = "train", threshold: float = 0.6) -> SplitOverlaps:
    """Records of other splits whose question and context both overlap those of a train record.

    Overlap is words in both by words in either; both must be at least threshold. Rows with a null
    key or split don't count, and texts without words overlap nothing. Records of one split with
    equal word sets are compared once, by a representative; a key with several texts counts with each.

    Both texts become canonical strings: their distinct words, rare ones first. Sets with overlap
    t or more differ by at most (1 - t) / (1 + t) of their joint length in insertions and
    deletions, and of an evaluation string's first k + 1 one-word segments, k its allowed losses,
    one must survive in the train string, among its own first words; no insertion can destroy a
    segment of one word. The first survivor's positions in both strings bound what can follow it,
    which the join checks, as it does lengths and bitmaps of both texts, all without loss. What
    remains is verified by banded dynamic programming. A frequent word's train records are spread
    over as many join keys as their count asks for, so that no task gets them all.
    """
    ratio = (1 - threshold) / (1 + threshold)
    lanes = BITMAP_BITS // 64
    spark = df.sparkSession
    sets = materialize(word_sets(df, key, split, question, context).withColumn("id", F.monotonically_increasing_id()), "sets")
    several = sets.groupBy("s", "fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("s", "fp1", "fp2", "rep")
    same = materialize(sets.select("id", "k", "s", "fp1", "fp2").join(several, ["s", "fp1", "fp2"]).select("id", "k", "rep"), "copies")
    ones = sets.join(counted_broadcast(same.where("id <> rep").select("id")), "id", "left_anti")

    top = frequent_words(sets)
    names = ["id", "pos", "qn", "cn", "qm", *[f"m{x}" for x in range(lanes)]]
    ev = segments(ones.where(F.col("s") != train), top, threshold, True).select("w", "salt", *[F.col(c).alias(f"a_{c}") for c in names])
    tr = segments(ones.where(F.col("s") == train), top, threshold, False).select("w", "salt", *[F.col(c).alias(f"b_{c}") for c in names])
    near = (
        F.expr(f"least(a_qn, b_qn) >= {threshold} * greatest(a_qn, b_qn) - 1e-6D and least(a_cn, b_cn) >= {threshold} * greatest(a_cn, b_cn) - 1e-6D")
        & F.expr(f"least(a_qn - a_pos, b_qn - b_pos) >= {threshold / (1 + threshold)}D * (a_qn + b_qn) - 1e-6D")
        & F.expr(f"bit_count(a_qm ^ b_qm) <= {ratio}D * (a_qn + b_qn) + 1e-6D")
        & F.expr(" + ".join(f"bit_count(a_m{x} ^ b_m{x})" for x in range(lanes)) + f" <= {ratio}D * (a_cn + b_cn) + 1e-6D")
    )
    cand = materialize(ev.join(tr, ["w", "salt"]).where(near).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct(), "candidates")

    # Verification in as many tasks as the session's shuffles have: candidates are few bytes but much work.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    need = materialize(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "to_verify")
    side = ones.join(counted_broadcast(need), "id", "left_semi")
    left = side.select(F.col("id").alias("a"), F.col("s").alias("eval_split"), F.col("k").alias("ka"), F.col("q").alias("aq"), F.col("c").alias("ac"))
    right = side.select(F.col("id").alias("b"), F.col("k").alias("kb"), F.col("q").alias("bq"), F.col("c").alias("bc"))
    both = cand.join(left, "a").repartition(tasks, "b").join(right.repartition(tasks, "b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(i: int, j: int, part: pa.RecordBatch) -> np.ndarray:
            x, y = ([np.sort(w) for w in np.split(flat.astype(np.int64), np.cumsum(n)[:-1])] for flat, n in (unpack(part.column(c).to_pylist()) for c in (i, j)))
            bands = np.array([int(ratio * (len(a) + len(b)) + 1e-9) for a, b in zip(x, y)], np.int64)
            return banded_distances(x, y, bands) <= bands

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                part = part.filter(pa.array(close(5, 7, part)))
                if part.num_rows:
                    part = part.filter(pa.array(close(6, 8, part)))
                yield pa.RecordBatch.from_arrays(part.columns[:5], names=["a", "b", "ka", "kb", "eval_split"])

    links = both.select("a", "b", "ka", "kb", "eval_split", "aq", "ac", "bq", "bc").mapInArrow(verify, "a long, b long, ka string, kb string, eval_split string")
    return SplitOverlaps(same.select("rep", "k").distinct(), links)

"""Percentiles of large numeric columns by radix selection over order-preserving integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import counted_broadcast, materialize

DIGIT_BITS = 16
_TOP = np.uint64(1 << 63)


def to_ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers whose unsigned order is that of the values; both zeros are one."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def from_ordered(k: np.ndarray) -> np.ndarray:
    """The doubles that to_ordered maps to k."""
    k = np.asarray(k, np.uint64)
    return np.where(k & _TOP, k & ~_TOP, ~k).view(np.float64)


def ordered_keys(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups and key (ordered integer, as long) of every row whose value is a number; null and NaN are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = to_ordered(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(k.view(np.int64))], names=[*groups, "key"])

    kinds = dict(df.dtypes)
    rows = df.select(*groups, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    return rows.mapInArrow(run, ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", key long")


def digit_histogram(df: DataFrame, groups: list[str], value: str, digits: int = 2) -> DataFrame:
    """groups, prefix, n: counts of the leading digits (16 bits each) of the values.

    A partial result of fixed error: tables of separate partitions or days combine by union and
    summing n. With two digits a positive value is known to 2^-20 of itself.
    """
    prefix = F.shiftrightunsigned("key", 64 - DIGIT_BITS * digits) if digits < 4 else F.col("key")
    return ordered_keys(df, groups, value).groupBy(*groups, prefix.alias("prefix")).agg(F.count("*").alias("n"))


def _as_values(df: DataFrame, digits: int) -> DataFrame:
    """Adds value (middle of the values with that prefix) and bound (most it can be off) to a table with column prefix."""
    shift = 64 - DIGIT_BITS * digits
    names, kinds = df.columns, dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = b.column(names.index("prefix")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) << np.uint64(shift)
            lo = from_ordered(low)
            hi = from_ordered(low | np.uint64((1 << shift) - 1))
            mid = lo + (hi - lo) / 2
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mid), pa.array(hi - mid)], names=[*names, "value", "bound"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", value double, bound double")


def _choose(hist: DataFrame, targets: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Moves each target rank into the digit that holds it. hist: by, digit, n; the window is over at most 65,536 digits of a prefix."""
    w = Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("upto", F.sum("n").over(w))
    hit = targets.join(cum, by).where("rank < upto and rank >= upto - n")
    return hit.withColumn("rank", F.expr("rank - (upto - n)")).withColumn("prefix", F.expr(prefix)).drop("digit", "n", "upto")


def percentiles(df: DataFrame, groups: list[str], value: str, qs: list[float], levels: list[list[str]], digits: int = 4) -> DataFrame:
    """level, groups, n, q, value, bound: percentiles of each level's groups, linear between neighbouring values.

    levels: subsets of groups; level is the number of the subset and group columns outside it are
    null. digits: how many 16-bit digits are followed; with 4 the result is exact (bound 0),
    with fewer, bound is the most that it can be off. Null and NaN values don't count, groups
    without values have no row, groups whose own key is null are a group of their own.

    Each round counts one digit with map-side partial sums, keeps for each target rank the digit
    that holds it, and the next round reads only the values under the kept prefixes, a small part
    of the last; no group is ever sorted or collected, however large.
    """
    kinds = dict(df.dtypes)
    keys = materialize(ordered_keys(df, groups, value), "keys")
    by = ["level", *groups]
    each = [F.struct(F.lit(i).alias("level"), *[(F.col(g) if g in lv else F.lit(None).cast(kinds[g])).alias(g) for g in groups]) for i, lv in enumerate(levels)]
    nul = lambda d: d.select("level", *[F.struct(F.col(g)).alias(g) for g in groups], *[c for c in d.columns if c not in by])  # noqa: E731  null-safe join keys
    first = keys.groupBy(*groups, F.shiftrightunsigned("key", 48).alias("digit")).agg(F.count("*").alias("n"))
    hist = nul(first.select(F.explode(F.array(*each)).alias("g"), "digit", "n").select("g.*", "digit", "n")).groupBy(*by, "digit").agg(F.sum("n").alias("n"))
    hist = materialize(hist, "digits")
    total = hist.groupBy(*by).agg(F.sum("n").alias("total"))
    ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(up).alias("up")) for q in qs for up in (False, True)]))
    targets = total.select(*by, "total", ranks.alias("t")).select(*by, "total", "t.q", "t.up").withColumn("pos", F.expr("q * (total - 1)")).withColumn("rank", F.expr("if(up, ceil(pos), floor(pos))"))
    targets = materialize(_choose(hist, targets, by, "digit"), "targets")
    left = None  # level, groups and key of the values under the kept prefixes
    for d in range(2, digits + 1):
        shift = 64 - DIGIT_BITS * d
        if left is None:
            low = keys.select(F.explode(F.array(*each)).alias("g"), "key")
            low = nul(low.select("g.*", "key"))
        else:
            low = left
        low = low.select(*by, "key", F.shiftrightunsigned("key", shift + DIGIT_BITS).alias("prefix"), F.expr(f"shiftrightunsigned(key, {shift}) & 65535").alias("digit"))
        want = targets.select(*by, "prefix").distinct()
        side = counted_broadcast(want)
        if side is want:  # too many groups to broadcast: count first, so that the join sees counts and no hot group
            hist = low.groupBy(*by, "prefix", "digit").agg(F.count("*").alias("n")).join(want, [*by, "prefix"], "left_semi")
        else:
            low = low.join(side, [*by, "prefix"], "left_semi")
            if d < digits:  # the next round reads these only
                low = materialize(low, "left")
                left = low.select(*by, "key")
            hist = low.groupBy(*by, "prefix", "digit").agg(F.count("*").alias("n"))
        targets = materialize(_choose(hist, targets, [*by, "prefix"], f"shiftleft(prefix, {DIGIT_BITS}) | digit"), "targets")
    flat = _as_values(targets.select("level", *[F.col(f"{g}.{g}").alias(g) for g in groups], "total", "q", "up", "pos", "prefix"), digits)
    ends = flat.groupBy("level", *groups, "q", "total").agg(F.max("pos").alias("pos"), F.max(F.when(~F.col("up"), F.col("value"))).alias("a"), F.max(F.when(F.col("up"), F.col("value"))).alias("b"), F.max("bound").alias("bound"))
    return ends.select("level", *groups, F.col("total").alias("n"), "q", F.expr("a + (b - a) * (pos - floor(pos))").alias("value"), "bound")


def percentiles_of_histogram(hist: DataFrame, groups: list[str], qs: list[float], digits: int = 2) -> DataFrame:
    """groups, n, q, value, bound from (combined) digit_histogram tables."""
    h = hist.groupBy(*groups, "prefix").agg(F.sum("n").alias("n"))
    total = h.groupBy(*groups).agg(F.sum("n").alias("total"))
    w = Window.partitionBy(*groups).orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = h.withColumn("upto", F.sum("n").over(w)).drop("n").withColumn("before", F.coalesce(F.lag("upto").over(Window.partitionBy(*groups).orderBy("prefix")), F.lit(0)))
    t = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(up).alias("up")) for q in qs for up in (False, True)]))
    targets = total.select(*groups, "total", t.alias("t")).select(*groups, "total", "t.q", "t.up").withColumn("pos", F.expr("q * (total - 1)")).withColumn("rank", F.expr("if(up, ceil(pos), floor(pos))"))
    hit = targets.join(cum, groups).where("rank < upto and rank >= before").select(*groups, "total", "q", "up", "pos", "prefix")
    flat = _as_values(hit, digits)
    ends = flat.groupBy(*groups, "q", "total").agg(F.max("pos").alias("pos"), F.max(F.when(~F.col("up"), F.col("value"))).alias("a"), F.max(F.when(F.col("up"), F.col("value"))).alias("b"), F.max("bound").alias("bound"))
    return ends.select(*groups, F.col("total").alias("n"), "q", F.expr("a + (b - a) * (pos - floor(pos))").alias("value"), "bound")


def samples(runs: DataFrame) -> DataFrame:
    """(benchmark_name, run_day, ms) of the measured samples: each run once (its earliest record, null times last), without null, NaN and negative samples."""
    one = runs.groupBy("run_id").agg(F.min(F.struct(F.col("recorded_at").isNull(), "recorded_at", "benchmark_name", "run_day", "latency_samples_ms")).alias("r"))
    return one.select("r.benchmark_name", "r.run_day", F.explode("r.latency_samples_ms").alias("ms")).where("ms is not null and not isnan(ms) and ms >= 0")


def disagreeing(runs: DataFrame, summaries: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(benchmark_name, run_day) of summaries whose p50_ms or p95_ms is off by more than tolerance of the exact percentile.

    A null percentile doesn't differ; neither does a summary of a day without measured samples.
    """
    p = percentiles(samples(runs), ["benchmark_name", "run_day"], "ms", [0.5, 0.95], [["benchmark_name", "run_day"]])
    wide = p.groupBy("benchmark_name", "run_day").agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > tolerance * F.abs(F.col(b)), F.lit(False))
    return summaries.join(wide, ["benchmark_name", "run_day"]).where(off("p50_ms", "p50") | off("p95_ms", "p95")).select("benchmark_name", "run_day").distinct()

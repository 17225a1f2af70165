"""Paired statistics: alignment, bootstrap, sign and McNemar tests, Holm correction, effect size, rank correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import average_ranks
from tessera.runtime import counted_broadcast, materialize, running_total

# Defaults of the resampling, and up to how many differences all sign vectors are tried.
REPLICATES, SEED, CONFIDENCE, BATCH, EXACT = 10_000, 42, 0.95, 256, 20
#: Means that differ by less count as equal.
SAME = 1e-12


def align(a: DataFrame, b: DataFrame, keys: str | list[str], value: str) -> DataFrame:
    """(keys, a, b, diff) of two tables with exactly the same unique keys; anything else is an error when it runs."""
    keys = [keys] if isinstance(keys, str) else keys
    x = a.groupBy(*keys).agg(F.count("*").alias("__na"), F.first(value).alias("a"))
    y = b.groupBy(*keys).agg(F.count("*").alias("__nb"), F.first(value).alias("b"))
    both = x.join(y, keys, "full_outer")
    bad = F.col("__na").isNull() | F.col("__nb").isNull() | (F.col("__na") > 1) | (F.col("__nb") > 1)
    checked = F.when(bad, F.raise_error(F.lit("the two runs must have the same unique ids"))).otherwise(F.col("a"))
    return both.select(*keys, checked.alias("a"), "b").withColumn("diff", F.col("a") - F.col("b"))


def shared_population(values: DataFrame, key: str, run: str, reference: str) -> DataFrame:
    """(key, run) of the keys that a run and the reference both have, for each other run; the reference's own rows aren't listed."""
    ref = values.where(F.col(run) == reference).select(key).distinct()
    return values.where(F.col(run) != reference).select(key, run).distinct().join(ref, key, "left_semi")


def against_reference(values: DataFrame, key: str, run: str, metric: str, value: str, reference: str, shared: bool = False) -> DataFrame:
    """(key, run, metric, a, b, diff) of every other run against the reference.

    The populations must be the same, each key once, or it is an error when it runs. With shared,
    each run is compared over the keys that it shares with the reference, and nothing is said about
    the others (see populations).
    """
    runs = values.where(F.col(run) != reference).select(run).distinct()
    other = values.where(F.col(run) != reference)
    ref = values.where(F.col(run) == reference).drop(run).crossJoin(F.broadcast(runs))  # one row a run
    if shared:
        both = shared_population(values, key, run, reference)
        other, ref = other.join(both, [key, run], "left_semi"), ref.join(both, [key, run], "left_semi")
    return align(other, ref, [key, run, metric], value)


def populations(values: DataFrame, key: str, run: str, reference: str) -> DataFrame:
    """(run, n_shared, n_only_run, n_only_reference): how the keys of each other run and the reference overlap."""
    n = values.where(F.col(run) == reference).select(F.count_distinct(key).alias("n_ref"))
    both = shared_population(values, key, run, reference).groupBy(run).agg(F.count("*").alias("n_shared"))
    own = values.where(F.col(run) != reference).groupBy(run).agg(F.count_distinct(key).alias("n_own"))
    got = own.join(both, run, "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0))).crossJoin(F.broadcast(n))
    return got.select(run, "n_shared", (F.col("n_own") - F.col("n_shared")).alias("n_only_run"), (F.col("n_ref") - F.col("n_shared")).alias("n_only_reference"))


def relative_delta(reference: Column, other: Column) -> Column:
    """(other - reference) / |reference|, null for a zero reference."""
    return (other - reference) / F.nullif(F.abs(reference), F.lit(0.0))


def effect_size(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean_diff, effect: mean difference by its sample deviation; without deviation 0 or infinite."""
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd"))
    flat = F.when(F.col("mean_diff") == 0, 0.0).otherwise(F.signum("mean_diff") * F.lit(float("inf")))
    return g.select(*by, "n", "mean_diff", F.when((F.col("n") < 2) | (F.coalesce("sd", F.lit(0.0)) == 0), flat).otherwise(F.col("mean_diff") / F.col("sd")).alias("effect"))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, only_a, only_b, p_value: exact two-sided test on the discordant pairs of two 0/1 columns a and b."""
    zero_one = F.col("a").isin(0.0, 1.0) & F.col("b").isin(0.0, 1.0)
    a = F.when(zero_one, F.col("a")).otherwise(F.raise_error(F.lit("the outcomes must be 0 or 1")))
    g = pairs.groupBy(*by).agg(F.count(F.when((a == 1) & (F.col("b") == 0), 1)).alias("only_a"), F.count(F.when((a == 0) & (F.col("b") == 1), 1)).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # log of C(n, i) / 2^n, built up term by term from i = 0
    fold = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k), F.struct((-n * math.log(2.0)).cast("double").alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] + F.log((n - i) / (i + 1.0))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")), lambda s: s["sum"],
    )
    return g.select(*by, "only_a", "only_b", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * fold)).alias("p_value"))


def holm(df: DataFrame, p: str = "p_value", order: list[str] | None = None, by: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """df with step-down corrected p-values over each family (by, or all rows); ties in the given order. A family's rows are one comparison plan, so few."""
    w = Window.partitionBy(*(by or [])).orderBy(p, *(order or []))
    m = F.count("*").over(Window.partitionBy(*(by or [])))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("__s", step).withColumn(out, F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def hash_bits(*parts: Column) -> Column:
    """An integer of 32 bits from the MD5 of the parts: the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def draw(df: DataFrame, rep: str, slot: str, seed: int, out: str) -> DataFrame:
    """df with a 32-bit integer fixed by seed, replicate and slot: multiplications and shifts of 64-bit integers, the same on any engine."""
    x = df.withColumn(out, F.expr(f"(bigint({rep}) * 1000003L + bigint({slot}) * 998244353L + {seed * 7919}L) & 4294967295L"))
    for _ in range(2):
        x = x.withColumn(out, F.expr(f"(({out} ^ shiftright({out}, 16)) * 73244475L) & 4294967295L"))
    return x.withColumn(out, F.expr(f"{out} ^ shiftright({out}, 16)"))


def _over_tasks(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session's shuffles have: few bytes, but each row is resampled thousands of times."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bootstrap_hash(values: DataFrame, by: list[str], key: str, value: str, replicates: int = 200, seed: int = SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """by, n, mean, low, high: percentile interval of the mean over resamples whose draws any engine repeats (see draw).

    Values are numbered in the order of key, without a group in one task. Draws are made where the
    numbers are; they look their values up in a broadcast (if there are few, else by a shuffle),
    and sums of a replicate combine before the shuffle, so only replicates x tasks rows travel.
    """
    v = materialize(running_total(values.select(*by, key, F.col(value).alias("v")), by, key, out="ord").select(*by, "ord", "v"), "numbered")
    n = v.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    draws = _over_tasks(v).select(*by, F.col("ord").alias("slot")).join(F.broadcast(n.select(*by, "n")), by).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))  # n: one row a comparison
    draws = draw(draws, "rep", "slot", seed, "x").select(*by, "rep", (F.col("x") % F.col("n")).alias("ord"))
    means = draws.join(counted_broadcast(v), [*by, "ord"]).groupBy(*by, "rep").agg(F.avg("v").alias("m"))
    tail = (1 - confidence) / 2
    ends = means.groupBy(*by).agg(F.expr(f"percentile(m, {tail})").alias("low"), F.expr(f"percentile(m, {1 - tail})").alias("high"))  # over the replicates
    return n.join(ends, by).select(*by, "n", "mean", "low", "high")


def _confidence(c: float) -> float:
    f = c / 100 if c > 1 else c
    if not 0 < f < 1:
        raise ValueError("confidence must be a share or a percentage")
    return f


def bootstrap_exact(values: DataFrame, by: list[str], order: str, value: str, replicates: int = REPLICATES, seed: int = SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """by, n, mean, low, high: percentile interval by NumPy's generator in batches of BATCH replicates; values in the given order. A group must fit one task: one run's examples."""
    c = _confidence(confidence)
    kinds = dict(values.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        if not len(x) or not np.isfinite(x).all():
            raise ValueError("values must be finite")
        rng = np.random.default_rng(seed)
        means = np.concatenate([x[rng.integers(0, len(x), (min(BATCH, replicates - at), len(x)))].mean(1) for at in range(0, replicates, BATCH)])
        low, high = np.quantile(means, [(1 - c) / 2, 1 - (1 - c) / 2])
        return pd.DataFrame([[*key, len(x), x.mean(), low, high]], columns=[*by, "n", "mean", "low", "high"])

    return values.select(*by, order, value).groupBy(*by).applyInPandas(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", n long, mean double, low double, high double")


def sign_test_hash(pairs: DataFrame, by: list[str], key: str, replicates: int = 500, seed: int = SEED) -> DataFrame:
    """by, n, p_value: Monte-Carlo random-sign test of mean difference 0 with the signs of draw and add-one smoothing.

    Sums of a replicate combine before the shuffle.
    """
    v = materialize(running_total(pairs.select(*by, key, "diff"), by, key, out="ord").select(*by, "ord", "diff"), "numbered")
    obs = v.groupBy(*by).agg(F.count("*").alias("n"), F.abs(F.avg("diff")).alias("obs"))
    flips = draw(_over_tasks(v).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))), "rep", "ord", seed, "x")
    means = flips.groupBy(*by, "rep").agg(F.abs(F.avg(F.when(F.col("x") % 2 == 0, F.col("diff")).otherwise(-F.col("diff")))).alias("m"))
    return means.join(F.broadcast(obs), by).groupBy(*by).agg(F.max("n").alias("n"), ((F.count(F.when(F.col("m") >= F.col("obs") - SAME, 1)) + 1) / (replicates + 1)).alias("p_value"))


def sign_test_exact(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, p_value over all sign vectors, for groups of at most EXACT differences; others have no row.

    A vector is the bits of a number; its mean is a fold over the group's few differences.
    """
    few = pairs.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") <= EXACT)
    d = pairs.join(F.broadcast(few), by).groupBy(*by, "n").agg(F.collect_list("diff").alias("d"))  # at most EXACT numbers
    each = d.withColumn("bits", F.explode(F.expr("sequence(0L, shiftleft(1L, int(n)) - 1)")))
    total = F.expr("aggregate(d, named_struct('s', 0.0D, 'b', bits), (a, x) -> named_struct('s', a.s + if(a.b & 1 = 1, x, -x), 'b', shiftright(a.b, 1)), a -> abs(a.s) / n)")
    obs = F.expr("abs(aggregate(d, 0.0D, (a, x) -> a + x)) / n")
    return each.groupBy(*by).agg(F.max("n").alias("n"), F.avg(F.when(total >= obs - SAME, 1.0).otherwise(0.0)).alias("p_value"))


def sign_test(diffs: list[float] | np.ndarray, replicates: int = REPLICATES, seed: int = SEED, exact: int = EXACT) -> float:
    """p-value of mean 0 under random signs: all sign vectors up to `exact` values, else Monte-Carlo with add-one smoothing.

    The Monte-Carlo signs are 8-bit integers drawn in batches of BATCH vectors: width and batch are
    fixed values, as the generator's stream depends on them.
    """
    d = np.asarray(diffs, float)
    if not len(d) or not np.isfinite(d).all():
        raise ValueError("differences must be finite")
    if len(d) <= exact:
        sums = np.zeros(1)
        for x in d:  # each value doubles the number of vectors
            sums = np.concatenate([sums - x, sums + x])
        return float((np.abs(sums) >= abs(d.sum()) - SAME * len(d)).mean())
    rng, least = np.random.default_rng(seed), abs(d.mean()) - 1e-15
    sizes = np.diff(np.append(np.arange(0, replicates, BATCH), replicates))
    hits = sum(int((np.abs((np.where(rng.integers(0, 2, (m, len(d)), dtype=np.int8) == 1, 1.0, -1.0) * d).mean(1)) >= least).sum()) for m in sizes)
    return (hits + 1) / (replicates + 1)


def sign_test_groups(pairs: DataFrame, by: list[str], key: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """by, n, p_value of sign_test for each group; a group is one comparison's examples."""
    kinds = dict(pairs.dtypes)
    run = lambda k, pdf: pd.DataFrame([[*k, len(pdf), sign_test(pdf.sort_values(key)["diff"].to_numpy(), replicates, seed)]], columns=[*by, "n", "p_value"])
    return pairs.select(*by, key, "diff").groupBy(*by).applyInPandas(lambda k, pdf: run(k, pdf), ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", n long, p_value double")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho: correlation of average ranks, 0 without variance."""
    r = average_ranks(average_ranks(df.select(*by, x, y), x, "__rx", by), y, "__ry", by)
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.stddev_pop("__rx") == 0) | (F.stddev_pop("__ry") == 0), 0.0).otherwise(F.corr("__rx", "__ry")).alias("rho"))


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along the last axis, equal values sharing their mean rank."""
    order = np.argsort(x, axis=-1, kind="stable")
    s = np.take_along_axis(x, order, -1)
    new = np.concatenate([np.ones((*s.shape[:-1], 1), bool), s[..., 1:] != s[..., :-1]], -1)
    place = np.broadcast_to(np.arange(s.shape[-1]), s.shape)
    first = np.maximum.accumulate(np.where(new, place, 0), -1)
    last = np.flip(np.minimum.accumulate(np.flip(np.where(np.concatenate([new[..., 1:], np.ones((*s.shape[:-1], 1), bool)], -1), place, s.shape[-1]), -1), -1), -1)
    out = np.empty(s.shape)
    np.put_along_axis(out, order, (first + last) / 2, -1)
    return out


def _correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    rx, ry = _average_ranks(x), _average_ranks(y)
    rx, ry = rx - rx.mean(-1, keepdims=True), ry - ry.mean(-1, keepdims=True)
    scale = np.sqrt((rx * rx).sum(-1) * (ry * ry).sum(-1))
    return np.where(scale > 0, (rx * ry).sum(-1) / np.where(scale > 0, scale, 1.0), 0.0)


def spearman_interval(df: DataFrame, x: str, y: str, by: list[str], order: str, replicates: int = REPLICATES, seed: int = SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """by, n, rho, low, high: rank correlation with a percentile interval over resampled pairs, one draw of NumPy's generator a replicate.

    Null and NaN pairs are left out. A group must fit one task: one run's examples.
    """
    c = _confidence(confidence)
    kinds = dict(df.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        rng = np.random.default_rng(seed)
        got = []
        for at in range(0, replicates, 64):
            i = np.stack([rng.integers(0, len(a), len(a)) for _ in range(min(64, replicates - at))])
            got.append(_correlations(a[i], b[i]))
        low, high = np.quantile(np.concatenate(got), [(1 - c) / 2, 1 - (1 - c) / 2])
        return pd.DataFrame([[*key, len(a), float(_correlations(a, b)), low, high]], columns=[*by, "n", "rho", "low", "high"])

    rows = df.select(*by, order, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", n long, rho double, low double, high double")


def comparison_table(values: DataFrame, key: str, run: str, metric: str, value: str, reference: str, binary: tuple[str, ...] = ("em",), replicates: int = REPLICATES, seed: int = SEED, shared: bool = False) -> DataFrame:
    """One row for each other run and metric: n, means, absolute and relative delta (run - reference), interval of the mean delta, effect, test, p_value, p_holm over all rows.

    values: (key, run, metric, value), each (key, run, metric) once. Binary metrics get McNemar's
    test, others the random-sign test. The runs must have the same keys, or it is an error; with
    shared, pairs are the keys that a run and the reference both have.
    """
    p = materialize(against_reference(values, key, run, metric, value, reference, shared), "pairs")  # five aggregations read it
    by = [run, metric]
    means = p.groupBy(*by).agg(F.avg("a").alias("mean"), F.avg("b").alias("reference_mean"))
    ci = bootstrap_hash(p, by, key, "diff", replicates, seed).select(*by, "n", F.col("mean").alias("delta"), "low", "high")
    eff = effect_size(p, by).select(*by, "effect")
    tests = sign_test_hash(p.where(~F.col(metric).isin(*binary)), by, key, replicates, seed).select(*by, F.lit("random sign").alias("test"), "p_value")
    tests = tests.unionByName(mcnemar(p.where(F.col(metric).isin(*binary)), by).select(*by, F.lit("mcnemar").alias("test"), "p_value"))
    rows = means.join(ci, by).join(eff, by).join(tests, by).withColumn("relative_delta", relative_delta(F.col("reference_mean"), F.col("mean")))
    return holm(rows, order=by).select(*by, "n", "mean", "reference_mean", "delta", "relative_delta", "low", "high", "effect", "test", "p_value", "p_holm")

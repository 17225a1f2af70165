"""Latency summaries, timing of Spark actions, and registry tables."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialize, running_total


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, sample_count, mean_ms, std_ms (population), p50_ms, p95_ms (linear), min_ms, max_ms. Negative samples are an error; nulls and NaN aren't samples.

    Equal samples are counted first and the counts summed up over ranges of values, so that the
    percentiles of a large group aren't found in one task.
    """
    v = F.when(F.col(value) < 0, F.raise_error(F.lit("latency samples must not be negative"))).otherwise(F.col(value))
    s = samples.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, v.alias("v"))
    s = materialize(s.groupBy(*by, "v").agg(F.count("*").alias("c")), "counted")
    whole = s.groupBy(*by).agg(F.sum("c").alias("sample_count"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_ms"), F.min("v").alias("min_ms"), F.max("v").alias("max_ms"))
    spread_ = s.join(F.broadcast(whole.select(*by, "mean_ms")), by).groupBy(*by).agg(F.sqrt(F.sum((F.col("v") - F.col("mean_ms")) ** 2 * F.col("c")) / F.sum("c")).alias("std_ms")) if by else s.crossJoin(F.broadcast(whole.select("mean_ms"))).agg(F.sqrt(F.sum((F.col("v") - F.col("mean_ms")) ** 2 * F.col("c")) / F.sum("c")).alias("std_ms"))
    at = running_total(s, by, "v", "c", "before").join(whole.select(*by, "sample_count"), by)
    end = lambda q, f: F.max(F.when(F.expr(f"before <= {f}({q} * (sample_count - 1)) and before + c > {f}({q} * (sample_count - 1))"), F.col("v")))
    part = lambda q: F.expr(f"{q} * (max(sample_count) - 1) - floor({q} * (max(sample_count) - 1))")
    p = at.groupBy(*by).agg(*[(end(q, "floor") + (end(q, "ceil") - end(q, "floor")) * part(q)).alias(name) for q, name in ((0.5, "p50_ms"), (0.95, "p95_ms"))])
    return whole.join(spread_, by).join(p, by).select(*by, "sample_count", "mean_ms", "std_ms", "p50_ms", "p95_ms", "min_ms", "max_ms")


def latency_rows(results: DataFrame, name: str, samples: str, metadata: list[str] = ()) -> DataFrame:
    """(metadata..., benchmark, sample_index, latency_ms): a row for each sample of each result, in order. Metadata must not be named like these."""
    own = ("benchmark", "sample_index", "latency_ms")
    if clash := sorted(set(metadata) & set(own)):
        raise ValueError(f"metadata named like a column of the table: {', '.join(clash)}")
    return results.select(*metadata, F.col(name).alias("benchmark"), F.posexplode(samples).alias("sample_index", "latency_ms"))


def breakdown(summary: DataFrame, by: list[str], parts: list[str], total: str) -> DataFrame:
    """by, component, value, share: the parts of a total as rows."""
    long = summary.unpivot([*by, total], parts, "component", "value")
    return long.select(*by, "component", "value", F.when(F.col(total) == 0, 0.0).otherwise(F.col("value") / F.col(total)).alias("share"))


def against_baseline(summary: DataFrame, by: str, baseline: str, metrics: list[str]) -> DataFrame:
    """summary with <metric>_delta to the baseline's row; null without a baseline row. One row a method."""
    base = summary.where(F.col(by) == baseline).select(*[F.col(m).alias(f"__{m}") for m in metrics]).limit(1)
    return summary.join(F.broadcast(base), F.lit(True), "left").select(*summary.columns, *[(F.col(m) - F.col(f"__{m}")).alias(f"{m}_delta") for m in metrics])


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """registry with rows added, or put in place of those with the same key; repeated keys in rows are an error."""
    n = F.count("*").over(Window.partitionBy(key))
    new = rows.withColumn("__n", n).withColumn(key, F.when(F.col("__n") > 1, F.raise_error(F.lit("repeated key"))).otherwise(F.col(key))).drop("__n")
    return registry.join(rows.select(key), key, "left_anti").select(*registry.columns).unionByName(new, allowMissingColumns=True)


def next_id(registry: DataFrame, key: str, prefix: str) -> str:
    """The next free identifier prefix001, prefix002, and so on."""
    top = registry.agg(F.max(F.regexp_extract(key, rf"^{prefix}(\d+)$", 1).try_cast("int"))).first()[0]
    return f"{prefix}{(top or 0) + 1:03d}"


class PeakMemory:
    """Largest resident memory of this process in MB between start() and stop(), sampled by a thread."""

    def __init__(self, every: float = 0.01) -> None:
        self.every, self.peak, self._stop = every, 0.0, threading.Event()

    def _rss(self) -> float:
        with open("/proc/self/status") as f:
            return next((int(x.split()[1]) / 1024 for x in f if x.startswith("VmRSS")), 0.0)

    def start(self) -> "PeakMemory":
        def loop() -> None:
            while not self._stop.wait(self.every):
                self.peak = max(self.peak, self._rss())

        self.peak = self._rss()
        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> float:
        self._stop.set()
        self._thread.join()
        return self.peak


def measure(action: Callable[[], object], warmup: int = 1, repetitions: int = 3, clock: Callable[[], float] = time.perf_counter) -> list[float]:
    """Milliseconds of each repetition of an action, after the warm-up runs."""
    if repetitions < 1 or warmup < 0:
        raise ValueError("at least one repetition and no negative warm-up")
    for _ in range(warmup):
        action()
    out = []
    for _ in range(repetitions):
        t = clock()
        action()
        out.append((clock() - t) * 1000)
    return out

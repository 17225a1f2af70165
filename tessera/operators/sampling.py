"""Stratified samples, split checks and ordered id hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.stats import hash_bits


def allocation(strata: DataFrame, size: int, label: str = "stratum", seen: str | None = None) -> DataFrame:
    """(label, n, take): proportional shares of a sample of `size` by largest remainder. strata: a row for each record.

    Ties go to the label seen first, by the smallest value of the ordinal column `seen`; without one, to the smaller label.
    """
    n = strata.groupBy(label).agg(F.count("*").alias("n"), (F.min(seen) if seen else F.lit(0)).alias("seen"))
    total = n.agg(F.sum("n").alias("total"))
    if size < 0:
        raise ValueError("size must not be negative")
    exact = n.crossJoin(F.broadcast(total)).withColumn("floor", F.expr(f"cast(floor(n * {size} / total) as long)")).withColumn("rest", F.expr(f"(n * {size}) % total"))
    left = F.lit(size) - F.sum("floor").over(Window.partitionBy())
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), "seen", label))
    return exact.withColumn("left", left).withColumn("place", place).select(label, "n", (F.col("floor") + (F.col("place") <= F.col("left")).cast("long")).alias("take"))


def stratified_sample(records: DataFrame, key: str, label: str, size: int, seed: int = 42) -> DataFrame:
    """(key, label) of a proportional sample: in each stratum the keys of smallest hash. Each stratum's window keeps only its share, so it prunes before the shuffle where Spark can."""
    take = allocation(records, size, label)
    w = Window.partitionBy(label).orderBy(hash_bits(F.lit(seed), F.col(key)), key)
    return records.select(key, label).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).join(F.broadcast(take.select(label, "take")), label).where("__r <= take").select(key, label)


def label_of(*columns: str):
    """Stratum label: JSON list of the columns."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def duplicates(records: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def shared_between_splits(records: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, splits) of keys that occur in more than one split; empty if the splits are disjoint."""
    return records.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def ordered_ids_sha256(records: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """by, n, sha256 of the JSON list of keys in the given order.

    A hash of one document has to be computed in one go; the sorted keys stream through it, so no list is ever held.
    """
    kinds = dict(records.dtypes)
    names = [*by, "n", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, h = None, 0, None

        def done() -> pa.RecordBatch:
            h.update(b"]")
            return pa.RecordBatch.from_arrays([*(pa.array([x], types[i]) for i, x in enumerate(now)), pa.array([n], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=names)

        for b in batches:
            types = [b.column(i).type for i in range(len(by))]
            for row in zip(*(b.column(i).to_pylist() for i in range(len(by) + 1))):
                if h is None or row[:-1] != now:
                    if h is not None:
                        yield done()
                    now, n, h = row[:-1], 0, hashlib.sha256(b"[")
                h.update((b"," if n else b"") + json.dumps(row[-1], ensure_ascii=False).encode())
                n += 1
        if h is not None:
            yield done()

    rows = records.select(*by, F.col(order).alias("__o"), F.col(key).cast("string").alias("__k")).repartition(*by).sortWithinPartitions(*by, "__o", "__k").select(*by, "__k")
    return rows.mapInArrow(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", n long, sha256 string")

"""Manifests, protocol comparisons and check reports: small driver-side documents bound to data by hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import canonical_sha256

MANIFEST_VERSION = 2
REPORT = "check string, passed boolean, details string"


def freeze(config: dict, identity: dict) -> dict:
    """A manifest of a resolved configuration and of what it was chosen on, with the hash of both."""
    body = {"schema_version": MANIFEST_VERSION, "config": config, "identity": identity}
    return {**body, "sha256": canonical_sha256(body)}


def verify_frozen(manifest: dict) -> None:
    """Raises ValueError unless the manifest has the right version and its hash fits."""
    body = {k: v for k, v in manifest.items() if k != "sha256"}
    if body.get("schema_version") != MANIFEST_VERSION or canonical_sha256(body) != manifest.get("sha256"):
        raise ValueError("the manifest was changed or is of another version")


def differences(a: dict, b: dict, prefix: str = "") -> dict[str, tuple[Any, Any]]:
    """Dotted paths at which two configurations differ."""
    out: dict[str, tuple[Any, Any]] = {}
    for k in sorted({*a, *b}, key=str):
        x, y, path = a.get(k), b.get(k), f"{prefix}{k}"
        if isinstance(x, dict) and isinstance(y, dict):
            out |= differences(x, y, f"{path}.")
        elif x != y:
            out[path] = (x, y)
    return out


def only_allowed(a: dict, b: dict, allowed: Iterable[str]) -> None:
    """Raises ValueError if the configurations differ anywhere else than under the allowed paths."""
    allow = tuple(allowed)
    bad = [p for p in differences(a, b) if not any(p == x or p.startswith(f"{x}.") for x in allow)]
    if bad:
        raise ValueError(f"these settings must not differ: {', '.join(bad)}")


def run_id(family: str, variation: dict, frozen_sha256: str) -> str:
    """Identifier of a run, fixed by its family, variation and frozen manifest."""
    return f"{family}-{canonical_sha256({'family': family, 'variation': variation, 'frozen': frozen_sha256})[:12]}"


def constant_fields(rows: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """by, field, n_values: how many different values (nulls count as one) each field has; a fair comparison has 1 everywhere."""
    one = rows.groupBy(*(by or [])).agg(*[F.countDistinct(F.to_json(F.struct(f))).alias(f) for f in fields])
    return one.unpivot(by or [], fields, "field", "n_values")


def report(spark: SparkSession, checks: list[tuple[str, bool, str]]) -> DataFrame:
    """(check, passed, details) rows."""
    return spark.createDataFrame(checks, REPORT)


def split_checks(records: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Check rows: keys not null, unique within a split, and in one split only, each counted over all rows."""
    n = records.groupBy(key, split).agg(F.count("*").alias("n"))
    per = n.groupBy(key).agg(F.max("n").alias("n"), F.count("*").alias("splits"))
    a = per.agg(F.count(F.when(F.col(key).isNull(), 1)).alias("null_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"), F.count(F.when(F.col("splits") > 1, 1)).alias("shared_keys"))
    return a.unpivot([], ["null_keys", "repeated_keys", "shared_keys"], "check", "n_bad").select("check", (F.col("n_bad") == 0).alias("passed"), F.col("n_bad").cast("string").alias("details"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def valid_experiment_id(value: str) -> bool:
    """EXP or DBG and at least three digits."""
    return re.fullmatch(r"(EXP|DBG)\d{3,}", value) is not None


def require_empty(path: str) -> None:
    """Raises FileExistsError if an output folder exists and holds anything."""
    p = Path(path)
    if p.exists() and any(p.iterdir()):
        raise FileExistsError(f"{path} isn't empty")


STAGES: dict[str, tuple[str, ...]] = {
    # stage: stages that must be complete before it
    "splits": (), "development_packing": ("splits",), "development_generation": ("development_packing",), "freeze": ("development_generation",),
    "final_main": ("freeze",), "statistics": ("final_main",), "error_analysis": ("final_main",), "robustness": ("final_main",), "retrieval": ("freeze",), "systems": ("final_main",), "report": ("statistics", "error_analysis", "robustness", "retrieval", "systems"),
}


def stage_order(stages: dict[str, tuple[str, ...]] = STAGES) -> list[str]:
    """The stages so that each comes after those it needs; unknown needs and cycles are errors."""
    done: list[str] = []
    todo = dict(stages)
    while todo:
        ready = [s for s, need in todo.items() if all(n in done for n in need)]
        if not ready:
            raise ValueError(f"these stages wait for each other or for unknown ones: {', '.join(todo)}")
        done += ready
        for s in ready:
            del todo[s]
    return done


def reproducibility_checks(spark: SparkSession, first: DataFrame, second: DataFrame, key: str, metrics: list[str], settings: dict[str, Any] | None = None) -> DataFrame:
    """Check rows for two runs: the same ids, no repeated ids, the metrics present and not null, settings as given, and equal metric values."""
    checks: list[tuple[str, bool, str]] = []
    for name, df in (("first", first), ("second", second)):
        missing = [m for m in metrics if m not in df.columns]
        checks.append((f"{name} has its metrics", not missing, ", ".join(missing)))
        a = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"), *[F.count(m).alias(m) for m in metrics if m in df.columns]).first()
        checks.append((f"{name} has unique ids", a["n"] == a["k"], f"{a['n']} rows, {a['k']} ids"))
        checks.append((f"{name} has no null metric", all(a[m] == a["n"] for m in metrics if m in df.columns), ""))
        for s, want in (settings or {}).items():
            bad = df.where(~F.col(s).eqNullSafe(F.lit(want))).limit(1).count()
            checks.append((f"{name} has {s} as fixed", not bad, str(want)))
    x, y = first.select(key).distinct(), second.select(key).distinct()
    lost = x.join(y, key, "left_anti").count() + y.join(x, key, "left_anti").count()
    checks.append(("the ids are the same", lost == 0, f"{lost} in one run only"))
    common = [m for m in metrics if m in first.columns and m in second.columns]
    off = first.select(key, *common).exceptAll(second.select(key, *common)).count()
    checks.append(("the metrics are the same", off == 0, f"{off} rows differ"))
    return report(spark, checks)


def union_runs(runs: list[DataFrame], same: list[str], unique: str, order: list[str]) -> DataFrame:
    """All run summaries as one table, sorted by the order columns as strings; differing `same` columns or a repeated `unique` value are errors when it runs."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    bad = out.agg((F.countDistinct(F.to_json(F.struct(*same))) > 1).alias("differ"), (F.countDistinct(unique) < F.count("*")).alias("repeated"))
    checked = out.crossJoin(F.broadcast(bad))  # one row
    ok = F.when(F.col("differ"), F.raise_error(F.lit("the runs are of different protocols"))).when(F.col("repeated"), F.raise_error(F.lit("a run is repeated"))).otherwise(F.col(unique))
    return checked.withColumn(unique, ok).drop("differ", "repeated").orderBy(*[F.col(c).cast("string") for c in order])

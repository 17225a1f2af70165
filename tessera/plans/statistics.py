"""A statistics plan: runs of predictions, checked against one protocol, as tables of means and of paired comparisons."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import canonical_sha256
from tessera.operators import stats
from tessera.runtime import materialize

#: Metrics that predictions may have; the first is binary and gets McNemar's test.
METRICS = ("answer_em", "answer_f1", "support_em", "support_precision", "support_recall", "support_f1", "coverage_at_budget", "evidence_tokens")


def check_plan(plan: dict[str, Any], few_replicates: bool = False) -> dict[str, Any]:
    """The plan with its defaults filled in; anything missing, repeated or out of range raises ValueError.

    plan: runs (a list of {config_id, method, predictions}, the first is the reference), metrics,
    num_examples, protocol (settings that all runs share), and optionally bootstrap_replicates,
    permutation_replicates, confidence_level, seed, holm_bonferroni. few_replicates allows less
    than the published number of replicates.
    """
    p = {"metrics": list(METRICS[:2]), "bootstrap_replicates": stats.REPLICATES, "permutation_replicates": stats.REPLICATES, "confidence_level": stats.CONFIDENCE, "seed": stats.SEED, "holm_bonferroni": False, "protocol": {}, **plan}
    runs = p.get("runs") or []
    if len(runs) < 2 or any(not isinstance(r.get(k), str) or not r[k].strip() for r in runs for k in ("config_id", "method", "predictions")):
        raise ValueError("a plan needs a reference and another run, each with config_id, method and predictions")
    if len({r["config_id"] for r in runs}) < len(runs):
        raise ValueError("config_id must differ between runs")
    if not p["metrics"] or len(set(p["metrics"])) < len(p["metrics"]) or set(p["metrics"]) - set(METRICS):
        raise ValueError(f"metrics must be different ones of {', '.join(METRICS)}")
    if not isinstance(p.get("num_examples"), int) or isinstance(p["num_examples"], bool) or p["num_examples"] <= 0:
        raise ValueError("num_examples must be a positive whole number")
    least = 1 if few_replicates else stats.REPLICATES
    if min(p["bootstrap_replicates"], p["permutation_replicates"]) < least:
        raise ValueError(f"at least {least} replicates are needed")
    if not 0 < p["confidence_level"] < 1:
        raise ValueError("confidence_level must lie between 0 and 1")
    return p


def load_runs(spark: SparkSession, plan: dict[str, Any]) -> DataFrame:
    """(example_id, config_id, ordinal, metric, value) of all runs of a checked plan; ordinal keeps the predictions' order, in which resampling draws.

    Predictions are JSON lines (or a Parquet folder) with example_id, method, the metrics and the
    protocol's fields. Another number of rows, another method or protocol, a missing id or a value
    that is no finite number is an error when it runs.
    """
    out = None
    for r in plan["runs"]:
        df = spark.read.parquet(r["predictions"]) if r["predictions"].endswith(".parquet") else spark.read.json(r["predictions"])
        missing = [c for c in ("example_id", "method", *plan["metrics"], *plan["protocol"]) if c not in df.columns]
        if missing:
            raise ValueError(f"{r['config_id']} lacks {', '.join(missing)}")
        n = df.count()
        if n != plan["num_examples"]:
            raise ValueError(f"{r['config_id']} has {n} predictions, not {plan['num_examples']}")
        same = (F.col("method") == r["method"]) & F.coalesce(F.col("example_id") != "", F.lit(False))
        for k, v in plan["protocol"].items():
            same = same & F.col(k).eqNullSafe(F.lit(v))
        key = F.when(F.coalesce(same, F.lit(False)), F.col("example_id")).otherwise(F.raise_error(F.lit(f"a prediction of {r['config_id']} has no id, or another method or protocol")))
        df = df.select(key.alias("example_id"), F.lit(r["config_id"]).alias("config_id"), F.monotonically_increasing_id().alias("ordinal"), *[F.col(m).cast("double").alias(m) for m in plan["metrics"]])
        long = df.unpivot(["example_id", "config_id", "ordinal"], list(plan["metrics"]), "metric", "value")
        out = long if out is None else out.unionByName(long)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return out.withColumn("value", F.when(finite, F.col("value")).otherwise(F.raise_error(F.concat(F.col("config_id"), F.lit(" has a metric that is no finite number")))))


def method_table(values: DataFrame, plan: dict[str, Any]) -> DataFrame:
    """(config_id, metric, n, mean, low, high) of every run: means with resampled intervals."""
    return stats.bootstrap_exact(values, ["config_id", "metric"], "ordinal", "value", plan["bootstrap_replicates"], plan["seed"], plan["confidence_level"])


def paired_table(values: DataFrame, plan: dict[str, Any]) -> DataFrame:
    """One row for each other run and metric against the reference: n, means, deltas, interval, test, counts of discordant pairs, p_value, p_holm (null unless asked for), significant.

    The runs must have the same examples; pairs are in the order of the other run's predictions.
    """
    reference, by = plan["runs"][0]["config_id"], ["config_id", "metric"]
    order = values.select("example_id", *by, "ordinal")
    p = stats.against_reference(values.drop("ordinal"), "example_id", "config_id", "metric", "value", reference)
    p = materialize(p.join(order, ["example_id", *by]), "pairs")
    binary = F.col("metric") == METRICS[0]
    means = p.groupBy(*by).agg(F.avg("b").alias("reference_mean"), F.avg("a").alias("mean"))
    ci = stats.bootstrap_exact(p, by, "ordinal", "diff", plan["bootstrap_replicates"], plan["seed"], plan["confidence_level"]).select(*by, "n", F.col("mean").alias("delta"), "low", "high")
    m = stats.mcnemar(p.where(binary), by).select(*by, F.lit("mcnemar_exact_two_sided").alias("test"), "only_a", "only_b", "p_value")
    s = stats.sign_test_groups(p.where(~binary), by, "ordinal", plan["permutation_replicates"], plan["seed"]).select(*by, F.lit("paired_random_sign_two_sided").alias("test"), F.lit(None).cast("long").alias("only_a"), F.lit(None).cast("long").alias("only_b"), "p_value")
    rows = means.join(ci, by).join(stats.effect_size(p, by).select(*by, "effect"), by).join(m.unionByName(s), by).withColumn("relative_delta", stats.relative_delta(F.col("reference_mean"), F.col("mean")))
    rows = stats.holm(rows, order=by) if plan["holm_bonferroni"] else rows.withColumn("p_holm", F.lit(None).cast("double"))
    return rows.select(F.lit(reference).alias("reference"), *by, "n", "reference_mean", "mean", "delta", "relative_delta", "low", "high", "effect", "test", "only_a", "only_b", "p_value", "p_holm", (F.coalesce("p_holm", "p_value") < 0.05).alias("significant"))


def run(spark: SparkSession, plan: dict[str, Any], out: str, few_replicates: bool = False) -> dict[str, Any]:
    """Writes method_summary and paired_comparisons (CSV folders) under out, which must not hold them yet, and returns the manifest."""
    p = check_plan(plan, few_replicates)
    values = materialize(load_runs(spark, p), "values")
    for name, table in (("method_summary", method_table(values, p)), ("paired_comparisons", paired_table(values, p))):
        table.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{out}/{name}")  # a row a run and metric
    return {"status": "completed", "plan": p, "plan_sha256": canonical_sha256(p), "tables": [f"{out}/method_summary", f"{out}/paired_comparisons"]}

"""Error categories of failed predictions, paired outcomes, balanced samples and blinded pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_answer, jaccard, normalize_answer, same_numbers, terms
from tessera.operators.stats import hash_bits

# The labels in their reporting order, and the answer that counts as abstaining.
CATEGORIES = ["support_missing", "support_present_answer_wrong", "formatting_mismatch", "hallucination", "multi_hop_reasoning_failure", "insufficient_evidence_forced_answer", "other"]
ABSTAIN = "insufficient evidence"


def formatting_mismatch(pred: Column, gold: Column, f1: Column) -> Column:
    """True if a wrong answer is the right one in another form."""
    p, g = normalize_answer(pred), normalize_answer(gold)
    close = (f1 >= 0.5) | F.contains(p, g) | F.contains(g, p) | same_numbers(pred, gold) | (jaccard(terms(p), terms(g)) >= 0.8)
    return (p != "") & (g != "") & close


def category(pred: Column, gold: Column, evidence: Column, f1: Column, cover: Column, qtype: Column) -> Column:
    """The error label of a failed prediction; null coverage counts as 0. First matching rule wins."""
    cover = F.coalesce(cover, F.lit(0.0))
    abstains = normalize_answer(pred) == ABSTAIN
    known = contains_answer(gold, evidence)
    partial, full, weak = (cover > 0) & (cover < 1), (cover >= 0.75) | known, (cover < 0.5) & ~known
    return (
        F.when(~abstains & formatting_mismatch(pred, gold, f1), "formatting_mismatch")
        .when(abstains & weak, "support_missing").when(abstains & full, "support_present_answer_wrong").when(abstains & partial, "multi_hop_reasoning_failure").when(abstains, "support_present_answer_wrong")
        .when(weak, "insufficient_evidence_forced_answer")
        .when(qtype.isin("bridge", "comparison") & partial & ~known, "multi_hop_reasoning_failure")
        .when(full, "support_present_answer_wrong").when(partial, "multi_hop_reasoning_failure")
        .when(~contains_answer(pred, evidence) & (f1 == 0), "hallucination").otherwise("other")
    )


def category_counts(errors: DataFrame, by: str) -> DataFrame:
    """by, category, n, share: every label for every group, zero where it doesn't occur."""
    spark = errors.sparkSession
    labels = spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "place int, category string")
    n = errors.groupBy(by, "category").agg(F.count("*").alias("n"))
    full = n.select(by).distinct().crossJoin(F.broadcast(labels)).join(n, [by, "category"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(by))
    return full.select(by, "category", F.coalesce("n", F.lit(0)).alias("n"), F.when(total == 0, 0.0).otherwise(F.coalesce("n", F.lit(0)) / total).alias("share"))


def round_robin(rows: DataFrame, target: int, key: str, group: str = "category", order: list[str] | None = None) -> DataFrame:
    """At most target rows, taken from the groups in turn (in the given group order), each group by key."""
    order = order or CATEGORIES
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return rows.withColumn("turn", turn).where(F.col("turn") <= target).withColumn("place", place).orderBy("turn", "place").limit(target).drop("place")


def outcome(a_failed: Column, b_failed: Column, a: str, b: str) -> Column:
    """Which of two methods fails."""
    return F.when(a_failed & b_failed, "both_fail").when(a_failed, f"{a}_fail_only").when(b_failed, f"{b}_fail_only").otherwise("both_success")


def blinded(pairs: DataFrame, key: str, a: str, b: str, seed: int = 42) -> DataFrame:
    """(key, first, second, swapped): the two answers of each pair in an order set by a hash of the key."""
    swap = F.pmod(hash_bits(F.lit(seed), F.col(key)), F.lit(2)) == 1
    return pairs.select(key, F.when(swap, F.col(b)).otherwise(F.col(a)).alias("first"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias("second"), swap.alias("swapped"))


def annotation_sample(own: DataFrame, other: DataFrame, key: str, own_name: str, other_name: str, own_target: int = 30, other_target: int = 10) -> DataFrame:
    """(key, method, category, outcome) of failures to look at: own's failures where the other method succeeds, filled up in turns with failures of both; and the other's with smaller target.

    own, other: (key, category) of each method's failures.
    """
    a, b = own.select(key, "category"), other.select(key, "category")

    def part(x: DataFrame, y: DataFrame, name: str, target: int) -> DataFrame:
        only = x.join(y.select(key), key, "left_anti").withColumn("outcome", F.lit(f"{name}_fail_only"))
        both = x.join(y.select(key), key, "left_semi").withColumn("outcome", F.lit("both_fail"))
        turn = F.row_number().over(Window.partitionBy("outcome", "category").orderBy(key))
        place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
        rows = only.unionByName(both).withColumn("turn", turn).where(F.col("turn") <= target).withColumn("first", (F.col("outcome") == "both_fail").cast("int"))
        return rows.orderBy("first", "turn", place).limit(target).select(key, F.lit(name).alias("method"), "category", "outcome")

    return part(a, b, own_name, own_target).unionByName(part(b, a, other_name, other_target))


def note(category: Column, cover: Column, pred: Column, both_fail: Column, other: str) -> Column:
    """A sentence on the failure and one on the paired run. The wordings are fixed values."""
    c = F.format_string("%.2f", F.bround(F.coalesce(cover, F.lit(0.0)), 2))
    said = {
        "support_missing": F.concat(F.lit("Coverage is "), c, F.lit("; the packed context misses key support and the model abstains.")),
        "support_present_answer_wrong": F.concat(F.lit("Answer evidence is present enough (coverage "), c, F.lit("), but the model still outputs '"), F.coalesce(pred, F.lit("")), F.lit("'.")),
        "formatting_mismatch": F.lit("The prediction overlaps with the gold answer but fails normalization-sensitive scoring."),
        "hallucination": F.lit("The prediction is not grounded in the packed evidence excerpt."),
        "multi_hop_reasoning_failure": F.concat(F.lit("Coverage is "), c, F.lit("; the chain is only partly preserved and the model fails to connect it.")),
        "insufficient_evidence_forced_answer": F.concat(F.lit("Coverage is "), c, F.lit("; the model commits to a concrete answer instead of abstaining.")),
        "other": F.lit("The failure does not fit the main taxonomy cleanly."),
    }
    text = F.coalesce(*[F.when(category == k, v) for k, v in said.items()])
    pair = F.when(both_fail, f"The paired {other} run also fails on this example.").otherwise(f"The paired {other} run succeeds on this example.")
    return F.concat(text, F.lit(" "), pair)


def failure_table(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """(key, method, category, outcome, note, f1, cover, other_f1, other_cover) of every failure of two runs over the same keys.

    a, b: (key, em, f1, cover, text, category), each key once; different populations or repeated
    keys are an error when it runs. category may be null where em is 1.
    """
    side = lambda x, p: x.groupBy(key).agg(F.count("*").alias(f"{p}n"), F.any_value(F.struct("em", "f1", "cover", "text", "category")).alias(p))
    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    bad = F.col("an").isNull() | F.col("bn").isNull() | (F.col("an") > 1) | (F.col("bn") > 1)
    both = both.withColumn("a", F.when(bad, F.raise_error(F.lit("the two runs must have the same unique ids"))).otherwise(F.col("a")))
    both = both.withColumn("outcome", outcome(F.col("a.em") < 1, F.col("b.em") < 1, a_name, b_name))

    def rows(own: str, other: str, name: str, other_name: str) -> DataFrame:
        said = note(F.col(f"{own}.category"), F.col(f"{own}.cover"), F.col(f"{own}.text"), F.col("outcome") == "both_fail", other_name)
        return both.where(F.col(f"{own}.em") < 1).select(key, F.lit(name).alias("method"), f"{own}.category", "outcome", said.alias("note"), f"{own}.f1", f"{own}.cover", F.col(f"{other}.f1").alias("other_f1"), F.col(f"{other}.cover").alias("other_cover"))

    return rows("a", "b", a_name, b_name).unionByName(rows("b", "a", b_name, a_name))


def representatives(rows: DataFrame, key: str, wishes: list[Column], limit: int = 5) -> DataFrame:
    """Up to limit rows: for each wish (a condition, in order of importance) the first row by key, each row once, then others by key."""
    best = F.coalesce(*[F.when(w, F.lit(i)) for i, w in enumerate(wishes)], F.lit(len(wishes)))
    w = Window.partitionBy("wish").orderBy(key)
    ranked = rows.withColumn("wish", best).withColumn("turn", F.row_number().over(w))
    return ranked.where(F.col("turn") <= limit).orderBy(((F.col("turn") > 1) | (F.col("wish") == len(wishes))).cast("int"), "wish", "turn").limit(limit).drop("wish", "turn")

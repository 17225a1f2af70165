"""Answer, support, retrieval and coverage metrics as column functions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, let, normalize_answer, terms
from tessera.runtime import counted_broadcast, materialize, running_total


def exact_match(pred: Column, gold: Column) -> Column:
    """1.0 if the normalized answers are equal, else 0.0."""
    return (normalize_answer(pred) == normalize_answer(gold)).cast("double")


def _parts(x: Column) -> Column:
    return F.filter(F.split(normalize_answer(x), " "), lambda t: t != "")


def answer_f1(pred: Column, gold: Column) -> Column:
    """F1 of the bags of words of the normalized answers: 1 if both are empty, 0 if one is."""
    count = lambda bag, t: F.size(F.filter(bag, lambda x: x == t))

    def score(s):
        p, g = s["p"], s["g"]
        same = F.aggregate(F.array_distinct(p), F.lit(0), lambda a, t: a + F.least(count(p, t), count(g, t)))
        return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))

    return let(F.struct(_parts(pred).alias("p"), _parts(gold).alias("g")), score)


def support_metrics(pred: Column, gold: Column) -> dict[str, Column]:
    """em, precision, recall and f1 of predicted against gold support keys (arrays of structs, as sets).

    Both empty: all 1; only one empty: all 0. Null arrays count as empty.
    """
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    np_, ng = F.coalesce(F.size(p), F.lit(0)), F.coalesce(F.size(g), F.lit(0))
    hit = F.coalesce(F.size(F.array_intersect(p, g)), F.lit(0))
    both = (np_ <= 0) & (ng <= 0)
    one = (np_ <= 0) | (ng <= 0)
    case = lambda v: F.when(both, 1.0).when(one, 0.0).otherwise(v)
    return {"em": case(((hit == np_) & (hit == ng)).cast("double")), "precision": case(hit / np_), "recall": case(hit / ng), "f1": case(2.0 * hit / (np_ + ng))}


def coverage(pred: Column, gold: Column) -> Column:
    """Share of the gold support keys that are predicted; 1 without gold keys."""
    g = F.array_distinct(gold)
    n = F.coalesce(F.size(g), F.lit(0))
    return F.when(n <= 0, 1.0).otherwise(F.coalesce(F.size(F.array_intersect(F.array_distinct(pred), g)), F.lit(0)) / n)


def recall_at(ranked: DataFrame, gold: DataFrame, query: str, item: str, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(k, n, recall): mean recall of gold items (query, item) among ranked (query, item, rank) at each cutoff, over all queries of gold's keys.

    Queries without gold items count as 1; give them with a null item.
    """
    if len(set(ks)) != len(ks) or min(ks) < 0:
        raise ValueError("cutoffs must be different and not negative")
    want = gold.select(query, item).distinct()
    n = want.groupBy(query).agg(F.count(item).alias("n_gold"))
    hits = want.where(F.col(item).isNotNull()).join(ranked.groupBy(query, item).agg(F.min("rank").alias("rank")), [query, item])
    counted = hits.groupBy(query).agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in ks])
    wide = n.join(counted, query, "left")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("n_gold") == 0, 1.0).otherwise(F.coalesce(f"h{k}", F.lit(0)) / F.col("n_gold")).alias("r")) for k in ks]))
    return wide.select(each.alias("x")).groupBy("x.k").agg(F.count("*").alias("n"), F.avg("x.r").alias("recall"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, item: str) -> DataFrame:
    """(query, n_gold, hits, recall, all_gold, any_gold, mrr, both_gold): both_gold is null unless there are two gold items; queries without gold are left out."""
    want = gold.select(query, item).where(F.col(item).isNotNull()).distinct()
    got = want.join(ranked.groupBy(query, item).agg(F.min("rank").alias("rank")), [query, item], "left")
    g = got.groupBy(query).agg(F.count("*").alias("n_gold"), F.count("rank").alias("hits"), F.min("rank").alias("first"))
    return g.select(
        query, "n_gold", "hits", (F.col("hits") / F.col("n_gold")).alias("recall"), (F.col("hits") == F.col("n_gold")).cast("double").alias("all_gold"), (F.col("hits") > 0).cast("double").alias("any_gold"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("n_gold") == 2, (F.col("hits") == 2).cast("double")).alias("both_gold"),
    )


def coverage_diagnostics(selected: Column, question_terms: Column, gold: Column) -> dict[str, Column]:
    """question_coverage, unique_titles, unique_title_ratio, mean_redundancy, max_redundancy, gold_recall of a selection (array of structs title, sentence_id, text)."""
    sets = F.transform(selected, lambda s: terms(s["text"]))
    found = F.array_distinct(F.flatten(sets))
    q = F.size(question_terms)
    n = F.size(selected)
    titles = F.size(F.array_distinct(F.transform(selected, lambda s: s["title"])))
    pairs = let(sets, lambda t: F.flatten(F.transform(t, lambda a, i: F.transform(F.slice(t, i + 2, F.greatest(n, F.lit(1))), lambda b: jaccard(a, b)))))
    keys = F.transform(selected, lambda s: F.struct(s["title"].alias("title"), s["sentence_id"].alias("sent_id")))
    return {
        "question_coverage": F.when(q == 0, 1.0).otherwise(F.size(F.array_intersect(question_terms, found)) / q),
        "unique_titles": titles, "unique_title_ratio": F.when(n == 0, 0.0).otherwise(titles / n),
        "mean_redundancy": F.when(n < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(pairs), F.lit(1))),
        "max_redundancy": F.when(n < 2, 0.0).otherwise(F.array_max(pairs)), "gold_recall": coverage(keys, gold),
    }


def method_summary(records: DataFrame, by: list[str], metrics: list[str], strict: bool = True) -> DataFrame:
    """by, n and the mean of each metric. strict: a metric that is null in some but not all rows of a group is an error (raise_error), else nulls are ignored."""
    aggs = []
    for m in metrics:
        mean = F.avg(m)
        if strict:
            mean = F.when((F.count(m) > 0) & (F.count(m) < F.count("*")), F.raise_error(F.lit(f"{m} is null in some rows of a group"))).otherwise(mean)
        aggs.append(mean.alias(m))
    return records.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


#: The means of a run's records: always there, and there for all records or for none.
REQUIRED = ("answer_em", "answer_f1", "evidence_tokens", "retrieval_latency_ms", "packing_latency_ms", "generation_latency_ms", "total_latency_ms", "peak_rss_mb")
OPTIONAL = ("support_em", "support_precision", "support_recall", "support_f1", "coverage_at_budget")


def record_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """by, num_examples and the 13 means of a run's records.

    A null in a required column is an error, as is an optional column that only some records of a
    group have; an optional column without values has a null mean.
    """
    must = [F.when(F.count(c) < F.count("*"), F.raise_error(F.lit(f"{c} is missing in a record"))).otherwise(F.avg(c)).alias(c) for c in REQUIRED]
    may = [F.when((F.count(c) > 0) & (F.count(c) < F.count("*")), F.raise_error(F.lit(f"{c} is null in some records of a group"))).otherwise(F.avg(c)).alias(c) for c in OPTIONAL]
    return records.groupBy(*by).agg(F.count("*").alias("num_examples"), *must, *may)


#: What a retrieval diagnostic must have one value of, and its means.
RETRIEVAL_PROTOCOL = ("retrieval_mode", "retrieval_method", "retrieval_parameters", "tokenizer_identity", "corpus_id", "corpus_sha256", "query_population_sha256", "top_k", "query_role")
RETRIEVAL_MEANS = ("recall", "all_gold", "any_gold", "mrr", "both_gold")


def retrieval_summary(records: DataFrame, protocol: tuple[str, ...] = RETRIEVAL_PROTOCOL, latency: str | None = None) -> DataFrame:
    """One row: the protocol's values, n and the means of ranking_metrics rows; means over the rows that have a value.

    More than one value of a protocol column, a repeated or null query, or a negative latency is an error when it runs.
    """
    one = [F.when(F.count_distinct(F.to_json(F.struct(c))) > 1, F.raise_error(F.lit(f"records mix values of {c}"))).otherwise(F.any_value(c)).alias(c) for c in protocol]
    n = F.when(F.count_distinct("query") < F.count("*"), F.raise_error(F.lit("queries must have different ids"))).otherwise(F.count("*")).alias("n")
    late = [F.avg(F.when(F.col(latency) < 0, F.raise_error(F.lit("latencies must not be negative"))).otherwise(F.col(latency))).alias(latency)] if latency else []
    return records.agg(*one, n, *[F.avg(c).alias(c) for c in RETRIEVAL_MEANS], *late)


def unfair(candidates: DataFrame, packer: str, query: str, item: str, rank: str, score: str) -> DataFrame:
    """(query, packer) of packers that got other candidates than the first packer (by name) of the same query: other items, order or scores. Empty if the comparison is fair."""
    given = candidates.groupBy(query, packer).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(rank, item, score)))), 256).alias("given"))  # the top candidates of one query
    first = given.groupBy(query).agg(F.min_by("given", packer).alias("first"))
    everyone = first.crossJoin(F.broadcast(given.select(packer).distinct()))  # packers are few
    return everyone.join(given, [query, packer], "left").where(~F.col("given").eqNullSafe(F.col("first"))).select(query, packer)


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with 0-based ranks of value, equal values sharing their mean rank; rows with a null value are left out.

    Different values are counted and the counts summed up over ranges of values, so no group is
    ranked in one task.
    """
    by = by or []
    df = df.where(F.col(value).isNotNull())
    n = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    r = running_total(n, by, value, "__n", "__before").select(*[F.col(c).alias(f"__{c}") for c in [*by, value]], (F.col("__before") + (F.col("__n") - 1) / 2).alias(out))
    same = F.lit(True)
    for c in [*by, value]:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(counted_broadcast(materialize(r, "ranks")), same).select(*df.columns, out)

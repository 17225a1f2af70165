"""Mixing sources to target shares of tokens by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokenize import count_column
from tessera.runtime import materialize

#: Residuals that one task of the reduction tree combines come from this many tasks below it.
FAN_IN = 32
#: About how many documents a task of the first round has.
LEAF_DOCUMENTS = 50_000
_M = (1 << 64) - 1
_SCHEMA = "doc_id long, source string, n_tokens long, base int, p double, done boolean"


def _unit(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) fixed by two ids and the seed."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9 + 0x27D4EB2F165667C5) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(one: tuple, two: tuple, seed: int) -> tuple[float, float]:
    """New probabilities of two items (id, tokens, p): the token mass is kept, at least one becomes 0 or 1, expectations stay."""
    (i, w, p), (j, v, q) = one, two
    to_one, to_two = min((1 - p) * w, q * v), min(p * w, (1 - q) * v)
    if _unit(i, j, seed) * (to_one + to_two) < to_two:
        p, q = (p + to_one / w if to_one < (1 - p) * w else 1.0), (q - to_one / v if to_one < q * v else 0.0)
    else:
        p, q = (p - to_two / w if to_two < p * w else 0.0), (q + to_two / v if to_two < (1 - q) * v else 1.0)
    return p, q


def _round(seed: int, last: bool):
    """Runs pivots over a task's open items; at most one open item of each source is left, none if last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                i, s, w, base, p, done = row
                if done or w == 0 or p <= 0.0 or p >= 1.0:
                    out.append((i, s, w, base, 1.0 if p >= 1.0 and not done else p if done else 0.0, True))
                    continue
                old = held.pop(s, None)
                if old is None:
                    held[s] = [i, s, w, base, p]
                    continue
                op, np_ = pivot((old[0], old[2], old[4]), (i, w, p), seed)
                for item, x in ((old, op), ([i, s, w, base, p], np_)):
                    if 0.0 < x < 1.0:
                        held[s] = [*item[:4], x]
                    else:
                        out.append((*item[:4], x, True))
            yield _batch(out)
        rest = [(*x[:4], (1.0 if _unit(x[0], 0, seed + 1) < x[4] else 0.0) if last else x[4], last) for x in held.values()]
        yield _batch(rest)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.bool_())
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "source", "n_tokens", "base", "p", "done"])


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, vocabulary: str = "byte_bpe_50k.tiktoken") -> tuple[DataFrame, DataFrame]:
    """(copies, report). copies: (doc_id, source, n_tokens, copies) of every document of a listed source; report: a row for each listed source.

    report: source, n_documents, source_tokens, max_repeats, uses (mixed tokens by source tokens),
    mixed_tokens, actual_share, target_share. Without total_tokens the mixture is the largest one
    in which each source has exactly its target share and none is used more than max_repeats
    times; with it, a source that would need more is used max_repeats times and its actual share
    shows what is missing. Documents with null source, or of a source that isn't listed, aren't
    used; null and empty texts have no tokens and get the whole repeats only. Each doc_id counts
    once. A listed source without tokens has 0 uses and doesn't limit the others.

    A source's uses u are the same for all its documents: floor(u) copies, and one more with
    probability u - floor(u). Pivotal rounding settles these: pairs pass token mass to each other
    until one is whole, so a source's tokens miss their target by less than one document. Documents
    are dealt to about one task for each LEAF_DOCUMENTS of them, by hash and sorted, so the result
    follows from the data and the seed alone. Each task keeps one open document a source; open
    ones go up a tree of FAN_IN tasks a node.
    """
    spark = documents.sparkSession
    listed = targets.where("source is not null")
    shares = {r["source"]: (float(r["target_share"] or 0.0), int(r["max_repeats"] or 0)) for r in listed.collect()}  # one row for each source of the mixture plan
    sized = count_column(documents.where(F.col("source").isin(*shares)), ["doc_id", "source"], "text", vocabulary)
    sized = materialize(sized.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.source", "x.n_tokens"), "sizes")
    sums = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    tokens = {s: (int(sums[s]["tokens"]) if s in sums else 0) for s in shares}
    limits = [cap * tokens[s] / share for s, (share, cap) in shares.items() if share > 0 and tokens[s]]
    total = total_tokens if total_tokens is not None else min(limits, default=0.0)
    uses = {s: min(cap, share * total / tokens[s]) if tokens[s] else 0.0 for s, (share, cap) in shares.items()}
    plan = F.create_map(*[x for s, u in uses.items() for x in (F.lit(s), F.lit(float(u)))]) if uses else F.lit(None).cast("map<string,double>")
    u = plan[F.col("source")]
    items = sized.select("doc_id", "source", "n_tokens", F.floor(u).cast("int").alias("base"), (u - F.floor(u)).alias("p"), F.lit(False).alias("done"))
    parts = max(1, -(-sum(r["n"] for r in sums.values()) // LEAF_DOCUMENTS))  # of the data, not of the layout, so that the seed fixes the result
    items = items.repartition(parts, F.pmod(F.xxhash64("doc_id"), F.lit(parts))).sortWithinPartitions("source", "doc_id")
    state = materialize(items.mapInArrow(_round(seed, parts == 1), _SCHEMA), "rounded")
    settled = state.where("done")
    level = 0
    while parts > 1:
        parts, level = -(-parts // FAN_IN), level + 1
        open_ = state.where("not done").repartition(parts, F.pmod(F.xxhash64("doc_id"), F.lit(parts))).sortWithinPartitions("source", "doc_id")
        state = materialize(open_.mapInArrow(_round(seed + level, parts == 1), _SCHEMA), "rounded")
        settled = settled.unionByName(state.where("done"))
    copies = settled.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("copies"))
    got = copies.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    whole = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    plan_df = spark.createDataFrame([(s, a, c) for s, (a, c) in shares.items()], "source string, target_share double, max_repeats int")
    report = plan_df.join(got, "source", "left").crossJoin(whole).select(
        "source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), "max_repeats",
        F.coalesce(F.expr("mixed_tokens / nullif(source_tokens, 0)"), F.lit(0.0)).alias("uses"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.expr("mixed_tokens / nullif(all_tokens, 0)"), F.lit(0.0)).alias("actual_share"), "target_share",
    )
    return copies, report

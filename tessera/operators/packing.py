"""Sentence candidates and evidence selection under a token budget."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import part_count, space_count, term_list

# Weights of the combined objective and of base relevance.
BASE = {"query_overlap": 0.55, "paragraph_score": 0.35, "title_overlap": 0.10}
VARIANTS = {
    "full": (), "no_query_coverage": ("beta",), "no_title_gain": ("title_bonus",), "no_coverage": ("beta", "title_bonus"), "no_redundancy": ("gamma",),
    "no_token_penalty": ("delta",), "relevance_only": ("beta", "title_bonus", "gamma", "delta"),
}


@dataclass(frozen=True)
class PackPlan:
    """One configuration of a selector: what the sweep's plan table holds a row of. The defaults are fixed values."""

    config_id: str
    method: str = "cover"
    budget: int = 160
    alpha: float = 1.0
    beta: float = 1.2
    gamma: float = 0.6
    delta: float = 0.15
    title_bonus: float = 0.3
    stop: float = 0.0
    trade: float = 0.5
    seed: int = 42

    def variant(self, name: str) -> "PackPlan":
        """The plan with the coefficients of an ablation set to zero."""
        if name not in VARIANTS:
            raise ValueError(f"unknown variant {name}")
        return replace(self, **{c: 0.0 for c in VARIANTS[name]})


def candidates(ranked: DataFrame, count: Callable[[str | None], int] = part_count) -> DataFrame:
    """ranked (with question and the ranked paragraphs of rank_context) with cands array<struct>: a candidate for each sentence with terms.

    Sentences keep their number in the paragraph; scores are scaled to 0..1 within an example, all
    1 if equal; overlaps are shares of the question's terms. count gives a sentence's tokens:
    white-space parts, or a tokenizer's count. No shuffle.
    """
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    names = [c for c in ranked.columns if c != "ranked"]
    item = pa.struct([("title", pa.string()), ("sentence_id", pa.int32()), ("text", pa.string()), ("paragraph_rank", pa.int32()), ("terms", pa.list_(pa.string())), ("token_count", pa.int32()), ("paragraph_score", pa.float64()), ("title_overlap", pa.float64()), ("query_overlap", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                qs = [term_list(x) for x in b.column(names.index("question")).to_pylist()]
                out = [_of(q, r or [], count) for q, r in zip(qs, b.column(len(names)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(item)), pa.array(qs, pa.list_(pa.string()))], names=[*names, "cands", "question_terms"])

    fields = "title:string,sentence_id:int,text:string,paragraph_rank:int,terms:array<string>,token_count:int,paragraph_score:double,title_overlap:double,query_overlap:double"
    return ranked.select(*names, "ranked").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", cands array<struct<{fields}>>, question_terms array<string>")


def _of(question_terms: list[str], ranked: list[dict], count: Callable[[str | None], int] = part_count) -> list[dict]:
    q = frozenset(question_terms)
    scores = [p["score"] for p in ranked]
    lo, hi = (min(scores), max(scores)) if scores else (0.0, 0.0)
    out = []
    for p in ranked:
        title = p["title"] or ""
        head = {"title": title, "paragraph_rank": p["rank"], "paragraph_score": 1.0 if hi == lo else (p["score"] - lo) / (hi - lo), "title_overlap": len(q.intersection(term_list(title))) / max(len(q), 1)}
        for i, s in enumerate(p["sentences"] or []):
            t = term_list(s)
            if t:
                out.append({**head, "sentence_id": i, "text": s, "terms": t, "token_count": count(s), "query_overlap": len(q.intersection(t)) / max(len(q), 1)})
    return out


def relevance(c: dict) -> float:
    """Base relevance of a candidate."""
    return sum(w * c[k] for k, w in BASE.items())


class _Row:
    """What all selections of one row share: term sets, their question terms, base relevance, and similarities as they are needed."""

    def __init__(self, cands: list[dict], question_terms: list[str]) -> None:
        self.cands, self.question = cands, frozenset(question_terms)
        self.sets = [frozenset(x["terms"]) for x in cands]
        self.asked = [s & self.question for s in self.sets]
        self.relevance = [relevance(c) for c in cands]
        self.keys = [(c["title"], c["sentence_id"]) for c in cands]
        self.tokens = [c["token_count"] for c in cands]
        self._similar: dict[int, list[float]] = {}

    def similar(self, i: int) -> list[float]:
        row = self._similar.get(i)
        if row is None:
            s, n = self.sets[i], len(self.sets[i])
            row = self._similar[i] = []
            for t in self.sets:
                both = len(s & t)
                union = n + len(t) - both
                row.append(both / union if union else 1.0)
        return row


_LAST: list = [None, None, None]


def _row(cands: list[dict], question_terms: list[str]) -> _Row:
    """The shared part of a row, kept while the plans of the same row follow each other."""
    if _LAST[0] is not cands or _LAST[1] != question_terms:
        _LAST[:] = [cands, question_terms, _Row(cands, question_terms)]
    return _LAST[2]


class _Greedy:
    """State of a greedy selection: what is taken, what is still allowed, and similarities kept up to date after each step."""

    def __init__(self, row: _Row, budget: int) -> None:
        self.row, self.budget, self.used = row, budget, 0
        self.open = list(range(len(row.cands)))
        self.near = [0.0] * len(row.cands)
        self.new = [len(a) for a in row.asked]  # question terms of a candidate that aren't covered yet
        self.covered: set[str] = set()
        self.titles: set[str] = set()
        self.taken: list[tuple[int, float]] = []

    def best(self, score) -> tuple[int, float] | None:
        room, tokens = self.budget - self.used, self.row.tokens
        top, at = None, -1
        for i in self.open:
            if tokens[i] <= room:
                s = round(score(i), 12)  # so that equal scores stay equal whatever the order of sums
                if top is None or s > top:
                    top, at = s, i
        return None if top is None else (at, top)

    def take(self, i: int, score: float) -> None:
        row = self.row
        self.taken.append((i, score))
        self.used += row.tokens[i]
        self.titles.add(row.cands[i]["title"])
        same, similar = row.keys[i], row.similar(i)
        fresh = row.asked[i] - self.covered
        self.covered |= fresh
        self.open = [j for j in self.open if row.keys[j] != same]
        for j in self.open:
            if similar[j] > self.near[j]:
                self.near[j] = similar[j]
            if fresh:
                self.new[j] -= len(fresh & row.asked[j])


def select_cover(cands: list[dict], question_terms: list[str], p: PackPlan) -> list[tuple[int, float]]:
    """Greedy on relevance, new question terms, new titles, redundancy and cost; the first pick is taken whatever its score."""
    row = _row(cands, question_terms)
    g, terms = _Greedy(row, p.budget), max(len(row.question), 1)
    fixed = [p.alpha * r - p.delta * (t / max(p.budget, 1)) for r, t in zip(row.relevance, row.tokens)]
    titles = [c["title"] for c in cands]
    score = lambda i: fixed[i] + p.beta * g.new[i] / terms + (0.0 if titles[i] in g.titles else p.title_bonus) - p.gamma * g.near[i]
    while (b := g.best(score)) and not (g.taken and b[1] < p.stop):
        g.take(*b)
    return g.taken


def select_mmr(cands: list[dict], question_terms: list[str], p: PackPlan) -> list[tuple[int, float]]:
    """Greedy on relevance against the largest similarity to what is taken."""
    if not 0.0 <= p.trade <= 1.0:
        raise ValueError("the trade-off must lie between 0 and 1")
    row = _row(cands, question_terms)
    g = _Greedy(row, p.budget)
    while b := g.best(lambda i: p.trade * row.relevance[i] - (1.0 - p.trade) * g.near[i]):
        g.take(*b)
    return g.taken


def select_query_cover(cands: list[dict], question_terms: list[str], p: PackPlan) -> list[tuple[int, float]]:
    """Greedy on new question terms by token; ends when nothing new is covered."""
    if any(c["token_count"] <= 0 for c in cands):
        raise ValueError("candidates need a positive number of tokens")
    row = _row(cands, question_terms)
    g = _Greedy(row, p.budget)
    while (b := g.best(lambda i: g.new[i] / row.tokens[i])) and b[1] > 0:
        g.take(*b)
    return g.taken


def _scan(order: Iterator[int], cands: list[dict], budget: int, unique: bool, score) -> list[tuple[int, float]]:
    used, keys, out = 0, set(), []
    for i in order:
        c = cands[i]
        k = (c["title"], c["sentence_id"])
        if (unique and k in keys) or used + c["token_count"] > budget:
            continue
        keys.add(k)
        used += c["token_count"]
        out.append((i, score(c)))
    return out


def select_relevance(cands: list[dict], question_terms: list[str], p: PackPlan) -> list[tuple[int, float]]:
    """By query overlap, paragraph score and title overlap; what doesn't fit is skipped."""
    order = sorted(range(len(cands)), key=lambda i: (-cands[i]["query_overlap"], -cands[i]["paragraph_score"], -cands[i]["title_overlap"]))
    return _scan(iter(order), cands, p.budget, True, lambda c: c["query_overlap"])


def select_random(cands: list[dict], question_terms: list[str], p: PackPlan) -> list[tuple[int, float]]:
    """In the order of a shuffle by the plan's seed, the same for each example; what doesn't fit is skipped."""
    order = list(range(len(cands)))
    random.Random(p.seed).shuffle(order)
    return _scan(iter(order), cands, p.budget, False, lambda c: 0.0)


SELECTORS = {"cover": select_cover, "mmr": select_mmr, "query_cover": select_query_cover, "relevance": select_relevance, "random": select_random, "none": lambda c, q, p: []}


def register_compressor(name: str, select) -> None:
    """Adds a selector (candidates, question terms, plan) -> [(index, score)] under a method name; it must keep the budget."""
    SELECTORS[name] = select


def pack(cands: DataFrame, key: str, plans: list[PackPlan], keep: list[str] = ()) -> DataFrame:
    """(key, config_id, method, budget, used_tokens, selected array<struct<pos, title, sentence_id, text, score>>, keep...): every plan's selection for each row.

    keep: further columns of cands that each selection carries along. All plans share a row's candidates, in one narrow pass of Python over Arrow batches. No shuffle.
    A selector that overruns its budget or repeats a support key is an error.
    """
    plan_rows = [asdict(p) for p in plans]
    own = {p.method: SELECTORS[p.method] for p in plans}
    types = dict(cands.dtypes)
    schema = f"`{key}` {types[key]}, config_id string, method string, budget int, used_tokens int, selected array<struct<pos:int,title:string,sentence_id:int,text:string,score:double>>" + "".join(f", `{c}` {types[c]}" for c in keep)
    item = pa.struct([("pos", pa.int32()), ("title", pa.string()), ("sentence_id", pa.int32()), ("text", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = [PackPlan(**p) for p in plan_rows]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                k, ids, meth, bud, used, sel = [], [], [], [], [], []
                for x, q, cs in zip(*(part.column(i).to_pylist() for i in range(3))):
                    cs = cs or []
                    for p in todo:
                        got = own[p.method](cs, q or [], p)
                        n = sum(cs[i]["token_count"] for i, _ in got)
                        if n > p.budget:
                            raise ValueError(f"{p.config_id} took {n} of {p.budget} tokens")
                        k.append(x)
                        ids.append(p.config_id)
                        meth.append(p.method)
                        bud.append(p.budget)
                        used.append(n)
                        sel.append([{"pos": i, "title": cs[i]["title"], "sentence_id": cs[i]["sentence_id"], "text": cs[i]["text"], "score": s} for i, s in got])
                yield pa.RecordBatch.from_arrays([pa.array(k, part.column(0).type), pa.array(ids, pa.string()), pa.array(meth, pa.string()), pa.array(bud, pa.int32()), pa.array(used, pa.int32()), pa.array(sel, pa.list_(item)), *(part.column(3 + j).take(pa.array(np.repeat(np.arange(part.num_rows), len(todo)))) for j in range(len(keep)))], names=["k", "config_id", "method", "budget", "used_tokens", "selected", *keep])

    return cands.select(key, "question_terms", "cands", *keep).mapInArrow(run, schema)


def pack_paragraphs(ranked: DataFrame, key: str, budget: int = 160) -> DataFrame:
    """(key, used_tokens, n_paragraphs, support array<struct<title, sentence_id>>): whole paragraphs in rank order, up to the first that doesn't fit.

    Running sums within the row; the support keys are all sentences of the paragraphs, each once.
    """
    cost = lambda p: space_count(F.array_join(p["sentences"], " "))
    fold = F.aggregate(
        "ranked", F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full")),
        lambda a, p: F.when(a["full"] | (a["used"] + cost(p) > budget), F.struct(a["used"].alias("used"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct((a["used"] + cost(p)).alias("used"), (a["n"] + 1).alias("n"), F.lit(False).alias("full"))),
    )
    df = ranked.withColumn("__f", fold)
    keys = F.flatten(F.transform(F.slice("ranked", F.lit(1), F.col("__f.n")), lambda p: F.transform(p["sentences"], lambda s, i: F.struct(F.coalesce(p["title"], F.lit("")).alias("title"), i.alias("sentence_id")))))
    return df.select(key, F.col("__f.used").alias("used_tokens"), F.col("__f.n").alias("n_paragraphs"), F.array_distinct(keys).alias("support"))


def relevance_in_sql(cands: DataFrame, key: str, budget: int = 160) -> DataFrame:
    """(key, used_tokens, positions): the relevance selection by column functions only, a cross-check without Python."""
    order = F.array_sort(F.transform("cands", lambda c, i: F.struct((-c["query_overlap"]).alias("a"), (-c["paragraph_score"]).alias("b"), (-c["title_overlap"]).alias("d"), i.alias("pos"), c["title"].alias("title"), c["sentence_id"].alias("sid"), c["token_count"].alias("tok"))))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("pos"), F.expr("cast(array() as array<string>)").alias("keys"))
    name = lambda c: F.concat_ws("\x01", c["title"], c["sid"].cast("string"))
    fold = F.aggregate(
        order, start,
        lambda a, c: F.when((a["used"] + c["tok"] > budget) | F.array_contains(a["keys"], name(c)), a).otherwise(F.struct((a["used"] + c["tok"]).alias("used"), F.concat(a["pos"], F.array(c["pos"])).alias("pos"), F.concat(a["keys"], F.array(name(c))).alias("keys"))),
    )
    return cands.withColumn("__f", fold).select(key, F.col("__f.used").alias("used_tokens"), F.col("__f.pos").alias("positions"))


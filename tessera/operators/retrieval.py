"""BM25 ranking: within each example's own context, and over a whole corpus by an inverted index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import paragraph_id
from tessera.functions.text import joined, paragraph_text, token_list, tokens
from tessera.runtime import counted_broadcast, materialize

K1, B = 1.5, 0.75  # fixed values
EPS = 1e-8


def check_parameters(k1: float, b: float) -> None:
    """k1 is finite and not negative, b between 0 and 1."""
    if not math.isfinite(k1) or k1 < 0 or not 0 <= b <= 1:
        raise ValueError(f"BM25 needs k1 >= 0 and 0 <= b <= 1, got {k1} and {b}")


def rank_context(examples: DataFrame, top_k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """examples with ranked array<struct<pos, rank, score, title, sentences, text>>: the top_k paragraphs of each example's own context.

    Statistics are those of the example's paragraphs; a query token counts as often as it occurs;
    equal scores (to nine digits) keep the context's order. All of it happens within the row, in
    one pass of Python over Arrow batches, so there is no shuffle. Null titles count as empty, a null context gives an empty list.
    """
    check_parameters(k1, b)
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    kinds = {f.name: f.dataType.simpleString() for f in examples.schema.fields}
    names = examples.columns
    question_at, context_at = names.index("question"), names.index("context")
    item = pa.struct([("pos", pa.int32()), ("rank", pa.int32()), ("score", pa.float64()), ("title", pa.string()), ("sentences", pa.list_(pa.string())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out = [best_of(q, c or [], top_k, k1, b_) for q, c in zip(b.column(question_at).to_pylist(), b.column(context_at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(item))], names=[*names, "ranked"])

    b_ = b
    return examples.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", ranked array<struct<pos:int,rank:int,score:double,title:string,sentences:array<string>,text:string>>")


def best_of(question: str | None, context: list[dict], top_k: int, k1: float, b: float) -> list[dict]:
    """The top_k paragraphs of one context."""
    texts = [joined(p["sentences"]) for p in context]
    counts = [Counter(token_list(f"{p['title'] or ''} {t}")) for p, t in zip(context, texts)]
    sizes = [c.total() for c in counts]
    n, mean = len(context), max(sum(sizes) / max(len(sizes), 1), EPS)
    norms = [k1 * (1 - b + b * s / mean) for s in sizes]
    scores = [0.0] * n
    for t, qf in Counter(token_list(question)).items():
        having = [i for i in range(n) if t in counts[i]]
        idf = math.log((n - len(having) + 0.5) / (len(having) + 0.5) + 1)
        for i in having:
            tf = counts[i][t]
            scores[i] += qf * idf * tf * (k1 + 1) / max(tf + norms[i], EPS)
    order = sorted(range(n), key=lambda i: (-round(scores[i], 9), i))[:top_k]
    return [{"pos": i, "rank": r, "score": scores[i], "title": context[i]["title"], "sentences": context[i]["sentences"] or [], "text": texts[i]} for r, i in enumerate(order, 1)]


@dataclass
class BM25Index:
    """Inverted index of a corpus: docs (key, dl), postings (term, key, tf, dl), stats (one row: n, avgdl). Each may be kept as a table."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    key: str
    k1: float
    b: float

    def doc_freq(self) -> DataFrame:
        """(term, df) of all terms."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))


def build_index(corpus: DataFrame, key: str, k1: float = K1, b: float = B) -> BM25Index:
    """Index over title and text of corpus (key, title, sentences); keys must be unique and not null.

    The key also orders documents of equal score; a struct column gives several tie keys.
    """
    check_parameters(k1, b)
    doc = corpus.select(F.col(key).alias("key"), tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), paragraph_text(F.col("sentences")))).alias("toks"))
    docs = doc.select("key", F.size("toks").alias("dl"))
    postings = doc.select("key", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("term", "key", "dl").agg(F.count("*").alias("tf")).select("term", "key", "tf", "dl")
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return BM25Index(docs, postings, stats, key, k1, b)


def index_identity(index: BM25Index) -> dict:
    """What an index was built on and with: parameters, documents, and an order-free digest of keys and lengths."""
    d = index.docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.col("key"), F.col("dl")).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    return {"k1": index.k1, "b": index.b, "n": d["n"], "digest": d["digest"]}


def save_index(index: BM25Index, path: str) -> dict:
    """Writes the index as tables, documents by key and postings by term, with its identity, which is returned."""
    spark = index.docs.sparkSession
    identity = index_identity(index)
    index.docs.sortWithinPartitions("key").write.mode("errorifexists").parquet(f"{path}/docs")
    index.postings.repartition("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{path}/postings")
    row = (index.key, index.k1, index.b, identity["n"], identity["digest"])
    spark.createDataFrame([row], "key string, k1 double, b double, n long, digest string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/identity")
    return identity


def load_index(spark, path: str, digest: str | None = None) -> BM25Index:
    """The index at path. Tables that don't fit its identity, or another digest than the given one, are refused."""
    i = spark.read.parquet(f"{path}/identity").first()
    docs, postings = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")
    index = BM25Index(docs, postings, docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), i["key"], i["k1"], i["b"])
    if index_identity(index)["digest"] != i["digest"] or digest not in (None, i["digest"]):
        raise ValueError("the index doesn't belong to this corpus")
    return index


def content_id_problems(corpus: DataFrame, corpus_id: str = "corpus_id") -> DataFrame:
    """(corpus_id, problem) of rows whose identifier isn't that of their title and text, or occurs more than once: an index by content refuses them."""
    wrong = corpus.where(~F.col(corpus_id).eqNullSafe(paragraph_id(F.coalesce("title", F.lit("")), paragraph_text(F.col("sentences"))))).select(corpus_id, F.lit("not the hash of its content").alias("problem"))
    return wrong.unionByName(corpus.groupBy(corpus_id).count().where("count > 1").select(corpus_id, F.lit("repeated").alias("problem")))


#: A term is common in an index if at least this share of the documents has it; queries for which the first share isn't enough try the next.
COMMON = (0.05, 0.3)


def rank_corpus(index: BM25Index, queries: DataFrame, query_id: str, question: str, top_k: int = 5) -> DataFrame:
    """(query_id, key, rank, score): the top_k documents of the whole corpus for each query.

    Only terms of the queries meet the postings, and these are dealt by document: the query weights
    are broadcast (if there are few), so a document's scores are summed up where it is, and each
    task keeps its top_k of each query before they are merged. With too many weights to broadcast,
    the join shuffles by term.

    Common terms would pair nearly every query with nearly every document, so documents are first
    scored by the other terms. Where a query's top_k-th such score is beyond all that its common
    terms can add to any document, only documents that could still reach it are scored in full: no
    document is lost. The remaining queries are scored against all their postings.

    Queries that match fewer than top_k documents are filled up with score-0 documents by smallest
    key: matched scores are positive, so only the top_k smallest keys can be needed. Null questions
    and an empty corpus give only such rows, or none.
    """
    q = materialize(queries.select(F.col(query_id).alias("qid"), F.explode(tokens(F.col(question))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qf")), "query_terms")
    stats = materialize(index.stats, "stats")  # one row
    small = index.postings.join(counted_broadcast(q.select("term").distinct()), "term", "left_semi")
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    impact = tf * (index.k1 + 1) / F.greatest(tf + index.k1 * (1 - index.b + index.b * dl / F.greatest(F.col("avgdl"), F.lit(EPS))), F.lit(EPS))
    impacts = materialize(small.crossJoin(F.broadcast(stats.select("avgdl"))).select("term", "key", impact.alias("impact")), "impacts")  # once a posting, whatever the number of queries
    df = impacts.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = q.join(df, "term").crossJoin(F.broadcast(stats.select("n")))
    weights = materialize(weights.select("qid", "term", (F.col("qf") * idf).alias("weight"), (F.col("qf") * idf * F.col("most")).alias("most"), (F.col("df") / F.col("n")).alias("share")), "weights")
    dealt = impacts.repartition("key")

    def score(w: DataFrame, rows: DataFrame = dealt) -> DataFrame:
        return rows.join(counted_broadcast(w.select("qid", "term", "weight")), "term").groupBy("key", "qid").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))

    by = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "key")
    cut = lambda d: d.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)
    found, todo, floor = [], weights, None  # floor: a score that top_k documents of a query are known to have
    for share in COMMON:
        common = todo.where(F.col("share") >= share)
        add = materialize(common.groupBy("qid").agg(F.sum("most").alias("add")), "add")
        rare = score(todo.where(F.col("share") < share))
        if floor is not None:
            at_least = floor.join(add, "qid", "left").select("qid", (F.col("least") - F.coalesce("add", F.lit(0.0)) - 1e-6).alias("at_least"))
            rare = rare.join(counted_broadcast(at_least), "qid", "left").where(F.col("score") >= F.coalesce("at_least", F.lit(0.0))).select("key", "qid", "score")
        rare = materialize(rare, "rare")
        least = floor = materialize(cut(rare).where(F.col("rank") == top_k).select("qid", F.col("score").alias("least")), "least")
        safe = least.join(add, "qid", "left").withColumn("add", F.coalesce("add", F.lit(0.0))).where(F.col("least") > F.col("add") + 1e-6)
        safe = materialize(safe, "safe")  # a row a query
        able = materialize(rare.join(counted_broadcast(safe), "qid").where(F.col("score") + F.col("add") >= F.col("least") - 1e-6).select("qid", "key", "score"), "able")
        of_common = impacts.join(counted_broadcast(common.select("term").distinct()), "term", "left_semi").join(counted_broadcast(able.select("key").distinct()), "key", "left_semi")
        more = able.select("qid", "key").join(of_common, "key").join(counted_broadcast(common.select("qid", "term", "weight")), ["qid", "term"]).select("qid", "key", (F.col("weight") * F.col("impact")).alias("score"))
        found.append(cut(able.unionByName(more).groupBy("qid", "key").agg(F.sum("score").alias("score"))))
        todo = materialize(todo.join(counted_broadcast(safe.select("qid")), "qid", "left_anti"), "todo")
        if todo.isEmpty():
            break
    else:
        found.append(cut(score(todo)))
    best = found[0].select("qid", "key", "score")
    for f in found[1:]:
        best = best.unionByName(f.select("qid", "key", "score"))
    best = materialize(best, "best")  # top_k rows a query
    full = best.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= top_k).select("qid")
    first = F.broadcast(index.docs.select("key").orderBy("key").limit(top_k))
    fill = queries.select(F.col(query_id).alias("qid")).distinct().join(full, "qid", "left_anti").crossJoin(first).join(best.select("qid", "key"), ["qid", "key"], "left_anti").select("qid", "key", F.lit(0.0).alias("score"))
    return cut(best.unionByName(fill)).select(F.col("qid").alias(query_id), F.col("key").alias(index.key), "rank", "score")

"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import generation, text
from tessera.functions.hashing import paragraph_id
from tessera.operators import corpus, errors, metrics, packing, provenance, retrieval, sampling, stats, systems
from tessera.operators.packing import PackPlan
from tessera.plans import sqltext as q
from tessera.plans import sweep
from tessera.runtime import first_delivery, materialize, table
from tessera.sources import records

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: SQL of failed predictions with their labels, and the labels in order.
_SUP = f"""{q.PRED}, ln AS (SELECT generation_id, unnest(string_split(coalesce(evidence, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(evidence, ''), chr(10)), 1) AS i FROM pred),
lt AS (SELECT *, max(CASE WHEN starts_with(x, 'Title: ') THEN i END) OVER (PARTITION BY generation_id ORDER BY i) AS ti FROM ln),
lk AS (SELECT p.example_id, s.generation_id, coalesce(substr(t.x, 8), '') AS title, substr(s.x, 3) AS text FROM lt s JOIN pred p USING (generation_id) LEFT JOIN ln t ON t.generation_id = s.generation_id AND t.i = s.ti WHERE starts_with(s.x, '- ')),
ge AS (SELECT * FROM (SELECT example_id, context, supporting_facts, row_number() OVER (PARTITION BY example_id ORDER BY split) AS k FROM ex) WHERE k = 1),
gp AS (SELECT example_id, unnest(context) AS p, generate_subscripts(context, 1) AS pi FROM ge),
gs AS (SELECT example_id, pi, coalesce(p.title, '') AS title, unnest(p.sentences) AS text, generate_subscripts(p.sentences, 1) - 1 AS sid FROM gp),
gf AS (SELECT example_id, title, text, min(struct_pack(p := pi, s := sid)).s AS sid FROM gs GROUP BY ALL),
sk AS (SELECT DISTINCT lk.generation_id, lk.title, gf.sid FROM lk JOIN gf ON gf.example_id = lk.example_id AND gf.title = lk.title AND gf.text = lk.text),
gg AS (SELECT example_id, list_distinct(list_transform(coalesce(supporting_facts, []), lambda f: coalesce(f.title, chr(2)) || chr(1) || coalesce(f.sent_id::VARCHAR, chr(2)))) AS gold FROM ge),
sp AS (SELECT generation_id, list(title || chr(1) || sid) AS keys FROM sk GROUP BY generation_id),
sup AS (SELECT pred.*, len(coalesce(keys, [])) AS n_keys, len(gold) AS n_gold, len(list_intersect(coalesce(keys, []), gold)) AS hits, CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(keys, []), gold))::DOUBLE / len(gold) END AS cover FROM pred JOIN gg USING (example_id) LEFT JOIN sp USING (generation_id))"""
_CAT = f"""{_SUP}, c0 AS (SELECT *, {q.norm('evidence')} AS ne FROM sup WHERE em = 0),
c1 AS (SELECT *, np = 'insufficient evidence' AS ab, (ng <> '' AND contains(ne, ng)) AS known, (np <> '' AND contains(ne, np)) AS seen, {q.trm('np')} AS tp, {q.trm('ng')} AS tg, regexp_extract_all(coalesce(text, ''), '(\\d+)', 1) AS dp, regexp_extract_all(coalesce(answer, ''), '(\\d+)', 1) AS dg FROM c0),
c2 AS (SELECT *, np <> '' AND ng <> '' AND (f1 >= 0.5 OR contains(np, ng) OR contains(ng, np) OR (len(dp) > 0 AND dp = dg) OR {q.jac('tp', 'tg')} >= 0.8) AS form, cover > 0 AND cover < 1 AS part, cover >= 0.75 OR known AS whole, cover < 0.5 AND NOT known AS weak FROM c1),
cat AS (SELECT generation_id, example_id, token_budget, method, em, f1, cover, text, CASE WHEN NOT ab AND form THEN 'formatting_mismatch' WHEN ab AND weak THEN 'support_missing' WHEN ab AND whole THEN 'support_present_answer_wrong' WHEN ab AND part THEN 'multi_hop_reasoning_failure' WHEN ab THEN 'support_present_answer_wrong'
  WHEN weak THEN 'insufficient_evidence_forced_answer' WHEN qtype IN ('bridge', 'comparison') AND part AND NOT known THEN 'multi_hop_reasoning_failure' WHEN whole THEN 'support_present_answer_wrong' WHEN part THEN 'multi_hop_reasoning_failure' WHEN NOT seen AND f1 = 0 THEN 'hallucination' ELSE 'other' END AS category FROM c2)"""
_LABELS = "[" + ",".join(f"'{c}'" for c in errors.CATEGORIES) + "]"


# Base tables: each record once.


def examples(spark, sf) -> DataFrame:
    e = first_delivery(table(spark, sf, "examples"), ["example_id", "split"])
    return e.withColumn("eid", F.concat_ws(":", "split", "example_id"))


def generations(spark, sf) -> DataFrame:
    return first_delivery(table(spark, sf, "generations"), ["generation_id"])


def paragraphs(spark, sf) -> DataFrame:
    return first_delivery(table(spark, sf, "corpus"), ["paragraph_id"])


def retrieved(spark, sf) -> DataFrame:
    return first_delivery(table(spark, sf, "retrieved"), ["example_id", "paragraph_id"])


def runs(spark, sf) -> DataFrame:
    return first_delivery(table(spark, sf, "benchmark_runs"), ["run_id"], "recorded_at")


def predictions(spark, sf) -> DataFrame:
    """Generated answers with the gold answer of the example's first split, exact match and F1."""
    gold = examples(spark, sf).groupBy("example_id").agg(F.min_by(F.struct("answer", "qtype"), "split").alias("g")).select("example_id", "g.answer", "g.qtype")
    p = generations(spark, sf).select("generation_id", "example_id", "method", "token_budget", "evidence", "text").join(gold, "example_id")
    return p.withColumn("em", metrics.exact_match(F.col("text"), F.col("answer"))).withColumn("f1", metrics.answer_f1(F.col("text"), F.col("answer")))


def supported(spark, sf) -> DataFrame:
    """predictions with keys, the support keys that the evidence holds, gold, those of the example's first split, and cover, the share of gold that is held."""
    e = examples(spark, sf).select("example_id", "split", text.sentence_list(F.col("context")).alias("sentences"), F.col("supporting_facts").alias("gold"))
    first = e.groupBy("example_id").agg(F.min_by(F.struct("sentences", "gold"), "split").alias("s"))
    p = predictions(spark, sf).join(first, "example_id")
    p = p.withColumn("keys", text.evidence_keys(F.col("evidence"), F.col("s.sentences"))).withColumn("gold", F.col("s.gold")).drop("s")
    return p.withColumn("cover", metrics.coverage(F.col("keys"), F.col("gold")))


def ranked(spark, sf) -> DataFrame:
    return retrieval.rank_context(examples(spark, sf).select("eid", "question", "qtype", "context", "supporting_facts"))


def cands(spark, sf) -> DataFrame:
    return packing.candidates(ranked(spark, sf)).select("eid", "question_terms", "cands", "supporting_facts")


# Text


@query(f"SELECT doc_id, len({q.tok('text')})::BIGINT AS n_tokens, len({q.trm('text')})::BIGINT AS n_terms, ({q.spaces('text')})::BIGINT AS n_parts FROM documents")
def tok_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(text.terms(F.col("text"))).cast("long").alias("n_terms"), text.space_count(F.col("text")).cast("long").alias("n_parts"))


@query(f"WITH {q.GEN} SELECT generation_id, round({q.jac('a', 'b')}, 9) AS overlap FROM (SELECT generation_id, {q.trm('question')} AS a, {q.trm('text')} AS b FROM gen)")
def term_overlap(spark, sf):
    return generations(spark, sf).select("generation_id", F.round(text.jaccard(text.terms(F.col("question")), text.terms(F.col("text"))), 9).alias("overlap"))


@query(f"WITH {q.EX} SELECT eid, {q.norm('answer')} AS answer FROM ex")
def normalize_answers(spark, sf):
    return examples(spark, sf).select("eid", text.normalize_answer(F.col("answer")).alias("answer"))


@query(f"WITH {q.COR} SELECT paragraph_id, t AS text, 'paragraph-' || sha256(to_json([coalesce(title, ''), t])) AS content_id FROM (SELECT *, {q.para('sentences')} AS t FROM cor)")
def paragraph_texts(spark, sf):
    p = paragraphs(spark, sf).select("paragraph_id", "title", text.paragraph_text(F.col("sentences")).alias("text"))
    return p.select("paragraph_id", "text", paragraph_id(F.coalesce("title", F.lit("")), F.col("text")).alias("content_id"))


_LINES = f"array_to_string(list_filter(list_transform(string_split(coalesce(evidence, ''), chr(10)), lambda z: {q.strip('z')}), lambda z: z <> ''), ' ')"


@query(f"WITH {q.GEN} SELECT generation_id, CASE WHEN length(l) <= 420 THEN l ELSE regexp_replace(substr(l, 1, 417), '{q.WS}+$', '') || '...' END AS excerpt FROM (SELECT generation_id, {_LINES} AS l FROM gen)")
def excerpts(spark, sf):
    return generations(spark, sf).select("generation_id", text.excerpt(F.col("evidence")).alias("excerpt"))


@query(f"WITH {q.GEN} SELECT generation_id, regexp_replace({q.strip('text')}, '^(?:(?:assistant|final answer)\\s*:?\\s*)+', '', 'i') AS answer FROM gen")
def stripped_answers(spark, sf):
    return generations(spark, sf).select("generation_id", text.strip_answer_labels(F.col("text")).alias("answer"))


@query(f"WITH {q.GEN} SELECT generation_id, CASE WHEN e = '' THEN 'insufficient evidence' ELSE {q.strip('string_split(e, chr(10))[1]')} END AS answer FROM (SELECT generation_id, {q.strip(chr(99) + 'oalesce(evidence, ' + chr(39) * 2 + ')')} AS e FROM gen)")
def echo_answers(spark, sf):
    return generations(spark, sf).select("generation_id", generation.echo(F.col("evidence")).alias("answer"))


@query(f"WITH {q.GEN}, p AS (SELECT generation_id, {q.strip(chr(99) + 'oalesce(evidence, ' + chr(39) * 2 + ')')} AS e, {q.strip(chr(99) + 'oalesce(question, ' + chr(39) * 2 + ')')} AS x FROM gen) SELECT generation_id, 'Evidence:' || chr(10) || CASE WHEN e = '' THEN 'No evidence provided.' ELSE e END || chr(10) || chr(10) || 'Question: ' || x AS prompt, 'User:' || chr(10) || 'Evidence:' || chr(10) || CASE WHEN e = '' THEN 'No evidence provided.' ELSE e END || chr(10) || chr(10) || 'Question: ' || x || chr(10) || chr(10) || 'Assistant:' AS completion FROM p")
def prompts(spark, sf):
    return generations(spark, sf).select("generation_id", generation.prompt(F.col("question"), F.col("evidence")).alias("prompt"), generation.completion(F.col("question"), F.col("evidence"), system="").alias("completion"))


# Retrieval


@query(f"WITH {q.COR}, t AS (SELECT DISTINCT paragraph_id, unnest({q.tok('coalesce(title, ' + chr(39) * 2 + ') || chr(32) || ' + q.para('sentences'))}) AS term FROM cor) SELECT term, count(*) AS df FROM t GROUP BY term")
def doc_freq(spark, sf):
    return retrieval.build_index(paragraphs(spark, sf), "paragraph_id").doc_freq()


@query(f"WITH {q.COR}, t AS (SELECT paragraph_id, unnest({q.tok('coalesce(title, ' + chr(39) * 2 + ') || chr(32) || ' + q.para('sentences'))}) AS term FROM cor) SELECT term, paragraph_id, count(*) AS tf FROM t GROUP BY term, paragraph_id")
def index_postings(spark, sf):
    return retrieval.build_index(paragraphs(spark, sf), "paragraph_id").postings.select("term", F.col("key").alias("paragraph_id"), "tf")


@query(f"WITH {q.RANKED} SELECT eid, rank::INTEGER AS rank, pos::INTEGER AS pos, round(score, 6) AS score FROM rk")
def bm25_context_topk(spark, sf):
    r = ranked(spark, sf).select("eid", F.explode("ranked").alias("r"))
    return r.select("eid", "r.rank", "r.pos", F.round("r.score", 6).alias("score"))


_HUNDREDTH = "('0x' || substr(md5(example_id), 1, 8))::BIGINT % 100 = 0"


_GLOBAL = f"""WITH {q.EX}, {q.COR},
qs AS (SELECT eid, question FROM ex WHERE {_HUNDREDTH}),
d AS (SELECT paragraph_id, document_id, {q.tok("coalesce(title, '') || ' ' || " + q.para('sentences'))} AS toks FROM cor),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM d),
q AS (SELECT eid, t, count(*) AS qf FROM (SELECT eid, unnest({q.tok('question')}) AS t FROM qs) GROUP BY eid, t),
tf AS (SELECT paragraph_id, t, count(*)::DOUBLE AS tf FROM (SELECT paragraph_id, unnest(toks) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY paragraph_id, t),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
sc AS (SELECT q.eid, tf.paragraph_id, {q._bm()} AS score FROM tf JOIN q USING (t) JOIN df USING (t) JOIN (SELECT paragraph_id, len(toks) AS dl FROM d) l USING (paragraph_id), s GROUP BY q.eid, tf.paragraph_id),
fill AS (SELECT eid, paragraph_id, 0.0 AS score FROM qs, (SELECT paragraph_id FROM d ORDER BY document_id, paragraph_id LIMIT 5) f WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.eid = qs.eid AND sc.paragraph_id = f.paragraph_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY round(score, 9) DESC, document_id, paragraph_id) AS rank FROM (SELECT * FROM sc UNION ALL SELECT * FROM fill) JOIN (SELECT paragraph_id, document_id FROM d) USING (paragraph_id))
"""


@query(_GLOBAL + "SELECT eid, paragraph_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def bm25_global_topk(spark, sf):
    """Searches with every example whose hashed id is divisible by 100, against the whole corpus; equal scores by document, then paragraph."""
    return _global(spark, sf).select("eid", "paragraph_id", "rank", F.round("score", 6).alias("score"))


def _queries(spark, sf) -> DataFrame:
    return examples(spark, sf).where(F.pmod(F.conv(F.substring(F.md5("example_id"), 1, 8), 16, 10).cast("long"), F.lit(100)) == 0)


def _global(spark, sf) -> DataFrame:
    docs = paragraphs(spark, sf).withColumn("key", F.struct("document_id", "paragraph_id"))
    r = retrieval.rank_corpus(retrieval.build_index(docs, "key"), _queries(spark, sf), "eid", "question")
    return r.select("eid", F.col("key.paragraph_id").alias("paragraph_id"), "rank", "score")


@query(_GLOBAL + """, gd AS (SELECT DISTINCT eid, paragraph_id FROM (SELECT paragraph_id, unnest(source_example_ids) AS example_id FROM cor) JOIN ex USING (example_id) WHERE eid IN (SELECT eid FROM qs)),
g AS (SELECT gd.eid, count(*) AS n_gold, count(r.rank) AS hits, min(r.rank) AS first FROM gd LEFT JOIN r ON r.eid = gd.eid AND r.paragraph_id = gd.paragraph_id AND r.rank <= 5 GROUP BY gd.eid)
SELECT 'global_corpus' AS retrieval_mode, 'bm25' AS retrieval_method, 5 AS top_k, count(*) AS n, round(avg(hits::DOUBLE / n_gold), 6) AS recall, round(avg((hits = n_gold)::DOUBLE), 6) AS all_gold, round(avg((hits > 0)::DOUBLE), 6) AS any_gold, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, round(avg(CASE WHEN n_gold = 2 THEN (hits = 2)::DOUBLE END), 6) AS both_gold FROM g""")
def global_retrieval(spark, sf):
    """Evaluation of the corpus search against the paragraphs that each query's example came from: one row with its protocol and means."""
    r = materialize(_global(spark, sf), "retrieved")
    qs = _queries(spark, sf).select("example_id", "eid")
    gold = paragraphs(spark, sf).select("paragraph_id", F.explode("source_example_ids").alias("example_id")).join(qs, "example_id").select("eid", "paragraph_id")
    m = metrics.ranking_metrics(r, gold, "eid", "paragraph_id").withColumns({"query": F.col("eid"), "retrieval_mode": F.lit("global_corpus"), "retrieval_method": F.lit("bm25"), "top_k": F.lit(5)})
    t = metrics.retrieval_summary(m, ("retrieval_mode", "retrieval_method", "top_k"))
    return t.select("retrieval_mode", "retrieval_method", "top_k", "n", *[F.round(c, 6).alias(c) for c in metrics.RETRIEVAL_MEANS])


@query(f"""WITH {q.RANKED},
gold AS (SELECT DISTINCT eid, f.title FROM (SELECT eid, unnest(supporting_facts) AS f FROM ex) WHERE f.title IS NOT NULL),
ks AS (SELECT unnest([1, 3, 5]) AS k),
h AS (SELECT gold.eid, gold.title, min(rank) AS rank FROM gold LEFT JOIN rk ON rk.eid = gold.eid AND rk.title = gold.title GROUP BY ALL),
r AS (SELECT e.eid, k, CASE WHEN count(h.title) = 0 THEN 1.0 ELSE count(CASE WHEN h.rank <= k THEN 1 END)::DOUBLE / count(h.title) END AS r FROM ex e CROSS JOIN ks LEFT JOIN h ON h.eid = e.eid GROUP BY e.eid, k)
SELECT k, count(*) AS n, round(avg(r), 9) AS recall FROM r GROUP BY k""")
def recall_at_k(spark, sf):
    base = ranked(spark, sf).select("eid", "ranked", "supporting_facts")
    got = base.select("eid", F.explode("ranked").alias("r")).select("eid", F.col("r.title").alias("title"), F.col("r.rank").alias("rank"))
    gold = base.select("eid", F.explode_outer("supporting_facts").alias("f")).select("eid", F.col("f.title").alias("title"))
    return metrics.recall_at(got, gold, "eid", "title", (1, 3, 5)).select("k", "n", F.round("recall", 9).alias("recall"))


@query(f"""WITH {q.COR}, {q.RET}, gold AS (SELECT DISTINCT e AS example_id, paragraph_id FROM (SELECT paragraph_id, unnest(source_example_ids) AS e FROM cor) WHERE e IS NOT NULL),
g AS (SELECT gold.example_id, count(*) AS n_gold, count(ret.rank) AS hits, min(ret.rank) AS first FROM gold LEFT JOIN ret ON ret.example_id = gold.example_id AND ret.paragraph_id = gold.paragraph_id GROUP BY gold.example_id)
SELECT example_id, n_gold, hits, round(hits::DOUBLE / n_gold, 9) AS recall, (hits = n_gold)::DOUBLE AS all_gold, (hits > 0)::DOUBLE AS any_gold, round(coalesce(1.0 / first, 0.0), 9) AS mrr, CASE WHEN n_gold = 2 THEN (hits = 2)::DOUBLE END AS both_gold FROM g""")
def retrieval_metrics(spark, sf):
    gold = paragraphs(spark, sf).select(F.explode("source_example_ids").alias("example_id"), "paragraph_id").where("example_id is not null")
    m = metrics.ranking_metrics(retrieved(spark, sf), gold, "example_id", "paragraph_id")
    return m.select("example_id", "n_gold", "hits", F.round("recall", 9).alias("recall"), "all_gold", "any_gold", F.round("mrr", 9).alias("mrr"), "both_gold")


@query(f"""WITH {q.EX}, p AS (SELECT example_id, unnest(context) AS p FROM ex), t AS (SELECT example_id, coalesce(p.title, '') AS title, {q.para('p.sentences')} AS text, p.sentences AS s FROM p)
SELECT 'paragraph-' || sha256(to_json([title, text])) AS corpus_id, title, text, count(DISTINCT example_id) AS n_examples, array_to_string(list_sort(list_distinct(list(example_id))), ',') AS source_example_ids FROM t GROUP BY title, text""")
def dedup_corpus(spark, sf):
    c = corpus.paragraph_corpus(examples(spark, sf))
    return c.select("corpus_id", "title", "text", F.size("source_example_ids").cast("long").alias("n_examples"), F.array_join("source_example_ids", ",").alias("source_example_ids"))


@query(f"""WITH {q.EX}, f AS (SELECT DISTINCT eid, f.title FROM (SELECT eid, unnest(supporting_facts) AS f FROM ex) WHERE f.title IS NOT NULL), c AS (SELECT eid, p.title, count(*) AS n FROM (SELECT eid, unnest(context) AS p FROM ex) WHERE p.title IS NOT NULL GROUP BY ALL)
SELECT f.eid, f.title, coalesce(c.n, 0) AS n_matches FROM f LEFT JOIN c ON c.eid = f.eid AND c.title = f.title""")
def gold_paragraphs(spark, sf):
    return corpus.gold_paragraphs(examples(spark, sf), "eid")


@query(f"WITH {q.RET} SELECT 'retrieval_method' AS field, example_id, count(DISTINCT coalesce(retrieval_method, chr(0))) AS n_values FROM ret GROUP BY example_id UNION ALL SELECT 'top_k', example_id, count(DISTINCT coalesce(top_k, -1)) FROM ret GROUP BY example_id")
def retrieval_protocol(spark, sf):
    return provenance.constant_fields(retrieved(spark, sf), ["retrieval_method", "top_k"], ["example_id"])


# Candidates and packing


@query(f"WITH {q.CANDS} SELECT eid, pos::INTEGER AS pos, title, sid::INTEGER AS sentence_id, tok::INTEGER AS token_count, round(qoverlap, 9) AS query_overlap, round(toverlap, 9) AS title_overlap, round(ps, 6) AS paragraph_score, round(0.55 * qoverlap + 0.35 * ps + 0.10 * toverlap, 6) AS relevance FROM cd")
def sentence_candidates(spark, sf):
    c = cands(spark, sf).select("eid", F.posexplode("cands").alias("pos", "c"))
    rel = sum(F.col(f"c.{k}") * w for k, w in packing.BASE.items())
    return c.select("eid", "pos", "c.title", "c.sentence_id", "c.token_count", F.round("c.query_overlap", 9).alias("query_overlap"), F.round("c.title_overlap", 9).alias("title_overlap"), F.round("c.paragraph_score", 6).alias("paragraph_score"), F.round(rel, 6).alias("relevance"))


_PARA = f"""{q.RANKED}, pc AS (SELECT *, sum({q.spaces("array_to_string(sentences, ' ')")}) OVER (PARTITION BY eid ORDER BY rank) AS upto FROM rk),
keys AS (SELECT DISTINCT eid, coalesce(title, '') AS title, s.sid FROM pc, (SELECT unnest(range(0, 1000)) AS sid) s WHERE upto <= 160 AND s.sid < len(sentences))"""


@query(f"WITH {_PARA} SELECT e.eid, coalesce(max(CASE WHEN upto <= 160 THEN upto END), 0)::INTEGER AS used_tokens, count(CASE WHEN upto <= 160 THEN 1 END)::INTEGER AS n_paragraphs, coalesce((SELECT count(*) FROM keys k WHERE k.eid = e.eid), 0)::INTEGER AS n_keys FROM ex e LEFT JOIN pc USING (eid) GROUP BY e.eid")
def pack_paragraph(spark, sf):
    p = packing.pack_paragraphs(ranked(spark, sf), "eid")
    return p.select("eid", "used_tokens", "n_paragraphs", F.size("support").alias("n_keys"))


def _positions(spark, sf, plan: PackPlan) -> DataFrame:
    p = packing.pack(cands(spark, sf), "eid", [plan])
    return p.select("eid", "used_tokens", F.array_join(F.transform("selected", lambda s: s["pos"].cast("string")), ",").alias("positions"))


_FOLD = f"""WITH {q.CANDS}, l AS (SELECT eid, list(struct_pack(pos := pos, tok := tok, key := title || chr(1) || sid) ORDER BY qoverlap DESC, round(ps, 12) DESC, toverlap DESC, pos) AS cs FROM cd GROUP BY eid),
f AS (SELECT eid, list_reduce(list_prepend(struct_pack(used := 0::BIGINT, pos := []::BIGINT[], keys := []::VARCHAR[], c := NULL::STRUCT(pos BIGINT, tok INTEGER, key VARCHAR)), list_transform(cs, lambda c: struct_pack(used := 0::BIGINT, pos := []::BIGINT[], keys := []::VARCHAR[], c := struct_pack(pos := c.pos::BIGINT, tok := c.tok::INTEGER, key := c.key)))),
  lambda a, x: CASE WHEN a.used + x.c.tok > 160 OR list_contains(a.keys, x.c.key) THEN a ELSE struct_pack(used := (a.used + x.c.tok)::BIGINT, pos := list_append(a.pos, x.c.pos), keys := list_append(a.keys, x.c.key), c := a.c) END) AS r FROM l)
SELECT e.eid, coalesce(r.used, 0)::INTEGER AS used_tokens, coalesce(array_to_string(r.pos, ','), '') AS positions FROM ex e LEFT JOIN f USING (eid)"""


@query(_FOLD)
def pack_relevance(spark, sf):
    return _positions(spark, sf, PackPlan("relevance", "relevance"))


@query(_FOLD)
def pack_relevance_columns(spark, sf):
    p = packing.relevance_in_sql(cands(spark, sf), "eid")
    return p.select("eid", "used_tokens", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(q.greedy(q.cover_score(), stop="AND (step = 0 OR b.score >= 0.0)"))
def pack_cover_full(spark, sf):
    return _positions(spark, sf, PackPlan("cover"))


@query(q.greedy(q.cover_score(gamma=0.0), stop="AND (step = 0 OR b.score >= 0.0)"))
def pack_cover_no_redundancy(spark, sf):
    return _positions(spark, sf, PackPlan("cover").variant("no_redundancy"))


@query(q.greedy(q.cover_score(beta=0.0), stop="AND (step = 0 OR b.score >= 0.0)"))
def pack_cover_no_query_coverage(spark, sf):
    return _positions(spark, sf, PackPlan("cover").variant("no_query_coverage"))


@query(q.greedy(q.cover_score(bonus=0.0), stop="AND (step = 0 OR b.score >= 0.0)"))
def pack_cover_no_title_gain(spark, sf):
    return _positions(spark, sf, PackPlan("cover").variant("no_title_gain"))


@query(q.greedy(q.cover_score(delta=0.0), stop="AND (step = 0 OR b.score >= 0.0)"))
def pack_cover_no_token_penalty(spark, sf):
    return _positions(spark, sf, PackPlan("cover").variant("no_token_penalty"))


@query(q.greedy("round(0.5 * c.rel - 0.5 * nn.near, 12)"))
def pack_mmr(spark, sf):
    return _positions(spark, sf, PackPlan("mmr", "mmr"))


@query(q.greedy("len(list_filter(list_intersect(c.terms, c.qterms), lambda z: NOT list_contains(g.covered, z)))::DOUBLE / c.tok", stop="AND b.score > 0"))
def pack_query_cover(spark, sf):
    return _positions(spark, sf, PackPlan("query_cover", "query_cover"))


@query()
def pack_random(spark, sf):
    return _positions(spark, sf, PackPlan("random", "random"))


@query(q.greedy(q.cover_score(), stop="AND (step = 0 OR b.score >= 0.0)", final=q.CHOSEN + """, bl AS (SELECT eid, title, min(i) AS i, 'Title: ' || title || chr(10) || string_agg('- ' || text, chr(10) ORDER BY i) AS block FROM ch GROUP BY eid, title)
SELECT e.eid, coalesce(any_value(tk.used), 0)::INTEGER AS used_tokens, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY bl.i), '') AS evidence FROM ex e LEFT JOIN tk USING (eid) LEFT JOIN bl USING (eid) GROUP BY e.eid"""))
def render_evidence(spark, sf):
    p = packing.pack(cands(spark, sf), "eid", [PackPlan("cover")])
    return p.select("eid", "used_tokens", text.render(F.col("selected")).alias("evidence"))


def _scored(spark, sf, plans: list[PackPlan]) -> DataFrame:
    """Support metrics of each plan's selection against the supporting facts."""
    p = packing.pack(cands(spark, sf), "eid", plans, ["supporting_facts"])
    pred = F.transform("selected", lambda s: F.struct(s["title"].alias("title"), s["sentence_id"].alias("sent_id")))
    gold = F.col("supporting_facts")
    m = metrics.support_metrics(pred, gold)
    return p.select("eid", "config_id", "method", "budget", "used_tokens", *[v.alias(f"support_{k}") for k, v in m.items()], metrics.coverage(pred, gold).alias("coverage"))


_MEANS = ["used_tokens", "support_em", "support_precision", "support_recall", "support_f1", "coverage"]


def _summary(df: DataFrame, by: list[str]) -> DataFrame:
    s = metrics.method_summary(df, by, _MEANS)
    return s.select(*by, "n", *[F.round(c, 6).alias(c) for c in _MEANS])


_METHOD_PLANS = [PackPlan(m, m) for m in ("cover", "mmr", "query_cover", "relevance", "none")]


@query(q.summaries(_METHOD_PLANS, "method, budget"))
def method_summary(spark, sf):
    """One row for each selector: means over all examples."""
    return _summary(_scored(spark, sf, _METHOD_PLANS), ["method", "budget"])


@query(q.summaries(sweep.budgets(), "config_id, method, budget"))
def budget_sweep(spark, sf):
    return _summary(_scored(spark, sf, sweep.budgets()), ["config_id", "method", "budget"])


@query(q.summaries(sweep.sweep(), "config_id, method, budget"))
def sweep_29(spark, sf):
    return _summary(_scored(spark, sf, sweep.sweep()), ["config_id", "method", "budget"])


@query(" UNION ALL ".join(f"SELECT 'depth-{d}' AS config_id, count(*) AS n, round(avg(used_tokens), 6) AS used_tokens, round(avg(CASE WHEN positions = '' THEN 0 ELSE len(string_split(positions, ',')) END), 6) AS n_sentences FROM ({q.greedy(q.cover_score(), stop='AND (step = 0 OR b.score >= 0.0)').replace('WHERE rank <= 5', f'WHERE rank <= {d}')})" for d in sweep.DEPTHS))
def depth_sweep(spark, sf):
    """The cover selector on the best paragraphs up to each depth: ranked once, then cut at each depth."""
    e = examples(spark, sf).select("eid", "question", "context")
    r = retrieval.rank_context(e, max(sweep.DEPTHS)).select("eid", "question", "ranked")
    each = F.explode(F.array(*[F.struct(F.lit(f"depth-{d}").alias("depth"), F.slice("ranked", 1, d).alias("ranked")) for d in sweep.DEPTHS]))
    c = packing.candidates(r.select("eid", "question", each.alias("x")).select("eid", "question", "x.depth", "x.ranked"))
    p = packing.pack(c, "eid", [PackPlan("cover")], ["depth"]).groupBy(F.col("depth").alias("config_id"))
    return p.agg(F.count("*").alias("n"), F.round(F.avg("used_tokens"), 6).alias("used_tokens"), F.round(F.avg(F.size("selected")), 6).alias("n_sentences"))


@query(f"""WITH {_PARA}, g AS (SELECT DISTINCT eid, f.title, f.sent_id FROM (SELECT eid, unnest(supporting_facts) AS f FROM ex)),
n AS (SELECT e.eid, (SELECT count(*) FROM keys k WHERE k.eid = e.eid) AS np, (SELECT count(*) FROM g WHERE g.eid = e.eid) AS ng, (SELECT count(*) FROM g JOIN keys k ON k.eid = g.eid AND k.title = g.title AND k.sid = g.sent_id WHERE g.eid = e.eid) AS h FROM ex e)
SELECT eid, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE (h = np AND h = ng)::DOUBLE END AS support_em, round(CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE h::DOUBLE / np END, 9) AS support_precision,
round(CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE h::DOUBLE / ng END, 9) AS support_recall, round(CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE 2.0 * h / (np + ng) END, 9) AS support_f1, round(CASE WHEN ng = 0 THEN 1.0 ELSE h::DOUBLE / ng END, 9) AS coverage FROM n""")
def support_metrics(spark, sf):
    r = ranked(spark, sf)
    p = packing.pack_paragraphs(r.withColumn("key", F.struct("eid", "supporting_facts")), "key").select("key.eid", "key.supporting_facts", "support")
    pred = F.transform("support", lambda s: F.struct(s["title"].alias("title"), s["sentence_id"].alias("sent_id")))
    m = metrics.support_metrics(pred, F.col("supporting_facts"))
    return p.select("eid", *[F.round(v, 9).alias(f"support_{k}") for k, v in m.items()], F.round(metrics.coverage(pred, F.col("supporting_facts")), 9).alias("coverage"))


@query(q.greedy(q.cover_score(), stop="AND (step = 0 OR b.score >= 0.0)", final=q.CHOSEN + f""", pr AS (SELECT a.eid, avg({q.jac("a.terms", "b.terms")}) AS mean, max({q.jac("a.terms", "b.terms")}) AS most FROM ch a JOIN ch b ON a.eid = b.eid AND a.i < b.i GROUP BY a.eid),
sm AS (SELECT eid, count(*) AS n, count(DISTINCT title) AS titles, list_distinct(flatten(list(terms))) AS found, list(title || chr(1) || sid) AS keys FROM ch GROUP BY eid),
gd AS (SELECT eid, list_distinct(list_transform(coalesce(supporting_facts, []), lambda f: coalesce(f.title, chr(2)) || chr(1) || coalesce(f.sent_id::VARCHAR, chr(2)))) AS gold FROM ex)
SELECT e.eid, CASE WHEN len(qt.qterms) = 0 THEN 1.0 ELSE round(len(list_intersect(qt.qterms, coalesce(found, [])))::DOUBLE / len(qt.qterms), 9) END AS question_coverage, coalesce(titles, 0)::INTEGER AS unique_titles, round(coalesce(titles::DOUBLE / n, 0.0), 9) AS unique_title_ratio,
round(coalesce(pr.mean, 0.0), 9) AS mean_redundancy, round(coalesce(pr.most, 0.0), 9) AS max_redundancy, CASE WHEN len(gold) = 0 THEN 1.0 ELSE round(len(list_intersect(coalesce(keys, []), gold))::DOUBLE / len(gold), 9) END AS gold_recall
FROM ex e JOIN qt USING (eid) JOIN gd USING (eid) LEFT JOIN sm USING (eid) LEFT JOIN pr USING (eid)"""))
def coverage_diagnostics(spark, sf):
    c = cands(spark, sf).withColumn("asked", F.col("question_terms"))
    p = packing.pack(c, "eid", [PackPlan("cover")], ["asked", "supporting_facts"]).withColumnRenamed("asked", "question_terms")
    d = metrics.coverage_diagnostics(F.col("selected"), F.col("question_terms"), F.col("supporting_facts"))
    return p.select("eid", *[(F.round(v, 9) if k != "unique_titles" else v).alias(k) for k, v in d.items()])


# Answers and statistics


@query(f"WITH {q.PRED} SELECT generation_id, em, round(f1, 9) AS f1 FROM pred")
def answer_em_f1(spark, sf):
    return predictions(spark, sf).select("generation_id", "em", F.round("f1", 9).alias("f1"))


@query(f"WITH {q.PRED} SELECT method, token_budget, count(*) AS n, round(avg(em), 9) AS em, round(avg(f1), 9) AS f1 FROM pred GROUP BY method, token_budget")
def answer_summary(spark, sf):
    s = metrics.method_summary(predictions(spark, sf), ["method", "token_budget"], ["em", "f1"])
    return s.select("method", "token_budget", "n", F.round("em", 9).alias("em"), F.round("f1", 9).alias("f1"))


_METHODS = ["echo", "mmr", "paragraph", "relevance"]
#: Each method's first answer to an example at a budget, and cover against the others over the examples and budgets that both answered.
_ONE = f"{q.PRED}, one AS (SELECT example_id || ':' || token_budget AS unit, method, arg_min(em, generation_id) AS em, arg_min(f1, generation_id) AS f1 FROM pred WHERE method IS NOT NULL AND example_id IS NOT NULL AND token_budget IS NOT NULL GROUP BY ALL)"
_PAIRS = f"""{_ONE},
pairs AS (SELECT o.method AS comparison, c.unit, c.em AS a, o.em AS b, c.f1 - o.f1 AS diff FROM one c JOIN one o ON c.unit = o.unit AND c.method = 'cover' AND o.method IN ('echo', 'mmr', 'paragraph', 'relevance'))"""


def answers(spark, sf) -> DataFrame:
    """(unit, method, em, f1): each method's first answer to an example at a budget; unit is both."""
    p = predictions(spark, sf).where("method is not null and example_id is not null and token_budget is not null")
    first = p.groupBy(F.concat_ws(":", "example_id", "token_budget").alias("unit"), "method").agg(F.min_by(F.struct("em", "f1"), "generation_id").alias("x"))
    return materialize(first.select("unit", "method", "x.em", "x.f1"), "answers")


def pairs(spark, sf) -> DataFrame:
    """(comparison, unit, a, b, diff): cover against each other method, aligned over the examples and budgets that both answered; a and b are exact matches, diff is of F1."""
    one = answers(spark, sf).where(F.col("method").isin("cover", *_METHODS)).unpivot(["unit", "method"], ["em", "f1"], "metric", "value")
    p = stats.against_reference(one, "unit", "method", "metric", "value", "cover", shared=True)  # a: the other method, b: cover
    wide = p.groupBy("unit", "method").agg(F.max(F.when(F.col("metric") == "em", F.col("b"))).alias("a"), F.max(F.when(F.col("metric") == "em", F.col("a"))).alias("b"), F.max(F.when(F.col("metric") == "f1", -F.col("diff"))).alias("diff"))
    return wide.withColumnRenamed("method", "comparison")


@query(f"""WITH {_ONE}, m AS (SELECT unnest(['echo', 'mmr', 'paragraph', 'relevance']) AS method), c AS (SELECT unit FROM one WHERE method = 'cover')
SELECT m.method, (SELECT count(*) FROM one o WHERE o.method = m.method AND o.unit IN (SELECT unit FROM c)) AS n_shared, (SELECT count(*) FROM one o WHERE o.method = m.method AND o.unit NOT IN (SELECT unit FROM c)) AS n_only_run,
(SELECT count(*) FROM c WHERE unit NOT IN (SELECT o.unit FROM one o WHERE o.method = m.method)) AS n_only_reference FROM m""")
def populations(spark, sf):
    """How many examples and budgets each method shares with cover, and which it doesn't: what the paired queries leave out."""
    return stats.populations(answers(spark, sf).where(F.col("method").isin("cover", *_METHODS)), "unit", "method", "cover")


@query(f"WITH {_PAIRS} SELECT comparison, count(*) AS n, round(avg(diff), 9) AS mean_diff, round(CASE WHEN count(*) < 2 OR stddev_samp(diff) = 0 THEN CASE WHEN avg(diff) = 0 THEN 0.0 ELSE sign(avg(diff)) * 'inf'::DOUBLE END ELSE avg(diff) / stddev_samp(diff) END, 6) AS effect FROM pairs GROUP BY comparison")
def effect_size(spark, sf):
    e = stats.effect_size(pairs(spark, sf), ["comparison"])
    return e.select("comparison", "n", F.round("mean_diff", 9).alias("mean_diff"), F.round("effect", 6).alias("effect"))


_MCN = f"""{_PAIRS}, d AS (SELECT comparison, count(CASE WHEN a = 1 AND b = 0 THEN 1 END) AS only_a, count(CASE WHEN a = 0 AND b = 1 THEN 1 END) AS only_b FROM pairs GROUP BY comparison),
m AS (SELECT comparison, only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END AS p FROM d)"""


@query(f"WITH {_MCN} SELECT comparison, only_a, only_b, round(p, 6) AS p_value FROM m")
def mcnemar(spark, sf):
    return stats.mcnemar(pairs(spark, sf), ["comparison"]).select("comparison", "only_a", "only_b", F.round("p_value", 6).alias("p_value"))


@query(f"WITH {_MCN}, o AS (SELECT *, row_number() OVER (ORDER BY p, comparison) AS k, count(*) OVER () AS n FROM m) SELECT comparison, round(max(least(1.0, (n - k + 1) * p)) OVER (ORDER BY k), 6) AS p_holm FROM o")
def holm(spark, sf):
    return stats.holm(stats.mcnemar(pairs(spark, sf), ["comparison"]), order=["comparison"]).select("comparison", F.round("p_holm", 6).alias("p_holm"))


_BITS = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _draw(rep: str, slot: str, seed: int = 42) -> str:
    """The integers of stats.draw in SQL."""
    x = f"(({rep}::BIGINT * 1000003 + {slot}::BIGINT * 998244353 + {seed * 7919}) & 4294967295)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


@query(f"""WITH {_PAIRS}, v AS (SELECT comparison, diff, row_number() OVER (PARTITION BY comparison ORDER BY unit) - 1 AS o FROM pairs), n AS (SELECT comparison, count(*) AS n, avg(diff) AS mean FROM v GROUP BY comparison),
dr AS (SELECT comparison, rep, {_draw('rep', 'v.o')} % n AS o FROM v JOIN n USING (comparison), (SELECT unnest(range(0, 200)) AS rep) r),
m AS (SELECT dr.comparison, rep, avg(v.diff) AS m FROM dr JOIN v ON v.comparison = dr.comparison AND v.o = dr.o GROUP BY dr.comparison, rep)
SELECT n.comparison, n.n, round(any_value(mean), 9) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN n USING (comparison) GROUP BY n.comparison, n.n""")
def bootstrap_hash(spark, sf):
    b = stats.bootstrap_hash(pairs(spark, sf), ["comparison"], "unit", "diff")
    return b.select("comparison", "n", F.round("mean", 9).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {_PAIRS}, v AS (SELECT comparison, diff, row_number() OVER (PARTITION BY comparison ORDER BY unit) - 1 AS o FROM pairs), n AS (SELECT comparison, count(*) AS n, abs(avg(diff)) AS obs FROM v GROUP BY comparison),
m AS (SELECT comparison, rep, abs(avg(CASE WHEN {_draw('rep', 'v.o')} % 2 = 0 THEN diff ELSE -diff END)) AS m FROM v, (SELECT unnest(range(0, 500)) AS rep) r GROUP BY comparison, rep)
SELECT comparison, any_value(n) AS n, round((count(CASE WHEN m >= obs - 1e-12 THEN 1 END) + 1) / 501.0, 9) AS p_value FROM m JOIN n USING (comparison) GROUP BY comparison""")
def sign_test_hash(spark, sf):
    return stats.sign_test_hash(pairs(spark, sf), ["comparison"], "unit").select("comparison", "n", F.round("p_value", 9).alias("p_value"))


@query(f"""WITH {_ONE}, l AS (SELECT unit, method, 'em' AS metric, em AS v FROM one UNION ALL SELECT unit, method, 'f1', f1 FROM one),
p AS (SELECT a.method, a.metric, a.unit, a.v AS a, b.v AS b, a.v - b.v AS diff FROM l a JOIN l b ON a.unit = b.unit AND a.metric = b.metric AND b.method = 'echo' AND a.method <> 'echo'),
v AS (SELECT method, metric, diff, row_number() OVER (PARTITION BY method, metric ORDER BY unit) - 1 AS o FROM p),
n AS (SELECT method, metric, count(*) AS n, avg(a) AS mean, avg(b) AS reference_mean, avg(diff) AS delta, stddev_samp(diff) AS sd, count(CASE WHEN a = 1 AND b = 0 THEN 1 END) AS x, count(CASE WHEN a = 0 AND b = 1 THEN 1 END) AS y FROM p GROUP BY method, metric),
r AS (SELECT unnest(range(0, 10000)) AS rep),
bm AS (SELECT d.method, d.metric, rep, avg(w.diff) AS m FROM (SELECT v.method, v.metric, rep, {_draw('rep', 'v.o')} % n AS o FROM v JOIN n USING (method, metric), r) d JOIN v w ON w.method = d.method AND w.metric = d.metric AND w.o = d.o GROUP BY d.method, d.metric, rep),
ci AS (SELECT method, metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY method, metric),
sm AS (SELECT method, metric, rep, abs(avg(CASE WHEN {_draw('rep', 'v.o')} % 2 = 0 THEN diff ELSE -diff END)) AS m FROM v, r WHERE metric = 'f1' GROUP BY method, metric, rep),
sp AS (SELECT method, metric, (count(CASE WHEN m >= abs(delta) - 1e-12 THEN 1 END) + 1) / 10001.0 AS p FROM sm JOIN n USING (method, metric) GROUP BY method, metric),
t AS (SELECT n.*, low, high, CASE WHEN n.metric = 'em' THEN 'mcnemar' ELSE 'random sign' END AS test, CASE WHEN n < 2 OR coalesce(sd, 0) = 0 THEN CASE WHEN delta = 0 THEN 0.0 ELSE sign(delta) * 'inf'::DOUBLE END ELSE delta / sd END AS effect,
  CASE WHEN n.metric = 'f1' THEN sp.p WHEN x + y = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(0, least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))))) END AS p FROM n JOIN ci USING (method, metric) LEFT JOIN sp USING (method, metric)),
o AS (SELECT *, row_number() OVER (ORDER BY p, method, metric) AS k, count(*) OVER () AS f FROM t)
SELECT method, metric, n, test, round(mean, 6) AS mean, round(reference_mean, 6) AS reference_mean, round(delta, 6) AS delta, round(delta / nullif(abs(reference_mean), 0), 6) AS relative_delta, round(low, 6) AS low, round(high, 6) AS high, round(effect, 6) AS effect, round(p, 6) AS p_value,
round(max(least(1.0, (f - k + 1) * p)) OVER (ORDER BY k), 6) AS p_holm FROM o""")
def comparison_table(spark, sf):
    """Every other method against echo on both metrics, over the examples and budgets that both answered, with intervals, tests and correction over all rows."""
    one = answers(spark, sf).unpivot(["unit", "method"], ["em", "f1"], "metric", "value")
    t = stats.comparison_table(one, "unit", "method", "metric", "value", "echo", shared=True)
    return t.select("method", "metric", "n", "test", *[F.round(c, 6).alias(c) for c in ("mean", "reference_mean", "delta", "relative_delta", "low", "high", "effect", "p_value", "p_holm")])


@query(f"""WITH {_CAT}, f AS (SELECT example_id, method, min(category) AS category FROM cat GROUP BY ALL),
a AS (SELECT f.example_id, f.method, f.category, CASE WHEN o.example_id IS NULL THEN f.method || '_fail_only' ELSE 'both_fail' END AS outcome FROM f LEFT JOIN f o ON o.example_id = f.example_id AND o.method = CASE f.method WHEN 'cover' THEN 'echo' ELSE 'cover' END WHERE f.method IN ('cover', 'echo')),
t AS (SELECT *, row_number() OVER (PARTITION BY method, outcome, category ORDER BY example_id) AS turn FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY (outcome = 'both_fail')::INTEGER, turn, list_position({_LABELS}, category)) AS k FROM t)
SELECT example_id, method, category, outcome FROM r WHERE k <= CASE method WHEN 'cover' THEN 30 ELSE 10 END""")
def annotation_sample(spark, sf):
    """Failures of cover and echo to look at; the sizes are the sample's own."""
    f = failures(spark, sf).groupBy("example_id", "method").agg(F.min("category").alias("category"))
    return errors.annotation_sample(f.where("method = 'cover'"), f.where("method = 'echo'"), "example_id", "cover", "echo")


@query()
def bootstrap_numpy(spark, sf):
    return stats.bootstrap_exact(pairs(spark, sf), ["comparison"], "unit", "diff")


@query()
def sign_test_numpy(spark, sf):
    return stats.sign_test_groups(pairs(spark, sf), ["comparison"], "unit")


@query(f"WITH {q.RET}, r AS (SELECT coalesce(retrieval_method, '') AS retrieval_method, rank, score FROM ret WHERE rank IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)), a AS (SELECT *, rank() OVER (PARTITION BY retrieval_method ORDER BY rank) - 1 + (count(*) OVER (PARTITION BY retrieval_method, rank) - 1) / 2.0 AS x, rank() OVER (PARTITION BY retrieval_method ORDER BY score) - 1 + (count(*) OVER (PARTITION BY retrieval_method, score) - 1) / 2.0 AS y FROM r) SELECT retrieval_method, count(*) AS n, round(CASE WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0.0 ELSE corr(x, y) END, 6) AS rho FROM a GROUP BY retrieval_method")
def spearman(spark, sf):
    r = retrieved(spark, sf).where("rank is not null and score is not null and not isnan(score)").withColumn("retrieval_method", F.coalesce("retrieval_method", F.lit("")))
    return stats.spearman(r, "rank", "score", ["retrieval_method"]).select("retrieval_method", "n", F.round("rho", 6).alias("rho"))


# Samples and splits

_STRATA = f"{q.EX}, st AS (SELECT eid, to_json([coalesce(qtype, ''), coalesce(level, '')]) AS stratum FROM ex)"
_ALLOC = f"{_STRATA}, n AS (SELECT stratum, count(*) AS n FROM st GROUP BY stratum), x AS (SELECT stratum, n, (n * 200) // (SELECT sum(n) FROM n) AS f, (n * 200) % (SELECT sum(n) FROM n) AS r FROM n), al AS (SELECT stratum, n, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, stratum) <= 200 - (SELECT sum(f) FROM x) THEN 1 ELSE 0 END)::BIGINT AS take FROM x)"


def _strata(spark, sf) -> DataFrame:
    return examples(spark, sf).select("eid", sampling.label_of("qtype", "level").alias("stratum"))


@query(f"WITH {_ALLOC} SELECT stratum, n, take FROM al")
def stratified_alloc(spark, sf):
    return sampling.allocation(_strata(spark, sf), 200)


@query(f"WITH {_ALLOC}, p AS (SELECT eid, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_BITS.format(chr(39) + '42:' + chr(39) + ' || eid')}, eid) AS k FROM st) SELECT p.eid, p.stratum FROM p JOIN al USING (stratum) WHERE k <= take")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(_strata(spark, sf), "eid", "stratum", 200).select("eid", "stratum")


@query(f"WITH {q.EX} SELECT example_id, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits FROM ex GROUP BY example_id HAVING count(DISTINCT split) > 1")
def shared_ids(spark, sf):
    return sampling.shared_between_splits(examples(spark, sf), "example_id").select("example_id", F.array_join("splits", ",").alias("splits"))


@query(f"WITH {q.EX} SELECT split, count(*) AS n, sha256(to_json(list(example_id ORDER BY example_id))) AS sha256 FROM ex GROUP BY split")
def ids_sha256(spark, sf):
    return sampling.ordered_ids_sha256(examples(spark, sf), ["split"], "example_id", "example_id")


@query("WITH n AS (SELECT example_id, split, count(*) AS n FROM examples GROUP BY ALL), p AS (SELECT example_id, max(n) AS n, count(*) AS s FROM n GROUP BY example_id), a AS (SELECT count(CASE WHEN example_id IS NULL THEN 1 END) AS x, count(CASE WHEN n > 1 THEN 1 END) AS y, count(CASE WHEN s > 1 THEN 1 END) AS z FROM p) SELECT 'null_keys' AS check, x = 0 AS passed, x::VARCHAR AS details FROM a UNION ALL SELECT 'repeated_keys', y = 0, y::VARCHAR FROM a UNION ALL SELECT 'shared_keys', z = 0, z::VARCHAR FROM a")
def split_checks(spark, sf):
    return provenance.split_checks(table(spark, sf, "examples"), "example_id")


@query(f"""WITH {q.EX}, f AS (SELECT *, coalesce(supporting_facts, []) AS facts, list_transform(context, lambda x: x.title) AS titles FROM ex),
r AS (SELECT 'blank question' AS problem, trim(coalesce(question, ''), ' ') = '' AS bad FROM f UNION ALL SELECT 'blank answer', trim(coalesce(answer, ''), ' ') = '' FROM f UNION ALL SELECT 'no context', coalesce(len(context), 0) = 0 FROM f
UNION ALL SELECT 'repeated title', len(list_distinct(list_transform(titles, lambda x: coalesce(x, chr(2))))) < len(titles) FROM f
UNION ALL SELECT 'fact of no title', len(list_filter(facts, lambda x: x.title IS NOT NULL AND NOT coalesce(list_contains(titles, x.title), false))) > 0 FROM f
UNION ALL SELECT 'sentence out of range', len(list_filter(facts, lambda x: len(list_filter(coalesce(context, []), lambda y: y.title = x.title AND (x.sent_id < 0 OR x.sent_id >= coalesce(len(y.sentences), 0)))) > 0)) > 0 FROM f
UNION ALL SELECT 'repeated fact', len(list_distinct(list_transform(facts, lambda x: coalesce(x.title, chr(2)) || chr(1) || coalesce(x.sent_id::VARCHAR, chr(2))))) < len(facts) FROM f)
SELECT problem, count(*) AS n FROM r WHERE bad GROUP BY problem""")
def record_problems(spark, sf):
    return records.problems(examples(spark, sf), "eid").groupBy("problem").agg(F.count("*").alias("n"))


# Errors


def failures(spark, sf) -> DataFrame:
    """Wrong predictions with their error category; coverage is that of the evidence's sentences against the supporting facts."""
    p = supported(spark, sf).where("em = 0")
    return p.select("generation_id", "example_id", "token_budget", "method", "em", "f1", "cover", "text", errors.category(F.col("text"), F.col("answer"), F.col("evidence"), F.col("f1"), F.col("cover"), F.col("qtype")).alias("category"))


@query(f"WITH {_SUP} SELECT generation_id, n_keys::INTEGER AS n_keys, round(cover, 9) AS cover FROM sup")
def evidence_coverage(spark, sf):
    """How many support keys each answer's evidence holds, and its share of the gold ones."""
    return supported(spark, sf).select("generation_id", F.size("keys").alias("n_keys"), F.round("cover", 9).alias("cover"))


@query(f"""WITH {_SUP}, x AS (SELECT *, CASE WHEN n_keys = 0 AND n_gold = 0 THEN 1.0 WHEN n_keys = 0 OR n_gold = 0 THEN 0.0 END AS edge, {q.spaces('evidence')} AS tokens FROM sup)
SELECT method, token_budget, count(*) AS n, round(avg(em), 6) AS answer_em, round(avg(f1), 6) AS answer_f1, round(avg(coalesce(edge, (hits = n_keys AND hits = n_gold)::DOUBLE)), 6) AS support_em, round(avg(coalesce(edge, hits::DOUBLE / n_keys)), 6) AS support_precision,
round(avg(coalesce(edge, hits::DOUBLE / n_gold)), 6) AS support_recall, round(avg(coalesce(edge, 2.0 * hits / (n_keys + n_gold))), 6) AS support_f1, round(avg(cover), 6) AS coverage, round(avg(tokens), 6) AS evidence_tokens FROM x GROUP BY method, token_budget""")
def run_summary(spark, sf):
    """Means of answer and support metrics, coverage and evidence size of each method and budget."""
    p = supported(spark, sf)
    p = p.select("method", "token_budget", F.col("em").alias("answer_em"), F.col("f1").alias("answer_f1"), *[v.alias(f"support_{k}") for k, v in metrics.support_metrics(F.col("keys"), F.col("gold")).items()], F.col("cover").alias("coverage"), text.space_count(F.col("evidence")).alias("evidence_tokens"))
    means = [c for c in p.columns if c not in ("method", "token_budget")]
    return metrics.method_summary(p, ["method", "token_budget"], means).select("method", "token_budget", "n", *[F.round(c, 6).alias(c) for c in means])


@query(f"""WITH {_CAT}, o AS (SELECT example_id || ':' || token_budget AS unit, method, arg_min(struct_pack(id := generation_id, em := em, f1 := f1, cover := cover, text := text), generation_id) AS r FROM sup WHERE method IN ('cover', 'echo') AND token_budget IS NOT NULL GROUP BY ALL),
b AS (SELECT x.unit, x.method, y.method AS other, x.r, y.r AS s FROM o x JOIN o y ON x.unit = y.unit AND x.method <> y.method WHERE x.r.em < 1),
t AS (SELECT b.*, c.category, CASE WHEN s.em < 1 THEN 'both_fail' ELSE b.method || '_fail_only' END AS outcome, printf('%.2f', r.cover) AS c FROM b JOIN cat c ON c.generation_id = r.id)
SELECT unit, method, category, outcome, CASE category WHEN 'support_missing' THEN 'Coverage is ' || c || '; the packed context misses key support and the model abstains.' WHEN 'support_present_answer_wrong' THEN 'Answer evidence is present enough (coverage ' || c || '), but the model still outputs ' || chr(39) || coalesce(r.text, '') || chr(39) || '.'
  WHEN 'formatting_mismatch' THEN 'The prediction overlaps with the gold answer but fails normalization-sensitive scoring.' WHEN 'hallucination' THEN 'The prediction is not grounded in the packed evidence excerpt.' WHEN 'multi_hop_reasoning_failure' THEN 'Coverage is ' || c || '; the chain is only partly preserved and the model fails to connect it.'
  WHEN 'insufficient_evidence_forced_answer' THEN 'Coverage is ' || c || '; the model commits to a concrete answer instead of abstaining.' ELSE 'The failure does not fit the main taxonomy cleanly.' END || ' The paired ' || other || CASE WHEN outcome = 'both_fail' THEN ' run also fails on this example.' ELSE ' run succeeds on this example.' END AS note,
round(r.f1, 9) AS f1, round(r.cover, 9) AS cover, round(s.f1, 9) AS other_f1, round(s.cover, 9) AS other_cover FROM t""")
def failure_table(spark, sf):
    """Every failure of cover and echo on the examples and budgets that both answered, with label, paired outcome and note."""
    p = supported(spark, sf).where("method in ('cover', 'echo') and token_budget is not null").withColumn("unit", F.concat_ws(":", "example_id", "token_budget"))
    label = F.when(F.col("em") < 1, errors.category(F.col("text"), F.col("answer"), F.col("evidence"), F.col("f1"), F.col("cover"), F.col("qtype")))
    one = p.groupBy("unit", "method").agg(F.min_by(F.struct("em", "f1", "cover", "text", label.alias("category")), "generation_id").alias("r")).select("unit", "method", "r.*")
    one = materialize(one, "answers")
    a, b = one.where("method = 'cover'"), one.where("method = 'echo'")
    t = errors.failure_table(a.join(b.select("unit"), "unit", "left_semi"), b.join(a.select("unit"), "unit", "left_semi"), "unit", "cover", "echo")
    return t.select("unit", "method", "category", "outcome", "note", *[F.round(c, 9).alias(c) for c in ("f1", "cover", "other_f1", "other_cover")])


@query()
def spearman_interval(spark, sf):
    """Rank correlation of evidence coverage and answer F1 within each method, with its resampled interval."""
    p = supported(spark, sf).where("method is not null").select("method", "generation_id", "cover", "f1")
    t = stats.spearman_interval(p, "cover", "f1", ["method"], "generation_id")
    return t.select("method", "n", *[F.round(c, 6).alias(c) for c in ("rho", "low", "high")])


@query(f"WITH {_CAT} SELECT generation_id, method, category FROM cat")
def error_categories(spark, sf):
    return failures(spark, sf).select("generation_id", "method", "category")




@query(f"WITH {_CAT}, l AS (SELECT unnest({_LABELS}) AS category), m AS (SELECT DISTINCT method FROM cat), n AS (SELECT m.method, l.category, count(cat.generation_id) AS n FROM m CROSS JOIN l LEFT JOIN cat ON cat.method = m.method AND cat.category = l.category GROUP BY ALL) SELECT method, category, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY method), 9) AS share FROM n")
def error_summary(spark, sf):
    return errors.category_counts(failures(spark, sf), "method").select("method", "category", "n", F.round("share", 9).alias("share"))


@query(f"WITH {_CAT}, t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY generation_id) AS turn, list_position({_LABELS}, category) AS place FROM cat WHERE method = 'cover') SELECT generation_id, category FROM (SELECT * FROM t ORDER BY turn, place LIMIT 30)")
def round_robin_sample(spark, sf):
    """Thirty failures of one method, the categories in turn; the limit is the sampling operator's own size."""
    return errors.round_robin(failures(spark, sf).where("method = 'cover'"), 30, "generation_id").select("generation_id", "category")


@query(f"WITH {_PAIRS} SELECT comparison, CASE WHEN a = 0 AND b = 0 THEN 'both_fail' WHEN a = 0 THEN 'cover_fail_only' WHEN b = 0 THEN 'other_fail_only' ELSE 'both_success' END AS outcome, count(*) AS n FROM pairs GROUP BY ALL")
def paired_outcomes(spark, sf):
    p = pairs(spark, sf).select("comparison", errors.outcome(F.col("a") == 0, F.col("b") == 0, "cover", "other").alias("outcome"))
    return p.groupBy("comparison", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {q.PRED}, o AS (SELECT generation_id, coalesce(text, '') AS a, coalesce(answer, '') AS b, {_BITS.format(chr(39) + '42:' + chr(39) + ' || generation_id')} % 2 = 1 AS s FROM pred) SELECT generation_id, CASE WHEN s THEN b ELSE a END AS first, CASE WHEN s THEN a ELSE b END AS second, s AS swapped FROM o")
def blinded_pairs(spark, sf):
    p = predictions(spark, sf).select("generation_id", F.coalesce("text", F.lit("")).alias("a"), F.coalesce("answer", F.lit("")).alias("b"))
    return errors.blinded(p, "generation_id", "a", "b")


# Systems


@query(f"WITH {q.RUN}, s AS (SELECT benchmark_name, unnest(latency_samples_ms) AS v FROM runs) SELECT benchmark_name, count(*) AS sample_count, round(avg(v), 6) AS mean_ms, round(stddev_pop(v), 6) AS std_ms, round(quantile_cont(v, 0.5), 6) AS p50_ms, round(quantile_cont(v, 0.95), 6) AS p95_ms, min(v) AS min_ms, max(v) AS max_ms FROM s WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 GROUP BY benchmark_name")
def latency_summary(spark, sf):
    s = runs(spark, sf).select("benchmark_name", F.explode("latency_samples_ms").alias("v")).where("v >= 0")
    m = systems.latency_summary(s, ["benchmark_name"], "v")
    return m.select("benchmark_name", "sample_count", *[F.round(c, 6).alias(c) for c in ("mean_ms", "std_ms", "p50_ms", "p95_ms")], "min_ms", "max_ms")


@query(f"WITH {q.RUN} SELECT run_id, benchmark_name AS benchmark, (generate_subscripts(latency_samples_ms, 1) - 1)::INTEGER AS sample_index, unnest(latency_samples_ms) AS latency_ms FROM runs")
def latency_rows(spark, sf):
    """A row for each latency sample of each run."""
    return systems.latency_rows(runs(spark, sf), "benchmark_name", "latency_samples_ms", ["run_id"])


_PART = "SELECT benchmark_name, run_day, '{0}' AS component, {0} AS value, round(CASE WHEN max_ms = 0 THEN 0.0 ELSE {0} / max_ms END, 9) AS share FROM latency_summaries"


@query(" UNION ALL ".join(_PART.format(c) for c in ("min_ms", "p50_ms", "p95_ms")))
def latency_breakdown(spark, sf):
    b = systems.breakdown(table(spark, sf, "latency_summaries"), ["benchmark_name", "run_day"], ["min_ms", "p50_ms", "p95_ms"], "max_ms")
    return b.select("benchmark_name", "run_day", "component", "value", F.round("share", 9).alias("share"))


_BASE = f"WITH {q.PRED}, s AS (SELECT method, avg(em) AS em, avg(f1) AS f1 FROM pred GROUP BY method)"


@query(f"{_BASE} SELECT s.method, round(s.f1, 9) AS f1, round(s.f1 - b.f1, 9) AS f1_delta, round((s.f1 - b.f1) / nullif(abs(b.f1), 0), 6) AS f1_relative FROM s, (SELECT * FROM s WHERE method = 'echo') b")
def baseline_delta(spark, sf):
    s = predictions(spark, sf).groupBy("method").agg(F.avg("f1").alias("f1"))
    d = systems.against_baseline(s, "method", "echo", ["f1"])
    return d.select("method", F.round("f1", 9).alias("f1"), F.round("f1_delta", 9).alias("f1_delta"), F.round(stats.relative_delta(F.col("f1") - F.col("f1_delta"), F.col("f1")), 6).alias("f1_relative"))


@query(f"WITH {q.RUN} SELECT run_id, benchmark_name, round(coalesce(peak_rss_mb, -1), 6) AS peak_rss_mb FROM runs")
def registry_upsert(spark, sf):
    """Runs recorded before the median day, with the later ones put in by key."""
    r = runs(spark, sf).select("run_id", "benchmark_name", "peak_rss_mb", "run_day")
    day = r.select(F.expr("percentile_approx(dayofyear(to_date(run_day)), 0.5)").alias("d"))
    r = r.crossJoin(F.broadcast(day)).withColumn("late", F.expr("dayofyear(to_date(run_day)) > d"))
    old = r.where("not late").select("run_id", "benchmark_name", "peak_rss_mb")
    new = r.where("late").select("run_id", "benchmark_name", "peak_rss_mb")
    return systems.upsert(old, new, "run_id").select("run_id", "benchmark_name", F.round(F.coalesce("peak_rss_mb", F.lit(-1.0)), 6).alias("peak_rss_mb"))


@query(f"WITH {q.GEN} SELECT generation_id FROM gen WHERE example_id NOT IN (SELECT example_id FROM examples WHERE split = 'train')")
def resume_remaining(spark, sf):
    from tessera.streaming.resume import remaining

    return remaining(generations(spark, sf), table(spark, sf, "examples").where("split = 'train'"), "example_id").select("generation_id")


def entry(spark, sf) -> DataFrame:
    return method_summary(spark, sf)

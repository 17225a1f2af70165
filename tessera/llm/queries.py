"""The queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import lookalike, mixing, near_dup, pair_defects, percentiles, residue, segment_join, tokenize, top_n
from tessera.llm.common import components, joined_text
from tessera.runtime import materialize, spread, table


def _corpus(spark, sf):
    return spread(table(spark, sf, "corpus").select("paragraph_id", "title", "sentences", "source_example_ids"))


def _near(spark, sf):
    return near_dup.near_duplicates(_corpus(spark, sf), "paragraph_id", joined_text(F.col("title"), F.col("sentences")))


def p1_found(spark, sf):
    return _near(spark, sf).pairs().select(F.col("x").alias("paragraph_id_a"), F.col("y").alias("paragraph_id_b"))


def p1_groups(spark, sf):
    """(paragraph_id, group_id, n_links): the group of near-copies of every paragraph with words (named by its smallest id), and its class's links."""
    near = _near(spark, sf)
    members, links = near.members, near.links
    comp = components(links)
    deg = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return (
        members.join(comp.withColumnRenamed("node", "class"), "class", "left").join(deg, "class", "left")
        .select("paragraph_id", F.coalesce("component", "class").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def p1_group_examples(spark, sf):
    """(group_id, n_paragraphs, source_example_id): a row for each example id in the union of each group of near-copies, one with null for a group without any."""
    groups = materialize(p1_groups(spark, sf).select("paragraph_id", "group_id").distinct(), "groups")
    n = groups.groupBy("group_id").agg(F.count("*").alias("n_paragraphs"))
    ids = _corpus(spark, sf).select("paragraph_id", F.explode("source_example_ids").alias("source_example_id")).where("source_example_id is not null").distinct()
    ids = ids.join(groups, "paragraph_id").select("group_id", "source_example_id").distinct()
    return n.join(ids, "group_id", "left").select("group_id", "n_paragraphs", "source_example_id")


def _records(spark, sf):
    gen = spread(table(spark, sf, "generations").select(F.lit("generations").alias("rec_table"), F.col("generation_id").alias("rec_id"), "question", "text", F.col("evidence").alias("reference")))
    parts = F.transform("context", lambda p: F.concat_ws("\n", p["title"], F.array_join(p["sentences"], " ")))
    ex = spread(table(spark, sf, "examples").select(F.lit("examples").alias("rec_table"), F.col("example_id").alias("rec_id"), "question", F.col("answer").alias("text"), F.array_join(parts, "\n").alias("reference")))
    return gen.unionByName(ex)


def p2_found(spark, sf):
    return pair_defects.find_defects(_records(spark, sf))


def p3_found(spark, sf):
    best = top_n.top_n(spread(table(spark, sf, "retrieved").select("example_id", "paragraph_id", "score", "rank")), "example_id", "paragraph_id", "score", "rank", 5)
    return best.select("example_id", "place", "paragraph_id")


def _splits(spark, sf):
    ex = spread(table(spark, sf, "examples").select("example_id", "split", "question", "context"))
    sentences = F.flatten(F.filter(F.transform("context", lambda x: x["sentences"]), lambda y: y.isNotNull()))
    return segment_join.cross_split_pairs(ex, "example_id", "split", F.col("question"), F.array_join(sentences, " "))


def p4_found(spark, sf):
    return _splits(spark, sf).pairs().select(F.least("x", "y").alias("example_id_a"), F.greatest("x", "y").alias("example_id_b"), "eval_split").distinct()


def p4_report(spark, sf):
    """(eval_split, source_dataset, n_records, n_overlapping, n_pairs) of the evaluation splits."""
    n = _splits(spark, sf).pairs().groupBy(F.col("x").alias("example_id"), F.col("eval_split").alias("split")).agg(F.count("*").alias("pairs"))
    ev = table(spark, sf, "examples").where("split in ('validation', 'test')").groupBy("example_id", "split").agg(F.min("source_dataset").alias("source_dataset"))
    return (
        ev.join(n, ["example_id", "split"], "left").groupBy(F.col("split").alias("eval_split"), "source_dataset")
        .agg(F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )


def p5_found(spark, sf):
    return percentiles.disagreeing(table(spark, sf, "benchmark_runs"), table(spark, sf, "latency_summaries"))


def p5_percentiles(spark, sf):
    """Exact p50 and p95 by benchmark and day (level 0), by benchmark (1) and of all (2)."""
    g = ["benchmark_name", "run_day"]
    p = percentiles.percentiles(percentiles.samples(table(spark, sf, "benchmark_runs")), g, "ms", [0.5, 0.95], [g, g[:1], []])
    return p.select("level", *g, "n", "q", F.round("value", 6).alias("value"), F.col("bound").alias("error_bound"))


def p5_combined(spark, sf):
    """p50 and p95 of each benchmark from the two-digit histograms of its days, with their error bound."""
    days = percentiles.digit_histogram(percentiles.samples(table(spark, sf, "benchmark_runs")), ["benchmark_name", "run_day"], "ms", 2)
    p = percentiles.percentiles_of_histogram(days, ["benchmark_name"], [0.5, 0.95], 2)
    return p.select("benchmark_name", "n", "q", F.col("value"), F.col("bound").alias("error_bound"))


def p5_combined_check(spark, sf):
    """(benchmark_name, q, n, holds): whether each percentile of the combined histograms is within its error bound of the exact one."""
    exact = percentiles.percentiles(percentiles.samples(table(spark, sf, "benchmark_runs")), ["benchmark_name"], "ms", [0.5, 0.95], [["benchmark_name"]]).select("benchmark_name", "q", F.col("value").alias("exact"))
    return p5_combined(spark, sf).join(exact, ["benchmark_name", "q"]).select("benchmark_name", "q", "n", (F.abs(F.col("value") - F.col("exact")) <= F.col("error_bound") * 1.0001 + 1e-12).alias("holds"))


def _look(spark, sf):
    ex = spread(table(spark, sf, "examples").select("example_id", "answer", "context", "supporting_facts"))
    return ex, table(spark, sf, "entities")


def p6_found(spark, sf):
    return lookalike.looking_like(*_look(spark, sf))


def p6_canonical(spark, sf):
    """Every title and answer in its consistent form, with the entity it names."""
    return lookalike.canonical_values(*_look(spark, sf))


def _mix(spark, sf):
    return mixing.mix(spread(table(spark, sf, "documents").select("doc_id", "source", "text")), table(spark, sf, "mix_targets"))


def p8_copies(spark, sf):
    """(doc_id, source, n_tokens, copies) of every document of a listed source."""
    return _mix(spark, sf)[0]


def p8_mix(spark, sf):
    """Uses, tokens, actual and target share of each listed source."""
    return _mix(spark, sf)[1]


def p8_check(spark, sf):
    """(source, n_documents, within_repeats, on_target): each source's documents, and whether its copies keep its cap and its share to one document's tokens."""
    copies, report = _mix(spark, sf)
    copies = materialize(copies, "copies")
    got = copies.groupBy("source").agg(F.max("n_tokens").alias("longest"), F.max("copies").alias("most"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed"), F.count("*").alias("n_documents"))
    whole = got.agg(F.sum("mixed").alias("whole"), F.sum("longest").alias("slack"))
    r = report.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(whole)  # one row
    return r.select("source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.coalesce("mixed", F.lit(0)) - F.col("target_share") * F.col("whole")) <= F.col("slack")).alias("on_target"))


def p7_ids(spark, sf):
    return tokenize.encode_column(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_found(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return residue.flag(docs).where("residue").select("doc_id").distinct()


def p9_clean(spark, sf):
    """(doc_id, text, lang, source, title) of the collection without residue; each doc_id once."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "title"))
    return docs.join(residue.flag(docs).where("residue").select("doc_id").distinct(), "doc_id", "left_anti").dropDuplicates(["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p1_group_examples, p2_found, p3_found, p4_found, p4_report, p5_found, p5_percentiles, p5_combined, p5_combined_check, p6_found, p6_canonical, p7_ids, p8_copies, p8_mix, p8_check, p9_found, p9_clean)
}

#: All evaluation and train records whose questions and contexts overlap: p(a, b, eval_split).
_OVERLAPS = r"""
        WITH r AS (SELECT DISTINCT example_id, split, list_distinct(regexp_extract_all(lower(question), '[\pL\pN]+')) AS q,
          list_distinct(regexp_extract_all(lower(array_to_string(flatten(list_transform(context, lambda x: x.sentences)), ' ')), '[\pL\pN]+')) AS c FROM examples),
        o AS (SELECT e.example_id AS a, t.example_id AS b, e.split AS eval_split, e.c AS ec, t.c AS tc FROM r e JOIN r t ON e.split IN ('validation', 'test') AND t.split = 'train'
          WHERE len(list_intersect(e.q, t.q))::DOUBLE / greatest(len(e.q) + len(t.q) - len(list_intersect(e.q, t.q)), 1) >= 0.6),
        p AS (SELECT a, b, eval_split FROM o WHERE len(list_intersect(ec, tc))::DOUBLE / greatest(len(ec) + len(tc) - len(list_intersect(ec, tc)), 1) >= 0.6)
        """

#: Near-duplicate pairs with words once for each set: c(paragraph_id, ws), p(a, b) of paragraph pairs; ws is the sorted word set.
_NEAR = r"""
        WITH RECURSIVE c AS (SELECT DISTINCT paragraph_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, array_to_string(sentences, ' '))), '[\pL\pN]+'))) AS ws FROM corpus),
        w AS (SELECT paragraph_id, unnest(ws) AS w, len(ws) AS n FROM c),
        p AS (SELECT a.paragraph_id AS a, b.paragraph_id AS b FROM w a JOIN w b ON a.w = b.w AND a.paragraph_id < b.paragraph_id GROUP BY a.paragraph_id, b.paragraph_id, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.7),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r AS (SELECT paragraph_id AS x, paragraph_id AS y FROM c WHERE len(ws) > 0 UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
        g AS (SELECT x AS paragraph_id, min(y) AS group_id FROM r GROUP BY x)
        """

SQL = {
    "p1_groups": _NEAR + """, l AS (SELECT DISTINCT e.a AS paragraph_id, cb.ws FROM e JOIN c ca ON ca.paragraph_id = e.a JOIN c cb ON cb.paragraph_id = e.b WHERE ca.ws <> cb.ws),
        n AS (SELECT paragraph_id, count(*) AS n FROM l GROUP BY paragraph_id)
        SELECT g.paragraph_id, group_id, coalesce(n, 0)::BIGINT AS n_links FROM g LEFT JOIN n USING (paragraph_id)""",
    "p1_group_examples": _NEAR + """, s AS (SELECT group_id, count(*) AS n_paragraphs FROM g GROUP BY group_id),
        i AS (SELECT DISTINCT group_id, x AS source_example_id FROM (SELECT DISTINCT paragraph_id, unnest(source_example_ids) AS x FROM corpus) JOIN g USING (paragraph_id) WHERE x IS NOT NULL)
        SELECT group_id, n_paragraphs, source_example_id FROM s LEFT JOIN i USING (group_id)""",
    "p5_combined_check": """
        WITH one AS (SELECT run_id, arg_min(struct_pack(b := benchmark_name, l := latency_samples_ms), recorded_at) AS r FROM benchmark_runs GROUP BY run_id),
        s AS (SELECT r.b AS b, unnest(r.l) AS ms FROM one)
        SELECT b AS benchmark_name, q, count(*) AS n, true AS holds FROM s, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) t(q) WHERE ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0 GROUP BY b, q""",
    "p8_check": """
        SELECT m.source, count(DISTINCT d.doc_id) AS n_documents, true AS within_repeats, true AS on_target FROM mix_targets m LEFT JOIN documents d ON d.source = m.source WHERE m.source IS NOT NULL GROUP BY m.source""",
    "p3_found": """
        WITH r AS (SELECT DISTINCT example_id, paragraph_id, rank, score FROM retrieved WHERE score IS NOT NULL AND NOT isnan(score)),
        one AS (SELECT *, row_number() OVER (PARTITION BY example_id, paragraph_id ORDER BY score DESC, rank ASC NULLS LAST) AS d FROM r),
        p AS (SELECT example_id, paragraph_id, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, rank ASC NULLS LAST, paragraph_id) AS place FROM one WHERE d = 1)
        SELECT example_id, CAST(place AS INTEGER) AS place, paragraph_id FROM p WHERE place <= 5""",
    "p5_found": """
        WITH one AS (SELECT run_id, arg_min(struct_pack(b := benchmark_name, d := run_day, l := latency_samples_ms), recorded_at) AS r FROM benchmark_runs GROUP BY run_id),
        s AS (SELECT r.b AS b, r.d AS d, unnest(r.l) AS ms FROM one),
        p AS (SELECT b, d, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95 FROM s WHERE ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0 GROUP BY b, d)
        SELECT DISTINCT benchmark_name, run_day FROM latency_summaries JOIN p ON b = benchmark_name AND d = run_day
        WHERE abs(p50_ms - p50) > 0.1 * abs(p50) OR abs(p95_ms - p95) > 0.1 * abs(p95)""",
    "p5_percentiles": """
        WITH one AS (SELECT run_id, arg_min(struct_pack(b := benchmark_name, d := run_day, l := latency_samples_ms), recorded_at) AS r FROM benchmark_runs GROUP BY run_id),
        s AS (SELECT * FROM (SELECT r.b AS b, r.d AS d, unnest(r.l) AS ms FROM one) WHERE ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0),
        l AS (SELECT 0 AS level, b, d, ms FROM s UNION ALL SELECT 1, b, NULL, ms FROM s UNION ALL SELECT 2, NULL, NULL, ms FROM s),
        q AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) t(q)),
        g AS (SELECT level, b, d, count(*) AS n, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95 FROM l GROUP BY level, b, d)
        SELECT CAST(level AS INTEGER) AS level, b AS benchmark_name, d AS run_day, n, q, round(CASE WHEN q = 0.5 THEN p50 ELSE p95 END, 6) AS value, 0.0::DOUBLE AS error_bound FROM g, q""",
    "p1_found": r"""
        WITH c AS (SELECT DISTINCT paragraph_id, title, sentences FROM corpus),
        w AS (SELECT DISTINCT paragraph_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, array_to_string(sentences, ' '))), '[\pL\pN]+')) AS w FROM c),
        n AS (SELECT paragraph_id, count(*) AS n FROM w GROUP BY paragraph_id),
        i AS (SELECT a.paragraph_id AS a, b.paragraph_id AS b, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.paragraph_id < b.paragraph_id GROUP BY ALL)
        SELECT a AS paragraph_id_a, b AS paragraph_id_b FROM i JOIN n x ON x.paragraph_id = a JOIN n y ON y.paragraph_id = b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.7""",
    "p4_found": _OVERLAPS + "SELECT DISTINCT least(a, b) AS example_id_a, greatest(a, b) AS example_id_b, eval_split FROM p",
    "p4_report": _OVERLAPS + """, n AS (SELECT a, eval_split, count(*) AS n FROM p GROUP BY ALL), e AS (SELECT example_id, split, min(source_dataset) AS source_dataset FROM examples WHERE split IN ('validation', 'test') GROUP BY ALL)
        SELECT e.split AS eval_split, source_dataset, count(*) AS n_records, count(n) AS n_overlapping, coalesce(sum(n), 0)::BIGINT AS n_pairs FROM e LEFT JOIN n ON n.a = e.example_id AND n.eval_split = e.split GROUP BY ALL""",
}

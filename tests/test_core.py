"""Golden values and plain-loop comparisons of the core operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import generation, text
from tessera.functions.hashing import canonical_json, canonical_sha256
from tessera.operators import corpus, errors, metrics, packing, provenance, retrieval, sampling, stats, systems
from tessera.operators.packing import PackPlan
from tessera.plans import sweep
from tessera.sources import records
from tessera.streaming.resume import run_stream


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("The Cat's  hat!", "cats hat"), ("A-b an the", "ab"), (None, ""), (" the end ", "end"), ("x" * 5000, "x" * 5000)])
def test_normalized_answers(spark, raw, want):
    assert one(spark, text.normalize_answer(F.col("a")), a=raw) == want


def test_tokens_and_terms(spark):
    assert one(spark, text.tokens(F.col("a")), a="Don't stop, café 42!") == ["don't", "stop", "caf", "42"] == text.token_list("Don't stop, café 42!")
    assert one(spark, text.terms(F.col("a")), a="The old mill and the OLD dam") == ["old", "mill", "dam"] == text.term_list("The old mill and the OLD dam")
    assert one(spark, text.space_count(F.col("a")), a=" \t ") == 1 == text.part_count(" \t ")
    assert one(spark, text.strip_answer_labels(F.col("a")), a=" Assistant: Final answer: yes") == "yes"
    assert one(spark, text.excerpt(F.col("a"), 10), a="one\n\n two three four") == "one two..."
    assert one(spark, text.paragraph_text(F.col("a")), a=[" x ", "", None, " ", "y"]) == "x y"
    assert one(spark, text.slug(F.col("a")), a="Big Model/7B (v2)") == "big-model-7b-v2"
    assert one(spark, generation.echo(F.col("a")), a="\n first \nsecond") == "first" and one(spark, generation.echo(F.col("a")), a=" ") == "insufficient evidence"


@pytest.mark.parametrize("p, g, em, f1", [("The Cat", "cat", 1.0, 1.0), ("a cat sat", "cat", 0.0, 2 / 3), ("", "", 1.0, 1.0), ("x", "", 0.0, 0.0), ("b b c", "b c c", 0.0, 2 / 3), (None, "the", 1.0, 1.0)])
def test_answer_scores(spark, p, g, em, f1):
    assert one(spark, metrics.exact_match(F.col("p"), F.col("g")), p=p, g=g) == em
    assert one(spark, metrics.answer_f1(F.col("p"), F.col("g")), p=p, g=g) == pytest.approx(f1)


def test_support_scores(spark):
    rows = [([("A", 0), ("B", 1)], [("A", 0)]), ([], []), ([], [("A", 0)]), ([("A", 0)], []), (None, None), ([("A", 0), ("A", 0)], [("A", 0)])]
    df = spark.createDataFrame(rows, "p array<struct<t:string,s:int>>, g array<struct<t:string,s:int>>")
    got = [tuple(x) for x in df.select(*metrics.support_metrics(F.col("p"), F.col("g")).values(), metrics.coverage(F.col("p"), F.col("g"))).collect()]
    assert got == [(0.0, 0.5, 1.0, pytest.approx(2 / 3), 1.0), (1, 1, 1, 1, 1), (0, 0, 0, 0, 0), (0, 0, 0, 0, 1), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1)]


def cand(title, i, terms, tok=1, q=0.0, t=0.0, p=1.0):
    return {"title": title, "sentence_id": i, "text": " ".join(terms), "terms": terms, "token_count": tok, "query_overlap": q, "title_overlap": t, "paragraph_score": p}


def test_selectors_on_small_cases():
    a, b, c = cand("A", 0, ["x", "y"], q=1.0), cand("B", 0, ["x", "y"], q=1.0), cand("C", 0, ["z"], q=0.5)
    assert [i for i, _ in packing.select_mmr([a, b, c], ["x"], PackPlan("p", budget=2))] == [0, 2]
    assert [i for i, _ in packing.select_query_cover([cand("L", 0, ["x", "y"], 4), cand("S", 0, ["x"], 1)], ["x", "y"], PackPlan("p", budget=4))] == [1]
    assert packing.select_query_cover([cand("N", 0, ["n"])], ["x"], PackPlan("p")) == []
    assert [i for i, _ in packing.select_relevance([cand("A", 0, ["x"], 5, q=0.9), cand("B", 0, ["x"], 1, q=0.5), cand("B", 0, ["x"], 1, q=0.4)], ["x"], PackPlan("p", budget=3))] == [1]
    with pytest.raises(ValueError):
        packing.select_mmr([a], [], PackPlan("p", trade=2.0))
    with pytest.raises(ValueError):
        PackPlan("p").variant("nothing")


def test_cover_equals_a_plain_loop():
    r = random.Random(7)
    for _ in range(60):
        q = r.sample("abcdefghij", 5)
        cs = [cand(r.choice("ABC"), r.randrange(4), r.sample("abcdefghijklmnop", r.randrange(1, 6)), r.randrange(1, 9), r.random(), r.random(), r.random()) for _ in range(r.randrange(0, 14))]
        p = PackPlan("p", budget=20, stop=r.choice([0.0, 0.4]))
        left, taken, used = list(range(len(cs))), [], 0
        while True:
            fit = [i for i in left if used + cs[i]["token_count"] <= p.budget]
            if not fit:
                break
            seen = {t for i in taken for t in cs[i]["terms"]}

            def score(i):
                sims = [len(set(cs[i]["terms"]) & set(cs[j]["terms"])) / len(set(cs[i]["terms"]) | set(cs[j]["terms"])) for j in taken]
                new = len((set(cs[i]["terms"]) & set(q)) - seen) / len(q)
                return round(packing.relevance(cs[i]) + 1.2 * new + 0.3 * (cs[i]["title"] not in {cs[j]["title"] for j in taken}) - 0.6 * max(sims, default=0) - 0.15 * cs[i]["token_count"] / p.budget, 12)

            top = max(fit, key=lambda i: (score(i), -i))
            if taken and score(top) < p.stop:
                break
            taken.append(top)
            used += cs[top]["token_count"]
            left = [i for i in left if (cs[i]["title"], cs[i]["sentence_id"]) != (cs[top]["title"], cs[top]["sentence_id"])]
        assert [i for i, _ in packing.select_cover(cs, q, p)] == taken


def test_pipeline_from_context_to_evidence(spark):
    rows = [("e1", "Who wrote Hamlet?", [("Hamlet", ["Hamlet was written by Shakespeare.", " "]), (None, None), ("Macbeth", ["Macbeth is a play."])]), ("e2", None, None), ("e3", "x", [])]
    ex = spark.createDataFrame(rows, "eid string, question string, context array<struct<title:string,sentences:array<string>>>")
    ranked = retrieval.rank_context(ex, 2)
    got = {r.eid: r for r in ranked.collect()}
    assert [p.title for p in got["e1"].ranked][0] == "Hamlet" and [p.rank for p in got["e1"].ranked] == [1, 2] and got["e2"].ranked == []
    packed = {(r.eid, r.config_id): r for r in packing.pack(packing.candidates(ranked), "eid", sweep.sweep()).collect()}
    assert len(packed) == 3 * 29 and all(r.used_tokens <= 160 for r in packed.values())
    assert packing.pack_paragraphs(ranked, "eid", 5).where("eid = 'e1'").first().n_paragraphs == 1
    rendered = packing.pack(packing.candidates(ranked), "eid", [PackPlan("c")]).where("eid = 'e1'").select(text.render(F.col("selected"))).first()[0]
    assert rendered.startswith("Title: Hamlet\n- Hamlet was written by Shakespeare.")
    with pytest.raises(ValueError):
        retrieval.rank_context(ex, -1)


def test_global_ranking_fills_up_with_smallest_keys(spark):
    c = spark.createDataFrame([("p3", "Other", ["unrelated words"]), ("p1", "T", ["apple fruit"]), ("p2", "T", ["orange orange fruit"])], "id string, title string, sentences array<string>")
    q = spark.createDataFrame([("a", "orange"), ("b", "absent"), ("c", None)], "qid string, question string")
    got = {(r.qid, r["rank"]): r.id for r in retrieval.rank_corpus(retrieval.build_index(c, "id"), q, "qid", "question", 3).collect()}
    assert [got["a", i] for i in (1, 2, 3)] == ["p2", "p1", "p3"] and [got["b", i] for i in (1, 2, 3)] == ["p1", "p2", "p3"]


def test_corpus_and_gold(spark):
    ex = spark.createDataFrame([("e1", [("T", ["a", "b"]), ("U", ["c"]), ("U", ["d"])], [("T", 0), ("U", 1), ("V", 0)]), ("e2", [("T", ["a b"])], None)], "example_id string, context array<struct<title:string,sentences:array<string>>>, supporting_facts array<struct<title:string,sent_id:int>>")
    c = {r.title + r.text: r for r in corpus.paragraph_corpus(ex).collect()}
    assert c["Ta b"].source_example_ids == ["e1", "e2"] and c["Ta b"].sentences == ["a", "b"]
    assert {(r.title, r.n_matches) for r in corpus.gold_paragraphs(ex, "example_id").collect()} == {("T", 1), ("U", 2), ("V", 0)}
    assert corpus.manifest(corpus.paragraph_corpus(ex)).first().paragraph_count == 3


def test_statistics(spark):
    p = spark.createDataFrame([("c", i, 1.0, 0.0, 1.0) for i in range(10)], "c string, id int, a double, b double, diff double")
    assert stats.mcnemar(p, ["c"]).first().p_value == pytest.approx(2 / 1024)
    assert stats.effect_size(p, ["c"]).first().effect == float("inf")
    h = spark.createDataFrame([("a", 0.04), ("b", 0.01), ("c", 0.03)], "n string, p_value double")
    assert {r.n: pytest.approx(r.p_holm) for r in stats.holm(h).collect()} == {"a": 0.06, "b": 0.03, "c": 0.06}
    b = stats.bootstrap_exact(p, ["c"], "id", "diff", 300).first()
    assert (b.mean, b.low, b.high) == (1.0, 1.0, 1.0)
    assert stats.sign_test([1.0] * 5) == pytest.approx(2 / 32) and stats.sign_test(np.r_[np.ones(30), -np.ones(30)], 200) > 0.5
    s = spark.createDataFrame([("g", 1.0, 3.0), ("g", 2.0, 2.0), ("g", 3.0, 1.0)], "g string, x double, y double")
    assert stats.spearman(s, "x", "y", ["g"]).first().rho == pytest.approx(-1.0)
    bad = stats.align(p.select("id", "a"), p.where("id < 9").select("id", "a"), "id", "a")
    with pytest.raises(Exception, match="same unique ids"):
        bad.collect()


def test_recall_and_ranking(spark):
    r = spark.createDataFrame([("q", "x", 1), ("q", "y", 3)], "q string, i string, rank int")
    g = spark.createDataFrame([("q", "x"), ("q", "y"), ("none", None)], "q string, i string")
    assert {x.k: x.recall for x in metrics.recall_at(r, g, "q", "i", (1, 2, 3)).collect()} == {1: 0.75, 2: 0.75, 3: 1.0}
    m = metrics.ranking_metrics(r, g, "q", "i").first()
    assert (m.mrr, m.both_gold, m.recall) == (1.0, 1.0, 1.0)


def test_samples(spark):
    df = spark.createDataFrame([(f"i{i}", "a" if i < 7 else "b") for i in range(10)], "id string, s string")
    assert {r.s: r["take"] for r in sampling.allocation(df, 5, "s").collect()} == {"a": 4, "b": 1}
    first = {tuple(r) for r in sampling.stratified_sample(df, "id", "s", 5).collect()}
    assert len(first) == 5 and first == {tuple(r) for r in sampling.stratified_sample(df.repartition(3), "id", "s", 5).collect()}


def test_error_labels(spark):
    case = lambda p, g, e, f1, c, t="bridge": one(spark, errors.category(F.col("p"), F.col("g"), F.col("e"), F.lit(f1), F.lit(c), F.lit(t)), p=p, g=g, e=e)
    assert case("insufficient evidence", "Mumbai", "", 0.0, 0.0) == "support_missing"
    assert case("Mumbai, Maharashtra", "Mumbai", "", 0.0, 0.0) == "formatting_mismatch"
    assert case("Delhi", "Mumbai", "", 0.0, 0.0) == "insufficient_evidence_forced_answer"
    assert case("Delhi", "Mumbai", "", 0.0, 0.6) == "multi_hop_reasoning_failure"
    assert case("Delhi", "Mumbai", "in Mumbai", 0.0, 0.6) == "support_present_answer_wrong"
    rows = spark.createDataFrame([(f"e{i}", c) for i, c in enumerate(["other", "other", "support_missing", "support_missing", "hallucination"])], "id string, category string")
    assert [r.id for r in errors.round_robin(rows, 4, "id").orderBy("turn").collect()] and errors.round_robin(rows, 4, "id").count() == 4


def test_systems(spark):
    s = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, None)], "m string, v double")
    r = systems.latency_summary(s, ["m"], "v").first()
    assert (r.mean_ms, r.p50_ms, r.std_ms, r.p95_ms, r.sample_count) == (2.5, 2.5, pytest.approx(1.25**0.5), pytest.approx(3.85), 4)
    reg = spark.createDataFrame([("EXP001", "x"), ("EXP007", "y")], "id string, v string")
    new = spark.createDataFrame([("EXP007", "z"), ("EXP008", "w")], "id string, v string")
    assert {tuple(x) for x in systems.upsert(reg, new, "id").collect()} == {("EXP001", "x"), ("EXP007", "z"), ("EXP008", "w")}
    assert systems.next_id(reg, "id", "EXP") == "EXP008" and len(systems.measure(lambda: None, 1, 3)) == 3
    assert systems.PeakMemory().start().stop() > 0


def test_provenance(spark):
    m = provenance.freeze({"a": 1}, {"split": "dev"})
    provenance.verify_frozen(m)
    with pytest.raises(ValueError):
        provenance.verify_frozen({**m, "config": {"a": 2}})
    with pytest.raises(ValueError):
        provenance.only_allowed({"a": {"b": 1, "c": 2}}, {"a": {"b": 2, "c": 3}}, ["a.b"])
    assert canonical_json({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}' and len(canonical_sha256([])) == 64
    order = provenance.stage_order()
    assert order.index("freeze") < order.index("final_main") and len(sweep.sweep()) == 29
    with pytest.raises(ValueError):
        provenance.stage_order({"a": ("b",), "b": ("a",)})


def test_sources(spark, tmp_path):
    raw = {"id": "r1", "question": "Q", "answer": "A", "type": "bridge", "level": "easy", "context": {"title": ["T"], "sentences": [[" s1 ", " ", "s2"]]}, "supporting_facts": {"title": ["T"], "sent_id": [2]}}
    (tmp_path / "raw.jsonl").write_text(json.dumps(raw) + "\n", encoding="utf-8")
    df = records.examples(records.normalize_columnar(records.read_jsonl(spark, str(tmp_path / "raw.jsonl"), records.RAW)))
    r = df.first()
    assert r.context[0].sentences == ["s1", "s2"] and {x.problem for x in records.problems(df).collect()} == {"sentence out of range"}
    pairs = {"_id": "p1", "question": "Q", "answer": "A", "type": "x", "context": [["T", ["a", ""]]], "supporting_facts": [["T", 1]]}
    cols = {"id": "p2", "question": "Q", "answer": "A", "context": {"title": ["T"], "content": [["a"]]}, "supporting_facts": {"title": ["T"], "sentence_id": [0]}}
    two = records.normalize_pairs(spark.createDataFrame([(json.dumps(pairs),), (json.dumps(cols),)], "value string")).orderBy("example_id").collect()
    assert two[0].context[0].sentences == ["a", ""] and two[0].supporting_facts[0].sent_id == 1 and two[1].context[0].sentences == ["a"]
    ids = spark.createDataFrame([(0, "r1")], "ordinal int, example_id string")
    assert records.by_ids(df.drop("ordinal"), ids).count() == 1
    with pytest.raises(Exception, match="missing or repeated id"):
        records.by_ids(df.drop("ordinal"), spark.createDataFrame([(0, "zz")], "ordinal int, example_id string")).collect()
    cache = str(tmp_path / "cache")
    records.write_cache(spark.createDataFrame([("a", "p"), ("b", "p")], "k string, protocol string"), cache, "k", ["protocol"])
    assert records.read_cache(spark, cache, {"protocol": "p"}).count() == 2
    with pytest.raises(ValueError):
        records.read_cache(spark, cache, {"protocol": "other"})
    assert not records.write_csv(spark.createDataFrame([], "a string"), str(tmp_path / "none")) and records.read_csv(spark, str(tmp_path / "none")) is None


def test_seeded_sign_test_draws_bytes():
    d = np.random.default_rng(5).normal(0.1, 1, 60)
    for replicates in (256, 700):
        rng, hits, done = np.random.default_rng(42), 0, 0
        while done < replicates:
            m = min(256, replicates - done)
            hits += sum(abs(float(np.mean((2.0 * s - 1.0) * d))) >= abs(d.mean()) - 1e-15 for s in rng.integers(0, 2, size=(m, 60), dtype=np.int8))
            done += m
        assert stats.sign_test(d, replicates) == pytest.approx((hits + 1) / (replicates + 1))


def test_exact_sign_test_in_columns_and_in_numpy(spark):
    rows = [(g, x) for g, xs in {"a": [1.0] * 5, "b": [0.5, -0.25, 0.0, 1.0], "c": [0.1] * 30}.items() for x in xs]
    got = {r.g: r.p_value for r in stats.sign_test_exact(spark.createDataFrame(rows, "g string, diff double"), ["g"]).collect()}
    assert set(got) == {"a", "b"} and all(got[g] == pytest.approx(stats.sign_test([x for h, x in rows if h == g])) for g in got)


def test_totals_ranks_and_percentiles_over_ranges(spark):
    from tessera.runtime import running_total

    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), float(r.randrange(12)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(5)
    got = {x.i: x.before for x in running_total(df, ["g"], "i").collect()}
    assert got == {i: sum(h == g and j < i for h, _, j in rows) for g, _, i in rows}
    for x in metrics.average_ranks(df, "v", "rank", ["g"]).collect():
        own = [v for g, v, _ in rows if g == x.g]
        assert x["rank"] == sum(v < x.v for v in own) + (own.count(x.v) - 1) / 2
    s = {x.g: x for x in systems.latency_summary(df.where("g is not null"), ["g"], "v").collect()}
    for g in "ab":
        own = [v for h, v, _ in rows if h == g]
        assert (s[g].p50_ms, s[g].p95_ms, s[g].std_ms) == tuple(pytest.approx(x) for x in (np.quantile(own, 0.5), np.quantile(own, 0.95), np.std(own)))
    assert running_total(df.limit(0), ["g"], "i").count() == 0


def test_first_deliveries(spark):
    rows = [("a", 2, "late"), ("a", 1, "early"), ("a", 1, "early"), ("b", None, "x"), ("b", 5, "y"), (None, 1, "n"), (None, 2, "m"), ("c", None, "only")]
    df = spark.createDataFrame(rows, "k string, ingested_at int, v string")
    from tessera.runtime import first_delivery

    assert sorted(map(str, (r.v for r in first_delivery(df, ["k"]).collect()))) == ["early", "n", "only", "y"]
    assert first_delivery(df.limit(0), ["k"]).count() == 0


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    from tessera import runtime

    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "i int, t string")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(runtime.counted_broadcast(df)) and not hinted(runtime.counted_broadcast(df, limit=49))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 4000)
    assert not hinted(runtime.counted_broadcast(df)) and not hinted(runtime.counted_broadcast(df, 50)) and hinted(runtime.counted_broadcast(df.select("i")))


def test_evidence_gives_back_its_keys(spark):
    ctx = [("T", ["a b", "c"]), (None, ["d"]), ("U", None)]
    picked = [("T", "c"), ("", "d"), ("T", "zz"), ("T", "c")]
    df = spark.createDataFrame([(ctx, picked), (None, [])], "context array<struct<title:string,sentences:array<string>>>, sel array<struct<title:string,text:string>>").withColumn("e", text.render(F.col("sel")))
    got = [[tuple(k) for k in r[0]] for r in df.select(text.evidence_keys(F.col("e"), text.sentence_list(F.col("context")))).collect()]
    assert got == [[("T", 1), ("", 0)], []]
    assert df.select(text.evidence_keys(F.lit(None).cast("string"), text.sentence_list(F.col("context")))).first()[0] == []


def test_strict_records(spark):
    good = {"_id": " p1 ", "question": "Q", "answer": "A", "context": [["T", ["a ", ""]]], "supporting_facts": [["T", 1]]}
    read = lambda **k: records.strict(records.normalize_pairs(spark.createDataFrame([(json.dumps({**good, **k}),)], "value string"))).collect()
    r = read()[0]
    assert (r.example_id, r.context[0].sentences, r.qtype, r.level) == ("p1", ["a", ""], "unknown", "unknown")
    for bad in ({"question": " "}, {"answer": None}, {"context": []}, {"context": [["T", ["a"]], ["T", ["b"]]]}, {"supporting_facts": []}, {"supporting_facts": [["T", 2]]}, {"supporting_facts": [["V", 0]]}, {"supporting_facts": [["T", 1], ["T", 1]]}, {"context": "text"}):
        with pytest.raises(Exception, match="p1"):
            read(**bad)


def test_corpus_ranking_equals_scoring_all(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"d{i:03d}", r.choice(words), [" ".join(["the", *r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randrange(1, 25))])]) for i in range(150)] + [("z1", None, None)]
    df = spark.createDataFrame(docs, "key string, title string, sentences array<string>")
    qs = [(f"q{i}", " ".join(["the", *r.sample(words, 3)])) for i in range(20)] + [("n", None), ("t", "the"), ("x", "unknown")]
    want = {}
    counts = {k: text.token_list(f"{t or ''} {text.joined(s)}") for k, t, s in docs}
    mean = sum(map(len, counts.values())) / len(docs)
    for q, question in qs:
        score = dict.fromkeys(counts, 0.0)
        for t in text.token_list(question):
            n = sum(t in c for c in counts.values())
            for k, c in counts.items():
                if f := c.count(t):
                    score[k] += np.log((len(docs) - n + 0.5) / (n + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(c) / mean))
        want[q] = [(k, pytest.approx(v)) for k, v in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]]
    for common in ((0.05, 0.3), (0.5,), (2.0,)):  # most, few and no terms are common
        monkeypatch.setattr(retrieval, "COMMON", common)
        got = {}
        for x in retrieval.rank_corpus(retrieval.build_index(df, "key"), spark.createDataFrame(qs, "qid string, question string"), "qid", "question", 4).orderBy("qid", "rank").collect():
            got.setdefault(x.qid, []).append((x.key, x.score))
        assert got == want


def test_saved_index_ranks_alike_and_knows_its_corpus(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "p2", "Mill", ["old mill"]), ("d1", "p1", "Mill", ["old mill"]), ("d0", "p9", "Mill", ["old mill"]), ("d5", "p5", "Dam", ["new dam"])], "document_id string, paragraph_id string, title string, sentences array<string>").withColumn("key", F.struct("document_id", "paragraph_id"))
    index = retrieval.build_index(docs, "key")
    identity = retrieval.save_index(index, str(tmp_path / "i"))
    qs = spark.createDataFrame([("q", "mill"), ("n", None)], "qid string, question string")
    for i in (index, retrieval.load_index(spark, str(tmp_path / "i"), identity["digest"])):
        got = [(r.qid, r.key.paragraph_id) for r in retrieval.rank_corpus(i, qs, "qid", "question", 3).orderBy("qid", "rank").collect()]
        assert got == [("n", "p9"), ("n", "p1"), ("n", "p2"), ("q", "p9"), ("q", "p1"), ("q", "p2")]
    with pytest.raises(ValueError, match="belong"):
        retrieval.load_index(spark, str(tmp_path / "i"), "1")
    c = corpus.paragraph_corpus(spark.createDataFrame([("e", [("T", ["a"])])], "example_id string, context array<struct<title:string,sentences:array<string>>>"))
    assert retrieval.content_id_problems(c).count() == 0 and {r.problem for r in retrieval.content_id_problems(c.unionByName(c.withColumn("title", F.lit("V")))).collect()} == {"not the hash of its content", "repeated"}


def test_fair_candidates_and_retrieval_summaries(spark):
    rows = [(q, p, f"i{k}", k, 1.0 / (k + 1)) for q in ("q1", "q2") for p in ("mmr", "cover") for k in range(3)]
    df = spark.createDataFrame(rows, "q string, packer string, item string, rank int, score double")
    assert metrics.unfair(df, "packer", "q", "item", "rank", "score").count() == 0
    other = df.withColumn("score", F.when((F.col("q") == "q2") & (F.col("packer") == "mmr"), 0.5).otherwise(F.col("score"))).where("not (q = 'q1' and packer = 'mmr')")
    assert {tuple(r) for r in metrics.unfair(other, "packer", "q", "item", "rank", "score").collect()} == {("q1", "mmr"), ("q2", "mmr")}
    m = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, None, "x", 3.0), ("b", 0.0, 0.0, 0.0, 0.0, 1.0, "x", 5.0)], "query string, recall double, all_gold double, any_gold double, mrr double, both_gold double, corpus_id string, ms double")
    r = metrics.retrieval_summary(m, ("corpus_id",), "ms").first()
    assert (r.n, r.recall, r.both_gold, r.ms, r.corpus_id) == (2, 0.5, 1.0, 4.0, "x")
    for bad in (m.withColumn("corpus_id", F.col("query")), m.withColumn("query", F.lit("a")), m.withColumn("ms", F.lit(-1.0))):
        with pytest.raises(Exception):
            metrics.retrieval_summary(bad, ("corpus_id",), "ms").collect()
    facts = spark.createDataFrame([("e", "T", 0), ("e", "T", 1), ("e", "U", 0)], "id string, title string, sent_id int")
    ids = spark.createDataFrame([("T", 0, "p1"), ("T", 1, "p1"), ("U", 0, "p0")], "title string, sent_id int, paragraph_id string")
    assert corpus.fact_paragraphs(facts, ids, "id").first().paragraph_ids == ["p0", "p1"]
    with pytest.raises(Exception, match="no paragraph"):
        corpus.fact_paragraphs(facts, ids.where("title = 'T'"), "id").collect()


def test_record_summary_wants_whole_columns(spark):
    cols = [*metrics.REQUIRED, *metrics.OPTIONAL]
    row = lambda v, o: ("m", *[v] * len(metrics.REQUIRED), *[o] * len(metrics.OPTIONAL))
    df = lambda *rows: spark.createDataFrame(list(rows), "method string, " + ", ".join(f"{c} double" for c in cols))
    r = metrics.record_summary(df(row(1.0, None), row(2.0, None)), ["method"]).first()
    assert r.num_examples == 2 and r.peak_rss_mb == 1.5 and r.support_f1 is None
    for bad in (df(row(1.0, 1.0), row(2.0, None)), df(row(1.0, 1.0), row(None, 1.0))):
        with pytest.raises(Exception, match="missing|null"):
            metrics.record_summary(bad, ["method"]).collect()


def test_failure_table_wants_one_population(spark):
    a = spark.createDataFrame([("1", 0.0, 0.5, 0.125, "x", "other"), ("2", 1.0, 1.0, 1.0, "y", None)], "id string, em double, f1 double, cover double, text string, category string")
    b = a.withColumn("em", F.lit(0.0)).withColumn("category", F.lit("support_missing"))
    t = {(r.id, r.method): (r.outcome, r.note) for r in errors.failure_table(a, b, "id", "a", "b").collect()}
    assert t["1", "a"] == ("both_fail", "The failure does not fit the main taxonomy cleanly. The paired b run also fails on this example.")
    assert t["1", "b"][1].startswith("Coverage is 0.12;") and t["2", "b"][0] == "b_fail_only" and len(t) == 3
    with pytest.raises(Exception, match="same unique ids"):
        errors.failure_table(a, b.where("id = '1'"), "id", "a", "b").collect()


def test_rank_correlation_interval(spark):
    rows = [("g", i, float(i), float(i * i % 17)) for i in range(40)] + [("g", 99, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    r = stats.spearman_interval(df, "x", "y", ["g"], "id", 200).first()
    assert r.n == 40 and r.low <= r.rho <= r.high and r.rho == pytest.approx(stats.spearman(df.where("x is not null"), "x", "y", ["g"]).first().rho)


def test_statistics_plan(spark, tmp_path):
    from tessera.plans import statistics

    r = random.Random(3)
    order = r.sample(range(40), 40)
    runs = {}
    for c in ("base", "x"):
        runs[c] = [{"example_id": f"e{i:02d}", "method": c, "answer_em": float(r.random() < 0.5), "answer_f1": round(r.random(), 3), "token_budget": 160} for i in order]
        (tmp_path / c).write_text("\n".join(json.dumps(x) for x in runs[c]))
    plan = {"runs": [{"config_id": c, "method": c, "predictions": str(tmp_path / c)} for c in runs], "num_examples": 40, "protocol": {"token_budget": 160}, "bootstrap_replicates": 300, "permutation_replicates": 300, "holm_bonferroni": True}
    with pytest.raises(ValueError, match="replicates"):
        statistics.check_plan(plan)
    doc = statistics.run(spark, plan, str(tmp_path / "out"), few_replicates=True)
    t = {x.metric: x for x in spark.read.option("header", True).option("inferSchema", True).csv(doc["tables"][1]).collect()}
    d = np.array([b["answer_f1"] - a["answer_f1"] for a, b in zip(runs["base"], runs["x"])])  # in the order of the files
    rng = np.random.default_rng(42)
    means = np.concatenate([d[rng.integers(0, 40, (m, 40))].mean(1) for m in (256, 44)])
    assert t["answer_f1"].p_value == pytest.approx(stats.sign_test(d, 300)) and t["answer_f1"].low == pytest.approx(np.quantile(means, 0.025)) and t["answer_em"].test == "mcnemar_exact_two_sided"
    assert spark.read.option("header", True).csv(doc["tables"][0]).count() == 4
    (tmp_path / "x").write_text("\n".join(json.dumps({**x, "token_budget": 96}) for x in runs["x"]))
    with pytest.raises(Exception, match="protocol"):
        statistics.run(spark, plan, str(tmp_path / "out2"), few_replicates=True)


def test_settings(tmp_path):
    from tessera import config

    (tmp_path / "a.json").write_text('{"packing": {"method": "mmr", "trade": 0.7}, "split": {"stratify_by": "qtype"}, "retrieval": {"top_k": 3}}')
    s = config.load(str(tmp_path / "a.json"))
    assert (s.packing.method, s.packing.trade, s.packing.budget, s.retrieval.top_k, s.split.stratify_by) == ("mmr", 0.7, 160, 3, ("qtype",))
    assert config.build(s.resolved()) == s and config.build({}) == config.Settings()
    for bad in ({"other": {}}, {"retrieval": {"depth": 1}}, {"retrieval": {"b": 2.0}}):
        with pytest.raises(ValueError):
            config.build(bad)
    (tmp_path / "a.yaml").write_text("retrieval: {top_k: 4}")
    pytest.importorskip("yaml")
    assert config.load(str(tmp_path / "a.yaml")).retrieval.top_k == 4


def test_prompts(spark):
    df = spark.createDataFrame([(" Who? ", " "), (None, "Title: T\n- a ")], "q string, e string")
    got = df.select(generation.prompt(F.col("q"), F.col("e"), " Short. ").alias("p"), generation.completion(F.col("q"), F.col("e"), "Be brief.").alias("c"), F.size(generation.messages(F.col("q"), F.col("e"), "")).alias("n")).collect()
    assert got[0].p == "Evidence:\nNo evidence provided.\n\nQuestion: Who?\n\nShort." and got[0].n == 1
    assert got[1].c == "System:\nBe brief.\n\nUser:\nEvidence:\nTitle: T\n- a\n\nQuestion: \n\nAssistant:"


def test_other_token_counters_and_latency_rows(spark):
    ex = spark.createDataFrame([("e", "old mill", [("T", ["the old mill", "x y"])])], "eid string, question string, context array<struct<title:string,sentences:array<string>>>")
    c = packing.candidates(retrieval.rank_context(ex), lambda s: len(s or "")).first()
    assert [x.token_count for x in c.cands] == [12, 3]
    r = spark.createDataFrame([("b", [1.0, 2.0], "m"), ("n", None, "m")], "name string, ms array<double>, model string")
    assert [tuple(x) for x in systems.latency_rows(r, "name", "ms", ["model"]).collect()] == [("m", "b", 0, 1.0), ("m", "b", 1, 2.0)]
    with pytest.raises(ValueError, match="metadata"):
        systems.latency_rows(r.withColumn("latency_ms", F.lit(1)), "name", "ms", ["latency_ms"])


def test_stream_appends_each_key_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: run_stream(spark, str(src), "id string, v int", str(tmp_path / "out"), str(tmp_path / "cp"), "id", lambda d: d.withColumn("w", F.col("v") * 2))
    (src / "a.json").write_text('{"id":"a","v":1}\n{"id":"b","v":2}\n')
    run()
    (src / "b.json").write_text('{"id":"b","v":2}\n{"id":"c","v":3}\n')
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1, 2), ("b", 2, 4), ("c", 3, 6)]


def test_comparison_table_draws_ten_thousand_replicates(spark):
    rows = [(i, r, "f1", float(r == "x") + i * 1e-3) for i in range(30) for r in ("base", "x")]
    t = stats.comparison_table(spark.createDataFrame(rows, "id int, run string, metric string, value double"), "id", "run", "metric", "value", "base").collect()
    assert len(t) == 1 and t[0].p_value == pytest.approx(1 / 10_001)


def test_comparisons_and_reports(spark):
    rows = [(i, r, m, float((i * k) % 3 == 0)) for i in range(30) for k, r in enumerate(("base", "x", "y"), 1) for m in ("em", "f1")]
    t = {(r.run, r.metric): r for r in stats.comparison_table(spark.createDataFrame(rows, "id int, run string, metric string, value double"), "id", "run", "metric", "value", "base", replicates=50).collect()}
    assert set(t) == {(r, m) for r in "xy" for m in ("em", "f1")} and t["y", "em"].delta == pytest.approx(2 / 3) and t["y", "em"].p_value < 0.01 and t["x", "em"].test == "mcnemar"
    assert all(v.p_holm >= v.p_value and v.low <= v.delta <= v.high for v in t.values())
    a = spark.createDataFrame([("1", 1.0), ("2", 0.5)], "id string, f1 double")
    same = {r.check: r.passed for r in provenance.reproducibility_checks(spark, a, a, "id", ["f1"]).collect()}
    other = {r.check: r.passed for r in provenance.reproducibility_checks(spark, a, a.where("id = '1'"), "id", ["f1", "em"]).collect()}
    assert all(same.values()) and not other["the ids are the same"] and not other["first has its metrics"]
    runs = [spark.createDataFrame([(f"r{b}", "s", b)], "run string, split string, budget int") for b in (96, 128)]
    assert [r.budget for r in provenance.union_runs(runs, ["split"], "run", ["budget"]).collect()] == [128, 96]
    with pytest.raises(Exception, match="repeated"):
        provenance.union_runs([runs[0], runs[0]], ["split"], "run", ["budget"]).collect()


def test_samples_of_failures(spark):
    own = spark.createDataFrame([(f"e{i}", "other") for i in range(6)], "id string, category string")
    got = errors.annotation_sample(own, own.where("id > 'e3'"), "id", "a", "b", 5, 2).collect()
    assert [r.outcome for r in got if r.method == "a"].count("a_fail_only") == 4 and len(got) == 7
    rep = errors.representatives(own, "id", [F.col("id") == "e5", F.col("id") == "e1"], 3).collect()
    assert {r.id for r in rep} == {"e5", "e1", "e0"}


def test_command_line(tmp_path, capsys):
    from tessera import cli

    for n, ids in (("a", ["1", "2"]), ("b", ["3"])):
        (tmp_path / n).write_text(json.dumps(records.split_manifest(ids, "dev", 1)))
    cli.main(["validate-splits", str(tmp_path / "a"), str(tmp_path / "b")])
    with pytest.raises(SystemExit):
        cli.main(["validate-splits", str(tmp_path / "a"), str(tmp_path / "a")])
    (tmp_path / "c").write_text("{}")
    cli.main(["freeze", "--config", str(tmp_path / "c"), "--manifest", str(tmp_path / "a"), "--out", str(tmp_path / "f")])
    cli.main(["verify-frozen", str(tmp_path / "f")])
    cli.main(["queries"])
    assert "method_summary" in capsys.readouterr().out

"""Building blocks of the checking SQL (DuckDB dialect): the same definitions as the column functions, written independently."""

from __future__ import annotations

from tessera.functions.text import STOP

WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STOP_LIST = "[" + ",".join(f"'{w}'" for w in STOP) + "]"
_PUNCT = r"""[!-/:-@\[-`{-~]"""
_EDGE = r"[^\pL\pN\pM_]"


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '([A-Za-z0-9]+(?:''[A-Za-z0-9]+)?)', 1), lambda t: lower(t))"


def trm(x: str) -> str:
    return f"list_distinct(list_filter({tok(x)}, lambda t: NOT list_contains({STOP_LIST}, t)))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def norm(x: str) -> str:
    bare = f"regexp_replace(lower(coalesce({x}, '')), '{_PUNCT}', '', 'g')"
    for _ in range(2):
        bare = rf"regexp_replace({bare}, '(^|{_EDGE})(a|an|the)({_EDGE}|$)', '\1 \3', 'g')"
    return squeeze(bare)


def spaces(x: str) -> str:
    return f"greatest(1, len(list_filter(string_split({squeeze(f'coalesce({x}, {chr(39)*2})')}, ' '), lambda s: s <> '')))"


def para(s: str) -> str:
    return f"coalesce(array_to_string(list_filter(list_transform({s}, lambda z: {strip('z')}), lambda z: z IS NOT NULL AND z <> ''), ' '), '')"


def jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


#: Each example record once, with a key over example and split.
EX = "ex AS (SELECT split || ':' || example_id AS eid, * FROM (SELECT *, row_number() OVER (PARTITION BY example_id, split ORDER BY ingested_at) AS rn FROM examples) WHERE rn = 1)"
GEN = "gen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY generation_id ORDER BY ingested_at) AS rn FROM generations) WHERE rn = 1)"
COR = "cor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paragraph_id ORDER BY ingested_at) AS rn FROM corpus) WHERE rn = 1)"
RET = "ret AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id, paragraph_id ORDER BY ingested_at) AS rn FROM retrieved) WHERE rn = 1)"
RUN = "runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY recorded_at) AS rn FROM benchmark_runs) WHERE rn = 1)"

#: Predictions: generated answers with the gold answer of the example's first split and their scores.
_P, _G = "string_split(np, ' ')", "string_split(ng, ' ')"
PRED = f"""{EX}, {GEN},
gold AS (SELECT * FROM (SELECT example_id, answer, qtype, row_number() OVER (PARTITION BY example_id ORDER BY split) AS k FROM ex) WHERE k = 1),
p0 AS (SELECT g.generation_id, g.example_id, g.method, g.token_budget, g.evidence, g.text, o.answer, o.qtype, {norm('g.text')} AS np, {norm('o.answer')} AS ng FROM gen g JOIN gold o USING (example_id)),
pred AS (SELECT *, (np = ng)::DOUBLE AS em,
  CASE WHEN np = '' AND ng = '' THEN 1.0 WHEN np = '' OR ng = '' THEN 0.0 ELSE
    2.0 * list_sum(list_transform(list_distinct({_P}), lambda t: least(len(list_filter({_P}, lambda z: z = t)), len(list_filter({_G}, lambda z: z = t))))) / (len({_P}) + len({_G})) END AS f1 FROM p0)"""

_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"


def _bm(qf: str = "qf") -> str:
    return f"sum({qf} * {_IDF} * (tf * 2.5) / greatest(tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-8)), 1e-8))"


#: The five best context paragraphs of each example: rk(eid, pos, rank, score, title, sentences).
RANKED = f"""{EX},
d AS (SELECT eid, question, u.pos, context[u.pos + 1].title AS title, context[u.pos + 1].sentences AS sentences, {tok("coalesce(context[u.pos + 1].title, '') || ' ' || " + para("context[u.pos + 1].sentences"))} AS toks
  FROM ex, (SELECT unnest(range(0, 1000)) AS pos) u WHERE u.pos < len(context)),
s AS (SELECT eid, count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM d GROUP BY eid),
q AS (SELECT eid, t, count(*) AS qf FROM (SELECT eid, unnest({tok('question')}) AS t FROM ex) GROUP BY eid, t),
tf AS (SELECT eid, pos, t, count(*)::DOUBLE AS tf FROM (SELECT eid, pos, unnest(toks) AS t FROM d) GROUP BY eid, pos, t),
df AS (SELECT eid, t, count(*)::DOUBLE AS df FROM tf GROUP BY eid, t),
sc AS (SELECT tf.eid, tf.pos, {_bm()} AS score FROM tf JOIN q USING (eid, t) JOIN df USING (eid, t) JOIN s USING (eid) JOIN (SELECT eid, pos, len(toks) AS dl FROM d) l ON l.eid = tf.eid AND l.pos = tf.pos GROUP BY tf.eid, tf.pos),
al AS (SELECT d.eid, d.pos, d.title, d.sentences, coalesce(sc.score, 0.0) AS score FROM d LEFT JOIN sc ON sc.eid = d.eid AND sc.pos = d.pos),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY round(score, 9) DESC, pos) AS rank FROM al) WHERE rank <= 5)"""

#: Sentence candidates of the ranked paragraphs: cd(eid, pos, title, sid, terms, tok, ps, toverlap, qoverlap).
CANDS = f"""{RANKED},
mm AS (SELECT eid, min(score) AS lo, max(score) AS hi FROM rk GROUP BY eid),
qt AS (SELECT eid, {trm('question')} AS qterms FROM ex),
c0 AS (SELECT rk.eid, rk.rank, coalesce(rk.title, '') AS title, u.sid, rk.sentences[u.sid + 1] AS text, {trm('rk.sentences[u.sid + 1]')} AS terms, {spaces('rk.sentences[u.sid + 1]')} AS tok,
  CASE WHEN hi = lo THEN 1.0 ELSE (rk.score - lo) / (hi - lo) END AS ps, qterms, len(list_intersect(qterms, {trm('rk.title')}))::DOUBLE / greatest(len(qterms), 1) AS toverlap
  FROM rk JOIN mm USING (eid) JOIN qt USING (eid), (SELECT unnest(range(0, 1000)) AS sid) u WHERE u.sid < len(rk.sentences)),
cd AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY rank, sid) - 1 AS pos, len(list_intersect(qterms, terms))::DOUBLE / greatest(len(qterms), 1) AS qoverlap FROM c0 WHERE len(terms) > 0)"""


_TAKEN = "SELECT e.eid, coalesce(max_by(used, step), 0)::INTEGER AS used_tokens, coalesce(array_to_string(max_by(taken, step), ','), '') AS positions FROM ex e LEFT JOIN g USING (eid) GROUP BY e.eid"

#: After greedy(): what was taken, in order: ch(eid, i, pos, title, sid, terms, text).
CHOSEN = """, tk AS (SELECT eid, max_by(taken, step) AS taken, max_by(used, step) AS used FROM g GROUP BY eid),
ch AS (SELECT u.eid, u.i, cd.pos, cd.title, cd.sid, cd.terms, cd.text FROM (SELECT eid, unnest(taken) AS pos, generate_subscripts(taken, 1) AS i FROM tk) u JOIN cd ON cd.eid = u.eid AND cd.pos = u.pos)
"""


def greedy(score: str, budget: int = 160, stop: str = "", final: str = _TAKEN) -> str:
    """A recursive selection: score over (c: candidate, g: state with covered, titles, taken) and near (largest similarity to what is taken)."""
    return f"""WITH RECURSIVE {CANDS},
cx AS MATERIALIZED (SELECT eid, pos, title, sid, terms, tok, qterms, 0.55 * qoverlap + 0.35 * ps + 0.10 * toverlap AS rel FROM cd),
g AS (
  SELECT eid, 0 AS step, 0 AS used, []::BIGINT[] AS taken, []::VARCHAR[] AS covered, []::VARCHAR[] AS titles, []::VARCHAR[] AS keys, []::VARCHAR[][] AS sets FROM (SELECT DISTINCT eid FROM cx)
  UNION ALL
  SELECT eid, step + 1, used + b.tok, list_append(taken, b.pos), list_distinct(list_concat(covered, b.terms)), list_append(titles, b.title), list_append(keys, b.key), list_append(sets, b.terms)
  FROM (
    SELECT g.eid, g.step, g.used, g.taken, g.covered, g.titles, g.keys, g.sets, arg_max(struct_pack(pos := c.pos, tok := c.tok, terms := c.terms, title := c.title, key := c.title || chr(1) || c.sid, score := {score}), struct_pack(s := {score}, p := -c.pos)) AS b
    FROM g JOIN cx c ON c.eid = g.eid,
      LATERAL (SELECT coalesce(list_max(list_transform(g.sets, lambda z: {jac('z', 'c.terms')})), 0.0) AS near) nn
    WHERE g.used + c.tok <= {budget} AND NOT list_contains(g.keys, c.title || chr(1) || c.sid)
    GROUP BY ALL HAVING b IS NOT NULL
  ) WHERE true {stop}
)
{final}"""


def summaries(plans: list, columns: str) -> str:
    """Means of support metrics for each of the plans (cover, mmr, query_cover, relevance, none): one recursion over examples and configurations."""
    val = lambda p: f"('{p.config_id}', '{p.method}', {p.budget}, {p.alpha}::DOUBLE, {p.beta}::DOUBLE, {p.gamma}::DOUBLE, {p.delta}::DOUBLE, {p.title_bonus}::DOUBLE, {p.stop}::DOUBLE, {p.trade}::DOUBLE)"
    new = "len(list_filter(list_intersect(c.terms, c.qterms), lambda z: NOT list_contains(g.covered, z)))::DOUBLE"
    score = f"""round(CASE g.method WHEN 'mmr' THEN g.trade * c.rel - (1 - g.trade) * nn.near WHEN 'query_cover' THEN {new} / c.tok WHEN 'relevance' THEN -c.place
      ELSE g.alpha * c.rel + g.beta * {new} / greatest(len(c.qterms), 1) + g.bonus * (CASE WHEN list_contains(g.titles, c.title) THEN 0.0 ELSE 1.0 END) - g.gamma * nn.near - g.delta * (c.tok::DOUBLE / g.budget) END, 12)"""
    return f"""WITH RECURSIVE {CANDS},
cfg AS (SELECT * FROM (VALUES {", ".join(map(val, plans))}) t(config_id, method, budget, alpha, beta, gamma, delta, bonus, stop, trade)),
cx AS MATERIALIZED (SELECT eid, pos, title, sid, terms, tok, qterms, 0.55 * qoverlap + 0.35 * ps + 0.10 * toverlap AS rel, row_number() OVER (PARTITION BY eid ORDER BY qoverlap DESC, round(ps, 12) DESC, toverlap DESC, pos)::DOUBLE AS place FROM cd),
g AS (
  SELECT eid, cfg.*, 0 AS step, 0 AS used, []::VARCHAR[] AS covered, []::VARCHAR[] AS titles, []::VARCHAR[] AS keys, []::VARCHAR[][] AS sets FROM (SELECT DISTINCT eid FROM cx), cfg WHERE method <> 'none'
  UNION ALL
  SELECT eid, config_id, method, budget, alpha, beta, gamma, delta, bonus, stop, trade, step + 1, used + b.tok, list_distinct(list_concat(covered, b.terms)), list_append(titles, b.title), list_append(keys, b.key), list_append(sets, b.terms)
  FROM (
    SELECT g.eid, g.config_id, g.method, g.budget, g.alpha, g.beta, g.gamma, g.delta, g.bonus, g.stop, g.trade, g.step, g.used, g.covered, g.titles, g.keys, g.sets,
      arg_max(struct_pack(tok := c.tok, terms := c.terms, title := c.title, key := c.title || chr(1) || c.sid, score := {score}), struct_pack(s := {score}, p := -c.pos)) AS b
    FROM g JOIN cx c ON c.eid = g.eid,
      LATERAL (SELECT coalesce(list_max(list_transform(g.sets, lambda z: {jac('z', 'c.terms')})), 0.0) AS near) nn
    WHERE g.used + c.tok <= g.budget AND NOT list_contains(g.keys, c.title || chr(1) || c.sid)
    GROUP BY ALL HAVING b IS NOT NULL
  ) WHERE CASE method WHEN 'cover' THEN step = 0 OR b.score >= stop WHEN 'query_cover' THEN b.score > 0 ELSE true END
),
tk AS (SELECT eid, config_id, max_by(used, step) AS used, max_by(keys, step) AS keys FROM g GROUP BY eid, config_id),
gold AS (SELECT eid, list_distinct(list_transform(coalesce(supporting_facts, []), lambda f: coalesce(f.title, chr(2)) || chr(1) || coalesce(f.sent_id::VARCHAR, chr(2)))) AS gold FROM ex),
n AS (SELECT gold.eid, cfg.config_id, cfg.method, cfg.budget, coalesce(used, 0) AS used, len(coalesce(keys, [])) AS np, len(gold) AS ng, len(list_intersect(coalesce(keys, []), gold)) AS h FROM gold CROSS JOIN cfg LEFT JOIN tk ON tk.eid = gold.eid AND tk.config_id = cfg.config_id),
m AS (SELECT *, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 END AS edge FROM n)
SELECT {columns}, count(*) AS n, round(avg(used), 6) AS used_tokens, round(avg(coalesce(edge, (h = np AND h = ng)::DOUBLE)), 6) AS support_em, round(avg(coalesce(edge, h::DOUBLE / np)), 6) AS support_precision, round(avg(coalesce(edge, h::DOUBLE / ng)), 6) AS support_recall,
  round(avg(coalesce(edge, 2.0 * h / (np + ng))), 6) AS support_f1, round(avg(CASE WHEN ng = 0 THEN 1.0 ELSE h::DOUBLE / ng END), 6) AS coverage FROM m GROUP BY {columns}"""


def cover_score(alpha: float = 1.0, beta: float = 1.2, gamma: float = 0.6, delta: float = 0.15, bonus: float = 0.3, budget: int = 160) -> str:
    new = "len(list_filter(list_intersect(c.terms, c.qterms), lambda z: NOT list_contains(g.covered, z)))::DOUBLE / greatest(len(c.qterms), 1)"
    return f"round({alpha} * c.rel + {beta} * {new} + {bonus} * (CASE WHEN list_contains(g.titles, c.title) THEN 0.0 ELSE 1.0 END) - {gamma} * nn.near - {delta} * (c.tok::DOUBLE / {budget}), 12)"

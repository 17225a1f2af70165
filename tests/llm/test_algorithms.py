import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing, percentiles, residue, segment_join, tokenize, top_n


# Top N

def best(rows, n):
    one = {}
    for g, i, s, r in rows:
        if g is None or i is None or s is None or s != s:
            continue
        k = (-s, 1 << 40 if r is None else r, i)
        if (g, i) not in one or k < one[g, i]:
            one[g, i] = k
    out = set()
    for g in {g for g, _ in one}:
        for p, k in enumerate(sorted(v for (h, _), v in one.items() if h == g)[:n], 1):
            out.add((g, p, k[2]))
    return out


def test_top_n_equals_sorting(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "hot", "hot", "hot", None]), r.choice([f"p{i}" for i in range(60)] + [None]), r.choice([1.0, 2.0, 0.5, -1.0, 0.0, -0.0, None, float("nan"), float("inf")]), r.choice([1, 2, 3, None])) for _ in range(1500)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "q string, i string, s double, r int").withColumns({"g": F.lit(1), "place": F.lit(2)}).repartition(7)
    monkeypatch.setattr(top_n, "FLUSH_GROUPS", 2)
    got = top_n.top_n(df, "q", "i", "s", "r", 5).collect()
    assert {(x.q, x.place, x.i) for x in got} == best(rows, 5) and len(got) == len(best(rows, 5))


def test_top_n_of_nothing(spark):
    assert top_n.top_n(spark.createDataFrame([], "q string, i string, s double, r int"), "q", "i", "s", "r").count() == 0


# Tokenizer

def test_encoding_is_that_of_the_public_libraries(spark):
    import public_tokenizers as p
    import tiktoken

    e = tokenize.encoder()
    other = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["", None, " ", "a" * 5000, "<|endoftext|>", "Héllo wörld  \n\n x", "漢字" * 400, "👩‍🔬 12345 don't", "".join(chr(r.randrange(32, 0x3000)) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"k": F.lit(0), "ids": F.lit(1)})
    got = {x.id: list(x.ids) for x in tokenize.encode_column(df, "id", "text").collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = {x.id: x.n_tokens for x in tokenize.count_column(df, ["id"], "text").collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert tokenize.encode_column(df.limit(0), "id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(t):
    e = tokenize.encoder()
    back = {v: k for k, v in e.ranks.items()}
    t = t.encode("utf-8", "ignore").decode()
    assert b"".join(back[i] for i in e.encode(t)) == t.encode()


# Segment join

def test_cross_split_pairs_equal_all_pairs(spark, monkeypatch):
    r = random.Random(5)
    vq, vc = [f"q{i}" for i in range(120)], [f"c{i}" for i in range(500)]
    rows = []
    for g in range(40):
        q, c = r.sample(vq, 12), r.sample(vc, 50)
        for j in range(3):
            edit = lambda w, v: [x if r.random() > 0.12 * j else r.choice(v) for x in w]
            rows.append((f"e{g}-{j}" if j else f"e{g}", r.choice(["train", "test", "validation"]), " ".join(edit(q, vq)), " ".join(edit(c, vc))))
    rows += [("n1", "test", None, "c1"), ("n2", None, "q1", "c1"), (None, "test", "q1", "c1"), ("n3", "train", "", ""), ("same", "test", "alpha beta", "gamma"), ("same", "train", "Beta alpha", "gamma!"), ("same", "train", "Beta alpha", "gamma!")]
    df = spark.createDataFrame(rows, "id string, split string, q string, c string").withColumns({"k": F.lit(1), "s": F.lit(2), "w": F.lit(3)})
    words = lambda t: frozenset((t or "").lower().replace("!", "").split())
    j = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    want = {(a[0], b[0], a[1]) for a in rows for b in rows if a[0] and b[0] and a[1] in ("test", "validation") and b[1] == "train" and j(words(a[2]), words(b[2])) >= 0.6 and j(words(a[3]), words(b[3])) >= 0.6}
    for per_key in (segment_join.PER_KEY, 1):
        monkeypatch.setattr(segment_join, "PER_KEY", per_key)
        got = segment_join.cross_split_pairs(df, "id", "split", F.col("q"), F.col("c")).pairs().collect()
        assert {tuple(x) for x in got} == want and len(want) > 20 and len(got) == len(want)


def test_cross_split_pairs_of_nothing(spark):
    assert segment_join.cross_split_pairs(spark.createDataFrame([], "id string, split string, q string, c string"), "id", "split", F.col("q"), F.col("c")).pairs().count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 30), unique=True, max_size=15), st.lists(st.integers(0, 30), unique=True, max_size=15), st.integers(0, 12)), min_size=1, max_size=6))
def test_banded_distance_of_sorted_sets_is_their_difference(pairs):
    a, b = ([np.array(sorted(p[i]), np.int64) for p in pairs] for i in (0, 1))
    got = segment_join.banded_distances(a, b, np.array([p[2] for p in pairs]))
    for g, (x, y, band) in zip(got, pairs):
        d = len(set(x) ^ set(y))
        assert g == d if d <= band else g > band


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_banded_distance_of_strings_counts_insertions_and_deletions(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row = [i] + [0] * len(y) if (old := row) is not None else row
        for j, d in enumerate(y, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] if c == d else 99)
    code = lambda t: np.array([ord(c) for c in t], np.int64)
    assert segment_join.banded_distances([code(x)], [code(y)], np.array([20]))[0] == row[-1]


# Percentiles

@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=2))
def test_ordered_integers_keep_the_order(x):
    k = percentiles.to_ordered(np.array(x))
    assert (k[0] < k[1]) == (x[0] < x[1]) and (k[0] == k[1]) == (x[0] == x[1])
    assert (percentiles.from_ordered(k) == np.array(x)).all()


@pytest.mark.parametrize("big", [False, True])
def test_percentiles_are_exact(spark, monkeypatch, big):
    if big:
        monkeypatch.setattr(percentiles, "counted_broadcast", lambda df, rows=None: df)
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", "y"]), r.choice([r.gauss(0, 50), r.random() * 1e-3, 7.0, None, float("nan"), 0.0, -0.0, 1e300])) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, h string, v double").withColumn("digit", F.lit(1))
    got = percentiles.percentiles(df, ["g", "h"], "v", [0.5, 0.95, 0.0, 1.0], [["g", "h"], ["g"], []]).collect()
    ok = [x for x in rows if x[2] is not None and x[2] == x[2]]
    want = {}
    for lv, keys in enumerate((lambda x: (x[0], x[1]), lambda x: (x[0], None), lambda x: (None, None))):
        groups = {}
        for x in ok:
            groups.setdefault(keys(x), []).append(x[2])
        for (g, h), v in groups.items():
            for p in (0.5, 0.95, 0.0, 1.0):
                want[lv, g, h, p] = (len(v), float(np.percentile(v, p * 100)))
    assert {(x.level, x.g, x.h, x.q) for x in got} == set(want)
    for x in got:
        n, v = want[x.level, x.g, x.h, x.q]
        assert x.n == n and x.value == pytest.approx(v, rel=1e-12, abs=1e-300) and x.bound == 0


def test_combined_histograms_keep_their_bound(spark):
    r = random.Random(4)
    rows = [("a", d, r.expovariate(0.01)) for d in ("1", "2", "3") for _ in range(300)]
    parts = [percentiles.digit_histogram(spark.createDataFrame([x for x in rows if x[1] == d], "g string, d string, v double"), ["g"], "v", 2) for d in ("1", "2", "3")]
    got = percentiles.percentiles_of_histogram(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"], [0.5, 0.95]).collect()
    for x in got:
        true = float(np.percentile([v for _, _, v in rows], x.q * 100))
        assert abs(x.value - true) <= 2 * x.bound + 1e-12 and x.bound < 1e-5 * true


def test_percentiles_of_nothing(spark):
    assert percentiles.percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5], [["g"], []]).count() == 0


def test_disagreeing_summaries(spark):
    runs = spark.createDataFrame([("r1", "b", "d", None, [1.0, 2.0, None, -5.0, float("nan"), 3.0]), ("r1", "b", "d", None, [1.0, 2.0, None, -5.0, float("nan"), 3.0]), ("r2", "c", "d", None, None), ("r3", "z", "d", None, [0.0])], "run_id string, benchmark_name string, run_day string, recorded_at timestamp, latency_samples_ms array<double>")
    s = spark.createDataFrame([("b", "d", 2.0, 2.9), ("b", "d", 2.3, None), ("c", "d", 1.0, 1.0), ("z", "d", 0.1, 0.0)], "benchmark_name string, run_day string, p50_ms double, p95_ms double")
    assert {tuple(x) for x in percentiles.disagreeing(runs, s).collect()} == {("b", "d"), ("z", "d")}


# Mixing

def test_mixture_keeps_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    r = random.Random(6)
    docs = [(i, r.choice(["a"] * 6 + ["b", "c", "unlisted", None]), "word " * r.randrange(0, 60)) for i in range(900)] + [(901, "a", None), (902, "b", ""), (5, "a", "repeated key")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"p": F.lit(1), "done": F.lit(2)}).repartition(9)
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(df, t)
    rep = {x.source: x for x in report.collect()}
    assert set(rep) == {"a", "b", "c", "none"} and rep["none"].uses == 0
    for s in "abc":
        assert rep[s].actual_share == pytest.approx(rep[s].target_share, abs=0.01) and rep[s].uses <= rep[s].max_repeats + 1e-9
    got = copies.collect()
    assert len(got) == len({x.doc_id for x in got}) and all(x.copies in (int(rep[x.source].uses), int(rep[x.source].uses) + 1) for x in got)
    for layout in (df, df.repartition(7), df.coalesce(1)):  # the seed fixes the result
        assert {x.doc_id: x.copies for x in got} == {x.doc_id: x.copies for x in mixing.mix(layout, t)[0].collect()}


def test_mixture_of_nothing(spark):
    copies, report = mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert copies.count() == 0 and report.first().uses == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 500), st.integers(1, 500), st.floats(0.001, 0.999), st.floats(0.001, 0.999), st.integers(0, 99))
def test_pivot_keeps_mass_and_settles_one(w, v, p, q, seed):
    a, b = mixing.pivot((1, w, p), (2, v, q), seed)
    assert a * w + b * v == pytest.approx(p * w + q * v) and (a in (0.0, 1.0) or b in (0.0, 1.0)) and 0 <= a <= 1 and 0 <= b <= 1


# Residue

def test_residue_is_told_from_talk_about_it(spark):
    r = random.Random(1)
    town = lambda: r.choice("Alta Berga Corin Dalum Eskil Farno Gelda".split())
    clean = [f"The old mill at {town()} was sold by the baker {town()} {town()} in {r.randrange(1300, 1999)}. A road connects {town()} with the harbour of the town." for _ in range(300)]
    bad = ["404 Not Found\nBack to home", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Dear {{name}}, the entry for ${title} was updated on [DATE HERE].", f"{clean[0]} The {{{{ year }}}} council sold it.", "xxx xxx xxx xxx", f"{clean[1]}\nAccess denied. You don't have permission to access this resource."]
    talk = ['The clerk wrote "access denied" above the old door of the mill at Alta in 1450.', "The code keeps a slot written as {question} and fills it before the road to Berga is sold.", "Tram route 404 runs from Alta to Berga and was not found on older maps of the town.", "def pack(items):\n    return {i.title: i.text for i in items}"]
    rows = list(enumerate([*clean, *bad, *talk, None, "", "  ", " ".join(clean) * 5]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "residue": F.lit(2)})
    got = {x.doc_id for x in residue.flag(df).where("residue").collect()}
    assert got == set(range(300, 300 + len(bad)))
    assert residue.flag(df.limit(0)).count() == 0


def test_words_beside_slots_are_learnt_not_listed():
    r = random.Random(4)
    town = lambda: r.choice("Alta Berga Corin Dalum Eskil Farno Gelda".split())
    clean = [f"The name derives from {town()}, an older word for a mill. The baker {town()} sold the {r.choice('red green low tall'.split())} mill in {r.randrange(1300, 1999)}." for _ in range(400)]
    slots = ["{{ year }}", "${title}", "<%= name %>", "[DATE HERE]", "%PLACE%"]
    open_ = [f"The name derives from {town()}, an older word {r.choice(slots)} a mill." for _ in range(20)] + [f"The baker {r.choice(slots)} sold the tall mill in 1455." for _ in range(40)]
    said = [f"The renderer swaps {r.choice(slots)} at print time for the baker {town()}." for _ in range(30)]
    m = residue.fit(clean + open_ + said, ["Dear {{ name }}, ${title} of [DATE HERE]", "{{ title }} {{ year }}"] * 5)
    assert all(m.residue(t) for t in open_) and not any(m.residue(t) for t in clean)
    assert not any(m.residue(t) for t in said)  # no listed cue word beside the slot
    assert not m.residue("The code keeps a placeholder written as {name} for the baker.")


def test_fit_does_not_depend_on_how_often_texts_recur(spark):
    rows = [(i, f"The mill at Alta was sold in {1300 + i}.") for i in range(300)] + [(1000 + i, "One text that holds a third of all rows.") for i in range(150)] + [(5000, "404 Not Found")]
    got = residue.flag(spark.createDataFrame(rows, "doc_id long, text string")).where("residue").collect()
    assert [x.doc_id for x in got] == [5000]


def test_every_passage_is_scored():
    words = frozenset("gust rowed past plain".split())
    pair = residue.ResidueModel({"gust rowed": 3.0}, -2.0, words)
    weak = residue.ResidueModel({w: 0.9 for w in words}, -3.0, words)
    number = residue.ResidueModel({"0": 3.0}, -2.0, words)
    name = residue.ResidueModel({"⟦name⟧": 3.0}, -2.0, words)
    assert all(m.residue("Nothing here. " + t) for m, t in ((pair, "gust rowed past plain"), (weak, "gust rowed past plain"), (number, "gust 503 rowed past plain"), (name, "503 Qorv rowed past plain gust")))
    assert not any(m.residue("past plain rowed far gust") for m in (pair, number, name))


def test_float_layout_is_ieee():
    assert percentiles.to_ordered(np.array([1.0]))[0] == struct.unpack(">Q", struct.pack(">d", 1.0))[0] | 1 << 63

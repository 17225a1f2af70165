import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dup
from tessera.llm.common import components, joined_text


def brute(rows, threshold):
    sets = {}
    for k, t in rows:
        if k is not None and t:
            w = frozenset(re.findall(r"[^\W_]+", t.lower()))
            if w:
                sets[k] = w
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def make(seed, groups=25, per=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(groups):
        base = r.sample(vocab, 40)
        for j in range(per):
            w = [x if r.random() > 0.08 * j else r.choice(vocab) for x in base]
            r.shuffle(w)
            rows.append((f"k{g:03d}-{j}", " ".join(w)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, t string").withColumns({"k": F.lit(1), "w": F.lit("x"), "class": F.lit(2), "n": F.lit(3)})
    near = near_dup.near_duplicates(df, "id", F.col("t"), **kw)
    got = near.pairs().collect()
    assert len(got) == len({tuple(x) for x in got})
    return {tuple(x) for x in got}, near.members, near.links


def test_equals_all_pairs_with_nulls_copies_and_long_texts(spark):
    long = " ".join(f"z{i}" for i in range(30_000))
    rows = make(1) + [("n1", None), (None, "w1 w2"), ("e1", ""), ("e2", " .,! "), ("c1", "Same words here"), ("c2", "same WORDS, here"), ("c2", "same WORDS, here"), ("l1", long), ("l2", long + " more")]
    got, members, _ = run(spark, rows)
    assert got == brute(rows, 0.7)
    assert {r[0] for r in members.collect()} == {k for k, t in rows if k and t and re.search(r"\w", t)}


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 5)
    rows = make(2, groups=3, per=30)
    got, _, _ = run(spark, rows)
    want = brute(rows, 0.7)
    assert got <= want and len(got) >= 0.995 * len(want)


def test_hot_buckets_find_what_cold_ones_do(spark, monkeypatch):
    rows = make(2, groups=3, per=30)
    cold, _, _ = run(spark, rows, bands=4)  # few bands, so many pairs share just one
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 5)
    hot, _, _ = run(spark, rows, bands=4)
    assert cold and hot == cold


def test_empty_table(spark):
    got, members, links = run(spark, [])
    assert not got and members.count() == 0 and links.count() == 0


def test_components_name_the_smallest_node(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("p", "q"), ("q", "p"), ("z", "z")], "a string, b string")
    assert {tuple(r) for r in components(e).collect()} == {(n, "a") for n in "abcd"} | {("x", "x"), ("y", "x"), ("p", "p"), ("q", "p")}


def test_title_and_sentences_join_without_nulls(spark):
    df = spark.createDataFrame([("T", ["a", None, "b"]), (None, None), (None, ["x"])], "t string, s array<string>")
    assert [r[0] for r in df.select(joined_text(F.col("t"), F.col("s"))).collect()] == ["T a b", "", "x"]


@pytest.mark.parametrize("j", [0.75, 0.9])
def test_registers_agree_as_often_as_words_are_shared(j):
    import numpy as np

    rng = np.random.default_rng(1)
    n = 400
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    keep = int(round(2 * n * j / (1 + j)))
    b = np.concatenate([a[:keep], rng.integers(0, 2**63, n - keep, dtype=np.uint64)])
    r = near_dup.registers(np.concatenate([a, b]), np.array([n, n]), 256)
    assert abs((r[0] == r[1]).mean() - keep / (2 * n - keep)) < 0.06


@pytest.mark.parametrize("n", [4, 8, 20, 60])
def test_few_pairs_at_the_threshold_share_no_band(n):
    import numpy as np

    rng = np.random.default_rng(2)
    times, same = 4000, int(np.ceil(0.7 * n))
    h = rng.integers(0, 2**40, (times, n), dtype=np.uint64)
    cut = same + (n - same) // 2
    a, b = h[:, :cut], np.concatenate([h[:, :same], h[:, cut:]], 1)
    keys = [near_dup.band_keys(near_dup.registers(x.reshape(-1), np.full(times, x.shape[1]), 28)) for x in (a, b)]
    assert (~(keys[0] == keys[1]).any(1)).mean() < 0.002


def test_a_key_with_several_texts_belongs_to_the_class_of_each(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [("x", one), ("x", two), ("y", two), ("z", one + " more")]
    got, members, _ = run(spark, rows)
    assert got == {("x", "y"), ("x", "z")}
    assert {tuple(r) for r in members.collect()} == {("x", "x"), ("y", "x"), ("z", "z")}


def test_one_cluster_of_thousands_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(f"k{i:04d}", " ".join([*base, f"own{i}", f"x{r.randrange(50)}"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, t string").repartition(4)
    links = near_dup.near_duplicates(df, "id", F.col("t")).links
    assert links.count() == 2000 * 1999 // 2

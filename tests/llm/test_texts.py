import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.llm import lookalike, pair_defects

Q = "Between Alta Castle and Berga Abbey, which one kept the old harbour that Corin Dalum described in 1560?"


@pytest.mark.parametrize("text, want", [
    (None, "empty"), ("", "empty"), (" ​ ", "empty"), ("**", "empty"), ("```\n```", "empty"), ("Final answer:", "empty"), ("assistant: Answer:", "empty"), ("...", "empty"), ("<br>", "empty"),
    ("I'm sorry, but I cannot answer this question.", "refusal"), ("Leider kann ich diese Frage nicht beantworten.", "refusal"), ("cannot be answered", "refusal"), ("no conclusion about Alta is possible from these texts", "refusal"),
    (Q, "question_copy"), (f"You asked: {Q}", "question_copy"), (Q.lower().replace("old", "oold"), "question_copy"), (f"{Q} Berga Abbey.", None),
    ("Речь идёт о Berga Abbey, потому что так сказано в тексте.", "other_language"), ("la fille aînée du forgeron", "other_language"), ("Het gaat om Berga Abbey, want de tekst noemt dat zo.", "other_language"),
    ("It was Berga Abbey, as the second pass", "truncated"), ("The answer is Berga Abbey. It clo", "truncated"), ("According to the text, it is…", "truncated"), ("Berga,", "truncated"), ('It was "Berga', "truncated"), ("a guild of", "truncated"),
    ("Paris, Lyon, Nice, Metz, Lille, Brest", None), ("Anna Berg, Carl Dahl and Erik Falk", None), ("the baker, the smith and the old miller", None), ("the tall mill of the bridge, the red house", None), ("Chronicle of Hesvik 8, old town", None), ("in the hills of Rila, in the town of Varna", None),
    ("During the long strike of 1598, dockers", "truncated"), ("In 1979 the council of Falka repeatedly annexed the regional", "truncated"), ("Between 1976 and 1414, about 1020 tonnes of pewter left", "truncated"),
    ("Berga Abbey", None), ("1560", None), ("no", None), ("yes.", None), ("the eldest daughter of the baker", None), ("- Alta Castle\n- Berga Abbey", None), ("It was Berga Abbey, as the text says. The council refused to sell it, and Corin could not answer its letter in time.", None),
    ('It was Alta Castle. A song titled "Der lange Weg nach Hause" mentions it too.', None), ("D'Oler Castle", None), ("It is not known by its older name any more, but it was Berga.", None),
])
def test_defects(text, want):
    assert pair_defects.defect(Q, text) == want


@pytest.mark.parametrize("text", [  # wordings that aren't in the list of patterns as they stand
    "That's outside what I can discuss.", "I'm not in a position to say; we lack sufficient evidence for it.", "We couldn't reliably determine this.", "It is impossible to say from what is given.", "Nothing here lets me answer; the documents don't support any reply.",
    "Il m'est impossible de donner une réponse ici.", "Nous ne sommes pas en mesure de conclure.", "Es ist mir leider nicht möglich, darauf zu antworten.", "Das lässt sich aus dem Text nicht bestimmen.", "Me resulta imposible decirlo.", "No tengo acceso a esos datos.", "Non ho abbastanza informazioni.", "Nie potrafię powiedzieć.", "Não tenho como saber; não é possível determinar.", "Мы не можем определить это.",
])
def test_refusals_in_other_words(text):
    assert pair_defects.defect(Q, text) == "refusal"


@pytest.mark.parametrize("text", ["The council refused to sell it, and Corin could not answer its letter in time.", "He could not say who had built it, but it was Berga Abbey.", "It was impossible to cross the river before Berga Abbey was built.", "The map does not show it, yet Berga Abbey stands there."])
def test_talk_of_inability_is_no_refusal(text):
    assert pair_defects.defect(Q, text) is None


def test_languages_of_words_are_learnt():
    pairs = [("Who sold the old mill that was in the town of Alta?", "the eldest daughter of the smith")] * 50 + [("¿Quién dirigió el taller de Alta antes de que se quemara?", "la hija mayor del herrero")] * 6 + [("Who sold the mill that was in the old town?", "la hija mayor del herrero")]
    learnt = pair_defects.learn_words(pairs)
    assert learnt["hija"] == learnt["herrero"] == "es" and learnt["daughter"] == "en"
    assert pair_defects.defect(Q, "la hija mayor del herrero", learnt=learnt) == "other_language"
    assert pair_defects.defect("¿Quién dirigió el taller de Alta?", "la hija mayor del herrero", learnt=learnt) is None


EN, ES = "Who sold the old mill that was in the town of Alta?", "¿Quién dirigió el taller de Alta antes de que se quemara?"


@pytest.mark.parametrize("others, more", [(12_000, ""), (100, " Alta Berga" * 500)])
def test_words_are_learnt_from_every_pair_however_many_or_long(spark, others, more):
    rows = [("t", f"es{i}", ES, f"la hija mayor del herrero{more if i == 1 else ''} {i}") for i in range(3)] + [("t", "en", EN, "la hija mayor del herrero")]
    df = spark.range(others).selectExpr("'t' rec_table", "concat('o', id) rec_id", f"'{EN}' question", "concat('the smith ', id) text")
    df = df.union(spark.createDataFrame(rows, df.schema)).withColumn("reference", F.lit(None).cast("string"))
    assert [tuple(r) for r in pair_defects.find_defects(df).collect()] == [("t", "en", "other_language")]


def test_words_counted_by_many_tasks_are_those_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(pair_defects, "FLUSH_WORDS", 3)
    pairs = [(EN, f"the eldest daughter of smith {i % 9}") for i in range(40)] + [(ES, f"la hija mayor, don't {i}") for i in range(5)] + [(ES, "daughter"), (None, "daughter"), (EN, None), (EN, "x " * 5000), ("", "")]
    df = spark.createDataFrame(pairs, "question string, text string").repartition(7)
    learnt = {r.w: r.lang for r in pair_defects.learnt_words(df).collect()}
    assert learnt == pair_defects.learn_words(list(dict.fromkeys(pairs))) and learnt["hija"] == "es" and learnt["eldest"] == "en"
    assert pair_defects.learnt_words(df.limit(0)).count() == 0


def test_stubs_are_beginnings_of_known_words_only(spark):
    q = "the harbour was harsh and the harbour was old"
    rows = [("t", str(i), q, x) for i, x in enumerate(["it was old", "it was har", "it was harbour", "it was zzz", "Har", None, "", "old **har** "])]
    df = spark.createDataFrame(rows, "rec_table string, rec_id string, question string, text string")
    assert [r[0] for r in pair_defects.stubs(df).collect()] == ["har"]


def test_defects_over_tables(spark):
    rows = [("t", "1", Q, "Berga Abb", "Berga Abbey is old. Alta Castle too."), ("t", "2", Q, "Berga Abbey", "Berga Abbey is old."), ("t", "2", Q, "Berga Abbey", None), ("t", "3", None, "x" * 200_000 + ".", None), ("t", "4", None, None, None), ("t", None, Q, None, None), (None, "5", "", "", None), ("t", "6", Q, "no", "nothing noble"), ("t", "7", Q, "Corin Dal", "(b \\E [Corin Dalum")]
    df = spark.createDataFrame(rows, "rec_table string, rec_id string, question string, text string, reference string").withColumns({"ref": F.lit(1), "tok": F.lit(2), "cut": F.lit(3)})
    got = {(x.rec_id, x.defect) for x in pair_defects.find_defects(df).collect()}
    assert got == {("1", "truncated"), ("4", "empty"), ("5", "empty"), ("7", "truncated")}
    assert pair_defects.find_defects(df.limit(0)).count() == 0


def test_suffix_automaton_covers_what_is_copied():
    a = pair_defects.SuffixAutomaton("the quick brown fox")
    assert a.covered("quick brown", 4) == 11 and a.covered("zzz quick zzz", 5) == 7 and a.covered("", 3) == 0
    for i in range(19):
        for j in range(i + 1, 20):
            s = "the quick brown fox"[i:j]
            assert a.covered(s, 1) == len(s)


NAMES = [(1, "Nèva Railway"), (2, "Coreth Township"), (3, "Καθαξε"), (4, "O'Rumund Fjord"), (5, "Halis Castle"), (6, "Тивоза Ставож")]


@pytest.mark.parametrize("text, want", [
    ("Ｃｏｒｅｔｈ　Ｔｏｗｎｓｈｉｐ", 2), (unicodedata.normalize("NFD", "Nèva Railway"), 1), ("​Coreth Town­ship﻿", 2), ("Сorеth Tоwnshiр", 2), ("O’Rumund ﬁord", None), ("O’Rumund Fjord", 4), ("Ηalⅰs Caﬆle", 5),
    ("coreth township", None), ("Neva Railway", None), ("Néva Railway", None), ("The Coreth Township", None), ("Coreth Townshp", None), ("", None), ("Κаθαξε", 3),
])
def test_what_looks_the_same(text, want):
    assert lookalike.NameTrie(NAMES).match(text) == want


def test_many_names_are_joined_by_their_looks(spark, monkeypatch):
    rows = [("e1", "Сoreth Township", [("Coreth Township",), (None,), ("Ｈａｌｉｓ Castle",)], None), ("e2", None, None, [("Nèva Railway",)]), ("e3", "", [("Néva Railway",)], [])]
    ex = spark.createDataFrame(rows, "example_id string, answer string, context array<struct<title:string>>, supporting_facts array<struct<title:string>>")
    en = spark.createDataFrame([*NAMES, (7, None)], "entity_id int, name string")
    few = [sorted(map(tuple, f(ex, en).collect()), key=str) for f in (lookalike.looking_like, lookalike.canonical_values)]
    monkeypatch.setattr(lookalike, "MAX_NAMES", 2)
    assert few == [sorted(map(tuple, f(ex, en).collect()), key=str) for f in (lookalike.looking_like, lookalike.canonical_values)] and len(few[0]) == 2


def test_looks_of_other_scripts_and_ligatures():
    t = lookalike.NameTrie([*NAMES, (9, "AB HAT")])
    assert t.match("ᎪᏴ ⲎⲀꓔ") == 9 and t.match("O'Rumund Fj\u200dord") == 4 and t.match("𝐇alis Castle") == 5


def test_weighted_edits_within_a_limit():
    t = lookalike.NameTrie(NAMES)
    assert t.match("Coreth Townshp", 1) == 2 and t.match("Сoreth Townsship", 1) == 2 and t.match("Coreth", 1) is None


def test_values_of_tables(spark):
    rows = [("e1", "Сoreth Township", [("Coreth Township", ["s"]), (None, None), ("Ｈａｌｉｓ Castle", [])], None), ("e1", "Сoreth Township", [("Coreth Township", ["s"]), (None, None), ("Ｈａｌｉｓ Castle", [])], None), ("e2", None, None, [("Nèva Railway", 1)]), (None, "", [], [])]
    ex = spark.createDataFrame(rows, "example_id string, answer string, context array<struct<title:string,sentences:array<string>>>, supporting_facts array<struct<title:string,sent_id:int>>").withColumns({"value": F.lit(1), "entity_id": F.lit(2)})
    en = spark.createDataFrame([*NAMES, (7, None)], "entity_id int, name string").withColumn("kind", F.lit("x"))
    got = sorted(tuple(x) for x in lookalike.looking_like(ex, en).collect())
    assert got == [("e1", "answer", 0, 2), ("e1", "context_title", 2, 5), ("e2", "supporting_fact", 0, 1)]
    canon = {(x.example_id, x.field, x.pos): (x.canonical, x.entity_id) for x in lookalike.canonical_values(ex, en).collect()}
    assert canon["e1", "answer", 0] == ("Coreth Township", 2) and canon["e1", "context_title", 0] == ("Coreth Township", 2) and canon[None, "answer", 0] == ("", None)
    assert lookalike.looking_like(ex.limit(0), en).count() == 0 and lookalike.looking_like(ex, en.limit(0)).count() == 0


def test_plain_form():
    assert lookalike.plain("Ｆｕｌｌ  wіdth​") == "Full width" and lookalike.plain("Тивоза") == "Тивоза"


def test_ascii_value_gets_the_name_in_other_letters(spark):
    ex = spark.createDataFrame([("e1", "Novovo", None, None), ("e2", "Nowhere", None, None)], "example_id string, answer string, context array<struct<title:string>>, supporting_facts array<struct<title:string>>")
    en = spark.createDataFrame([(5, "Νονονο")], "entity_id int, name string")
    got = {r.example_id: (r.canonical, r.entity_id) for r in lookalike.canonical_values(ex, en).collect()}
    assert got == {"e1": ("Νονονο", 5), "e2": ("Nowhere", None)}
    assert [tuple(r) for r in lookalike.looking_like(ex, en).collect()] == [("e1", "answer", 0, 5)]

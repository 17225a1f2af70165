"""One consistent form for text that looks the same: weighted edit automaton over a trie of known names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entities whose names are sent to the tasks as a trie; a larger vocabulary is joined by the names' looks instead.
MAX_NAMES = 200_000

# Letters of other scripts that look like Latin ones, each list aligned with the next.
_CYRILLIC, _CYRILLIC_AS = "аеорсухіјѕһԁԛԝѵүгАВЕКМНОРСТУХЅІЈҮѴԚԜԌ", "aeopcyxijshdqwvyrABEKMHOPCTYXSIJYVQWG"
_GREEK, _GREEK_AS = "αγικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ayikvopuxABEZHIKMNOPTYX"
_ARMENIAN, _ARMENIAN_AS = "օսհոցզ", "ouhngq"
_LATIN, _LATIN_AS = "ɑɡıʋᴏᴄᴠᴡᴢꜱ", "agivocvwzs"
_CHEROKEE, _CHEROKEE_AS = "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"
_COPTIC, _COPTIC_AS = "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲥⲣ", "ABEHIKMNOPCTYXocp"
_LISU, _LISU_AS = "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"
_MARKS, _MARKS_AS = "‐‑﹣−’ʼ‘′ʹ＇", "----" + "'" * 6

LOOKS = {x: y for a, b in ((_CYRILLIC, _CYRILLIC_AS), (_GREEK, _GREEK_AS), (_ARMENIAN, _ARMENIAN_AS), (_LATIN, _LATIN_AS), (_CHEROKEE, _CHEROKEE_AS), (_COPTIC, _COPTIC_AS), (_LISU, _LISU_AS), (_MARKS, _MARKS_AS)) for x, y in zip(a, b, strict=True)}
# Default-ignorable characters (soft hyphen, joiners, zero-width and bidirectional marks, selectors, tags).
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")


def shape(text: str) -> str:
    """What a text looks like: compatibility forms decomposed, ignorables dropped, look-alikes replaced by one letter."""
    d = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
    return "".join(LOOKS.get(c, c) for c in d)


#: The characters that look like each character of LOOKS, by the letter that they stand for.
_ALIKE: dict[str, tuple[str, ...]] = {}
for _c, _as in LOOKS.items():
    _ALIKE[_as] = (*_ALIKE.get(_as, (_as,)), _c)


@lru_cache(65_536)
def _readings(c: str) -> tuple[str, ...]:
    """The characters that a text's character reads as, one after the other: its compatibility form, nothing if it is invisible."""
    return () if _INVISIBLE.match(c) else tuple(unicodedata.normalize("NFKD", c))


@lru_cache(65_536)
def _labels(c: str) -> tuple[str, ...]:
    """The labels of the edges that a character may follow at no cost: itself and what looks like it."""
    return _ALIKE.get(LOOKS.get(c, c), (c,))


class NameTrie:
    """Trie over the characters of the names; match() runs a weighted edit automaton along it.

    Edges carry the names' own (decomposed) characters. A character of the text follows every edge
    whose label looks like it at no cost; width and compatibility forms read as what they stand
    for, invisible characters of the text cost nothing and those of a name are free edges; any
    other inserted, dropped or replaced character costs one. With limit 0 only texts that look the
    same match. Among equal costs the smallest entity id wins.
    """

    def __init__(self, names: list[tuple[int, str]]) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.entity: list[int | None] = [None]
        for i, name in sorted(names):
            at = 0
            for c in unicodedata.normalize("NFKD", name):
                if _INVISIBLE.match(c):
                    continue
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    self.entity.append(None)
                at = nxt
            if self.entity[at] is None:
                self.entity[at] = i

    def _closure(self, states: dict[int, int], limit: int) -> dict[int, int]:
        todo = list(states)
        while todo:
            s = todo.pop()
            cost = states[s] + 1
            if cost <= limit:
                for t in self.edges[s].values():
                    if cost < states.get(t, limit + 1):
                        states[t] = cost
                        todo.append(t)
        return states

    def match(self, text: str, limit: int = 0) -> int | None:
        """Entity whose name the text looks like, or None."""
        states = self._closure({0: 0}, limit)
        edges = self.edges
        for c in _ordered(text):
            new: dict[int, int] = {}
            labels = _labels(c)
            for s, cost in states.items():
                own = edges[s]
                for x in labels:
                    t = own.get(x)
                    if t is not None and cost < new.get(t, limit + 1):
                        new[t] = cost
                if cost < limit:
                    for t in (s, *own.values()):
                        if cost + 1 < new.get(t, limit + 1):
                            new[t] = cost + 1
            if not new:
                return None
            states = self._closure(new, limit) if limit else new
        ends = [(cost, self.entity[s]) for s, cost in states.items() if self.entity[s] is not None]
        return min(ends)[1] if ends else None


def _ordered(text: str) -> str:
    """The characters a text reads as, combining marks in their canonical order."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKD", "".join(r for c in text for r in _readings(c)))


def plain(text: str) -> str:
    """The consistent form of a text that is no known name: compatibility forms composed, ignorables dropped,
    spaces single, and in each word that mixes scripts the look-alikes turned into the script of most letters."""
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    words = []
    for w in t.split():
        scripts = {s: sum(1 for c in w if c.isalpha() and _script(c) == s) for s in ("LATIN", "CYRILLIC", "GREEK")}
        foreign = sum(1 for c in w if c in LOOKS)
        if foreign and (scripts["LATIN"] or foreign == sum(c.isalpha() for c in w) and not scripts["CYRILLIC"] and not scripts["GREEK"]):
            other = sum(1 for c in w if c.isalpha() and _script(c) != "LATIN" and c not in LOOKS)
            if not other:
                w = "".join(LOOKS.get(c, c) for c in w)
        words.append("".join("'" if c in "’ʼ‘′ʹ" else "-" if c in "‐‑" else c for c in w))
    return " ".join(words)


@lru_cache(8192)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def _names(entities: DataFrame) -> list[tuple[int, str]] | None:
    """The names, or None if there are more than MAX_NAMES."""
    rows = entities.select("entity_id", "name").where("entity_id is not null and name is not null").limit(MAX_NAMES + 1).collect()
    return [(r[0], r[1]) for r in rows] if len(rows) <= MAX_NAMES else None


def with_shape(df: DataFrame, column: str) -> DataFrame:
    """df (of plain columns) with the column __shape: what the text in `column` looks like."""
    names, kinds = df.columns, dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else shape(t) for t in b.column(names.index(column)).to_pylist()], pa.string())], names=[*names, "__shape"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", __shape string")


def _by_shape(odd: DataFrame, entities: DataFrame) -> DataFrame:
    """odd with entity_id of the name that its value looks like (null if none), by a join on shapes: for any number of names."""
    shapes = with_shape(entities.where("entity_id is not null and name is not null").select("entity_id", "name"), "name").groupBy("__shape").agg(F.min("entity_id").cast("int").alias("entity_id"))
    return with_shape(odd, "value").join(shapes, "__shape", "left").drop("__shape")


def values(examples: DataFrame) -> DataFrame:
    """(example_id, field, pos, value) of the answers, context titles and supporting-fact titles; nulls are left out."""
    lists = F.concat(
        F.array(F.struct(F.lit("answer").alias("field"), F.lit(0).alias("pos"), F.col("answer").alias("value"))),
        F.coalesce(F.expr("transform(context, (x, i) -> struct('context_title' as field, i as pos, x.title as value))"), F.expr("cast(array() as array<struct<field:string,pos:int,value:string>>)")),
        F.coalesce(F.expr("transform(supporting_facts, (x, i) -> struct('supporting_fact' as field, i as pos, x.title as value))"), F.expr("cast(array() as array<struct<field:string,pos:int,value:string>>)")),
    )
    return examples.select("example_id", F.explode(lists).alias("v")).select("example_id", "v.field", "v.pos", "v.value").where("value is not null")


def looking_like(examples: DataFrame, entities: DataFrame, limit: int = 0) -> DataFrame:
    """(example_id, field, pos, entity_id) of values that are no entity's exact name but look like that of entity_id.

    Letter case, missing or other accents and other spelling are differences (limit 0). Null and
    empty values match nothing. Exact names leave in a join, so only the few odd values reach
    Python. Up to MAX_NAMES names go to the workers as a broadcast variable; beyond that, values
    and names meet in a join on what they look like (limit 0 only). Each row once.
    """
    names = _names(entities)
    exact = entities.select(F.col("name").alias("value")).where("value is not null").distinct()
    odd = values(examples).join(exact if names is None else F.broadcast(exact), "value", "left_anti").select("example_id", "field", "pos", "value")
    if names is None:
        if limit:
            raise ValueError(f"edits can only be matched against up to {MAX_NAMES} names")
        return _by_shape(odd, entities).where("entity_id is not null and value <> ''").select("example_id", "field", "pos", "entity_id").distinct()
    sent = examples.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = NameTrie(sent.value)
        known: dict[str, int | None] = {}
        for b in batches:
            ids = []
            for v in b.column(3).to_pylist():
                if v not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[v] = trie.match(v, limit)
                ids.append(known[v])
            a = pa.array(ids, pa.int32())
            keep = a.is_valid()
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), b.column(2).filter(keep), a.filter(keep)], names=["example_id", "field", "pos", "entity_id"])

    return odd.mapInArrow(run, "example_id string, field string, pos int, entity_id int").distinct()


def canonical_values(examples: DataFrame, entities: DataFrame) -> DataFrame:
    """(example_id, field, pos, value, canonical, entity_id): every value in its consistent form.

    The canonical form is the name of the entity that the value is or looks like; other values are
    normalized by table (see plain). Exact names and plain ASCII without odd spacing stay in the JVM,
    but for ASCII that a name in other letters looks like. Beyond MAX_NAMES names, values and names
    meet in joins instead.
    """
    names = _names(entities)
    schema = "example_id string, field string, pos int, value string, canonical string, entity_id int"
    one = entities.where("name is not null").groupBy(F.col("name").alias("value")).agg(F.min("entity_id").cast("int").alias("entity_id"))
    if names is None:
        v = values(examples).distinct().join(one.withColumnRenamed("entity_id", "own"), "value", "left")
        v = _by_shape(v.select("example_id", "field", "pos", "value", "own"), entities).withColumn("entity_id", F.coalesce("own", F.when(F.col("value") != "", F.col("entity_id"))))
        v = v.join(one.select(F.col("value").alias("name"), "entity_id").groupBy("entity_id").agg(F.min("name").alias("name")), "entity_id", "left")

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                form = [n if n is not None else plain(t) for t, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(form, pa.string()), b.column(5)], names=["example_id", "field", "pos", "value", "canonical", "entity_id"])

        return v.select("example_id", "field", "pos", "value", F.when(F.col("own").isNotNull(), F.col("value")).otherwise(F.col("name")).alias("name"), "entity_id").mapInArrow(finish, schema)
    sent = examples.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, spelled = NameTrie(sent.value), dict(sent.value)
        known: dict[str, tuple[str, int | None]] = {}
        for b in batches:
            out = []
            for v in b.column(3).to_pylist():
                if v not in known:
                    if len(known) > 200_000:
                        known.clear()
                    i = trie.match(v)
                    known[v] = (plain(v), None) if i is None else (spelled[i], i)
                out.append(known[v])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())], names=["example_id", "field", "pos", "value", "canonical", "entity_id"])

    twins = sorted({x for _, n in names if not n.isascii() and (x := shape(n)).isascii()})
    twins = examples.sparkSession.createDataFrame([(x, True) for x in twins], "value string, twin boolean")
    v = values(examples).distinct().join(F.broadcast(one), "value", "left").join(F.broadcast(twins), "value", "left")
    simple = F.col("entity_id").isNotNull() | F.col("twin").isNull() & F.col("value").rlike(r"^[!-~]+( [!-~]+)*$")
    easy = v.where(simple).select("example_id", "field", "pos", "value", F.col("value").alias("canonical"), "entity_id")
    hard = v.where(~simple).select("example_id", "field", "pos", "value").mapInArrow(run, schema)
    return easy.unionByName(hard)

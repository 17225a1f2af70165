"""Readers, adapters and writers of question-answer records."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTEXT = "array<struct<title:string,sentences:array<string>>>"
FACTS = "array<struct<title:string,sent_id:int>>"
EXAMPLE = f"id string, question string, answer string, type string, level string, context {CONTEXT}, supporting_facts {FACTS}"
RAW = "id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>"


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines with an explicit schema (a malformed line is an error) and the line's ordinal; limit takes the first lines."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("ordinal", F.monotonically_increasing_id())
    return df if limit is None else df.orderBy("ordinal").limit(limit)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, text as it is."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with a header, all columns strings; None if there is nothing at the path."""
    return spark.read.option("header", "true").csv(path) if Path(path).exists() else None


def write_csv(df: DataFrame, path: str) -> bool:
    """One CSV folder with a header; without rows nothing is written and False is returned."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", "true").csv(path)
    return True


def examples(raw: DataFrame) -> DataFrame:
    """Processed records (id, ..., type) under the names of the examples table."""
    return raw.withColumnsRenamed({"id": "example_id", "type": "qtype"})


def normalize_columnar(raw: DataFrame) -> DataFrame:
    """Records with columnar context and facts as arrays of structs; sentences lose outer white space, blank ones are dropped, sentence numbers stay as they are."""
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|(?<!\s)\s+$", "")
    ctx = F.transform(F.arrays_zip("context.title", "context.sentences"), lambda p: F.struct(p["title"].alias("title"), F.filter(F.transform(p["sentences"], strip), lambda s: s != "").alias("sentences")))
    facts = F.transform(F.arrays_zip("supporting_facts.title", "supporting_facts.sent_id"), lambda f: F.struct(f["title"].alias("title"), f["sent_id"].alias("sent_id")))
    return raw.withColumn("context", ctx.cast(CONTEXT)).withColumn("supporting_facts", facts.cast(FACTS))


def normalize_pairs(text: DataFrame, column: str = "value") -> DataFrame:
    """Records of the second layout from JSON text: context and facts as pairs or as parallel lists, ids under _id or id; blank sentences are kept.

    Unreadable records give null columns; see problems().
    """
    j = F.col(column)
    pairs_c = F.from_json(F.get_json_object(j, "$.context"), "array<array<string>>")
    cols_c = F.from_json(F.get_json_object(j, "$.context"), "struct<title:array<string>,sentences:array<array<string>>,content:array<array<string>>>")
    from_pairs = F.transform(pairs_c, lambda p: F.struct(p[0].alias("title"), F.from_json(p[1], "array<string>").alias("sentences")))
    from_cols = F.transform(F.arrays_zip(cols_c["title"], F.coalesce(cols_c["sentences"], cols_c["content"])), lambda p: F.struct(p["title"].alias("title"), p["1"].alias("sentences")))
    pairs_f = F.from_json(F.get_json_object(j, "$.supporting_facts"), "array<array<string>>")
    cols_f = F.from_json(F.get_json_object(j, "$.supporting_facts"), "struct<title:array<string>,sent_id:array<int>,sentence_id:array<int>>")
    facts_p = F.transform(pairs_f, lambda p: F.struct(p[0].alias("title"), p[1].cast("int").alias("sent_id")))
    facts_c = F.transform(F.arrays_zip(cols_f["title"], F.coalesce(cols_f["sent_id"], cols_f["sentence_id"])), lambda p: F.struct(p["title"].alias("title"), p["1"].alias("sent_id")))
    get = lambda k: F.get_json_object(j, f"$.{k}")
    return text.select(F.coalesce(get("_id"), get("id")).alias("example_id"), get("question").alias("question"), get("answer").alias("answer"), get("type").alias("qtype"), get("level").alias("level"), F.coalesce(from_pairs, from_cols).cast(CONTEXT).alias("context"), F.coalesce(facts_p, facts_c).cast(FACTS).alias("supporting_facts"))


def strict(df: DataFrame) -> DataFrame:
    """Adapted records with outer white space removed; a record that breaks a rule is an error when it runs.

    Rules: id, question and answer aren't blank; there are paragraphs, with different titles that
    aren't blank and sentences that aren't null; there are facts, each once, each naming a title of
    the context and one of its sentences.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")
    df = df.withColumns({
        **{c: strip(F.col(c)) for c in ("example_id", "question", "answer")},
        "context": F.transform("context", lambda p: F.struct(strip(p["title"]).alias("title"), F.transform(p["sentences"], strip).alias("sentences"))),
        "supporting_facts": F.transform("supporting_facts", lambda f: F.struct(strip(f["title"]).alias("title"), f["sent_id"].alias("sent_id"))),
        "qtype": F.coalesce("qtype", F.lit("unknown")), "level": F.coalesce("level", F.lit("unknown")),
    })
    unnamed = F.exists("context", lambda p: p["title"].isNull() | (p["title"] == "") | p["sentences"].isNull() | F.exists(p["sentences"], lambda s: s.isNull()))
    titles = F.transform("context", lambda p: p["title"])
    known = lambda f: F.exists("context", lambda p: (p["title"] == f["title"]) & (f["sent_id"] >= 0) & (f["sent_id"] < F.size(p["sentences"])))
    rules = {
        "id, question and answer must not be blank": F.greatest(*[(F.coalesce(c, F.lit("")) == "") for c in ("example_id", "question", "answer")]),
        "paragraphs are needed": F.coalesce(F.size("context"), F.lit(0)) <= 0,
        "titles must not be blank nor sentences null": unnamed, "titles must be different": F.size(F.array_distinct(titles)) < F.size(titles),
        "supporting facts are needed": F.coalesce(F.size("supporting_facts"), F.lit(0)) <= 0,
        "facts must name a sentence of the context": F.exists("supporting_facts", lambda f: ~F.coalesce(known(f), F.lit(False))), "facts must be different": F.size(F.array_distinct("supporting_facts")) < F.size("supporting_facts"),
    }
    broken = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for m, c in rules.items()])
    ok = F.when(broken.isNotNull(), F.raise_error(F.concat(F.coalesce("example_id", F.lit("null")), F.lit(": "), broken))).otherwise(F.col("example_id"))
    return df.withColumn("example_id", ok)


def problems(df: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, problem) of records that break a rule: blank question or answer, no context, repeated titles, facts of no title, sentence out of range, repeated facts."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    titles = F.expr("transform(context, p -> p.title)")
    facts = F.coalesce(F.col("supporting_facts"), F.expr(f"cast(array() as {FACTS})"))
    unknown = F.exists(facts, lambda f: f["title"].isNotNull() & ~F.coalesce(F.array_contains(titles, f["title"]), F.lit(False)))
    beyond = F.exists(facts, lambda f: F.exists("context", lambda p: (p["title"] == f["title"]) & ((f["sent_id"] < 0) | (f["sent_id"] >= F.size(p["sentences"])))))
    rules = {
        "blank question": blank("question"), "blank answer": blank("answer"), "no context": F.coalesce(F.size("context"), F.lit(0)) <= 0, "repeated title": F.size(F.array_distinct(titles)) < F.size(titles),
        "fact of no title": unknown, "sentence out of range": beyond, "repeated fact": F.size(F.array_distinct(facts)) < F.size(facts),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(key, F.explode(found).alias("problem"))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "example_id") -> DataFrame:
    """The records of ids (ordinal, key), in their order; a repeated, null or missing id is an error when it runs."""
    n = F.count("*").over(Window.partitionBy(key))
    want = ids.withColumn("__n", n).join(df.withColumn("__found", F.lit(True)), key, "left")
    ok = F.when(F.col("__found").isNull() | (F.col("__n") > 1), F.raise_error(F.concat(F.lit("missing or repeated id "), F.coalesce(F.col(key), F.lit("null"))))).otherwise(F.col(key))
    return want.withColumn(key, ok).orderBy("ordinal").drop("__n", "__found")


def write_cache(df: DataFrame, path: str, key: str, protocol: list[str]) -> None:
    """Parquet sorted by key; an empty table, repeated keys or more than one protocol are refused."""
    a = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"), F.countDistinct(F.to_json(F.struct(*protocol))).alias("p")).first()
    if not a["n"] or a["n"] != a["k"] or a["p"] != 1:
        raise ValueError(f"a cache needs rows ({a['n']}), different keys ({a['k']}) and one protocol ({a['p']})")
    df.sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def read_cache(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """A cache whose rows all have the expected protocol values; others are refused."""
    df = spark.read.parquet(path)
    rule = " and ".join(f"`{k}` <=> {json.dumps(v)}" for k, v in expected.items()) or "true"
    bad = df.where(f"not ({rule})").limit(1).count()
    if bad:
        raise ValueError("the cache is of another protocol")
    return df


def split_ids(path: str) -> list[str]:
    """The ids of a JSON list, or of a split manifest whose hash fits."""
    from tessera.operators.provenance import canonical_sha256

    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    ids = doc["ids"] if isinstance(doc, dict) else doc
    if not all(isinstance(i, str) for i in ids) or len(set(ids)) != len(ids):
        raise ValueError("ids must be different strings")
    if isinstance(doc, dict) and canonical_sha256(ids) != doc.get("split_sha256"):
        raise ValueError("the split's hash doesn't fit its ids")
    return ids


def split_manifest(ids: list[str], role: str, seed: int, stratify_by: list[str] | None = None) -> dict:
    """Manifest of a split: role, seed, count, ids and their ordered hash."""
    from tessera.operators.provenance import canonical_sha256

    return {"role": role, "seed": seed, "count": len(ids), "split_sha256": canonical_sha256(ids), "ids": ids, **({"stratify_by": stratify_by} if stratify_by else {})}

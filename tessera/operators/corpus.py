"""Deduplicated paragraph corpus, gold paragraphs and corpus manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import paragraph_id
from tessera.functions.text import paragraph_text


def paragraph_corpus(examples: DataFrame) -> DataFrame:
    """(corpus_id, title, text, sentences, source_example_ids) of all context paragraphs, equal titles and texts as one.

    Of several sentence lists with one text the smallest is kept; example ids are distinct and sorted.
    Null titles count as empty. Partial minima and sets combine before the shuffle.
    """
    p = examples.select("example_id", F.explode("context").alias("p"))
    p = p.select("example_id", F.coalesce("p.title", F.lit("")).alias("title"), paragraph_text(F.col("p.sentences")).alias("text"), F.col("p.sentences").alias("sentences"))
    g = p.groupBy("title", "text").agg(F.min("sentences").alias("sentences"), F.sort_array(F.collect_set("example_id")).alias("source_example_ids"))
    return g.select(paragraph_id(F.col("title"), F.col("text")).alias("corpus_id"), "title", "text", "sentences", "source_example_ids")


def gold_paragraphs(examples: DataFrame, key: str) -> DataFrame:
    """(key, title, n_matches) of the titles that the supporting facts name: n_matches context paragraphs have it; 0 is missing, 2 or more ambiguous."""
    facts = examples.select(key, F.explode("supporting_facts").alias("f")).select(key, F.col("f.title").alias("title")).where("title is not null").distinct()
    ctx = examples.select(key, F.explode("context").alias("p")).select(key, F.col("p.title").alias("title")).where("title is not null").groupBy(key, "title").agg(F.count("*").alias("n"))
    return facts.join(ctx, [key, "title"], "left").select(key, "title", F.coalesce("n", F.lit(0)).alias("n_matches"))


def manifest(corpus: DataFrame) -> DataFrame:
    """One row: paragraphs, distinct titles, and an order-free digest of the corpus ids."""
    digest = F.sum(F.conv(F.substring(F.sha2("corpus_id", 256), 1, 12), 16, 10).cast("decimal(38,0)"))
    return corpus.agg(F.count("*").alias("paragraph_count"), F.countDistinct("title").alias("title_count"), digest.cast("string").alias("digest"))


def fact_paragraphs(facts: DataFrame, identities: DataFrame, key: str) -> DataFrame:
    """(key, paragraph_ids) of each record's supporting facts (key, title, sent_id), sorted and distinct, by identities (title, sent_id, paragraph_id). A fact without a paragraph is an error when it runs."""
    got = facts.join(identities, ["title", "sent_id"], "left")
    found = F.when(F.col("paragraph_id").isNull(), F.raise_error(F.concat(F.lit("no paragraph for the fact "), F.coalesce("title", F.lit("null"))))).otherwise(F.col("paragraph_id"))
    return got.groupBy(key).agg(F.sort_array(F.collect_set(found)).alias("paragraph_ids"))

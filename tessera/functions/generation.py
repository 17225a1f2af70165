"""Prompts and the offline answer generator as column functions; other generators plug in as batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip_answer_labels

# What stands for missing evidence and for an answer that isn't given.
NO_EVIDENCE, ABSTAIN = "No evidence provided.", "insufficient evidence"
SYSTEM = "Answer the question from the evidence only. Reply with the shortest answer, or with 'insufficient evidence'."


def _strip(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|(?<!\s)\s+$", "")


def prompt(question: Column, evidence: Column, instruction: str = "") -> Column:
    """The user part of the prompt: evidence, question, and the instruction if there is one, without outer white space."""
    e = _strip(evidence)
    given = F.when(e == "", F.lit(NO_EVIDENCE)).otherwise(e)
    parts = [F.concat(F.lit("Evidence:\n"), given), F.concat(F.lit("Question: "), _strip(question))]
    return F.concat_ws("\n\n", *parts, *([F.lit(instruction.strip())] if instruction.strip() else []))


def messages(question: Column, evidence: Column, system: str = SYSTEM, instruction: str = "") -> Column:
    """The prompt as a list of structs (role, content); a blank system text is left out."""
    said = [("system", F.lit(system.strip()))] if system.strip() else []
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in [*said, ("user", prompt(question, evidence, instruction))]])


def completion(question: Column, evidence: Column, system: str = SYSTEM, instruction: str = "") -> Column:
    """The messages as one text for models without a chat form: each under its role, and the assistant's turn open."""
    parts = F.transform(messages(question, evidence, system, instruction), lambda m: F.concat(F.initcap(m["role"]), F.lit(":\n"), m["content"]))
    return F.concat_ws("\n\n", parts, F.lit("Assistant:"))


def echo(evidence: Column) -> Column:
    """The first line of the evidence, or the abstaining answer without evidence."""
    t = F.regexp_replace(F.coalesce(evidence, F.lit("")), r"(?U)^\s+|(?<!\s)\s+$", "")
    return F.when(t == "", F.lit(ABSTAIN)).otherwise(F.regexp_replace(F.element_at(F.split(t, "\n"), 1), r"(?U)^\s+|(?<!\s)\s+$", ""))


def generate(df: DataFrame, key: str, question: str, evidence: str, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16) -> DataFrame:
    """(key, answer, latency_ms): answers of a generator that make() builds once a task; a batch's time is shared by its rows."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        answer = make()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                t = time.perf_counter()
                out = answer(part["prompt"].tolist())
                yield pd.DataFrame({key: part[key].values, "answer": out, "latency_ms": (time.perf_counter() - t) * 1000 / len(part)})

    rows = df.select(key, prompt(F.col(question), F.col(evidence)).alias("prompt")).mapInPandas(run, f"`{key}` {kind}, answer string, latency_ms double")
    return rows.withColumn("answer", strip_answer_labels(F.col("answer")))

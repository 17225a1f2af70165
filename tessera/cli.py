"""Command line: python -m tessera.cli COMMAND ... over a data folder."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from pathlib import Path

from tessera import config
from tessera.functions import generation, text
from tessera.operators import packing, provenance, retrieval, sampling
from tessera.plans import catalogue, statistics
from tessera.runtime import session
from tessera.sources import records


def _run(a: argparse.Namespace) -> None:
    provenance.require_empty(a.out)
    spark = session()
    for name in a.query or ["method_summary"]:
        catalogue.QUERIES[name](spark, a.data).write.parquet(f"{a.out}/{name}")


def _split(a: argparse.Namespace) -> None:
    spark = session()
    rows = catalogue.examples(spark, a.data).where(f"split = '{a.split}'").select("example_id", sampling.label_of(*a.by).alias("stratum"))
    ids = sorted(r[0] for r in sampling.stratified_sample(rows, "example_id", "stratum", a.size, a.seed).select("example_id").collect())  # a.size ids, the sample itself
    Path(a.out).write_text(json.dumps(records.split_manifest(ids, a.role, a.seed, a.by), indent=2), encoding="utf-8")


def _splits(a: argparse.Namespace) -> None:
    seen: dict[str, str] = {}
    for path in a.manifest:
        for i in records.split_ids(path):
            if i in seen:
                raise SystemExit(f"{i} is in {seen[i]} and in {path}")
            seen[i] = path
    print(f"{len(seen)} ids, no id in two splits")


def _preprocess(a: argparse.Namespace) -> None:
    spark = session()
    df = records.normalize_columnar(records.read_jsonl(spark, a.raw, records.RAW, a.limit)).drop("ordinal")
    records.write_jsonl(df, a.out)


def _freeze(a: argparse.Namespace) -> None:
    doc = provenance.freeze(json.loads(Path(a.config).read_text(encoding="utf-8")), {"split_sha256": provenance.canonical_sha256(records.split_ids(a.manifest))})
    Path(a.out).write_text(json.dumps(doc, indent=2), encoding="utf-8")


def _verify(a: argparse.Namespace) -> None:
    provenance.verify_frozen(json.loads(Path(a.frozen).read_text(encoding="utf-8")))
    print("the manifest is intact")


def _pack(a: argparse.Namespace) -> None:
    provenance.require_empty(a.out)
    s = config.load(a.config)
    e = catalogue.examples(session(), a.data)
    if s.split.manifest:
        e = e.where(e["example_id"].isin(records.split_ids(s.split.manifest)))
    else:
        e = e.where(e["split"] == s.split.name)
    ranked = retrieval.rank_context(e.select("eid", "question", "context"), s.retrieval.top_k, s.retrieval.k1, s.retrieval.b)
    p = packing.pack(packing.candidates(ranked), "eid", [s.packing], ["question"])
    evidence = text.render(p["selected"])
    p.select("eid", "config_id", "method", "budget", "used_tokens", evidence.alias("evidence"), generation.completion(p["question"], evidence, s.prompting.system, s.prompting.instruction).alias("prompt")).write.parquet(f"{a.out}/packed")
    (Path(a.out) / "settings.json").write_text(json.dumps(s.resolved(), indent=2), encoding="utf-8")


def _statistics(a: argparse.Namespace) -> None:
    doc = statistics.run(session(), json.loads(Path(a.plan).read_text(encoding="utf-8")), a.out, a.few_replicates)
    (Path(a.out) / "statistics_manifest.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")


def _environment(a: argparse.Namespace) -> None:
    import numpy
    import pyarrow
    import pyspark

    print(json.dumps({"python": sys.version.split()[0], "platform": platform.platform(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "numpy": numpy.__version__}, indent=2))


def main(argv: list[str] | None = None) -> None:
    """Parses and runs one command."""
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(required=True)

    def command(name: str, f, *args: tuple) -> None:
        c = sub.add_parser(name)
        for flag, kw in args:
            c.add_argument(flag, **kw)
        c.set_defaults(f=f)

    need = {"required": True}
    command("queries", lambda a: print("\n".join(catalogue.QUERIES)))
    command("run", _run, ("--data", need), ("--out", need), ("query", {"nargs": "*"}))
    command("create-split", _split, ("--data", need), ("--out", need), ("--split", {"default": "train"}), ("--size", {"type": int, "required": True}), ("--seed", {"type": int, "default": 42}), ("--role", {"default": "development"}), ("--by", {"nargs": "*", "default": ["qtype", "level"]}))
    command("validate-splits", _splits, ("manifest", {"nargs": "+"}))
    command("preprocess", _preprocess, ("--raw", need), ("--out", need), ("--limit", {"type": int}))
    command("freeze", _freeze, ("--config", need), ("--manifest", need), ("--out", need))
    command("verify-frozen", _verify, ("frozen", {}))
    command("pack", _pack, ("--config", need), ("--data", need), ("--out", need))
    command("statistics", _statistics, ("--plan", need), ("--out", need), ("--few-replicates", {"action": "store_true"}))
    command("check-environment", _environment)
    a = p.parse_args(argv)
    a.f(a)


if __name__ == "__main__":
    main()

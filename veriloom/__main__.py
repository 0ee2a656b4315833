"""python -m veriloom: verify, stats, recall, digest and orphans of a corpus; run a configuration."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .operators.corpus import Corpus
from .operators.scope import Query
from .plans import config
from .plans.export import to_json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veriloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("verify", "stats", "digest", "orphans", "prune", "runs"):
        s = sub.add_parser(name)
        s.add_argument("path")
        if name == "prune":
            s.add_argument("--apply", action="store_true")
    s = sub.add_parser("recall")
    s.add_argument("path")
    for facet in ("terms", "sources", "kinds", "methods"):
        s.add_argument(f"--{facet}", default="")
    s.add_argument("--limit", type=int)
    s = sub.add_parser("run")
    s.add_argument("config")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "run":
        record, _ = config.run_plan(config.plan_from_config(spark, config.load(a.config), time.time()))
        print(to_json(record.first()))
        return 0
    c = Corpus(spark, a.path)
    if a.command == "recall":
        split = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
        rows = c.recall_audited(Query(split(a.terms), split(a.sources), split(a.kinds), split(a.methods)), a.limit).drop("body").collect()
        print(to_json(rows))
        return int(any(r["status"] != "MATCH" for r in rows))
    if a.command == "verify":
        counts = {r["status"]: r["count"] for r in c.verify().groupBy("status").count().collect()}
        print(to_json(counts))
        return int(any(k != "MATCH" for k in counts))
    if a.command == "prune":
        print(to_json(c.prune(a.apply)))
        return 0
    found = {"stats": c.stats, "digest": c.digest, "orphans": c.orphans}[a.command]() if a.command != "runs" else c.runs
    print(to_json(found.collect()))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""A run's configuration to a plan: jobs, scope, store."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import items, runs
from ..operators.corpus import Corpus
from ..sources import edges, files, net, payloads

PAYLOADS = {"feed": payloads.feed, "arxiv": payloads.arxiv, "web": payloads.web}


@dataclass
class RunPlan:
    jobs: list[tuple[str, str, DataFrame]]
    scope: tuple[str, ...]
    store: Corpus | None
    prompt: str | None
    started_at: float


def source_rows(spark: SparkSession, name: str, target: str, options: dict, fetched_at: float) -> DataFrame:
    """Item rows with seq of one job.  docs reads folders; payload sources read text files, or fetch a target that is a URL
    (arxiv: with the option live; api: with auth_env, the variable that holds the credential); scholar always fetches.
    What could not be read is left out of the rows."""
    if name == "docs":
        return items.sequence(files.text_files(spark, target, fetched_at), "walk").drop("walk")
    placed = lambda rows: rows.withColumn("seq", F.col("pos").cast("bigint")).drop("pos", "url")
    target_row = spark.createDataFrame([(target, target)], "url string, target string")
    if name == "video":
        return placed(files.video_items(files.video_payloads(target_row, comments=bool(options.get("comments"))), fetched_at)[0])
    if name == "scholar":
        return items.sequence(edges.scholar_graph(target_row, fetched_at)[0], "id")
    if name == "arxiv" and options.get("live"):
        return placed(edges.arxiv_items(target_row, fetched_at)[0])
    if target.startswith(("http://", "https://")) and name in ("web", "feed"):
        return placed(edges.items_of(target_row, net.fetch, PAYLOADS[name], fetched_at)[0])
    if target.startswith(("http://", "https://")) and name == "api":
        return placed(edges.api_items(target_row, options.get("auth_env", ""), fetched_at, **options.get("keys", {}))[0])
    if name in ("pdf", "ocr", "transcribe", "browser"):
        targets = spark.createDataFrame([(target,)], "target string")
        return files.external_items(files.external_text(targets, name), name, fetched_at).withColumn("seq", F.lit(1).cast("bigint"))
    parse = PAYLOADS.get(name) or (payloads.api(**options.get("keys", {})) if name == "api" else None)
    if parse is None:
        raise ValueError(f"unknown source {name!r}")
    rows = spark.read.option("wholetext", True).text(target).select(F.lit(options.get("url", target)).alias("url"), F.col("value").alias("payload"))
    found, _ = payloads.parse_rows(rows, parse, fetched_at)
    return found.withColumnRenamed("pos", "seq").withColumn("seq", F.col("seq").cast("bigint")).drop("url")


def plan_from_config(spark: SparkSession, config: dict, started_at: float) -> RunPlan:
    """{"jobs": [{"source", "target", "options"?}], "scope"?: […], "store"?: path, "synthesize"?: {"prompt"}}"""
    if not isinstance(config.get("jobs"), list) or not config["jobs"]:
        raise ValueError("a run needs a list of jobs")
    jobs = []
    for j in config["jobs"]:
        if not isinstance(j, dict) or not j.get("source") or not j.get("target"):
            raise ValueError("a job needs a source and a target")
        jobs.append((j["source"], j["target"], source_rows(spark, j["source"], j["target"], j.get("options") or {}, started_at)))
    store = Corpus(spark, config["store"]) if config.get("store") else None
    prompt = (config.get("synthesize") or {}).get("prompt")
    return RunPlan(jobs, tuple(config.get("scope") or ()), store, prompt, started_at)


def run_plan(plan: RunPlan) -> tuple[DataFrame, DataFrame]:
    return runs.run(plan.jobs, started_at=plan.started_at, scope=plan.scope, prompt=plan.prompt, store=plan.store)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)

"""Crawls as waves of DataFrames over a page table or a fetch function, with a hash-chained ledger and resumable state."""

from __future__ import annotations

import tempfile
import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon, urls
from .html import links

PAGE = "url string, final_url string, status int, html string"
FRONT = "url string, depth int, discovered_from string, pos bigint"


def canonical(url: str) -> str:
    """The driver's form of functions.urls.canonicalize, for seeds."""
    from urllib.parse import urlsplit, urlunsplit

    p = urlsplit(url)
    scheme, host = (p.scheme or "http").lower(), (p.hostname or "").lower()
    port = "" if not p.port or (scheme, p.port) in (("http", 80), ("https", 443)) else f":{p.port}"
    return urlunsplit((scheme, host + port, p.path or "/", p.query, ""))


def robots_allowed(candidates: DataFrame, robots: DataFrame | None, agent: str) -> DataFrame:
    """Candidates that robots.txt lets `agent` fetch; robots: (scheme, host, text).  Hosts without one allow all."""
    if robots is None:
        return candidates
    rules = robots.select(F.col("scheme").alias("_s"), F.col("host").alias("_h"), F.col("text").alias("_robots"))
    both = candidates.join(rules, (urls.scheme(F.col("url")) == F.col("_s")) & (urls.host(F.col("url")) == F.col("_h")), "left").drop("_s", "_h")
    names = both.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, urllib.robotparser.RobotFileParser] = {}
        for batch in batches:
            allow = []
            for url, text in zip(batch.column(names.index("url")).to_pylist(), batch.column(names.index("_robots")).to_pylist()):
                if not text:
                    allow.append(True)
                    continue
                if text not in known:
                    known[text] = urllib.robotparser.RobotFileParser()
                    known[text].parse(text.splitlines())
                allow.append(known[text].can_fetch(agent, url))
            yield batch.filter(pa.array(allow))

    return both.mapInArrow(run, both.schema).drop("_robots")


def sitemap_urls(html: Column, hosts: list[str]) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1), urls.canonicalize)
    return F.filter(found, lambda u: urls.in_scope(u, hosts))


def fetch_table(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetcher over a table (url, html[, final_url, status]): URLs it lacks are not fetched."""
    have = set(pages.columns)
    full = pages.select("url", (F.col("final_url") if "final_url" in have else F.col("url")).alias("final_url"), (F.col("status").cast("int") if "status" in have else F.lit(200)).alias("status"), "html")
    return lambda wanted: wanted.join(full, "url")


@dataclass
class CrawlState:
    """What a later call goes on from: frontier and visited URLs, the ledger, and its last hash."""

    frontier: DataFrame
    visited: DataFrame
    ledger: DataFrame
    pages: int = 0
    root_hash: str = ""
    waves: list[int] = field(default_factory=list)


def core(at: float) -> Column:
    return canon.object_({
        "url": canon.string(F.col("url"), True), "final_url": canon.string(F.col("final_url"), True), "status": canon.integer(F.col("status")), "depth": canon.integer(F.col("depth")),
        "content_sha256": canon.string(F.col("content_sha256"), True), "discovered_from": canon.string(F.col("discovered_from"), True), "fetched_at": canon.floating(F.lit(float(at))),
    })


def crawl(fetch: Callable[[DataFrame], DataFrame], seeds: list[str], spark, *, max_depth: int = 2, max_pages: int = 50, hosts: list[str] | None = None, robots: DataFrame | None = None, agent: str = "veriloom", sitemaps: bool = False, fetched_at: float = 0.0, strategy: str = "bfs", resume: CrawlState | None = None) -> CrawlState:
    """Breadth-first waves (`bfs`): a depth's whole frontier is one join against the pages, one anti-join against the
    visited.  Depth-first (`dfs`) takes the URL found last, one at a time, as each page decides which is next: its waves
    are single pages.

    Frontier order is first-in first-out, so the ledger is that of a crawl that takes one URL at a time.  Pages that
    cannot be fetched are visited but not recorded; URLs that robots forbid are visited and not fetched; URLs deeper than
    max_depth stay unvisited.  A capped crawl keeps the rest of its frontier for resume.
    """
    if strategy not in ("bfs", "dfs"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if not spark.conf.get("spark.checkpoint.dir", ""):  # waves cut lineage there; a folder of this machine only where none is named
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veriloom-"))
    own = [canonical(s) for s in seeds]
    allowed = list(hosts or sorted({s.split("/")[2].partition(":")[0] for s in own}))
    if resume:
        state = resume
    else:
        first = [(u, 0, "", i) for i, u in enumerate(own)]
        front = spark.createDataFrame(first, FRONT)
        if sitemaps:
            asked = spark.createDataFrame([(f"{u.split('/')[0]}//{u.split('/')[2]}/sitemap.xml", i) for i, u in enumerate(own)], "url string, k int")
            found = fetch(asked).where("status = 200").select("k", F.posexplode(sitemap_urls(F.col("html"), allowed)).alias("p", "url"))
            front = front.unionByName(found.select("url", F.lit(0).alias("depth"), F.lit("sitemap").alias("discovered_from"), (F.lit(len(own)) + F.col("k") * 1_000_000 + F.col("p")).cast("bigint").alias("pos")))
        state = CrawlState(front, spark.createDataFrame([], "url string"), spark.createDataFrame([], "seq bigint, url string, final_url string, status int, depth int, content_sha256 string, discovered_from string, core string"))
    frontier, visited, ledger, pages = state.frontier, state.visited, state.ledger, state.pages
    while pages < max_pages:
        ready = frontier.where(F.col("depth") <= max_depth).join(visited, "url", "left_anti")
        turn = F.row_number().over(Window.partitionBy("url").orderBy("pos" if strategy == "bfs" else F.desc("pos")))
        ready = ready.withColumn("_t", turn).where("_t = 1").drop("_t")
        low = ready.agg(F.min("depth")).first()[0]
        if low is None:
            frontier = frontier.limit(0)
            break
        wave = (ready.where(F.col("depth") == low) if strategy == "bfs" else ready.orderBy(F.desc("pos")).limit(1)).checkpoint()
        got = fetch(robots_allowed(wave, robots, agent)).checkpoint()
        taken = got.orderBy("pos").limit(max_pages - pages).checkpoint()
        n = taken.count()
        last = taken.agg(F.max("pos")).first()[0]
        done = wave if n < max_pages - pages else wave.where(F.col("pos") <= F.lit(last))
        rows = taken.withColumn("content_sha256", canon.sha256(F.col("html")))
        numbered = rows.withColumn("seq", (F.row_number().over(Window.orderBy("pos")) + pages).cast("bigint"))  # at most max_pages rows
        ledger = ledger.unionByName(numbered.select("seq", "url", "final_url", "status", "depth", "content_sha256", "discovered_from", core(fetched_at).alias("core"))).checkpoint()
        visited = visited.unionByName(done.select("url")).checkpoint()
        out = links(numbered.where(F.col("depth") < max_depth), "final_url")
        from .html import scoped_links

        next_links = out.select(F.col("url").alias("discovered_from"), (F.col("depth") + 1).alias("depth"), "seq", F.posexplode(scoped_links(F.col("hrefs"), F.array(*map(F.lit, allowed)))).alias("p", "url"))
        added = next_links.select("url", "depth", "discovered_from", (F.lit(10**9) * (F.col("seq") + 1) + F.col("p")).cast("bigint").alias("pos"))
        frontier = frontier.join(visited, "url", "left_anti").unionByName(added.join(visited, "url", "left_anti")).checkpoint()
        pages += n
    return CrawlState(frontier, visited, ledger, pages, state.root_hash, state.waves)


def ledger_hashes(state: CrawlState) -> DataFrame:
    """The ledger with its chain: at most max_pages entries, folded in one group."""
    from .seal import chain_entries

    hashed = chain_entries(state.ledger.withColumn("chain", F.lit(0)), "chain", "seq").drop("chain")
    return state.ledger.join(hashed, "seq")

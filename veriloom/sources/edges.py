"""Edges end to end: tables of targets are fetched through a guarded function and their answers parsed to rows.

`get` takes a URL and gives a response row (net.fetch by default); tests give one that asks no network.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import urls
from ..operators import http, scholar
from . import net, payloads
from .net import decode_body
from .web import fetch_urls

Get = Callable[[str], dict]
REFUSED = "the credential travels in a header, never in a URL"


@pandas_udf(StringType())
def _decoded(body: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode_body(bytes(b), k or "") for b, k in zip(body, kind)])


def fetched(targets: DataFrame, get: Get, throttle: float = 0.0) -> DataFrame:
    """One response a distinct URL.  What was fetched is kept, so that it is asked for once: in the checkpoint folder, or,
    where none is named, in the executors' storage (a lost executor's share is asked for again)."""
    rows = fetch_urls(targets.select("url").where("url IS NOT NULL").distinct(), get, throttle)
    return rows.checkpoint() if targets.sparkSession.conf.get("spark.checkpoint.dir", "") else rows.persist()


def answers(responses: DataFrame) -> DataFrame:
    """url, payload, error: bodies of 2xx responses as text; else why there is none."""
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    text = _decoded(F.col("body"), http.header(F.col("headers"), "content-type"))
    return responses.select("url", F.when(bad.isNull(), F.coalesce(text, F.lit(""))).alias("payload"), bad.alias("error"))


def items_of(targets: DataFrame, get: Get, parse: Callable[[str, str], list[dict]], fetched_at: float | Column, throttle: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(items with url and pos, errors) of a table of URLs: what could not be fetched or parsed is an error row."""
    got = answers(fetched(targets, get, throttle))
    found, bad = payloads.parse_rows(got.where("error IS NULL").select("url", "payload"), parse, fetched_at)
    return found, bad.unionByName(got.where("error IS NOT NULL").select("url", "error"))


def bearer(token: str, scheme: str = "Bearer", send: Callable[..., dict] = net.fetch) -> Get:
    """A fetch function that sends the token as a header.  A URL that holds it is refused before any request, and is told
    without it, as URLs are kept in receipts."""

    def get(url: str) -> dict:
        if token in url:
            bare = url.replace(token, "***")
            return {"url": bare, "final_url": bare, "status": 0, "headers": [], "body": None, "attempts": 0, "truncated": False, "error": REFUSED}
        return send(url, headers={"Authorization": f"{scheme} {token}"})

    return get


def api_items(targets: DataFrame, secret: str, fetched_at: float, *, scheme: str = "Bearer", send: Callable[..., dict] = net.fetch, **keys: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON APIs.  `secret` names the driver's environment variable; its value is never a column or an option."""
    return items_of(targets, bearer(net.secret(secret), scheme, send), payloads.api(**keys), fetched_at)


def web_items(targets: DataFrame, fetched_at: float, get: Get = net.fetch, throttle: float = 0.0) -> tuple[DataFrame, DataFrame]:
    return items_of(targets, get, payloads.web, fetched_at, throttle)


def feed_items(targets: DataFrame, fetched_at: float, get: Get = net.fetch, throttle: float = 0.0) -> tuple[DataFrame, DataFrame]:
    return items_of(targets, get, payloads.feed, fetched_at, throttle)


def arxiv_items(targets: DataFrame, fetched_at: float, get: Get = net.fetch, max_results: int = 10) -> tuple[DataFrame, DataFrame]:
    """Items of a table of targets (`target`): an identifier is looked up, other text searched; the method tells which."""
    asked = targets.select(urls.is_arxiv_id(F.col("target")).alias("by_id"), urls.arxiv_query_url(F.col("target"), max_results).alias("url")).distinct()
    got = answers(fetched(asked, get)).join(asked, "url")
    found, bad = None, got.where("error IS NOT NULL").select("url", "error")
    for by_id, method in ((True, "arxiv-api-id"), (False, "arxiv-api-search")):
        rows, errors = payloads.parse_rows(got.where((F.col("by_id") == by_id) & F.col("error").isNull()).select("url", "payload"), partial(payloads.arxiv, method=method), fetched_at)
        found, bad = rows if found is None else found.unionByName(rows), bad.unionByName(errors)
    return found, bad


_GRAPHS = {"openalex": scholar.parse_openalex, "semanticscholar": scholar.parse_semanticscholar, "crossref": scholar.parse_crossref}


def scholar_works(targets: DataFrame, get: Get = net.fetch, providers: tuple[str, ...] = scholar.PROVIDERS) -> tuple[DataFrame, DataFrame]:
    """(works with target and seq, errors) of a table of targets (`target`: a DOI or words) over the graphs named.

    seq orders a target's works by graph, as named, and place in the answer.
    """
    if not providers or not set(providers) <= set(scholar.PROVIDERS):
        raise ValueError(f"providers must be some of {scholar.PROVIDERS}")
    lookup = dict(zip(scholar.PROVIDERS, scholar.provider_urls(F.col("target"))))
    graphs = F.array(*[F.struct(F.lit(p).alias("graph"), F.lit(k).alias("place"), lookup[p].alias("url")) for k, p in enumerate(providers)])
    asked = targets.select("target").distinct().select("target", F.inline(graphs))
    got = asked.join(answers(fetched(asked, get)), "url")
    works = None
    for p in providers:
        rows = _GRAPHS[p](got.where((F.col("graph") == p) & F.col("error").isNull()), keep=["target", "place"])
        works = rows if works is None else works.unionByName(rows)
    return works.withColumn("seq", F.struct("target", "place", "pos")).drop("place", "pos"), got.where("error IS NOT NULL").select("url", "error")


def scholar_graph(targets: DataFrame, fetched_at: float, get: Get = net.fetch, providers: tuple[str, ...] = scholar.PROVIDERS, federated: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, citation edge receipts, errors): papers as one item a DOI with every graph's part in derived_from, or, not
    federated, one item a work.  Works of all targets are federated together."""
    works, bad = scholar_works(targets, get, providers)
    papers = scholar.federated_items(scholar.federate(works), fetched_at) if federated else scholar.work_items(works, fetched_at)
    return papers, scholar.citation_edges(works), bad


def searx_hits(queries: DataFrame, base: str, get: Get = net.fetch) -> tuple[DataFrame, DataFrame]:
    """(hits: query, pos, title, url, snippet; queries that were answered) of a table of queries at a SearXNG address."""
    quoted = F.replace(urls.path_encode(F.col("query")), F.lit("%2F"), F.lit("/"))
    asked = queries.select("query", F.concat(F.lit(base.rstrip("/") + "/search?q="), quoted, F.lit("&format=json")).alias("url")).distinct()
    told = asked.join(answers(fetched(asked, get)).where("error IS NULL"), "url").select("query", F.from_json("payload", "results array<struct<title:string,url:string,content:string>>").getField("results").alias("results"))
    r = F.col("r")
    text = lambda c: F.coalesce(c, F.lit(""))
    hits = told.select("query", F.posexplode("results").alias("pos", "r")).select("query", "pos", text(r["title"]).alias("title"), text(r["url"]).alias("url"), text(r["content"]).alias("snippet"))
    return hits, told.select("query")


def search_and_fetch(hits: DataFrame, get: Get = net.fetch, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(leads, their fetch receipts): the first `limit` hits of each query, and each that could be fetched."""
    leads = http.search_leads(hits, "query", "pos", limit)
    got = fetched(leads.where("url <> ''"), get).where("error IS NULL")
    return leads, leads.select("query", "rank", "url").join(http.fetch_receipts(got), "url")

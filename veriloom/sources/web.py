"""Web pages as a Python data source, and a per-host fetcher for tables of URLs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESPONSE = "url string, final_url string, status int, headers array<struct<k:string,v:string>>, body binary, attempts int, truncated boolean, error string"


class UrlBatch(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.batch = int(options.get("batch", "32"))

    def partitions(self) -> list[UrlBatch]:
        return [UrlBatch(self.urls[i : i + self.batch]) for i in range(0, len(self.urls), self.batch)] or [UrlBatch([])]

    def read(self, partition: UrlBatch) -> Iterator[tuple]:
        from .net import fetch

        for url in partition.urls:
            r = _attempt(fetch, url)
            yield tuple(r[c.strip().split(" ")[0]] for c in ("url", "final_url", "status")) + ([(h["k"], h["v"]) for h in r["headers"]], r["body"], r["attempts"], r["truncated"], r["error"])


class WebSource(DataSource):
    """spark.read.format("veriloom_web").option("urls", "https://… https://…").load()"""

    @classmethod
    def name(cls) -> str:
        return "veriloom_web"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)


def _attempt(fetch: Callable[[str], dict], url: str) -> dict:
    try:
        return {"error": None, **fetch(url)}
    except (OSError, ValueError) as e:
        return {"url": url, "final_url": url, "status": 0, "headers": [], "body": None, "attempts": 0, "truncated": False, "error": str(e)[:200]}


def fetch_urls(wanted: DataFrame, fetch: Callable[[str], dict], throttle: float = 0.0, partitions: int | None = None) -> DataFrame:
    """Responses of a table of URLs: hosts are dealt to tasks, so that one task keeps a host's pace."""
    from pyspark.sql import functions as F

    from ..functions import urls

    dealt = wanted.select("url", urls.host(F.col("url")).alias("host"))
    dealt = (dealt.repartition(partitions, "host") if partitions else dealt.repartition("host")).sortWithinPartitions("host", "url")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        last: dict[str, float] = {}
        for pdf in frames:
            out = []
            for url, host in zip(pdf["url"], pdf["host"]):
                if throttle and (wait := throttle - (time.monotonic() - last.get(host, -1e18))) > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                out.append(_attempt(fetch, url))
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in ("url", "final_url", "status", "headers", "body", "attempts", "truncated", "error")])

    return dealt.mapInPandas(run, RESPONSE)

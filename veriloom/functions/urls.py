"""URLs and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_DOI_PREFIX = r"^(?:https?://(?:dx\.)?doi\.org/|doi\.org/|doi:)"
ARXIV_ID = r"(?i)^\d{4}\.\d{4,5}(v\d+)?$|^[a-z-]+(\.[A-Za-z-]+)?/\d{7}(v\d+)?$"
ARXIV_API = "https://export.arxiv.org/api/query"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "^.*@", ""), r":\d*$", ""))


def canonicalize(url: Column) -> Column:
    """Scheme and host in lower case; no user, fragment or default port; an empty path is /; the query stays."""
    s = F.when(scheme(url) == "", F.lit("http")).otherwise(scheme(url))
    port = F.regexp_extract(F.regexp_extract(url, _PARTS, 2), r":(\d+)$", 1)
    default = (port == "") | (port == "0") | ((s == "http") & (port == "80")) | ((s == "https") & (port == "443"))
    path, query = F.regexp_extract(url, _PARTS, 3), F.regexp_extract(url, _PARTS, 4)
    return F.concat(s, F.lit("://"), host(url), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def in_scope(url: Column, hosts: list[str] | Column) -> Column:
    web = scheme(url).isin("http", "https")
    return web & (F.array_contains(hosts, host(url)) if isinstance(hosts, Column) else host(url).isin(list(hosts)))


def normalize_doi(raw: Column) -> Column:
    """A bare lower-case DOI (10.stem/rest) without one resolver or doi: prefix and outer slashes; else ''."""
    s = F.regexp_replace(F.lower(strip(F.coalesce(raw, F.lit("")))), _DOI_PREFIX, "")
    s = F.regexp_replace(strip(s), "^/+|/+$", "")
    return F.when(s.startswith("10.") & s.contains("/"), s).otherwise(F.lit(""))


def work_key(doi: Column, provider: Column, native_id: Column) -> Column:
    return F.when(doi != "", doi).when(native_id != "", F.concat(provider, F.lit(":"), native_id)).otherwise(F.lit(""))


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def arxiv_id(url: Column) -> Column:
    return F.when(url.contains("/abs/"), F.regexp_replace(F.regexp_extract(url, r"/abs/(.*)$", 1), "/+$", "")).otherwise(last_segment(url))


def is_arxiv_id(target: Column) -> Column:
    return strip(target).rlike(ARXIV_ID)


def form_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def path_encode(text: Column) -> Column:
    return F.replace(form_encode(text), F.lit("+"), F.lit("%20"))


def arxiv_query_url(target: Column, max_results: int = 10) -> Column:
    t = strip(target)
    by_id = F.concat(F.lit(ARXIV_API + "?id_list="), form_encode(t), F.lit("&max_results=1"))
    search = F.concat(F.lit(ARXIV_API + "?search_query="), form_encode(F.concat(F.lit("all:"), t)), F.lit(f"&start=0&max_results={max_results}&sortBy=relevance"))
    return F.when(is_arxiv_id(target), by_id).otherwise(search)

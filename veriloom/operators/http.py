"""Fetch receipts, the response cache, search leads, and entries for evidence bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon
from .items import intact


def headers_digest(headers: Column) -> Column:
    """Of array<struct<k, v>>: lower-cased names, sorted lines, hashed."""
    return canon.sha256(F.array_join(F.array_sort(F.transform(headers, lambda h: F.concat(F.lower(h["k"]), F.lit(":"), h["v"]))), "\n"))


def header(headers: Column, name: str) -> Column:
    return F.coalesce(F.get(F.transform(F.filter(headers, lambda h: F.lower(h["k"]) == name.lower()), lambda h: h["v"]), F.lit(0)), F.lit(""))


def fetch_receipts(responses: DataFrame) -> DataFrame:
    """Receipts of (url, final_url, status, headers, body, attempts): the hash is over bytes; a 304 has no body."""
    kept = F.col("status") != 304
    return responses.select(
        "url", "final_url", "status", "attempts", (~kept).alias("not_modified"), F.when(kept, F.sha2(F.coalesce("body", F.lit(b"")), 256)).otherwise("").alias("content_sha256"),
        F.when(kept, F.octet_length("body")).otherwise(0).cast("bigint").alias("content_length"), headers_digest(F.col("headers")).alias("headers_sha256"),
        header(F.col("headers"), "etag").alias("etag"), header(F.col("headers"), "last-modified").alias("last_modified"), header(F.col("headers"), "content-type").alias("content_type"),
    )


def verify_fetch(receipts: DataFrame, bodies: DataFrame, on: str = "url") -> DataFrame:
    b = bodies.select(on, F.col("body").alias("_body"))
    ok = F.when(F.col("not_modified"), F.col("_body").isNull()).otherwise(F.sha2(F.col("_body"), 256) == F.col("content_sha256"))
    return receipts.join(b, on, "left").withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_body")


def cache_key(url: Column) -> Column:
    return F.substring(canon.sha256(url), 1, 20)


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Upsert of (url, status, body, etag, last_modified, fetched_at): the latest of each URL stays."""
    new = entries.withColumn("key", cache_key(F.col("url"))).withColumn("body_sha256", F.sha2("body", 256))
    both = cache.unionByName(new)
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("fetched_at"), F.desc("body_sha256")))
    return both.withColumn("_t", turn).where("_t = 1").drop("_t")


def cache_verify(cache: DataFrame) -> DataFrame:
    return cache.withColumn("ok", F.sha2("body", 256) == F.col("body_sha256"))


def cached_fetch(requests: DataFrame, cache: DataFrame, fetched: DataFrame, revalidate: bool = False, on: str = "url") -> DataFrame:
    """origin of each request: cache, network, cache-revalidated (304 to a conditional request), or an error.

    Requests are left-joined with the cache and with what the network answered (`on`, status, body).  Both have one row a
    key, as cache_put leaves them; requests that share a URL but not their answers are joined `on` a key of their own.
    """
    c = cache.select(on, F.col("body").alias("c_body"), F.col("body_sha256").alias("c_sha"))
    n = fetched.select(on, F.col("status").alias("n_status"), F.col("body").alias("n_body"))
    rows = requests.join(c, on, "left").join(n, on, "left")
    hit = F.col("c_sha").isNotNull()
    origin = F.when(hit & F.lit(not revalidate), "cache").when((F.col("n_status") == 304) & hit, "cache-revalidated").when(F.col("n_status") == 304, "error: 304 without an entry").when(F.col("n_status").isNull(), "error: not fetched").otherwise("network")
    rows = rows.withColumn("origin", origin)
    body = F.when(F.col("origin").startswith("cache"), F.col("c_body")).when(F.col("origin") == "network", F.col("n_body"))
    return rows.select(*requests.columns, "origin", body.alias("body"), F.sha2(body, 256).alias("body_sha256"))


def search_leads(hits: DataFrame, by: str, order: str, limit: int = 10) -> DataFrame:
    """The first `limit` leads of each query (title, url, snippet), each with the hash of its URL."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return hits.withColumn("rank", turn).where(F.col("rank") <= limit).withColumn("url_sha256", canon.sha256(F.col("url")))


def search_receipts(queries: DataFrame, leads: DataFrame, by: str, answered: DataFrame | None = None) -> DataFrame:
    """status searched, or UNVERIFIABLE without a provider's answer; ok: the leads' hashes hold.

    `answered`: the queries that a provider answered, with leads or none; else those with leads count as answered.
    """
    g = leads.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bool_and(intact("url", "url_sha256")).alias("hashes_ok"))
    if answered is not None:
        g = answered.select(by).distinct().join(g, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return queries.select(by).join(g, by, "left").select(by, F.when(F.col("n").isNull(), "UNVERIFIABLE").otherwise("searched").alias("status"), F.coalesce("n", F.lit(0)).alias("leads"), F.coalesce("hashes_ok", F.lit(True)).alias("ok"))


def bundle_entry(entry_id: Column, subtype: str, status: Column, sha: Column, summary: Column, ref: Column, organ: str = "veriloom", kind: str = "corpus") -> list[Column]:
    """The seven fields of a bundle entry; the summary has 160 characters at most."""
    return [entry_id.alias("entry_id"), F.lit(organ).alias("organ_id"), F.lit(kind).alias("receipt_kind"), status.alias("status"), sha.alias("payload_sha256"), F.substring(F.concat(F.lit(f"[{subtype}] "), summary), 1, 160).alias("summary"), ref.alias("payload_ref")]


def fetch_entries(receipts: DataFrame) -> DataFrame:
    status = F.when(F.col("not_modified"), "unverified").when(F.col("status").between(200, 299), "pass").otherwise("warn")
    sha = F.when(~F.col("not_modified") & (F.col("content_sha256") != ""), F.col("content_sha256")).otherwise(canon.sha256(F.col("url")))
    summary = F.concat(F.col("final_url"), F.lit(": HTTP "), F.col("status").cast("string"), F.lit(", "), F.col("attempts").cast("string"), F.lit(" attempt(s)"))
    return receipts.select(*bundle_entry(F.col("url"), "fetch", status, sha, summary, F.lit("fetch")))


def extraction_entries(extracted: DataFrame, key: str = "url") -> DataFrame:
    """Of extracted pages: the Markdown's hash, and how many blocks there are."""
    summary = F.concat(F.col(key).cast("string"), F.lit(": "), F.size("blocks").cast("string"), F.lit(" block(s), title "), F.col("title"))
    return extracted.select(*bundle_entry(F.col(key).cast("string"), "extraction", F.lit("pass"), F.col("markdown_sha256"), summary, F.lit("extraction")))


def crawl_entries(verified: DataFrame, by: str) -> DataFrame:
    """Of verified chains (`by`, ok, root_hash, entries)."""
    status = F.when(F.col("ok"), "pass").otherwise("fail")
    sha = F.when(F.col("root_hash") != "", F.col("root_hash")).otherwise(canon.sha256(F.lit("")))
    summary = F.concat(F.lit("ledger: "), F.col("entries").cast("string"), F.lit(" page(s), chain "), status)
    return verified.select(*bundle_entry(F.col(by).cast("string"), "crawl", status, sha, summary, F.lit("crawl")))


def search_entries(receipts: DataFrame, leads: DataFrame, by: str) -> DataFrame:
    """Of search receipts: the hash of the leads' URLs in order of rank."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]), "|")
    rows = receipts.join(leads.groupBy(by).agg(joined.alias("urls")), by, "left")
    status = F.when(F.col("status") == "searched", "pass").otherwise("unverified")
    summary = F.concat(F.col(by).cast("string"), F.lit(": "), F.col("leads").cast("string"), F.lit(" lead(s)"))
    return rows.select(*bundle_entry(F.col(by).cast("string"), "search-lead", status, canon.sha256(F.coalesce("urls", F.lit(""))), summary, F.lit("search")))

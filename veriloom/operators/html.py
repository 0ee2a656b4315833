"""Page operators: Arrow-batched parsing in Python, every hash and verdict as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import canon
from ..functions.htmltree import TEXT_BLOCKS, Reader, Tree, squeeze
from ..functions.text import grounded


def add_from_html(pages: DataFrame, html: str, fields: str, read: Callable[[str], dict]) -> DataFrame:
    """`pages` with the columns `fields` (DDL) that `read` makes of each page's HTML; null HTML is empty."""
    made = StructType.fromDDL(fields)
    names, at = pages.columns, pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(made)
        for batch in batches:
            rows = [read(x or "") for x in batch.column(at).to_pylist()]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *schema.names])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, *made.fields]))


def _nodes(html: str) -> dict:
    t = Tree(html)
    nodes = [0, *t.below(0)]
    order = {n: k for k, n in enumerate(nodes)}
    rows = [{"ord": k, "parent_ord": order.get(t.parent[n], -1), "tag": t.tag[n], "pos": t.pos[n], "path": t.path[n], "attrs": list(t.attrs[n].items()), "text": t.text(n)} for n, k in order.items()]
    return {"nodes": rows}


def nodes(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an element in document order: ord, parent_ord, tag, pos, path, attrs, text."""
    rows = add_from_html(pages.select(*keep, html), html, "nodes array<struct<ord:int,parent_ord:int,tag:string,pos:int,path:string,attrs:map<string,string>,text:string>>", _nodes)
    return rows.select(*keep, F.inline("nodes"))


def titles_and_text(pages: DataFrame, html: str = "html") -> DataFrame:
    def read(x: str) -> dict:
        title, text = Reader(x).read()
        return {"title": title, "text": text}

    return add_from_html(pages, html, "title string, text string", read)


def markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    return add_from_html(pages, html, "markdown string", lambda x: {"markdown": Tree(x).markdown()})


def _extract(html: str) -> dict:
    t = Tree(html)
    found = [(t.path[n], t.tag[n], t.text(n)) for n in t.below(0) if t.tag[n] in TEXT_BLOCKS]
    return {"title": t.title(), "markdown": t.markdown(), "parts": [{"path": p, "tag": g, "text": x} for p, g, x in found if x]}


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """title, markdown and blocks array<struct<path, tag, text, sha256>>, with hashes of the page and the Markdown."""
    rows = add_from_html(pages, html, "title string, markdown string, parts array<struct<path:string,tag:string,text:string>>", _extract)
    blocks = F.transform("parts", lambda b: F.struct(b["path"].alias("path"), b["tag"].alias("tag"), b["text"].alias("text"), canon.sha256(b["text"]).alias("sha256")))
    return rows.withColumn("blocks", blocks).withColumn("markdown_sha256", canon.sha256(F.col("markdown"))).withColumn("content_sha256", canon.sha256(F.coalesce(F.col(html), F.lit("")))).drop("parts")


def verify_extract(html: str | None = None) -> Column:
    ok = (canon.sha256(F.col("markdown")) == F.col("markdown_sha256")) & F.forall("blocks", lambda b: canon.sha256(b["text"]) == b["sha256"])
    return ok & (canon.sha256(F.col(html)) == F.col("content_sha256")) if html else ok


def links(pages: DataFrame, base: str = "url", html: str = "html") -> DataFrame:
    """`hrefs`: absolute web targets of the anchors in order; canonical form and scope are expressions on top."""
    both = pages.withColumn("_in", F.to_json(F.struct(F.col(base).alias("b"), F.coalesce(F.col(html), F.lit("")).alias("h"))))

    def read(x: str) -> dict:
        import json
        from urllib.parse import urljoin

        page = json.loads(x) if x else {}
        t = Tree(page.get("h", ""))
        hrefs = [t.attrs[n].get("href", "").strip() for n in t.select("a")]
        kept = [h for h in hrefs if h and not h.startswith(("#", "javascript:", "mailto:", "tel:"))]
        whole = []
        for h in kept:
            try:
                whole.append(urljoin(page.get("b") or "", h))
            except ValueError:
                continue
        return {"hrefs": [u for u in whole if u.lower().startswith(("http://", "https://"))]}

    return add_from_html(both, "_in", "hrefs array<string>", read).drop("_in")


def scoped_links(hrefs: Column, hosts: Column) -> Column:
    """Canonical targets on the hosts, first of each."""
    from ..functions import urls

    return F.array_distinct(F.filter(F.transform(hrefs, urls.canonicalize), lambda u: urls.in_scope(u, hosts)))


@dataclass(frozen=True)
class Rule:
    name: str
    selector: str
    attr: str = ""
    regex: str = ""
    many: bool = False
    required: bool = False


def schema_extract(pages: DataFrame, rules: list[Rule], html: str = "html") -> DataFrame:
    """`fields`: array<struct<name, attr, many, required, hits>>; a hit has its value, node path, and both hashes."""
    import re

    def read(x: str) -> dict:
        t = Tree(x)
        out = []
        for r in rules:
            hits = []
            for n in t.select(r.selector):
                source = squeeze(t.attrs[n].get(r.attr, "") if r.attr else t.text(n))
                value: str | None = source
                if r.regex:
                    m = re.search(r.regex, source)
                    value = m and (m[1] if m.groups() else m[0])
                if not value:
                    continue
                hits.append({"value": value, "path": t.path[n], "source": source})
                if not r.many:
                    break
            out.append({"name": r.name, "attr": r.attr, "many": r.many, "required": r.required, "hits": hits})
        return {"fields": out}

    ddl = "fields array<struct<name:string,attr:string,many:boolean,required:boolean,hits:array<struct<value:string,path:string,source:string>>>>"
    rows = add_from_html(pages, html, ddl, read)
    hit = lambda h: F.struct(h["value"].alias("value"), h["path"].alias("path"), canon.sha256(h["source"]).alias("source_sha256"), canon.sha256(h["value"]).alias("value_sha256"))
    field = lambda f: F.struct(f["name"].alias("name"), f["attr"].alias("attr"), f["many"].alias("many"), f["required"].alias("required"), F.transform(f["hits"], hit).alias("hits"))
    return rows.withColumn("fields", F.transform("fields", field)).withColumn("content_sha256", canon.sha256(F.coalesce(F.col(html), F.lit(""))))


def record(fields: str = "fields") -> Column:
    """map<name, array of values>: one value at most unless the rule takes many."""
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["name"], F.transform(f["hits"], lambda h: h["value"]))))


def missing_required(fields: str = "fields") -> Column:
    return F.transform(F.filter(fields, lambda f: f["required"] & (F.size(f["hits"]) == 0)), lambda f: f["name"])


def verify_schema(extracted: DataFrame, pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and ok: every hit's node, found by path in the page as it is now, still has the source and holds the value."""
    now = nodes(pages, html, (key,)).select(key, "path", "attrs", "text")
    hits = extracted.select(key, F.explode("fields").alias("f")).select(key, F.col("f.attr").alias("attr"), F.explode("f.hits").alias("h")).select(key, "attr", "h.*")
    found = hits.join(now, [key, "path"], "left")
    source = F.when(F.col("attr") != "", F.coalesce(F.col("attrs")[F.col("attr")], F.lit(""))).otherwise(F.col("text"))
    good = F.coalesce((canon.sha256(source) == F.col("source_sha256")) & (canon.sha256(F.col("value")) == F.col("value_sha256")) & F.contains(F.lower(source), F.lower(F.col("value"))), F.lit(False))
    held = found.groupBy(key).agg(F.bool_and(good).alias("hits_ok"))
    same = extracted.select(key, "content_sha256").join(pages.select(key, canon.sha256(F.coalesce(F.col(html), F.lit(""))).alias("_now")), key, "left")
    return same.join(held, key, "left").select(key, (F.coalesce(F.col("content_sha256") == F.col("_now"), F.lit(False)) & F.coalesce("hits_ok", F.lit(True))).alias("ok"))


def haystacks(pages: DataFrame, html: str = "html") -> DataFrame:
    return add_from_html(pages, html, "hay string", lambda x: {"hay": Tree(x).hay()})


def verify_record(pages: DataFrame, record: str = "record", html: str = "html") -> DataFrame:
    """ok, ungrounded and content_sha256 of claimed records (map<name, array of values>) against their pages.

    A record holds if each of its values stands in the page; `ungrounded` lists those that don't, as (name, value), in
    the map's order.  Empty values stand nowhere; a null record or one without values holds.
    """
    hay = "_record_hay"
    rows = add_from_html(pages, html, f"{hay} string", lambda x: {hay: Tree(x).hay()})
    claims = F.flatten(F.transform(F.map_entries(record), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("name"), v.alias("value")))))
    lost = F.coalesce(F.filter(claims, lambda c: ~F.coalesce(grounded(c["value"], F.col(hay)), F.lit(False))), F.array().cast("array<struct<name:string,value:string>>"))
    return rows.withColumn("ungrounded", lost).withColumn("ok", F.size("ungrounded") == 0).withColumn("content_sha256", canon.sha256(F.coalesce(F.col(html), F.lit("")))).drop(hay)


def verify_values(values: DataFrame, value: str = "value", hay: str = "hay") -> DataFrame:
    """(…, grounded) of each claimed value against its page's hay."""
    return values.withColumn("grounded", grounded(F.col(value), F.col(hay)))

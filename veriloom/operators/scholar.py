"""Scholarly works from three graphs: parsing, federation by DOI, citation edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.text import clean, inverted_index_text
from ..functions.urls import last_segment, normalize_doi, path_encode, form_encode, work_key
from .items import make_items

PROVIDERS = ("openalex", "semanticscholar", "crossref")
WORK = ("provider", "method", "key", "doi", "title", "abstract", "authors", "year", "native_id", "references", "citations")

_OPENALEX = "id string, doi string, display_name string, title string, publication_year bigint, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, referenced_works array<string>"
_SEMANTIC = "paperId string, title string, abstract string, year bigint, externalIds struct<DOI:string>, authors array<struct<name:string>>, references array<struct<paperId:string,externalIds:struct<DOI:string>>>, citations array<struct<paperId:string,externalIds:struct<DOI:string>>>"
_CROSSREF = "DOI string, title array<string>, author array<struct<given:string,family:string,name:string>>, issued struct<`date-parts`:array<array<bigint>>>, abstract string, reference array<struct<DOI:string>>"


def _listed(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def _names(a: Column) -> Column:
    return _listed(F.filter(F.transform(a, clean), lambda x: x != ""))


def _works(rows: DataFrame, provider: str, keep: list[str], **c: Column) -> DataFrame:
    p = F.lit(provider)
    return rows.select(*keep, p.alias("provider"), F.lit(f"{provider}-api").alias("method"), work_key(c["doi"], p, c["native_id"]).alias("key"), *[c[n].alias(n) for n in WORK[3:]]).where("key <> ''")


def _records(payloads: DataFrame, many: str, keep: list[str], schema: str, column: str, single: str | None = None) -> DataFrame:
    """Records under `many`, or under `single`, or the payload itself."""
    body = F.from_json(column, f"`{many}` array<struct<{_struct(schema)}>>") if "." not in many else None
    one = F.from_json(column, f"struct<{_struct(schema)}>")
    if body is None:
        outer, inner = many.split(".")
        wrapped = F.from_json(column, f"{outer} struct<{inner}:array<struct<{_struct(schema)}>>>").getField(outer)
        alone = F.from_json(column, f"{outer} struct<{_struct(schema)}>").getField(outer)
        has_outer = F.get_json_object(column, f"$.{outer}").isNotNull()
        records = F.when(F.get_json_object(column, f"$.{many}").isNotNull(), wrapped.getField(inner)).when(has_outer, F.array(alone)).otherwise(F.array(one))
    else:
        records = F.when(F.get_json_object(column, f"$.{many}").isNotNull(), body.getField(many)).otherwise(F.array(one))
    return payloads.select(*keep, F.posexplode(records).alias("pos", "r")).where("r IS NOT NULL")


def _struct(ddl: str) -> str:
    parts, depth, out = [], 0, ""
    for ch in ddl + ",":
        depth += ch in "<" 
        depth -= ch in ">"
        if ch == "," and depth == 0:
            name, _, kind = out.strip().partition(" ")
            parts.append(f"{name}:{kind}")
            out = ""
        else:
            out += ch
    return ",".join(parts)


def parse_openalex(payloads: DataFrame, column: str = "payload", keep: list[str] | None = None) -> DataFrame:
    r = F.col("r")
    title = F.when(clean(r["title"]) != "", clean(r["title"])).otherwise(clean(r["display_name"]))
    native = last_segment(F.coalesce(r["id"], F.lit("")))
    refs = F.transform(F.filter(_listed(r["referenced_works"]), lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit("openalex:"), last_segment(x)))
    rows = _records(payloads, "results", keep or [], _OPENALEX, column)
    return _works(rows, "openalex", [*(keep or []), "pos"], doi=normalize_doi(r["doi"]), title=title, abstract=inverted_index_text(r["abstract_inverted_index"]), authors=_names(F.transform(r["authorships"], lambda a: a["author"]["display_name"])), year=F.coalesce(r["publication_year"].cast("string"), F.lit("")), native_id=native, references=refs, citations=_listed(F.lit(None).cast("array<string>")))


def _edge_keys(a: Column) -> Column:
    keys = F.transform(a, lambda x: work_key(normalize_doi(x["externalIds"]["DOI"]), F.lit("semanticscholar"), clean(x["paperId"])))
    return _listed(F.filter(keys, lambda k: k != ""))


def parse_semanticscholar(payloads: DataFrame, column: str = "payload", keep: list[str] | None = None) -> DataFrame:
    r = F.col("r")
    rows = _records(payloads, "data", keep or [], _SEMANTIC, column)
    return _works(rows, "semanticscholar", [*(keep or []), "pos"], doi=normalize_doi(r["externalIds"]["DOI"]), title=clean(r["title"]), abstract=clean(r["abstract"]), authors=_names(F.transform(r["authors"], lambda a: a["name"])), year=F.coalesce(r["year"].cast("string"), F.lit("")), native_id=clean(r["paperId"]), references=_edge_keys(r["references"]), citations=_edge_keys(r["citations"]))


def parse_crossref(payloads: DataFrame, column: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """A DOI is required; the abstract keeps its markup; a year is the first part of the issue date."""
    r = F.col("r")
    rows = _records(payloads, "message.items", keep or [], _CROSSREF, column)
    doi = normalize_doi(r["DOI"])
    title = clean(F.get(r["title"], F.lit(0)))
    names = F.transform(r["author"], lambda a: F.concat_ws(" ", a["given"], a["family"]))
    year = F.get(F.get(r["issued"]["date-parts"], F.lit(0)), F.lit(0)).cast("string")
    refs = _listed(F.filter(F.transform(r["reference"], lambda x: normalize_doi(x["DOI"])), lambda k: k != ""))
    found = _works(rows, "crossref", [*(keep or []), "pos"], doi=doi, title=title, abstract=clean(r["abstract"]), authors=_names(names), year=F.coalesce(year, F.lit("")), native_id=doi, references=refs, citations=_listed(F.lit(None).cast("array<string>")))
    return found.where("doi <> ''")


def provider_urls(target: Column) -> list[Column]:
    """Lookup by DOI, else search, for each graph."""
    doi = normalize_doi(target)
    open_alex = F.when(doi != "", F.concat(F.lit("https://api.openalex.org/works?filter=doi:"), path_encode(doi))).otherwise(F.concat(F.lit("https://api.openalex.org/works?search="), form_encode(target)))
    semantic = F.when(doi != "", F.concat(F.lit("https://api.semanticscholar.org/graph/v1/paper/DOI:"), path_encode(doi))).otherwise(F.concat(F.lit("https://api.semanticscholar.org/graph/v1/paper/search?query="), form_encode(target)))
    crossref = F.when(doi != "", F.concat(F.lit("https://api.crossref.org/works/"), path_encode(doi))).otherwise(F.concat(F.lit("https://api.crossref.org/works?query="), form_encode(target)))
    return [open_alex, semantic, crossref]


def work_text() -> Column:
    return F.when(F.col("abstract") != "", F.col("abstract")).otherwise(F.col("title"))


def work_items(works: DataFrame, fetched_at: float) -> DataFrame:
    return make_items(works, kind=F.lit("paper"), id=F.col("key"), title=F.col("title"), text=work_text(), source=F.lit("scholar"), ref=F.col("key"), method=F.col("method"), fetched_at=fetched_at, meta=_meta(("provider", "doi", "native_id", "year"), ("authors", "references", "citations")))


def _meta(strings: tuple[str, ...], lists: tuple[str, ...]) -> Column:
    return canon.object_({**{c: canon.string(F.col(c)) for c in strings}, **{c: canon.strings(F.col(c)) for c in lists}})


def federate(works: DataFrame, order: str = "seq") -> DataFrame:
    """One row a DOI (a work without one stays alone, never joined by title): the first value by provider rank and order.

    A DOI's group holds a few works, one or so a graph; it is one aggregation with partial collection, no join.
    """
    rank = F.when(F.col("provider") == "openalex", 0).when(F.col("provider") == "semanticscholar", 1).when(F.col("provider") == "crossref", 2).otherwise(3)
    group = F.when(F.col("doi") != "", F.col("doi")).otherwise(F.concat(F.lit("__nodoi__:"), F.col("key")))
    fields = ("title", "abstract", "authors", "year", "references", "citations", "key", "doi", "provider")
    w = works.select(group.alias("gkey"), F.struct(rank.alias("rank"), F.col(order).alias("seq"), *[F.col(f) for f in fields], canon.sha256(work_text()).alias("hash")).alias("w"))
    g = w.groupBy("gkey").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.min(F.col("w.seq")).alias("seq"))

    def first(field: str) -> Column:
        return F.coalesce(F.get(F.filter(F.transform("ws", lambda x: x[field]), lambda v: v != ""), F.lit(0)), F.lit(""))

    def first_list(field: str) -> Column:
        return _listed(F.get(F.filter(F.transform("ws", lambda x: x[field]), lambda v: F.size(v) > 0), F.lit(0)))

    def union(field: str) -> Column:
        return F.array_distinct(F.filter(F.flatten(F.transform("ws", lambda x: x[field])), lambda v: v != ""))

    with_abstract = F.filter("ws", lambda x: x["abstract"] != "")
    doi, key = F.get("ws", F.lit(0))["doi"], F.get("ws", F.lit(0))["key"]
    return g.select(
        "seq", doi.alias("doi"), F.when(doi != "", doi).otherwise(key).alias("key"), first("title").alias("title"), first("abstract").alias("abstract"),
        F.coalesce(F.get(with_abstract, F.lit(0))["provider"], F.lit("")).alias("abstract_provider"), first_list("authors").alias("authors"), first("year").alias("year"),
        F.array_sort(F.array_distinct(F.transform("ws", lambda x: x["provider"]))).alias("providers"), union("references").alias("references"), union("citations").alias("citations"),
        F.transform("ws", lambda x: x["hash"]).alias("source_hashes"),
    )


def federated_items(federated: DataFrame, fetched_at: float) -> DataFrame:
    return make_items(federated, kind=F.lit("paper"), id=F.col("key"), title=F.col("title"), text=work_text(), source=F.lit("scholar"), ref=F.col("key"), method=F.lit("compiled"), fetched_at=fetched_at, derived_from=F.col("source_hashes"), meta=_meta(("doi", "abstract_provider", "year"), ("providers", "authors", "references", "citations")))


def citation_edges(works: DataFrame) -> DataFrame:
    """Receipts of directed edges, one for each (from, to, direction, provider); loops and empty ends are left out."""
    refs = works.select("provider", F.col("key").alias("from"), F.explode("references").alias("to"), F.lit("references").alias("direction"))
    cites = works.select("provider", F.explode("citations").alias("from"), F.col("key").alias("to"), F.lit("citations").alias("direction"))
    edges = refs.unionByName(cites).where((F.col("from") != "") & (F.col("to") != "") & (F.col("from") != F.col("to"))).distinct()
    json = canon.object_({c: canon.string(F.col(c)) for c in ("from", "to", "direction", "provider")})
    id = F.concat("provider", F.lit(":"), "direction", F.lit(":"), "from", F.lit("->"), "to")
    return edges.select(F.lit("citation-edge").alias("kind"), id.alias("id"), F.concat("from", F.lit(" -> "), "to").alias("title"), F.lit("scholar").alias("source"), F.col("provider").alias("ref"), F.lit("citation-edge").alias("method"), canon.sha256(json).alias("sha256"), F.array().cast("array<string>").alias("derived_from"))

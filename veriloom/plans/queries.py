"""Queries over the driver tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, checks, text, urls
from ..operators import availability, corpus, derive, federation, html, items, runs, scholar, scope, seal, tracking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TERMS = ("license", "worthless", "ention")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_items(spark: SparkSession, sf_dir: str, strict: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    title = F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 60)
    rows = items.make_items(d, keep=("doc_id",), kind=F.when(F.col("doc_id") % 3 == 0, "paper").otherwise("document"), id=F.col("doc_id").cast("string"), title=title, text=F.col("text"), source=F.col("source"), ref=F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), method=F.lit("file-read"), fetched_at=1.0, strict=strict)
    return rows.withColumn("seq", F.col("doc_id"))


ITEMS = """
items AS (SELECT doc_id, doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'paper' ELSE 'document' END AS kind, doc_id::VARCHAR AS id, substring(split_part(text, chr(10), 1), 1, 60) AS title,
  text, source, 'doc:' || doc_id AS ref, 'file-read' AS method, sha256(text) AS sha256 FROM documents)"""


def _esc(c: str) -> str:
    out = f"replace(replace({c}, '\\', '\\\\'), '\"', '\\\"')"
    for code, short in ((10, "n"), (13, "r"), (9, "t"), (8, "b"), (12, "f")):
        out = f"replace({out}, chr({code}), '\\{short}')"
    return f"'\"' || {out} || '\"'"


def receipt_sql(rung: str = "", derived: str = "'[]'") -> str:
    parts = ([f"'\"availability\": ' || {rung} || ', '"] if rung else []) + [f"'\"derived_from\": ' || {derived}"]
    parts += [f"', \"{c}\": ' || {_esc(c)}" for c in ("id", "kind", "method", "ref", "sha256", "source", "title")]
    return "'{' || " + " || ".join(parts) + " || '}'"


@query("SELECT doc_id::VARCHAR AS id, sha256(text) AS sha256, length(text)::BIGINT AS chars FROM documents")
def content_receipts(spark, sf):
    return items.catalog_rows(document_items(spark, sf)).select("id", "sha256", "chars")


def _has(c: str = "lower(title || chr(10) || text)") -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in TERMS) + ")"


@query(f"WITH {ITEMS} SELECT id, sha256 FROM items WHERE {_has()}")
def scope_filter(spark, sf):
    return scope.filter_scope(document_items(spark, sf), TERMS).select("id", "sha256")


@query(f"WITH {ITEMS} SELECT source, count(*) FILTER (WHERE {_has()})::BIGINT AS kept, count(*) FILTER (WHERE NOT {_has()})::BIGINT AS dropped FROM items GROUP BY source")
def scope_counts(spark, sf):
    return scope.scope_counts(document_items(spark, sf), TERMS, "source")


@query("SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'paper' ELSE 'document' END AS kind FROM documents) GROUP BY kind")
def kind_counts(spark, sf):
    return document_items(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


RECALL = scope.Query(terms=TERMS, sources=("src0", "src1", "src2", "src3"), kinds=("document",))


@query(f"WITH {ITEMS} SELECT id, seq, sha256 FROM items WHERE source IN ('src0','src1','src2','src3') AND kind = 'document' AND {_has()} ORDER BY seq LIMIT 25")
def recall_facets(spark, sf):
    rows = document_items(spark, sf)
    found = corpus.recall_audited(rows.drop("text"), rows.select("sha256", "text").dropDuplicates(["sha256"]), RECALL, 25, keep_text=False)
    return found.where("status = 'MATCH'").select("id", "seq", "sha256")


@query("SELECT sha256(text) AS sha256, count(*)::BIGINT AS receipts, count(DISTINCT doc_id)::BIGINT AS documents FROM documents GROUP BY 1")
def body_dedup(spark, sf):
    return document_items(spark, sf).groupBy("sha256").agg(F.count(F.lit(1)).alias("receipts"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1) GROUP BY 1")
def fresh_bodies(spark, sf):
    rows = document_items(spark, sf)
    return corpus.fresh_bodies(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")).select("sha256")


@query(f"WITH {ITEMS}, twice AS (SELECT id, seq, sha256 FROM items UNION ALL SELECT id, seq + 10000000, sha256 FROM items WHERE doc_id % 3 = 0) SELECT id, seq, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM twice) WHERE r = 1")
def receipt_dedup(spark, sf):
    rows = document_items(spark, sf)
    again = rows.where("doc_id % 3 = 0").withColumn("seq", F.col("seq") + 10_000_000)
    return items.dedup_receipts(rows.unionByName(again)).select("id", "seq", "sha256")


@query(f"WITH {ITEMS}, a AS (SELECT * FROM items WHERE doc_id % 10 < 6), b AS (SELECT * FROM items WHERE doc_id % 10 >= 4) SELECT count(*) FILTER (WHERE id NOT IN (SELECT id FROM a))::BIGINT AS added, count(*) FILTER (WHERE id IN (SELECT id FROM a))::BIGINT AS deduped, (SELECT count(*) FROM a)::BIGINT + count(*) FILTER (WHERE id NOT IN (SELECT id FROM a))::BIGINT AS total FROM b")
def incremental_add(spark, sf):
    rows = document_items(spark, sf)
    a, b = rows.where("doc_id % 10 < 6"), rows.where("doc_id % 10 >= 4")
    new = corpus.fresh_receipts(b, a).agg(F.count(F.lit(1)).alias("added"))
    n = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb"))).crossJoin(new)
    return n.select("added", (F.col("nb") - F.col("added")).alias("deduped"), (F.col("na") + F.col("added")).alias("total"))


@query(f"WITH {ITEMS}, j AS (SELECT {receipt_sql()} AS json FROM items) SELECT count(*)::BIGINT AS digested, sha256('[' || string_agg(json, ', ' ORDER BY json) || ']') AS seal FROM j")
def digest_seal(spark, sf):
    return seal.seal(items.receipts(document_items(spark, sf)))


RUNG_SQL = "CASE WHEN doc_id % 5 = 0 THEN '{\"checked_at\": 9.0, \"sha256\": \"\", \"status\": \"UNAVAILABLE\"}' ELSE '{\"checked_at\": 9.0, \"sha256\": \"' || sha256 || '\", \"status\": \"AVAILABLE\"}' END"


@query(f"WITH {ITEMS}, j AS (SELECT {receipt_sql(RUNG_SQL)} AS json FROM items) SELECT count(*)::BIGINT AS digested, sha256('[' || string_agg(json, ', ' ORDER BY json) || ']') AS seal FROM j")
def digest_seal_with_rung(spark, sf):
    rows = document_items(spark, sf).withColumn("availability", availability.rung(F.when(F.col("doc_id") % 5 != 0, F.col("text")), 9.0))
    return seal.seal(rows, "availability")


def _damaged(spark, sf):
    rows = document_items(spark, sf)
    bad = F.when(F.col("doc_id") % 101 == 0, F.lit("../../x")).otherwise(F.col("sha256"))
    catalog = rows.withColumn("sha256", bad).withColumn("key", F.col("doc_id"))
    bodies = rows.groupBy("sha256").agg(F.min("doc_id").alias("k"), F.first("text").alias("text")).where("k % 17 <> 0")
    return catalog.drop("text"), bodies.select("sha256", F.when(F.col("k") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))


DAMAGED = f"""WITH {ITEMS}, catalog AS (SELECT * EXCLUDE (sha256), CASE WHEN doc_id % 101 = 0 THEN '../../x' ELSE sha256 END AS sha256 FROM items),
o AS (SELECT sha256, min(doc_id) AS k, any_value(text) AS body FROM items GROUP BY sha256), objects AS (SELECT sha256, CASE WHEN k % 13 = 0 THEN body || '!' ELSE body END AS body FROM o WHERE k % 17 <> 0),
st AS (SELECT c.id, c.seq, c.title, c.source, c.kind, o.body, CASE WHEN NOT regexp_full_match(c.sha256, '[0-9a-f]{{64}}') THEN 'CORRUPT' WHEN o.body IS NULL THEN 'MISSING' WHEN sha256(o.body) = c.sha256 THEN 'MATCH' ELSE 'CORRUPT' END AS status, NOT regexp_full_match(c.sha256, '[0-9a-f]{{64}}') AS badsha FROM catalog c LEFT JOIN objects o USING (sha256))"""


@query(f"{DAMAGED} SELECT id, status FROM st")
def corpus_verify(spark, sf):
    return corpus.body_status(*_damaged(spark, sf)).select("id", "status")


@query(f"{DAMAGED} SELECT status, count(*)::BIGINT AS n FROM st GROUP BY status")
def verify_counts(spark, sf):
    return corpus.body_status(*_damaged(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"{DAMAGED}, f AS (SELECT * FROM st WHERE source IN ('src0','src1','src2','src3') AND kind = 'document' AND (status = 'MISSING' OR badsha OR {_has('lower(title || chr(10) || body)')})), h AS (SELECT seq FROM f WHERE status = 'MATCH' ORDER BY seq LIMIT 20) SELECT id, seq, status FROM f WHERE (SELECT count(*) FROM h) < 20 OR seq <= (SELECT max(seq) FROM h)")
def recall_with_skips(spark, sf):
    return corpus.recall_audited(*_damaged(spark, sf), RECALL, 20).select("id", "seq", "status")


@query("""WITH i AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'paper' ELSE 'document' END AS kind, 'file-read' AS method, sha256(text) AS sha256 FROM documents)
SELECT 'total' AS facet, '' AS value, count(*)::BIGINT AS receipts, count(DISTINCT sha256)::BIGINT AS bodies FROM i UNION ALL SELECT 'source', source, count(*)::BIGINT, count(DISTINCT sha256)::BIGINT FROM i GROUP BY source
UNION ALL SELECT 'kind', kind, count(*)::BIGINT, count(DISTINCT sha256)::BIGINT FROM i GROUP BY kind UNION ALL SELECT 'method', method, count(*)::BIGINT, count(DISTINCT sha256)::BIGINT FROM i GROUP BY method""")
def corpus_stats(spark, sf):
    return corpus.stats(document_items(spark, sf))


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 <> 0)")
def orphans(spark, sf):
    rows = document_items(spark, sf)
    return corpus.orphans(rows.select("sha256").distinct(), rows.where("doc_id % 4 <> 0"))


@query("SELECT id, CASE WHEN doc_id % 11 = 0 THEN 'UNAVAILABLE' WHEN doc_id % 7 = 0 THEN 'CHANGED' WHEN doc_id % 5 = 0 THEN 'UNWITNESSED' ELSE 'AVAILABLE' END AS outcome FROM (SELECT doc_id, doc_id::VARCHAR AS id FROM documents)")
def availability_outcomes(spark, sf):
    rows = document_items(spark, sf)
    probe = rows.where("doc_id % 11 <> 0").select("id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))
    seen = availability.check_receipts(rows, probe, "id", 9.0)
    r = F.col("availability")
    keep = (F.col("doc_id") % 5 != 0) | (F.col("doc_id") % 7 == 0) | (F.col("doc_id") % 11 == 0)
    return availability.outcomes(seen.withColumn("availability", F.when(keep, r))).select("id", "outcome")


METHODS = "(SELECT l_linenumber, l_orderkey, ['http-get','compiled','synthesized','feed','search-lead','ocr','registry'][1 + l_orderkey % 7] AS method, l_linenumber % 2 = 0 AS has_inputs FROM lineitem)"


@query(f"SELECT method, has_inputs, CASE WHEN method IN ('compiled','synthesized') THEN 'derived' WHEN method IN ('http-get','feed','ocr') THEN 'direct' ELSE 'unknown' END AS directness, CASE WHEN method IN ('compiled','synthesized') THEN has_inputs WHEN method IN ('http-get','feed','ocr') THEN NOT has_inputs ELSE true END AS consistent, count(*)::BIGINT AS n FROM {METHODS} GROUP BY ALL")
def method_ladder(spark, sf):
    li = table(spark, sf, "lineitem")
    names = F.array(*map(F.lit, ("http-get", "compiled", "synthesized", "feed", "search-lead", "ocr", "registry")))
    rows = li.select(F.get(names, (F.col("l_orderkey") % 7).cast("int")).alias("method"), (F.col("l_linenumber") % 2 == 0).alias("has_inputs"))
    return rows.groupBy("method", "has_inputs", checks.directness(F.col("method")).alias("directness"), checks.consistent(F.col("method"), F.col("has_inputs")).alias("consistent")).agg(F.count(F.lit(1)).alias("n"))


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", F.col("turn").cast("string").alias("id"), F.col("role").alias("title"), "text", F.lit("chat").alias("source"), canon.sha256(F.col("text")).alias("sha256"))


STRIP = r"regexp_replace(text, '^[\s]+|[\s]+$', '', 'g')"


@query(f"WITH s AS (SELECT conv_id, 'Summarise' || chr(10) || string_agg('- ' || role || ': ' || {STRIP}, chr(10) ORDER BY turn) AS statement, list(sha256(text) ORDER BY turn) AS d FROM conversations GROUP BY conv_id) SELECT conv_id, substring(sha256(statement), 1, 16) AS id, sha256(statement) AS sha256, array_to_string(d, ',') AS inputs, 'Summarise' AS title, 'compiled' AS method FROM s")
def compile_synthesis(spark, sf):
    made = derive.compiled(_turns(spark, sf), "conv_id", "turn", "Summarise")
    rows = derive.derived_items(made, "conv_id", fetched_at=1.0, ref=F.lit("synthesis"), title=F.lit("Summarise"))
    return rows.select("conv_id", "id", "sha256", F.array_join("derived_from", ",").alias("inputs"), "title", "method")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, sha256('Answer' || chr(10) || 'Sources:' || chr(10) || string_agg('- ' || role || ': ' || substring({STRIP}, 1, 100), chr(10) ORDER BY turn) FILTER (WHERE k <= 3) ||
CASE WHEN count(*) > 3 THEN chr(10) || '... and ' || (count(*) - 3) || ' more input(s) omitted (cap 3)' ELSE '' END) AS prompt_sha FROM r GROUP BY conv_id""")
def bounded_prompt(spark, sf):
    made = derive.compiled(_turns(spark, sf), "conv_id", "turn", "Answer", 100, 3)
    return made.select("conv_id", canon.sha256(F.col("statement")).alias("prompt_sha"))


RECORD_SQL = """'{"digest_seal": "' || seal || '", "digested": ' || kept || ', "dropped": ' || (n - kept) || ', "gathered": ' || n || ', "kept": ' || kept || ', "scope": ["license", "worthless", "ention"], "started_at": 100.0, "stored": null, "synthesized": false, "targets": [["docs", "documents"]]}'"""


@query(f"WITH {ITEMS}, j AS (SELECT {receipt_sql()} AS json FROM items WHERE {_has()}), s AS (SELECT count(*) AS kept, sha256('[' || string_agg(json, ', ' ORDER BY json) || ']') AS seal FROM j), n AS (SELECT count(*) AS n FROM items) SELECT n::BIGINT AS gathered, kept::BIGINT AS kept, (n - kept)::BIGINT AS dropped, seal AS digest_seal, sha256({RECORD_SQL}) AS seal FROM s, n")
def run_record(spark, sf):
    record, _ = runs.run([("docs", "documents", document_items(spark, sf).drop("doc_id"))], started_at=100.0, scope=TERMS)
    return record.select("gathered", "kept", "dropped", "digest_seal", "seal")


def _cores(spark, sf):
    c = table(spark, sf, "conversations")
    core = seal.core_json({"conv": ("int", F.col("conv_id")), "sha256": ("string", canon.sha256(F.col("text"))), "turn": ("int", F.col("turn"))})
    return c.withColumn("core", core)


CORE_SQL = """'{"conv": ' || conv_id || ', "sha256": "' || sha256(text) || '", "turn": ' || turn || '}'"""


@query(f"SELECT conv_id, count(*)::BIGINT AS entries, list_reduce(list_concat([''], list({CORE_SQL} ORDER BY turn)), lambda h, c: sha256(h || c)) AS root_hash FROM conversations GROUP BY conv_id")
def hash_chain(spark, sf):
    return seal.chain_root(_cores(spark, sf), "conv_id", "turn")


CHAIN_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, {CORE_SQL} AS core FROM conversations),
h AS (SELECT conv_id, turn, seq, core, sha256(core) AS entry_hash FROM t WHERE seq = 1 UNION ALL SELECT t.conv_id, t.turn, t.seq, t.core, sha256(h.entry_hash || t.core) FROM h JOIN t ON t.conv_id = h.conv_id AND t.seq = h.seq + 1)"""


@query(f"{CHAIN_SQL} SELECT conv_id, seq, entry_hash FROM h")
def chain_entries(spark, sf):
    return seal.chain_entries(_cores(spark, sf), "conv_id", "turn")


@query(f"{CHAIN_SQL}, bad AS (SELECT conv_id, min(turn) AS first_bad FROM h WHERE turn % 7 = 3 GROUP BY conv_id) SELECT c.conv_id, b.first_bad IS NULL AS ok, b.first_bad FROM (SELECT DISTINCT conv_id FROM h) c LEFT JOIN bad b USING (conv_id)")
def chain_verify(spark, sf):
    c = _cores(spark, sf)
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint")
    c = c.withColumn("seq", turn).join(seal.chain_entries(c, "conv_id", "turn"), ["conv_id", "seq"])
    forged = c.withColumn("core", F.when(F.col("turn") % 7 == 3, F.concat(F.col("core"), F.lit(" "))).otherwise(F.col("core")))
    return seal.chain_verify(forged, "conv_id", "turn")


DOI_DRESS = "CASE p_partkey % 6 WHEN 0 THEN 'https://doi.org/10.5555/P' || p_partkey WHEN 1 THEN 'doi:10.5555/p' || p_partkey || ' ' WHEN 2 THEN ' HTTP://DX.DOI.ORG/10.5555/P' || p_partkey || '/' WHEN 3 THEN '10.5555' WHEN 4 THEN '10.5555/p' || p_partkey ELSE 'not-a-doi' END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 6 IN (3, 5) THEN '' ELSE '10.5555/p' || p_partkey END AS doi, {DOI_DRESS} AS raw FROM part")
def normalize_doi(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(DOI_DRESS).alias("raw"))
    return p.withColumn("doi", urls.normalize_doi(F.col("raw")))


def _part_works(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    rows = None
    for r, provider in enumerate(("crossref", "semanticscholar", "openalex")):
        w = p.where((k + r) % 4 != 0).select(
            F.lit(provider).alias("provider"), F.lit(provider + "-api").alias("method"), F.concat(F.lit("10.5555/p"), s(k)).alias("doi"), F.concat(F.lit("10.5555/p"), s(k)).alias("key"),
            F.when((k + r) % 3 == 0, "").otherwise(F.concat(F.lit(f"{provider} "), F.col("p_name"))).alias("title"), F.when((k + r) % 5 == 0, "").otherwise(F.concat(F.lit(f"{provider} abstract "), s(k))).alias("abstract"),
            F.when((k + r) % 2 == 0, F.array(F.lit(f"{provider} author"))).otherwise(F.array().cast("array<string>")).alias("authors"), F.lit("2020").alias("year"), s(k).alias("native_id"),
            F.array(F.concat(F.lit("10.5555/p"), s(k + 1)), F.concat(F.lit("10.5555/p"), s(k + 7 + r)), F.concat(F.lit("10.5555/p"), s(k))).alias("references"),
            F.when(k % 10 == 0, F.array(F.concat(F.lit("10.5555/p"), s(k + 3)))).otherwise(F.array().cast("array<string>")).alias("citations"), (k * 10 + r).alias("seq"),
        )
        rows = w if rows is None else rows.unionByName(w)
    return rows


WORKS = "works AS (" + " UNION ALL ".join(
    f"SELECT p_partkey AS k, {2 - r} AS rank, '{p}' AS provider, '10.5555/p' || p_partkey AS doi, CASE WHEN (p_partkey + {r}) % 3 = 0 THEN '' ELSE '{p} ' || p_name END AS title, CASE WHEN (p_partkey + {r}) % 5 = 0 THEN '' ELSE '{p} abstract ' || p_partkey END AS abstract, "
    f"CASE WHEN (p_partkey + {r}) % 2 = 0 THEN '{p} author' ELSE '' END AS author, ['10.5555/p' || (p_partkey + 1), '10.5555/p' || (p_partkey + {7 + r}), '10.5555/p' || p_partkey] AS refs, CASE WHEN p_partkey % 10 = 0 THEN ['10.5555/p' || (p_partkey + 3)] ELSE []::VARCHAR[] END AS cites FROM part WHERE (p_partkey + {r}) % 4 <> 0"
    for r, p in enumerate(("crossref", "semanticscholar", "openalex"))
) + ")"


@query(f"""WITH {WORKS} SELECT doi, coalesce(first(nullif(title, '') ORDER BY rank) FILTER (WHERE title <> ''), '') AS title, coalesce(first(abstract ORDER BY rank) FILTER (WHERE abstract <> ''), '') AS abstract, coalesce(first(provider ORDER BY rank) FILTER (WHERE abstract <> ''), '') AS abstract_provider,
coalesce(first(author ORDER BY rank) FILTER (WHERE author <> ''), '') AS authors, array_to_string(list_sort(list_distinct(list(provider))), ',') AS providers, array_to_string(list(sha256(CASE WHEN abstract <> '' THEN abstract ELSE title END) ORDER BY rank), ',') AS source_hashes,
'10.5555/p' || (any_value(k) + 1) || ',' || string_agg(refs[2], ',' ORDER BY rank) FILTER (WHERE rank = 0) AS first_refs FROM works GROUP BY doi HAVING count(*) FILTER (WHERE rank = 0) > 0""")
def federate_works(spark, sf):
    f = scholar.federate(_part_works(spark, sf)).where(F.array_contains("providers", "openalex"))
    return f.select("doi", "title", "abstract", "abstract_provider", F.array_join("authors", ",").alias("authors"), F.array_join("providers", ",").alias("providers"), F.array_join("source_hashes", ",").alias("source_hashes"), F.array_join(F.slice("references", 1, 2), ",").alias("first_refs"))


EDGES = f"""WITH {WORKS}, e AS (SELECT provider, doi AS f, unnest(refs) AS t, 'references' AS direction FROM works UNION SELECT provider, unnest(cites) AS f, doi AS t, 'citations' AS direction FROM works),
r AS (SELECT DISTINCT 'citation-edge' AS kind, provider || ':' || direction || ':' || f || '->' || t AS id, f || ' -> ' || t AS title, 'scholar' AS source, provider AS ref, 'citation-edge' AS method, sha256('{{"direction": "' || direction || '", "from": "' || f || '", "provider": "' || provider || '", "to": "' || t || '"}}') AS sha256 FROM e WHERE f <> t)"""


@query(f"{EDGES} SELECT id, title, ref, sha256 FROM r")
def citation_edges(spark, sf):
    return scholar.citation_edges(_part_works(spark, sf)).select("id", "title", "ref", "sha256")


@query(f"{EDGES}, j AS (SELECT {receipt_sql()} AS json FROM r) SELECT count(*)::BIGINT AS digested, sha256('[' || string_agg(json, ', ' ORDER BY json) || ']') AS seal FROM j")
def edge_seal(spark, sf):
    return seal.seal(scholar.citation_edges(_part_works(spark, sf)))


@query(r"SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda x: x <> ''), ' ')) AS abstract_sha FROM documents")
def abstract_inversion(spark, sf):
    d = table(spark, sf, "documents")
    words = F.filter(F.split("text", r"[\x09-\x0D\x20]+"), lambda w: w != "")
    d = d.withColumn("words", words)
    # an inverted index as the graph sends it: word -> its places, one row a word of a document
    places = d.select("doc_id", F.posexplode("words").alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    whole = d.select("doc_id").join(index, "doc_id", "left")
    return whole.select("doc_id", canon.sha256(F.coalesce(text.inverted_index_text(F.col("index")), F.lit(""))).alias("abstract_sha"))


REG = """(SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN 'Bad Id' WHEN s_suppkey % 29 = 0 THEN 'src-1' ELSE 'src-' || s_suppkey END AS id, s_name AS system, 'family' || s_suppkey % 5 AS family, 'data' AS domain,
['open','key_required','rate_limited','restricted_or_registered','endpoint_alias_needed','source_lead_only','account_required','guessed'][1 + s_suppkey % 8] AS access, 'adapter' AS adapter, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'https://h' || s_suppkey || '.example/' END AS url, 'all' AS scope, ['high','medium','low','urgent'][1 + s_suppkey % 4] AS priority FROM supplier)"""


def _registry(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    return s.select(
        k.alias("k"), F.when(k % 13 == 0, "Bad Id").when(k % 29 == 0, "src-1").otherwise(F.concat(F.lit("src-"), k.cast("string"))).alias("id"), F.col("s_name").alias("system"), F.concat(F.lit("family"), (k % 5).cast("string")).alias("family"), F.lit("data").alias("domain"),
        pick((*federation.ACCESS, "guessed"), 8).alias("access"), F.lit("adapter").alias("adapter"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("https://h"), k.cast("string"), F.lit(".example/"))).alias("url"), F.lit("all").alias("scope"), pick((*federation.PRIORITIES, "urgent"), 4).alias("priority"),
    )


REG_ERR = f"""WITH g AS (SELECT *, CASE WHEN NOT regexp_full_match(id, '[a-z0-9][a-z0-9-]*') THEN 'bad id' WHEN access = 'guessed' THEN 'unknown access' WHEN priority = 'urgent' THEN 'bad priority' WHEN url = '' THEN 'empty url' END AS e FROM {REG}),
v AS (SELECT * EXCLUDE (e), CASE WHEN e IS NULL AND row_number() OVER (PARTITION BY id, e IS NULL ORDER BY k) > 1 THEN 'duplicate id' ELSE e END AS error FROM g)"""


@query(f"{REG_ERR} SELECT k, id, error FROM v")
def registry_validate(spark, sf):
    return federation.validate_registry(_registry(spark, sf), "k").select("k", "id", "error")


ROW_JSON = "'{' || " + " || ', ' || ".join(f"'\"{c}\": \"' || {c} || '\"'" for c in sorted(federation.ROW)) + " || '}'"


@query(f"{REG_ERR}, r AS (SELECT 'federation-source' AS kind, id, system || ': ' || family AS title, 'federation' AS source, url AS ref, 'registry' AS method, sha256({ROW_JSON}) AS sha256 FROM v WHERE error IS NULL), j AS (SELECT {receipt_sql()} AS json FROM r) SELECT count(*)::BIGINT AS digested, sha256('[' || string_agg(json, ', ' ORDER BY json) || ']') AS seal FROM j")
def registry_seal(spark, sf):
    return seal.seal(federation.registry_receipts(federation.validate_registry(_registry(spark, sf), "k")))


STATUS = "['VERIFIED','EMPTY_WARNING','DROPPED_WARNING','HTTP_503_WARNING','HTTP_400_QUERY_SHAPE_WARNING','HTTP_429_RATE_LIMIT_WARNING']"


@query(f"WITH s AS (SELECT user_id, list_sort(list_distinct(list({STATUS}[1 + (event_id % 6)] ) FILTER (WHERE event_id % 3 <> 1))) AS seen FROM events GROUP BY user_id) SELECT user_id, CASE WHEN seen IS NULL OR len(seen) = 0 THEN 'SOURCE_LEAD_ONLY' WHEN list_contains(seen, 'VERIFIED') AND len(seen) > 1 THEN 'VERIFIED_WITH_WARNINGS' ELSE CASE WHEN list_contains(seen, 'VERIFIED') THEN 'VERIFIED' ELSE seen[1] END END AS evidence FROM s")
def capture_status(spark, sf):
    e = table(spark, sf, "events")
    names = F.array(*map(F.lit, (*federation.CAPTURES, *federation.HTTP_CAPTURES)))
    rows = e.select("user_id", F.when(F.col("event_id") % 3 != 1, F.get(names, (F.col("event_id") % 6).cast("int"))).alias("status"))
    return federation.capture_status(rows, "user_id")


PLAN_VALUES = ", ".join("('{}', '{}', {}, {}, {})".format(k, a, str(p).lower(), len(s), len(f) + 1) for k, (a, p, s, f) in federation.PLANS.items())


@query(f"WITH p(access, action, live_probe, steps, forbids) AS (VALUES {PLAN_VALUES}) SELECT k, access, action, live_probe, steps::INTEGER AS steps, forbids::INTEGER AS forbids FROM {REG} r LEFT JOIN p USING (access)")
def capture_plans(spark, sf):
    rows = federation.compile_plans(_registry(spark, sf))
    return rows.select("k", "access", "action", "live_probe", F.when(F.col("steps").isNotNull(), F.size("steps")).alias("steps"), F.when(F.col("forbids").isNotNull(), F.size("forbids")).alias("forbids"))


CLAIMS = ["coverage", "availability", "full_text", "match", "absence"]
BASES = ["registry_size", "registry_listing", "metadata", "access_token", "empty_capture", "route_failure", "verified_capture", "exhausted_alternates"]


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH c AS (SELECT claim, basis FROM (SELECT unnest({_sql_list(CLAIMS)}) AS claim), (SELECT unnest({_sql_list(BASES)}) AS basis)), f(claim, basis, name) AS (VALUES {", ".join(f"('{a}', '{b}', '{n}')" for (a, b), n in federation.FORBIDDEN.items())}), a(claim, basis) AS (VALUES {", ".join(str(p) for p in federation.ALLOWED)})
SELECT c.claim, c.basis, a.claim IS NOT NULL AS allowed, CASE WHEN a.claim IS NULL THEN coalesce(f.name, 'denied by default') END AS refusal FROM c LEFT JOIN f USING (claim, basis) LEFT JOIN a USING (claim, basis)""")
def claim_guard(spark, sf):
    rows = spark.createDataFrame([(c, b) for c in CLAIMS for b in BASES], "claim string, basis string")
    return federation.guard_claims(rows)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'retryable_source_lead' WHEN 1 THEN 'access_escalation' WHEN 2 THEN 'retry_after' END AS verdict, CASE WHEN event_id % 9 = 0 THEN 'no capture ref' WHEN event_id % 4 = 3 THEN 'unknown failure class' WHEN event_id % 5 = 0 THEN 'superseded' END AS error FROM events""")
def policy_verdicts(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    rows = e.select("event_id", F.concat(F.lit("rule-"), k.cast("string")).alias("rule"), F.when(k % 9 == 0, "none").otherwise(canon.sha256(k.cast("string"))).alias("source_capture_ref"), F.get(F.array(*map(F.lit, ("429", "403", "503", "418"))), (k % 4).cast("int")).alias("failure_class"), (k % 5 == 0).alias("superseded"))
    return federation.validate_policy_rules(rows).select("event_id", "verdict", "error")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS l_linenumber, 'cand-' || l_partkey AS id, CASE WHEN l_suppkey % 19 = 0 THEN '' ELSE 'ror' END AS path, round(l_discount * 10, 2) AS confidence, l_quantity >= 10 AS exact FROM lineitem),
o AS (SELECT *, lag(confidence) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM c),
g AS (SELECT l_orderkey, bool_or(path = '') AS nopath, bool_and(before IS NULL OR confidence <= before) AS falls, arg_min(id, l_linenumber) AS id, arg_min(exact, l_linenumber) AS exact, arg_min(confidence, l_linenumber) AS confidence FROM o GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN NOT nopath AND falls AND exact THEN id END AS resolved, CASE WHEN NOT nopath AND falls AND exact THEN 'ror' END AS identifier_path, CASE WHEN NOT nopath AND falls AND exact THEN confidence END AS confidence, CASE WHEN nopath THEN 'no identifier path' WHEN NOT falls THEN 'not ordered by confidence' WHEN NOT exact THEN 'no exact-id join at the top' END AS error FROM g""")
def entity_resolution(spark, sf):
    li = table(spark, sf, "lineitem")
    place = (F.col("l_linenumber").cast("bigint") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("l_linenumber")
    rows = li.select("l_orderkey", place, F.concat(F.lit("cand-"), F.col("l_partkey").cast("string")).alias("candidate_id"), F.when(F.col("l_suppkey") % 19 == 0, "").otherwise("ror").alias("identifier_path"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.array(canon.sha256(F.col("l_partkey").cast("string"))).alias("evidence_refs"), (F.col("l_quantity") >= 10).alias("exact_id_join"))
    return federation.resolve_entities(rows, "l_orderkey", "l_linenumber")


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf):
    return html.titles_and_text(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "title")


@query(r"SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://([^/?#]+)', 1)) || '://' || lower(regexp_extract(url, '^([a-z]+)://([^/?#]+)', 2)) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]*)', 1) AS canonical FROM pages")
def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonicalize(F.col("url")).alias("canonical"))


@query(r"""WITH l AS (SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) AS base, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages) SELECT DISTINCT page_id, base || href AS link FROM l""")
def page_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    found = html.links(p).withColumn("links", html.scoped_links(F.col("hrefs"), F.array(urls.host(F.col("url")))))
    return found.select("page_id", F.explode("links").alias("link"))


@query()
def page_blocks(spark, sf):
    rows = html.extract(table(spark, sf, "pages").select("page_id", "html"))
    return rows.select("page_id", F.explode("blocks").alias("b")).groupBy("page_id", F.col("b.tag").alias("tag")).agg(F.count(F.lit(1)).alias("blocks"), F.min("b.sha256").alias("first_sha"))


@query()
def page_markdown(spark, sf):
    return html.markdown(table(spark, sf, "pages").select("page_id", "html")).select("page_id", canon.sha256(F.col("markdown")).alias("markdown_sha256"), F.length("markdown").cast("bigint").alias("chars"))


@query()
def html_text(spark, sf):
    return html.titles_and_text(table(spark, sf, "pages").select("page_id", "html")).select("page_id", canon.sha256(F.col("text")).alias("text_sha256"), F.length("text").cast("bigint").alias("chars"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS heading, len(regexp_extract_all(html, '<a href="(/[^"]*)"', 1))::INTEGER AS links FROM pages""")
def schema_extract(spark, sf):
    rules = [html.Rule("title", "article h1"), html.Rule("links", "nav a", attr="href", many=True)]
    rows = html.schema_extract(table(spark, sf, "pages").select("page_id", "html"), rules)
    rec = html.record()
    return rows.select("page_id", F.coalesce(F.get(rec["title"], F.lit(0)), F.lit("")).alias("heading"), F.size(rec["links"]).alias("links"))


@query()  # SQL takes over 100 s on whole tables; a test holds grounded_counts against brute force
def grounding(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.lower(F.regexp_extract("text", r"^[^\s]+\s+([^\s]+\s+[^\s]+)", 1)).alias("phrase")).where("phrase <> ''")
    d = table(spark, sf, "documents").select("doc_id", F.lower(text.norm(F.col("text"))).alias("hay"))
    return grounded_counts(d, b)


def grounded_counts(d: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows of d (doc_id, hay) each item of b (item_id, phrase) stands in.

    A phrase between word edges has its words whole and in sequence in the hay, so its first two (its only one, or '' if
    it has none) are among the hay's keys.  Documents come back by doc_id, so that long texts aren't copied to each key.
    """
    keys = d.select("doc_id", F.explode(text.word_keys(F.col("hay"))).alias("key"))
    phrases = b.select("phrase", text.first_key(F.col("phrase")).alias("key")).distinct()
    maybe = keys.join(phrases, "key").select(F.col("doc_id").alias("_id"), "phrase").distinct()
    pairs = d.join(maybe, F.col("doc_id").eqNullSafe(F.col("_id"))).where(F.contains("hay", "phrase"))
    counts = html.verify_values(pairs, "phrase").where("grounded").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return b.join(counts, "phrase").groupBy("item_id").agg(F.sum("n").alias("grounded"))


TOK = r"list_distinct(list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> ''))"


@query(f"""WITH e AS (SELECT a.doc_id, a.text AS old, b.text AS new FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 11), t AS (SELECT *, {TOK.format('substring(old, 1, 2000)')} AS x, {TOK.format('new')} AS y FROM e),
s AS (SELECT *, CASE WHEN old = new THEN 1.0::DOUBLE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS sim FROM t)
SELECT doc_id, CASE WHEN 0.55::DOUBLE * sim + 0.25::DOUBLE * 0.0::DOUBLE + 0.12::DOUBLE * 1.0::DOUBLE + 0.08::DOUBLE * 1.0::DOUBLE < 0.35 THEN 'GONE' WHEN old = new THEN 'MATCH' ELSE 'DRIFT' END AS verdict FROM s""")
def element_tracking(spark, sf):
    d = table(spark, sf, "documents")
    node = lambda c: d.select(c.alias("page"), F.lit("p").alias("tag"), F.lit("p[1]").alias("path"), F.lit(0).alias("ord"), F.create_map().cast("map<string,string>").alias("attrs"), "text", F.col("doc_id"))
    prints = tracking.fingerprints(node(F.col("doc_id")), ("page", "doc_id"))
    later = node(F.col("doc_id") - 11).drop("doc_id")
    return tracking.relocate(prints.join(later.select("page"), "page", "left_semi"), later, "doc_id", "page").select("doc_id", "verdict")


@query("SELECT event_id::VARCHAR AS id, sha256('{\"k\": ' || json_extract_string(props, '$.k') || '}') AS sha256 FROM events")
def api_records(spark, sf):
    from ..sources import payloads

    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("url"), F.col("props").alias("payload"))
    rows, _ = payloads.parse_rows(e, payloads.api(), 1.0)
    return rows.select(F.col("url").alias("id"), "sha256")


@query(r"""WITH l AS (SELECT conv_id, turn, k, trim(x, ' ' || chr(9) || chr(13)) AS line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations)),
o AS (SELECT *, lag(line) OVER (PARTITION BY conv_id ORDER BY turn, k) AS before FROM l WHERE line <> '') SELECT conv_id, count(*)::BIGINT AS lines FROM o WHERE before IS NULL OR line <> before GROUP BY conv_id""")
def caption_lines(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("k", "x")).select("conv_id", "turn", "k", text.strip(F.col("x")).alias("line")).where("line <> ''")
    before = F.lag("line").over(Window.partitionBy("conv_id").orderBy("turn", "k"))
    return c.withColumn("before", before).where("before IS NULL OR line <> before").groupBy("conv_id").agg(F.count(F.lit(1)).alias("lines"))


GRAPH = "(SELECT DISTINCT s, t FROM (SELECT i AS s, unnest([2 * i + 1, 2 * i + 2, i % 7]) AS t FROM (SELECT page_id AS i FROM pages)) WHERE t IN (SELECT page_id FROM pages))"


@query(f"WITH RECURSIVE c AS (SELECT 0::BIGINT AS page, 0 AS depth UNION SELECT g.t, c.depth + 1 FROM c JOIN {GRAPH} g ON g.s = c.page WHERE c.depth < 4) SELECT page, min(depth)::INTEGER AS depth FROM c GROUP BY page")
def crawl_bfs(spark, sf):
    return graph_crawl(spark, sf).ledger.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("page"), "depth")


@query()
def crawl_ledger(spark, sf):
    from ..operators import crawl

    return crawl.ledger_hashes(graph_crawl(spark, sf)).select("seq", "url", "depth", "content_sha256", "discovered_from", "entry_hash")


def graph_crawl(spark: SparkSession, sf_dir: str):
    """The crawl of a site with a page for each page_id i, which links to 2i + 1, 2i + 2 and i mod 7, from page 0 to depth 4.

    Three links a page make at most 121 pages to that depth, so max_pages cuts nothing off.
    """
    from ..operators import crawl

    i = F.col("page_id")
    link = lambda t: F.concat(F.lit('<a href="/'), t.cast("string"), F.lit('">page</a>'))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("http://graph.example/"), i.cast("string")).alias("url"), F.concat(link(2 * i + 1), link(2 * i + 2), link(i % 7)).alias("html"))
    return crawl.crawl(crawl.fetch_table(p), ["http://graph.example/0"], spark, max_depth=4, max_pages=122)


@query()
def stream_commits(spark, sf):
    from ..streaming.extract import batch_commits

    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "html")
    n = F.sequence(F.lit(0), F.floor(F.greatest(F.length("html") - 1, F.lit(0)) / 64).cast("int"))
    chunks = p.select("doc_id", F.explode(n).alias("seq"), "html").select("doc_id", "seq", F.substring(F.col("html"), F.col("seq") * 64 + 1, F.lit(64)).alias("chunk"))
    return batch_commits(chunks).select("doc_id", "seq", "path", "entry_hash")


@query("""SELECT doc_id, list_filter(['bad status', 'payload_sha256 is not a 64-hex digest', 'missing summary'], lambda x: (x = 'bad status' AND doc_id % 5 = 0) OR (x LIKE 'payload%' AND doc_id % 7 = 0) OR (x LIKE 'missing%' AND doc_id % 3 = 0)).len()::INTEGER + (CASE WHEN doc_id % 10 = 4 AND doc_id >= 10 THEN 1 ELSE 0 END) AS issues FROM documents""")
def bundle_validate(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        "doc_id", (k % 10).alias("bundle"), F.when(k % 10 == 4, "same").otherwise(k.cast("string")).alias("entry_id"), F.lit("o").alias("organ_id"), F.lit("r").alias("receipt_kind"), F.when(k % 5 == 0, "odd").otherwise("pass").alias("status"),
        F.when(k % 7 == 0, "zz").otherwise(canon.sha256(F.col("text"))).alias("payload_sha256"), F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise("s").alias("summary"), F.lit("p").alias("payload_ref"),
    )
    return federation.validate_bundle(d, "bundle", "doc_id").select("doc_id", F.size("issues").alias("issues"))


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN 'cache-revalidated' WHEN page_id % 3 = 1 THEN 'network' ELSE 'error: not fetched' END AS origin, CASE WHEN page_id % 3 = 0 THEN sha256(html) WHEN page_id % 3 = 1 THEN sha256(html || '!') END AS body_sha256 FROM pages")
def cache_revalidate(spark, sf):
    """Each page as a request with an entry and an answer of its own: pages can share a URL, so they go by page_id."""
    from ..operators import http

    p = table(spark, sf, "pages")
    k = F.col("page_id")
    cache = p.where(k % 3 == 0).select("page_id", F.encode("html", "UTF-8").alias("body"), F.sha2("html", 256).alias("body_sha256"))
    answers = p.where(k % 3 != 2).select("page_id", F.when(k % 3 == 0, 304).otherwise(200).alias("status"), F.when(k % 3 == 1, F.encode(F.concat("html", F.lit("!")), "UTF-8")).alias("body"))
    return http.cached_fetch(p.select("page_id", "url"), cache, answers, revalidate=True, on="page_id").select("url", "origin", "body_sha256")


@query(f"WITH {ITEMS}, twice AS (SELECT id, seq, source FROM items WHERE {_has()}) SELECT source, count(*)::BIGINT AS kept, count(DISTINCT id)::BIGINT AS receipts FROM twice GROUP BY source")
def flagship(spark, sf):
    """Documents to items, scope, receipt dedup, and counts by source."""
    kept = items.dedup_receipts(scope.filter_scope(document_items(spark, sf), TERMS))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("id").alias("receipts"))



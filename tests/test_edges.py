"""Edges over answers given by the test: credentials, feeds, graphs, search, captions, documents of rows, depth-first crawls."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from veriloom.operators import crawl, federation, html, http
from veriloom.plans import config, export
from veriloom.sources import edges, files


def served(answers, seen=None):
    """A fetch function over {url: body, or (status, body)}; other URLs can't be reached."""

    def get(url, headers=None):
        if url not in answers:
            raise OSError("unreachable")
        status, body = answers[url] if isinstance(answers[url], tuple) else (200, answers[url])
        sent = [{"k": "Content-Type", "v": "text/plain; charset=latin-1"}, {"k": "X-Sent", "v": (headers or {}).get("Authorization", "")}]
        return {"url": url, "final_url": url, "status": status, "headers": sent, "body": body.encode("latin-1"), "attempts": 1, "truncated": False}

    return get


def url_table(spark, *found):
    return spark.createDataFrame([(u,) for u in found], "url string")


def test_api_records_and_errors(spark, monkeypatch):
    monkeypatch.setenv("VERILOOM_TEST_KEY", "s3cr3t")
    answers = {"http://a/1": json.dumps({"rows": [{"id": 7, "title": "café"}, 3]}, ensure_ascii=False), "http://a/2": (500, ""), "http://a/4": "{"}
    found, bad = edges.api_items(url_table(spark, *answers, "http://a/3", "http://a/?k=s3cr3t"), "VERILOOM_TEST_KEY", 1.0, send=served(answers), items_key="rows")
    assert [(r.id, r.title, r.ref, r.method) for r in found.collect()] == [("7", "café", "http://a/1", "api-get")]
    errors = {r.url: r.error for r in bad.collect()}
    assert set(errors) == {"http://a/2", "http://a/3", "http://a/4", "http://a/?k=***"}
    assert errors["http://a/2"] == "HTTP 500" and errors["http://a/3"] == "unreachable" and errors["http://a/?k=***"] == edges.REFUSED


def test_the_credential_is_a_header(spark, monkeypatch):
    rows = edges.fetched(url_table(spark, "http://a/1"), edges.bearer("t0ken", "Token", served({"http://a/1": "{}"}))).collect()
    assert rows[0]["headers"][1] == ("X-Sent", "Token t0ken")
    monkeypatch.delenv("VERILOOM_TEST_KEY", raising=False)
    with pytest.raises(ValueError, match="VERILOOM_TEST_KEY"):
        edges.api_items(url_table(spark, "http://a/1"), "VERILOOM_TEST_KEY", 1.0)


def test_feeds_and_pages(spark):
    get = served({"http://f/": "<rss><channel><item><guid>g</guid><title>One</title></item></channel></rss>", "http://p/": "<title>P</title><p>text</p>"})
    found, bad = edges.feed_items(url_table(spark, "http://f/", "http://none/", "http://f/"), 1.0, get)
    assert [(r.id, r.text) for r in found.collect()] == [("g", "One")] and bad.count() == 1
    assert [(r.kind, r.title) for r in edges.web_items(url_table(spark, "http://p/"), 1.0, get)[0].collect()] == [("webpage", "P")]


def test_papers_by_identifier_and_by_search(spark):
    atom = '<feed><entry><id>http://arxiv.org/abs/{}</id><title>T</title></entry></feed>'
    base = "https://export.arxiv.org/api/query"
    answers = {f"{base}?id_list=2401.00001&max_results=1": atom.format("2401.00001v1"), f"{base}?search_query=all%3Agraph+colouring&start=0&max_results=10&sortBy=relevance": atom.format("2402.00002v1")}
    targets = spark.createDataFrame([("2401.00001",), ("graph colouring",), ("unknown",)], "target string")
    found, bad = edges.arxiv_items(targets, 1.0, served(answers))
    assert {(r.id, r.method) for r in found.collect()} == {("2401.00001v1", "arxiv-api-id"), ("2402.00002v1", "arxiv-api-search")} and bad.count() == 1


def test_graphs_are_federated_with_their_edges(spark):
    answers = {
        "https://api.openalex.org/works?filter=doi:10.7777%2Fx": json.dumps({"results": [{"id": "https://openalex.org/W5", "doi": "https://doi.org/10.7777/X", "title": "Open", "referenced_works": ["https://openalex.org/W6"]}]}),
        "https://api.crossref.org/works/10.7777%2Fx": json.dumps({"message": {"DOI": "10.7777/x", "title": ["Cross"], "abstract": "told"}}),
    }
    targets = spark.createDataFrame([("10.7777/x",)], "target string")
    papers, links, bad = edges.scholar_graph(targets, 1.0, served(answers))
    got = papers.collect()
    assert [(r.id, r.title, r.text, len(r.derived_from)) for r in got] == [("10.7777/x", "Open", "told", 2)]
    assert [r.id for r in links.collect()] == ["openalex:references:10.7777/x->openalex:W6"] and bad.count() == 1
    single, _, _ = edges.scholar_graph(targets, 1.0, served(answers), providers=("crossref",), federated=False)
    assert [(r.id, r.title) for r in single.collect()] == [("10.7777/x", "Cross")]
    for wrong in ((), ("elsewhere",)):
        with pytest.raises(ValueError, match="providers"):
            edges.scholar_works(targets, served({}), wrong)


def test_search_then_fetch(spark):
    results = {"results": [{"title": "A", "url": "http://r/1", "content": "s"}, {"title": "B", "url": "http://r/2"}, {"url": "http://r/3"}]}
    answers = {"http://s/search?q=a/b%20c&format=json": json.dumps(results), "http://s/search?q=empty&format=json": '{"results": []}', "http://r/1": "one", "http://r/3": "three"}
    queries = spark.createDataFrame([("a/b c",), ("empty",), ("lost",)], "query string")
    hits, told = edges.searx_hits(queries, "http://s/", served(answers))
    leads, got = edges.search_and_fetch(hits, served(answers), limit=2)
    assert sorted((r["rank"], r.url, r.snippet) for r in leads.collect()) == [(1, "http://r/1", "s"), (2, "http://r/2", "")]
    assert [(r.query, r.url, r.content_length) for r in got.collect()] == [("a/b c", "http://r/1", 3)]
    status = {r.query: (r.status, r.leads, r.ok) for r in http.search_receipts(queries, leads, "query", told).collect()}
    assert status == {"a/b c": ("searched", 2, True), "empty": ("searched", 0, True), "lost": ("UNVERIFIABLE", 0, True)}


def test_captions_of_people_before_those_of_machines(spark):
    def run(args, **_):
        target = args[-1]
        if "--dump-single-json" in args:
            return SimpleNamespace(returncode=int(target == "gone"), stdout=json.dumps({"id": target, "title": "V"}).encode(), stderr=b"no such video")
        wanted = {"both": ("--write-subs", "--write-auto-subs"), "auto": ("--write-auto-subs",)}.get(target, ())
        for flag in wanted:
            if flag in args:
                with open(args[args.index("-o") + 1].replace("%(id)s.%(ext)s", f"{target}.en.vtt"), "w") as f:
                    f.write(f"WEBVTT\n\n00:01.000 --> 00:02.000\n{flag}\n")
        return SimpleNamespace(returncode=int(target == "mute"), stdout=b"", stderr=b"refused")

    targets = spark.createDataFrame([("both",), ("auto",), ("mute",), ("gone",)], "target string")
    got = files.video_payloads(targets, run=run)
    notes = {r.target: (r.caption_error, r.error) for r in got.collect()}
    assert notes["both"] == (None, None) and notes["mute"][0].count("refused") == 2 and "no such video" in notes["gone"][1]
    rows, bad = files.video_items(got, 1.0)
    told = {(r.id, r.kind): (r.method, r.text) for r in rows.collect()}
    assert told["both", "transcript"] == ("yt-dlp", "--write-subs") and told["auto", "transcript"] == ("auto-caption", "--write-auto-subs")
    assert ("mute", "metadata") in told and ("mute", "transcript") not in told and [r.url for r in bad.collect()] == ["gone"]


def test_documents_of_rows(spark):
    rule = {"rule": "r", "source_capture_ref": "a" * 64, "failure_class": "429", "superseded": False}
    texts = [json.dumps([rule]), json.dumps({"rules": [rule | {"superseded": "no"}, 5]}), json.dumps({"rules": rule}), "[1", "7", None, "[]"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, payload string")
    rows, bad = federation.document_rows(docs, "rules", keep=("k",))
    got = {(r.k, r.pos): r.error for r in federation.validate_policy_rules(rows).collect()}
    assert got[0, 0] is None and got[1, 0] == "superseded" and got[1, 1] is not None and len(got) == 3
    assert sorted(r.k for r in bad.collect()) == [2, 3, 4, 5]
    one = {"candidate_id": "c", "identifier_path": "ror", "confidence": 1, "evidence_refs": ["b" * 64], "exact_id_join": True}
    ranking = spark.createDataFrame([(json.dumps({"candidates": [one, one | {"candidate_id": "d", "confidence": 0.5}]}),)], "payload string")
    told = export.entity_payload(federation.document_rows(ranking, "candidates")[0], "pos")
    assert told["resolution"]["resolved"] == "c" and told["digest"]["digested"] == 2
    assert export.policy_payload(federation.document_rows(docs.where("k = 0"), "rules")[0], "pos")["rules"][0]["rule"] == "r"
    with pytest.raises(ValueError, match="superseded"):
        export.policy_payload(federation.document_rows(docs.where("k = 1"), "rules")[0].where("pos = 0"), "pos")


def test_record_verdicts_name_what_is_not_there(spark):
    rows = [(1, "<p>costs $19.99 now</p>", {"price": ["$19.99"], "name": []}), (2, "<p>1000</p>", {"n": ["100"], "m": ["1000", ""]}), (3, None, {"x": ["y"]}), (4, "<p>a</p>", None)]
    got = {r.k: r for r in html.verify_record(spark.createDataFrame(rows, "k int, html string, record map<string,array<string>>")).collect()}
    assert got[1].ok and got[4].ok and not got[2].ok and not got[3].ok
    assert {(u.name, u.value) for u in got[2].ungrounded} == {("n", "100"), ("m", "")}


def depth_first(graph, seeds, max_depth, max_pages):
    stack, seen, out = [(s, 0) for s in seeds], set(), []
    while stack and len(out) < max_pages:
        url, depth = stack.pop()
        if url in seen or depth > max_depth:
            continue
        seen.add(url)
        if url in graph:
            out.append((url, depth))
            stack += [(t, depth + 1) for t in dict.fromkeys(graph[url]) if t not in seen and depth < max_depth]
    return out


@pytest.mark.parametrize("max_pages", [4, 20])
def test_depth_first_takes_the_url_found_last(spark, max_pages):
    base = "http://d.example/"
    graph = {base + str(i): [base + str(t) for t in (2 * i + 1, 2 * i + 2, i % 3, 40 + i)] for i in range(12)}
    pages = spark.createDataFrame([(u, "".join(f'<a href="{t}">x</a>' for t in ts)) for u, ts in graph.items()], "url string, html string")
    seeds = [base + "0", base + "5"]
    got = crawl.crawl(crawl.fetch_table(pages), seeds, spark, max_depth=2, max_pages=max_pages, strategy="dfs").ledger.orderBy("seq").collect()
    assert [(r.url, r.depth) for r in got] == depth_first(graph, seeds, 2, max_pages)
    with pytest.raises(ValueError, match="strategy"):
        crawl.crawl(crawl.fetch_table(pages), seeds, spark, strategy="random")


def test_envelope_and_unknown_sources(spark):
    assert export.envelope("status", native={"n": 1}) == {"schema": "operator-envelope/1", "tool": "veriloom", "command": "status", "status": "MATCH", "native": {"n": 1}, "next_actions": [], "diagnostics": []}
    with pytest.raises(ValueError, match="unknown source"):
        config.source_rows(spark, "nowhere", "x", {}, 1.0)

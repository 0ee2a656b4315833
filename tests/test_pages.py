"""Trees, Markdown, blocks, schema rules, grounding, tracking, streams, crawls."""

import random

from pyspark.sql import functions as F

from veriloom.functions.htmltree import Reader, Tree
from veriloom.operators import crawl, html, tracking
from veriloom.streaming.extract import Extractor, batch_commits, stream_commits, verify

PAGE = '<html><head><title>Doc</title></head><body><h1>Heading</h1><p>See <a href="http://e.com">link</a> <strong>bold</strong></p><ul><li>one</li><li>two</li></ul><blockquote><p>quoted</p></blockquote><pre>code</pre><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>'


def test_tree_paths_and_text():
    t = Tree("<html><body><div><p>a</p><p>Hello <b>world</b>!</p></div></body></html>")
    paths = {t.path[n]: t.text(n) for n in t.below(0)}
    assert paths["html[1]/body[1]/div[1]/p[2]"] == "Hello world!"
    assert Tree("<p>before<br>after</p>").text(0) == "before after"
    assert Tree("<div>keep<script>drop</script></div>").text(0) == "keep"


def test_unclosed_tags_nest_until_an_ancestor_closes():
    t = Tree("<div><p><b>one<br><p>two</div><p>three</p>")
    assert [t.path[n] for n in t.select("p")] == ["div[1]/p[1]", "div[1]/p[1]/b[1]/p[1]", "p[1]"]


def test_selectors():
    t = Tree('<div class="note x" id="lead"><p class="a">1</p></div><div><p>2</p></div>')
    assert len(t.select("div p")) == 2 and len(t.select("div.note#lead p")) == 1 and len(t.select("#lead.note")) == 1
    assert t.select("div > p") == [] and t.select("p[x]") == []


def test_markdown():
    md = Tree(PAGE).markdown()
    for part in ("# Heading", "[link](http://e.com)", "**bold**", "- one", "> quoted", "```\ncode\n```", "| A | B |", "| --- | --- |"):
        assert part in md


def test_reader_lines():
    assert Reader("<title>My &amp; Page</title><p>a<p>b<script>x</script><td>c</td><td>d</td>").read() == ("My & Page", "a\nb\nc\nd")


def pages(spark, **named):
    return spark.createDataFrame(list(named.items()), "url string, html string")


def test_extract_verifies_and_breaks(spark):
    rows = html.extract(pages(spark, a=PAGE, b=None))
    assert [r.ok for r in rows.select(html.verify_extract("html").alias("ok")).where("ok IS NOT NULL").collect()] == [True]
    assert rows.where("url = 'a'").first().title == "Doc"
    forged = rows.where("url = 'a'").withColumn("markdown", F.lit("x"))
    assert not forged.select(html.verify_extract().alias("ok")).first().ok


def test_links_are_absolute_scoped_and_distinct(spark):
    p = pages(spark, **{"http://s.com/x/": '<a href="/a#f">1</a><a href="../a">2</a><a href="mailto:x">3</a><a href="http://o.com/">4</a><a href="b?q=1">5</a>'})
    out = html.links(p).select(html.scoped_links(F.col("hrefs"), F.array(F.lit("s.com"))).alias("l")).first().l
    assert out == ["http://s.com/a", "http://s.com/x/b?q=1"]


def test_schema_rules(spark):
    p = pages(spark, a='<h1 class="name">Widget</h1><span class="price">$19.99 now</span><a class="link" href="/1">x</a><a class="link" href="/2">y</a>')
    rules = [html.Rule("name", "h1.name"), html.Rule("price", "span.price", regex=r"[\d.]+"), html.Rule("links", "a.link", attr="href", many=True), html.Rule("sku", "div.sku", required=True)]
    got = html.schema_extract(p, rules)
    r = got.select(html.record().alias("r"), html.missing_required().alias("m")).first()
    assert r.r == {"name": ["Widget"], "price": ["19.99"], "links": ["/1", "/2"], "sku": []} and r.m == ["sku"]
    assert html.verify_schema(got, p, "url").first().ok
    assert not html.verify_schema(got, p.withColumn("html", F.replace("html", F.lit("Widget"), F.lit("Gadget"))), "url").first().ok


def test_grounding(spark):
    p = html.haystacks(pages(spark, a="<h1>Widget</h1><b>$19.99</b><i>one</i>1000"))
    claims = p.crossJoin(spark.createDataFrame([("Widget",), ("$19.99",), ("quantum",), ("100",), ("one",)], "value string"))
    assert {r.value: r.grounded for r in html.verify_values(claims).collect()} == {"Widget": True, "$19.99": True, "quantum": False, "100": False, "one": True}


def test_grounding_counts_documents_of_every_language(spark, tmp_path):
    import re

    from veriloom.plans import queries

    texts = ["x-Alpha  beta, gamma", "alpha beta", "alphabet beta", "alpha betas", "no alpha\nbeta here", "the -- ++ signs", "a -- one", "C'est l'été ici", None, "", "alpha beta alpha beta", "été"]
    docs = [(i if i != 4 else None, t, ["en", "fr", "de", "es"][i % 4]) for i, t in enumerate(texts)] + [(1, "alpha gamma", "en")]
    items = [(0, "the Alpha beta x"), (1, "the alpha beta"), (2, "so -- ++ y"), (3, "so -- one"), (4, "quoi c'est l'été"), (5, "two words"), (6, "q no such phrase"), (7, "it alpha\tbeta"), (8, "is - --")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {}
    for i, t in items:
        m = re.match(r"\S+\s+(\S+\s+\S+)", t)
        n = sum(bool(re.search(rf"(?<!\w){re.escape(m[1].lower())}(?!\w)", " ".join((x or "").lower().split()))) for _, x, _ in docs) if m else 0
        want |= {i: n} if n else {}
    assert {r.item_id: r.grounded for r in queries.grounding(spark, str(tmp_path)).collect()} == want
    assert want[0] == want[1] == 4 and want[2] == want[3] == want[4] == 1


def test_tracking_verdicts(spark):
    old = "<div><p id='x'>alpha beta gamma</p></div>"
    cases = {"same": old, "moved": "<section><p id='x'>alpha beta gamma</p></section>", "changed": "<div><p id='x'>alpha beta delta</p></div>", "gone": "<div><span>none</span></div>"}
    prints = tracking.fingerprints(html.nodes(pages(spark, **{k: old for k in cases}), keep=("url",)).where("tag = 'p'"), ("url",)).withColumn("key", F.col("url"))
    got = tracking.relocate(prints, html.nodes(pages(spark, **cases), keep=("url",)), "key", "url").collect()
    assert {r.key: r.verdict for r in got} == {"same": "MATCH", "moved": "RELOCATED", "changed": "DRIFT", "gone": "GONE"}
    assert {r.key: r.residual for r in got}["same"] == 0.0


CHUNKS = ["<html><body><h1>Title</h1>", "<p>partial text stil", "l streaming</p><p>second</p>"]


def test_stream_commits_blocks_as_they_close():
    x = Extractor()
    assert [[c[2] for c in x.feed(chunk)] for chunk in CHUNKS] == [["h1"], [], ["p", "p"]]
    assert x.pending() == ["html", "body"]
    x.close()
    assert verify(x.ledger, x.root_hash)
    forged = [(*x.ledger[0][:3], "other", *x.ledger[0][4:]), *x.ledger[1:]]
    assert not verify(forged, x.root_hash)


def test_chunk_edges_do_not_matter(spark):
    whole = "".join(CHUNKS) + "<p>open"
    r = random.Random(3)
    rows = [("whole", 0, whole)] + [("chars", i, ch) for i, ch in enumerate(whole)]
    at = k = 0
    while at < len(whole):
        n = r.randint(1, 9)
        rows.append(("random", k, whole[at : at + n]))
        at, k = at + n, k + 1
    got = batch_commits(spark.createDataFrame(rows, "doc_id string, seq int, chunk string")).collect()
    by = {d: [(g.seq, g.path, g.entry_hash) for g in sorted(got, key=lambda g: g.seq) if g.doc_id == d] for d in ("whole", "chars", "random")}
    assert by["whole"] == by["chars"] == by["random"] and len(by["whole"]) == 3


def test_streaming_query_equals_its_batch_twin(spark, tmp_path):
    rows = [("a", i, c, i == len(CHUNKS) - 1) for i, c in enumerate(CHUNKS)]
    for k, part in enumerate((rows[:1], rows[1:2], rows[2:])):
        spark.createDataFrame(part, "doc_id string, seq int, chunk string, last boolean").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    chunks = spark.readStream.schema("doc_id string, seq int, chunk string, last boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream_commits(chunks).writeStream.format("memory").queryName("commits").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.seq, r.path, r.entry_hash) for r in spark.table("commits").collect()}
    want = {(r.seq, r.path, r.entry_hash) for r in batch_commits(spark.createDataFrame([r[:3] for r in rows], "doc_id string, seq int, chunk string")).collect()}
    assert got == want and len(got) == 3


SITE = {"http://s.com/": '<a href="/a">a</a><a href="/b">b</a>', "http://s.com/a": '<a href="/c">c</a><a href="/">home</a>', "http://s.com/b": '<a href="/c">c</a>', "http://s.com/c": "leaf"}


def site(spark):
    return crawl.fetch_table(spark.createDataFrame(list(SITE.items()), "url string, html string"))


def urls_of(state):
    return [r.url for r in state.ledger.orderBy("seq").collect()]


def test_crawl_depth_cap_and_resume(spark):
    whole = crawl.crawl(site(spark), ["http://s.com/"], spark, max_depth=2)
    assert urls_of(whole) == ["http://s.com/", "http://s.com/a", "http://s.com/b", "http://s.com/c"]
    assert len(urls_of(crawl.crawl(site(spark), ["http://s.com/"], spark, max_depth=1))) == 3
    part = crawl.crawl(site(spark), ["http://s.com/"], spark, max_pages=2)
    assert urls_of(part) == urls_of(whole)[:2]
    rest = crawl.crawl(site(spark), ["http://s.com/"], spark, max_depth=2, resume=part)
    a, b = (crawl.ledger_hashes(s).orderBy("seq").collect() for s in (whole, rest))
    assert [r.entry_hash for r in a] == [r.entry_hash for r in b]


def test_crawl_obeys_robots(spark):
    robots = spark.createDataFrame([("http", "s.com", "User-agent: *\nDisallow: /b\n")], "scheme string, host string, text string")
    assert urls_of(crawl.crawl(site(spark), ["http://s.com/"], spark, robots=robots)) == ["http://s.com/", "http://s.com/a", "http://s.com/c"]


def test_crawl_queries_run_the_crawl_operator(spark, tmp_path):
    import hashlib
    import json

    from veriloom.plans import queries

    spark.range(40).selectExpr("id AS page_id").where("page_id <> 4").write.parquet(str(tmp_path / "pages.parquet"))
    url, seen, queue = "http://graph.example/{}".format, {0: (0, "")}, [0]
    for i in queue:
        for t in (2 * i + 1, 2 * i + 2, i % 7):
            if t < 40 and t != 4 and t not in seen and seen[i][0] < 4:
                seen[t] = (seen[i][0] + 1, url(i))
                queue.append(t)
    got = queries.QUERIES["crawl_ledger"](spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.url, r.depth, r.discovered_from) for r in got] == [(url(i), *seen[i]) for i in queue]
    body = lambda i: "".join(f'<a href="/{t}">page</a>' for t in (2 * i + 1, 2 * i + 2, i % 7))
    assert [r.content_sha256 for r in got] == [hashlib.sha256(body(i).encode()).hexdigest() for i in queue]
    prior = ""
    for i, r in zip(queue, got):
        entry = {"url": r.url, "final_url": r.url, "status": 200, "depth": r.depth, "content_sha256": r.content_sha256, "discovered_from": r.discovered_from, "fetched_at": 0.0}
        prior = hashlib.sha256((prior + json.dumps(entry, sort_keys=True)).encode()).hexdigest()
        assert r.entry_hash == prior
    assert {r.page: r.depth for r in queries.crawl_bfs(spark, str(tmp_path)).collect()} == {i: d for i, (d, _) in seen.items()}

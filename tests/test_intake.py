"""Items, scope, seals, corpus, availability, derivation, runs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veriloom.functions import canon
from veriloom.operators import availability, derive, items, runs, scope, seal
from veriloom.operators.corpus import Corpus
from veriloom.operators.scope import Query


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def make(spark, rows, method="http-get", derived=None, strict=True):
    """rows: (id, text[, source, kind, method])"""
    full = [(k + 1, *r, *("web", "webpage", method)[len(r) - 2 :]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(full, "seq bigint, id string, text string, source string, kind string, method string")
    return items.make_items(df, keep=("seq",), kind=F.col("kind"), id=F.col("id"), title=F.concat(F.lit("T"), "id"), text=F.col("text"), source=F.col("source"), ref=F.concat(F.lit("r"), "id"), method=F.col("method"), fetched_at=1.0, derived_from=derived, strict=strict)


CORPUS = [("a", "about tiling and monotiles"), ("b", "group theory notes", "docs", "document", "file-read"), ("c", "tiling in crystals", "arxiv", "paper", "arxiv-api-id"), ("d", "unrelated cooking")]


def test_items_carry_the_hash_of_their_text(spark):
    row = make(spark, [("a", "alpha")]).first()
    assert row.sha256 == sha("alpha")
    assert items.catalog_rows(make(spark, [("a", "alpha")])).first().chars == 5


def test_a_direct_method_with_inputs_is_refused(spark):
    with pytest.raises(Exception, match="contradicts"):
        make(spark, [("a", "x")], derived=F.array(F.lit("h"))).collect()
    assert make(spark, [("a", "x")], derived=F.array(F.lit("h")), strict=False).first().consistent is False


def test_scope_is_an_unanchored_substring(spark):
    df = make(spark, [("a", "CARTESIAN"), ("g", "")])
    assert [r.id for r in scope.filter_scope(df, ["art"]).collect()] == ["a"]
    assert scope.filter_scope(df, []).count() == 2
    assert [r.id for r in scope.filter_scope(df, ["ta\ncart"]).collect()] == ["a"]


def reference_seal(rows):
    objs = sorted((json.dumps({k: r[k] for k in items.IDENTITY} | ({"availability": r["availability"]} if r.get("availability") else {}), sort_keys=True, ensure_ascii=False)) for r in rows)
    return sha("[" + ", ".join(objs) + "]")


def test_seal_is_that_of_sorted_canonical_json(spark):
    df = make(spark, [("a", 'x"\n'), ("b", "y é")])
    want = reference_seal([r.asDict() for r in df.collect()])
    assert seal.seal(df).first() == (2, want)
    assert seal.seal(df.orderBy(F.desc("id"))).first().seal == want
    assert seal.seal(df, small=1).first() == (2, want)
    assert seal.seal(df.withColumn("title", F.lit("z"))).first().seal != want
    assert seal.seal(df.limit(0)).first() == (0, sha("[]"))


def test_rungs_are_sealed_where_present(spark):
    df = make(spark, [("a", "x"), ("b", "y")]).withColumn("availability", F.when(F.col("id") == "a", availability.rung(F.col("text"), 9.0)))
    rows = [r.asDict(recursive=True) for r in df.collect()]
    assert seal.seal(df, "availability").first().seal == reference_seal(rows)
    assert seal.seal(df).first().seal != seal.seal(df, "availability").first().seal


def test_derivation_order_is_sealed(spark):
    one = make(spark, [("s", "sum", "synthesis", "synthesis", "synthesized")], derived=F.array(F.lit("h1"), F.lit("h2")))
    other = one.withColumn("derived_from", F.reverse("derived_from"))
    assert seal.seal(one).first().seal != seal.seal(other).first().seal


def test_corpus_adds_once_and_verifies(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/c")
    rows = make(spark, [("a", "alpha"), ("b", "beta")])
    assert c.add(rows) == {"added": 2, "deduped": 0, "total": 2}
    assert c.add(make(spark, [("a", "alpha")])) == {"added": 0, "deduped": 1, "total": 2}
    assert c.add(make(spark, [("z", "alpha")])) == {"added": 1, "deduped": 0, "total": 3}
    assert c.objects.count() == 2 and {r.status for r in c.verify().collect()} == {"MATCH"}
    assert c.digest().first().digested == 3
    assert c.load().count() == 3
    with_total = {(r.facet, r.value): (r.receipts, r.bodies) for r in c.stats().collect()}
    assert with_total["total", ""] == (3, 2)
    assert c.orphans().count() == 0 and c.prune() == {"orphans": 0, "pruned": 0}


def test_recall_filters_limits_and_skips(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/c")
    c.add(make(spark, CORPUS))
    ids = lambda q, n=None: [r.id for r in c.recall(q, n).orderBy("seq").collect()]
    assert ids(Query(terms=("tiling",))) == ["a", "c"]
    assert ids(Query(sources=("web",))) == ["a", "d"]
    assert ids(Query(terms=("tiling",), sources=("web",))) == ["a"]
    assert ids(Query(), 2) == ["a", "b"] and ids(Query(), 0) == [] and ids(Query(), -1) == []


def test_missing_and_forged_bodies(spark):
    from veriloom.operators import corpus

    rows = make(spark, CORPUS)
    catalog = rows.drop("text").withColumn("sha256", F.when(F.col("id") == "d", "../../etc/passwd").otherwise(F.col("sha256")))
    bodies = rows.where("id <> 'b'").select("sha256", F.when(F.col("id") == "c", "tiling, forged").otherwise(F.col("text")).alias("text"))
    got = {r.id: r.status for r in corpus.body_status(catalog, bodies).collect()}
    assert got == {"a": "MATCH", "b": "MISSING", "c": "CORRUPT", "d": "CORRUPT"}
    skips = {r.id: r.status for r in corpus.recall_audited(catalog, bodies, Query(terms=("tiling",))).collect()}
    assert skips == {"a": "MATCH", "b": "MISSING", "c": "CORRUPT", "d": "CORRUPT"}
    cooking = {r.id for r in corpus.recall_audited(catalog, bodies, Query(terms=("cooking",))).collect()}
    assert cooking == {"b", "d"}  # a forged body without the term is not looked at
    first = [r.id for r in corpus.recall_audited(catalog, bodies, Query(terms=("tiling",)), 1).collect()]
    assert first == ["a"]


def test_availability_outcomes(spark):
    df = make(spark, [("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")])
    probe = spark.createDataFrame([("a", "x"), ("c", "other")], "id string, text string")
    seen = availability.check_receipts(df, probe, "id", 9.0).withColumn("availability", F.when(F.col("id") != "d", F.col("availability")))
    assert {r.id: r.outcome for r in availability.outcomes(seen).collect()} == {"a": "AVAILABLE", "b": "UNAVAILABLE", "c": "CHANGED", "d": "UNWITNESSED"}


def test_compilation_and_bounded_prompt(spark):
    df = make(spark, [("a", " alpha "), ("b", "beta"), ("c", "gamma")]).withColumn("g", F.lit(1))
    made = derive.compiled(df, "g", "seq", "sum").first()
    assert made.statement == "sum\n- Ta: alpha\n- Tb: beta\n- Tc: gamma"
    assert made.derived_from == [sha(" alpha "), sha("beta"), sha("gamma")]
    short = derive.compiled(df, "g", "seq", "sum", 3, 2).first()
    assert short.statement == "sum\nSources:\n- Ta: alp\n- Tb: bet\n... and 1 more input(s) omitted (cap 2)"
    item = derive.derived_items(derive.compiled(df, "g", "seq", "sum"), "g", fetched_at=1.0, ref=F.lit("synthesis"), title=F.lit("sum")).first()
    assert item.id == sha(item.text)[:16] and item.method == "compiled"


def test_run_record_seals_its_fields(spark, tmp_path):
    store = Corpus(spark, f"file://{tmp_path}/c")
    rows = make(spark, [("a", "about tiling"), ("b", "about groups")])
    record, final = runs.run([("docs", "x", rows)], started_at=100.0, scope=("tiling",), store=store)
    r = record.first()
    assert (r.gathered, r.kept, r.dropped, r.digested) == (2, 1, 1, 1)
    fields = {"started_at": 100.0, "targets": [["docs", "x"]], "scope": ["tiling"], "gathered": 2, "kept": 1, "dropped": 1, "synthesized": False, "digested": 1, "digest_seal": r.digest_seal, "stored": {"added": 1, "deduped": 0, "total": 1}}
    assert r.seal == sha(json.dumps(fields, sort_keys=True, ensure_ascii=False))
    assert store.digest().first().seal == r.digest_seal and store.runs.count() == 1
    assert runs.verify_record(record).first().ok
    assert not runs.verify_record(record.withColumn("kept", F.lit(999))).first().ok


def test_run_compiles_what_was_kept(spark):
    _, final = runs.run([("docs", "x", make(spark, [("a", "alpha"), ("b", "beta")]))], started_at=1.0, prompt="sum")
    last = final.orderBy(F.desc("seq")).first()
    assert last.method == "compiled" and last.derived_from == [sha("alpha"), sha("beta")]


def test_chains(spark):
    df = spark.createDataFrame([(1, k, f"c{k}") for k in range(1, 6)], "g int, seq int, core string")
    h, want = "", []
    for k in range(1, 6):
        h = sha(h + f"c{k}")
        want.append(h)
    assert seal.chain_root(df, "g", "seq").first() == (1, 5, h)
    entries = seal.chain_entries(df, "g", "seq")
    assert [r.entry_hash for r in entries.orderBy("seq").collect()] == want
    whole = df.join(entries.withColumn("seq", F.col("seq").cast("int")), ["g", "seq"])
    assert seal.chain_verify(whole, "g", "seq").first() == (1, True, None)
    forged = whole.withColumn("core", F.when(F.col("seq") == 3, "x").otherwise(F.col("core")))
    assert seal.chain_verify(forged, "g", "seq").first() == (1, False, 3)


def test_sequence_numbers_in_order(spark):
    df = spark.range(0, 100, 1, 7).select((99 - F.col("id")).alias("k"))
    assert [r.seq for r in items.sequence(df, "k").orderBy("k").collect()] == list(range(1, 101))


def test_ascii_cores(spark):
    df = spark.createDataFrame([("é\U0001f600", 1.0)], "s string, x double")
    assert df.select(seal.core_json({"s": ("string", F.col("s")), "x": ("double", F.col("x"))})).first()[0] == json.dumps({"s": "é\U0001f600", "x": 1.0}, sort_keys=True)
    assert df.select(canon.sha256(F.col("s"))).first()[0] == sha("é\U0001f600")


def test_origins_are_sealed_only_where_there_are_any(spark):
    rows = make(spark, [("a", "alpha")])
    verdict = lambda df: df.withColumn("origin", F.lit('{"verdict": "ok"}'))
    r = runs.run([("docs", "x", rows)], started_at=1.0, origin=verdict)[0].first()
    fields = json.loads(r.record)
    assert fields["origins"] == [{"id": "a", "source": "web", "ref": "ra", "method": "http-get", "sha256": sha("alpha"), "origin": {"verdict": "ok"}}]
    assert r.seal == sha(json.dumps(fields, sort_keys=True, ensure_ascii=False))
    assert "origins" not in json.loads(runs.run([("docs", "x", rows)], started_at=1.0)[0].first().record)

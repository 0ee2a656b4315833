"""Stages and queries of the corpus pipeline, each stage against a version of its own in plain Python."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veriloom.llm import packing, pseudonyms, queries, toxicity

from test_operators import BASE, ROWS, brute_components, labelled, naive_best_fit, near_rows, odd, table, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_odd_rows_and_none(spark, tmp_path, k):
    spark.createDataFrame([(0, 0), (1, 1), (None, 1), (2, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd(table(spark))
    out = stage(spark, docs, str(tmp_path))
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert 0 < out.count() <= 2 * len(ROWS)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def texts_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_toxic_documents_go_and_others_stay_as_they_are(spark, tmp_path):
    docs, labels = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.withColumn("toxicity", F.lit("own")).withColumn("_toxicity", F.lit("own too"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {(r.toxicity, r._toxicity) for r in kept.collect()} == {("own", "own too")}
    model = toxicity.fit(docs, labels.where(toxicity.fold("doc_id") % 4 != 2))
    lexicon = toxicity.Lexicon(model.weights)
    want = collections.Counter((r.doc_id, r.text) for r in docs.collect() if model.scores([r.text], lexicon)[0] < corpus_pipeline.REJECT)
    assert texts_of(kept) == want and 0 < len(want) < 400


def test_near_duplicates_go(spark, tmp_path):
    rows = near_rows(40) + [(100 + i, t) for i, t in ROWS if i is not None and i != 11]
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), str(tmp_path))
    stay = {c for _, c in brute_components(rows, 5, 80).values()}
    assert texts_of(kept) == collections.Counter((i, t) for i, t in rows if i in stay)


def test_personal_values_alone_change(spark, tmp_path):
    worker = pseudonyms.Pseudonymizer(corpus_pipeline.KEY)
    kept = corpus_pipeline.hide_personal_data(spark, table(spark), str(tmp_path))
    assert texts_of(kept) == collections.Counter((i, None if t is None else worker.replace(t)[0]) for i, t in ROWS)


def test_mix_takes_whole_repetitions_and_cuts_one_a_source(spark, tmp_path):
    rows = [(i, " ".join(words(i, 10 + i))) for i in range(30)]
    docs = table(spark, rows)
    size = {i: len(t.split()) for i, t in rows}
    source = {r.doc_id: r.source for r in docs.collect()}
    totals, left = collections.Counter(), 1.5 * sum(size.values())
    for i, s in source.items():
        totals[s] += size[i]
    names = sorted(s for s in totals if s is not None) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * totals[s]]:
        for s in over:
            target[s] = 2 * totals[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken, cut = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect():
        own, whole = r.text.split(), dict(rows)[r.doc_id].split()
        assert own == whole[: len(own)]
        taken[r.source] += len(own)
        cut[r.source] += len(own) < len(whole)
    assert all(abs(taken[s] - target[s]) <= 1 and cut[s] <= 1 for s in names)


def test_packing_follows_best_fit(spark, tmp_path):
    rows = [(i, " ".join(["w"] * n)) for i, n in enumerate([5000, 4096, 3000, 900, 800, 700, 400, 90, 9, 1, 0, 12_288])] + [(20, None)]
    got = corpus_pipeline.pack(spark, table(spark, rows), str(tmp_path)).collect()
    pieces = [min(4096, n - at) for _, t in rows for n in [len((t or "").split())] for at in range(0, n, 4096)]
    want = collections.Counter((end, n) for _, end, n, _ in naive_best_fit(pieces, packing.CAPACITIES, packing.Cost()))
    held = collections.Counter()
    for r in got:
        if r.bin_id:
            held[r.bin_id, r.bin_size] += r.size
    assert collections.Counter((size, n) for (_, size), n in held.items()) == want
    assert {r.doc_id for r in got if r.bin_id is None} == {10, 20} and BASE


def test_run_packs_what_the_stages_kept(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "bin_id", "bin_size"} <= set(out.columns)
    assert out.where("size > 0").agg(F.max(F.col("bin_offset") + F.col("size") - F.col("bin_size"))).first()[0] <= 0


def test_every_operator_has_its_query():
    names = sorted(int(q[2:].split("_")[0]) for q in queries.queries())
    assert names == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())

"""A witnessed run: filter, derive, dedup, seal, store, and a sealed record of it all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from . import items as I
from .corpus import Corpus
from .derive import compiled, derived_items
from .scope import in_scope
from .seal import seal


def record_json(r: dict[str, Column], origins: Column | None = None) -> Column:
    """The sealed fields; origins only where there are any; stored is null or three counts."""
    stored = canon.object_({k: canon.integer(r["stored"][k]) for k in ("added", "deduped", "total")})
    fields: dict = {
        "started_at": canon.floating(r["started_at"], exact=True),  # one row, and a clock may have all its digits
        "targets": canon.array(F.transform(r["targets"], lambda t: canon.strings(F.array(t["source"], t["target"])))),
        "scope": canon.strings(r["scope"]),
        **{k: canon.integer(r[k]) for k in ("gathered", "kept", "dropped", "digested")},
        "synthesized": canon.boolean(r["synthesized"]),
        "digest_seal": canon.string(r["digest_seal"]),
        "stored": F.when(r["stored"].isNull(), F.lit("null")).otherwise(stored),
    }
    if origins is not None:
        fields["origins"] = (F.size(origins) > 0, canon.array(origins))
    return canon.object_(fields)


def with_seal(records: DataFrame) -> DataFrame:
    names = ("started_at", "targets", "scope", "gathered", "kept", "dropped", "synthesized", "digested", "digest_seal", "stored")
    origins = F.col("origins") if "origins" in records.columns else None
    return records.withColumn("record", record_json({n: F.col(n) for n in names}, origins)).withColumn("seal", canon.sha256(F.col("record")))


def verify_record(records: DataFrame) -> DataFrame:
    return with_seal(records.withColumnRenamed("seal", "_was")).withColumn("ok", F.col("seal") == F.col("_was")).drop("_was")


def run(jobs: list[tuple[str, str, DataFrame]], *, started_at: float, scope: tuple[str, ...] = (), prompt: str | None = None, store: Corpus | None = None, origin: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(record, items) of jobs (source, target, item rows with seq): union, scope, optional compilation, dedup, seal.

    `origin` adds a column of that name to item rows: a provider's verdict as canonical JSON, sealed in the record with
    the item's identity, in order of seq.  A run's record is one row, so this is for runs that one row can describe.
    Counts come from one pass over the scoped union; the derived item is added after the filter and is not filtered.
    """
    union = None
    for k, (_, _, rows) in enumerate(jobs):
        tagged = rows.withColumn("job", F.lit(k))
        union = tagged if union is None else union.unionByName(tagged)
    union = I.sequence(union.withColumnRenamed("seq", "pos"), "job", "pos").drop("job", "pos")
    counts = union.agg(F.count(F.lit(1)).alias("gathered"), F.count_if(in_scope(scope)).alias("kept"))
    kept = union.where(in_scope(scope))
    made = prompt is not None and not kept.isEmpty()
    if made:
        whole = compiled(kept.withColumn("_all", F.lit(1)), "_all", "seq", prompt)
        item = derived_items(whole, "_all", fetched_at=started_at, ref=F.lit("synthesis"), title=F.lit(prompt)).drop("_all")
        kept = kept.unionByName(item.withColumn("seq", F.lit(2**62)))
    final = I.dedup_receipts(kept)
    sealed = seal(I.receipts(final))
    stored = store.add(final) if store else None
    counts_of = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in stored.items()]) if stored else F.lit(None).cast("struct<added:int,deduped:int,total:int>")
    targets = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t, _ in jobs])
    record = counts.crossJoin(sealed).select(
        F.lit(float(started_at)).alias("started_at"), targets.alias("targets"), F.array(*[F.lit(t) for t in scope]).cast("array<string>").alias("scope"), "gathered", "kept",
        (F.col("gathered") - F.col("kept")).alias("dropped"), F.lit(made).alias("synthesized"), "digested", F.col("seal").alias("digest_seal"), counts_of.alias("stored"),
    )
    if origin is not None:
        entry = canon.object_({**{c: canon.string(F.col(c)) for c in ("id", "source", "ref", "method", "sha256")}, "origin": F.coalesce(F.col("origin"), F.lit('{"error": "no verdict"}'))})
        told = origin(final).select("seq", entry.alias("entry")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry"))), lambda x: x["entry"]).alias("origins"))
        record = record.crossJoin(told)
    record = with_seal(record)
    if store:
        store.add_record(record)
    return record, final

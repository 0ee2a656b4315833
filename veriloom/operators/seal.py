"""Order-independent seals and hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon

SMALL_RECEIPTS = 100_000


def receipt_json(availability: str | None = None) -> Column:
    """The canonical JSON of a receipt row; with a rung struct<status, checked_at, sha256> where it is not null."""
    fields: dict = {c: canon.string(F.col(c)) for c in ("kind", "id", "title", "source", "ref", "method", "sha256")}
    fields["derived_from"] = canon.strings(F.col("derived_from"))
    if availability:
        a = F.col(availability)
        rung = canon.object_({"status": canon.string(a["status"]), "checked_at": canon.floating(a["checked_at"]), "sha256": canon.string(a["sha256"])})
        fields["availability"] = (a.isNotNull(), rung)
    return canon.object_(fields)


def seal_expr(json: Column) -> Column:
    """The seal as an aggregate: the group's receipt texts, sorted, as one JSON array, hashed."""
    return canon.sha256(canon.array(F.array_sort(F.collect_list(json))))


def seal(receipts: DataFrame, availability: str | None = None, small: int = SMALL_RECEIPTS) -> DataFrame:
    """One row: digested (count) and seal.

    Few receipts (checked, not assumed) are sorted in one aggregate.  More are sorted by range and streamed, one range
    after the other, through one SHA-256 in bounded memory: the hash itself is sequential.
    """
    json = receipts.select(receipt_json(availability).alias("json"))
    if json.limit(small + 1).count() <= small:
        return json.agg(F.count(F.lit(1)).alias("digested"), seal_expr(F.col("json")).alias("seal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.sha256(b"["), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h.update((b", " if n else b"") + text.encode())
                n += 1
        h.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([h.hexdigest()])], names=["digested", "seal"])

    return json.orderBy("json").coalesce(1).mapInArrow(run, "digested bigint, seal string")


def core_json(fields: Mapping[str, Column], ascii_only: bool = True) -> Column:
    """A chained entry's core: strings, whole numbers and doubles given as (kind, Column) pairs are written by kind."""
    write = {"string": lambda c: canon.string(c, ascii_only), "int": canon.integer, "double": canon.floating, "bool": canon.boolean}
    return canon.object_({k: write[kind](c) for k, (kind, c) in fields.items()})


def _ordered(order: str, core: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(core)))), lambda s: s[core])


def chain_root(df: DataFrame, by: str, order: str, core: str = "core") -> DataFrame:
    """The last hash of each chain: h = sha256(h before + core), from an empty one."""
    root = F.aggregate(F.col("_cores"), F.lit(""), lambda h, c: F.sha2(F.concat(h, c), 256))
    return df.groupBy(by).agg(_ordered(order, core).alias("_cores")).select(by, F.size("_cores").cast("bigint").alias("entries"), root.alias("root_hash"))


def chain_entries(df: DataFrame, by: str, order: str, core: str = "core") -> DataFrame:
    """Every entry's hash: one row an entry, in chain order from 1."""
    step = lambda a, c: F.concat(a, F.array(F.sha2(F.concat(F.coalesce(F.get(a, F.size(a) - 1), F.lit("")), c), 256)))
    hashes = F.aggregate(F.col("_cores"), F.array().cast("array<string>"), step)
    grouped = df.groupBy(by).agg(_ordered(order, core).alias("_cores"))
    return grouped.select(by, F.posexplode(hashes).alias("_p", "entry_hash")).select(by, (F.col("_p") + 1).cast("bigint").alias("seq"), "entry_hash")


def chain_verify(df: DataFrame, by: str, order: str, core: str = "core", entry_hash: str = "entry_hash") -> DataFrame:
    """ok and first_bad of each chain.  Each entry is checked against the recorded hash before it, so all run at once."""
    before = F.lag(entry_hash, 1, "").over(Window.partitionBy(by).orderBy(order))
    good = F.coalesce(F.sha2(F.concat(before, F.col(core)), 256) == F.col(entry_hash), F.lit(False))
    checked = df.select(by, order, good.alias("_good"))
    return checked.groupBy(by).agg(F.bool_and("_good").alias("ok"), F.min(F.when(~F.col("_good"), F.col(order))).alias("first_bad"))

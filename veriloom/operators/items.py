"""Items, receipts and their identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import canon
from ..functions.checks import consistent

IDENTITY = ("kind", "id", "title", "source", "ref", "method", "sha256", "derived_from")
ITEM = (*IDENTITY[:3], "text", "source", "ref", "method", "fetched_at", "sha256", "derived_from", "meta")


def no_inputs() -> Column:
    return F.array().cast("array<string>")


def make_items(df: DataFrame, *, kind: Column, id: Column, title: Column, text: Column, source: Column, ref: Column, method: Column, fetched_at: Column | float, derived_from: Column | None = None, meta: Column | None = None, keep: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Item rows with the hash of their text.  `strict`: a method that contradicts its inputs raises; else it is a row
    with consistent = false."""
    inputs = F.coalesce(derived_from, no_inputs()) if derived_from is not None else no_inputs()
    clock = fetched_at if isinstance(fetched_at, Column) else F.lit(float(fetched_at))
    made = {"kind": kind, "id": id, "title": title, "text": text, "source": source, "ref": ref, "method": method}
    rows = df.select(*keep, *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in made.items()], clock.cast("double").alias("fetched_at"), inputs.alias("derived_from"), F.coalesce(meta, F.lit("{}")).alias("meta") if meta is not None else F.lit("{}").alias("meta"))
    rows = rows.withColumn("sha256", canon.sha256(F.col("text")))
    ok = consistent(F.col("method"), F.size("derived_from") > 0)
    if not strict:
        return rows.select(*keep, *ITEM, ok.alias("consistent"))
    checked = F.when(ok, F.col("method")).otherwise(F.raise_error(F.concat(F.lit("method contradicts derived_from: "), F.col("method"))).cast("string"))
    return rows.withColumn("method", checked).select(*keep, *ITEM)


def receipts(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return items.select(*keep, *IDENTITY)


def catalog_rows(items: DataFrame) -> DataFrame:
    return items.select("kind", "id", "title", "source", "ref", "method", "sha256", F.length("text").cast("bigint").alias("chars"), "fetched_at")


def intact(text: str | Column = "text", sha: str | Column = "sha256") -> Column:
    text, sha = (F.col(c) if isinstance(c, str) else c for c in (text, sha))
    return F.coalesce(canon.sha256(text) == sha, F.lit(False))


def dedup_receipts(items: DataFrame, order: str = "seq") -> DataFrame:
    """The first row in `order` of each identity; distinct identities all stay.

    A null `order` comes after all others; rows of one identity that tie go by a hash of their other columns.  It is one
    aggregate with partial results, so that an identity with very many rows is not gathered.
    """
    others = [c for c in items.columns if c not in IDENTITY]
    known = [c for c in others if not isinstance(items.schema[c].dataType, MapType)]
    place = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("order"), F.xxhash64(*[F.col(f"`{c}`") for c in known]).alias("tie"))
    first = items.groupBy(*IDENTITY).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), place).alias("_first"))
    return first.select(*[F.col(c) if c in IDENTITY else F.col("_first").getField(c).alias(c) for c in items.columns])


def sequence(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """A running number in `order`, starting at 1, without gathering rows: sorted ranges are counted, then numbered."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.persist()
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (inside + F.col("_start")).cast("bigint")).drop("_part", "_at", "_start")

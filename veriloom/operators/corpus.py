"""A content-addressed corpus: catalog rows and distinct bodies as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import is_hash
from . import items as I
from .scope import Query, in_scope
from .seal import seal

CATALOG = "kind string, id string, title string, source string, ref string, method string, fetched_at double, sha256 string, derived_from array<string>, meta string, seq bigint"
OBJECTS = "sha256 string, text string, shard string"
RUNS = "record string, seal string, started_at double"


def fresh_receipts(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """Receipts of the batch that the catalog lacks, first of each identity by seq."""
    first = I.dedup_receipts(batch)
    same = [first[c].eqNullSafe(catalog[c]) for c in I.IDENTITY]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return first.join(catalog, on, "left_anti")


def fresh_bodies(batch: DataFrame, objects: DataFrame) -> DataFrame:
    """Distinct bodies that are not stored yet."""
    return batch.select("sha256", "text").dropDuplicates(["sha256"]).join(objects.select("sha256"), "sha256", "left_anti")


def body_status(catalog: DataFrame, objects: DataFrame) -> DataFrame:
    """Each catalog row with its body and status: MATCH, MISSING, or CORRUPT (the hash is no hash, or the body differs)."""
    bodies = objects.select(F.col("sha256").alias("_sha"), F.col("text").alias("body"))
    joined = catalog.join(bodies, catalog["sha256"] == F.col("_sha"), "left").drop("_sha")
    status = F.when(~is_hash(F.col("sha256")), F.lit("CORRUPT")).when(F.col("body").isNull(), F.lit("MISSING")).when(I.intact("body"), F.lit("MATCH")).otherwise(F.lit("CORRUPT"))
    return joined.withColumn("status", status)


def recall_audited(catalog: DataFrame, objects: DataFrame, query: Query, limit: int | None = None, keep_text: bool = True) -> DataFrame:
    """Recalled rows (status MATCH) and skipped ones (MISSING, CORRUPT), in order of seq.

    Facets are filtered before bodies are joined.  Missing bodies and bad hashes are reported whatever the terms; a body
    that differs only if it still has a term.  With a limit, rows after the last hit are not looked at: the n-th hit's
    seq is found by a top-n, and rows beyond it are cut.
    """
    if limit is not None and limit <= 0:
        catalog = catalog.limit(0)
    rows = body_status(catalog.where(query.facets()), objects)
    terms = in_scope(query.terms, "title", "body")
    always = (F.col("status") == "MISSING") | ~is_hash(F.col("sha256"))
    rows = rows.where(always | terms)
    if limit is not None and limit > 0:
        nth = rows.where("status = 'MATCH'").select("seq").orderBy("seq").limit(limit).agg(F.max("seq").alias("_last"), F.count(F.lit(1)).alias("_hits"))
        rows = rows.crossJoin(F.broadcast(nth)).where((F.col("_hits") < limit) | (F.col("seq") <= F.col("_last"))).drop("_last", "_hits")
    return rows if keep_text else rows.drop("body")


def stats(catalog: DataFrame) -> DataFrame:
    """(facet, value, n) by source, kind and method, and the totals of receipts and distinct bodies: one pass."""
    sets = catalog.groupingSets([[], ["source"], ["kind"], ["method"]], "source", "kind", "method").agg(F.count(F.lit(1)).alias("receipts"), F.countDistinct("sha256").alias("bodies"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "source").when(F.col("g") == 5, "kind").otherwise("method")
    value = F.when(F.col("g") == 3, F.col("source")).when(F.col("g") == 5, F.col("kind")).when(F.col("g") == 6, F.col("method")).otherwise(F.lit(""))
    return sets.select(facet.alias("facet"), value.alias("value"), "receipts", "bodies")


def orphans(objects: DataFrame, catalog: DataFrame) -> DataFrame:
    return objects.select("sha256").join(catalog.select("sha256"), "sha256", "left_anti").distinct()


class Corpus:
    """Tables catalog, objects and runs under one folder; every write is an append committed by Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str = ""):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _read(self, name: str, schema: str) -> DataFrame:
        fs, target = self._fs(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if fs.exists(target) else self.spark.createDataFrame([], schema)

    def _generations(self) -> list[int]:
        """Numbers of the whole folders of bodies: the first one, and those that a prune has finished."""
        fs, top = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        later = [int(n[8:]) for n in names if n.startswith("objects-") and n[8:].isdigit()]
        return [0, *sorted(n for n in later if fs.exists(self._fs(f"objects-{n}/_SUCCESS")[1]))]

    @staticmethod
    def _folder(generation: int) -> str:
        return f"objects-{generation}" if generation else "objects"

    @property
    def rows(self) -> DataFrame:
        return self._read("catalog", CATALOG)

    @property
    def objects(self) -> DataFrame:
        return self._read(self._folder(self._generations()[-1]), OBJECTS)

    @property
    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def add(self, items: DataFrame) -> dict[str, int]:
        """Store item rows (seq gives their order); bodies first, then receipts.  Re-adding adds nothing.

        The rows are written to a folder of this call first, so that bodies, receipts and counts are of the same rows
        however they were made.
        """
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        items.write.parquet(staged)
        try:
            return self._add(self.spark.read.schema(items.schema).parquet(staged))
        finally:
            fs, target = self._fs(staged.rpartition("/")[2])
            fs.delete(target, True)

    def _add(self, items: DataFrame) -> dict[str, int]:
        catalog = self.rows
        bodies = fresh_bodies(items, self.objects).withColumn("shard", F.substring("sha256", 1, 2)).repartition("shard")  # a file a shard and task, not a shard in every task
        bodies.write.mode("append").partitionBy("shard").parquet(f"{self.path}/{self._folder(self._generations()[-1])}")
        top = catalog.agg(F.max("seq")).first()[0] or 0
        new = fresh_receipts(items, catalog).withColumn("seq", F.col("seq") + F.lit(top)).drop("text")
        before = catalog.count()
        new.select(*[c.split()[0] for c in CATALOG.split(", ")]).write.mode("append").parquet(f"{self.path}/catalog")
        total, given = self.rows.count(), items.count()
        return {"added": total - before, "deduped": given - (total - before), "total": total}

    def load(self) -> DataFrame:
        return body_status(self.rows, self.objects).where("status = 'MATCH'").withColumnRenamed("body", "text").drop("status")

    def verify(self) -> DataFrame:
        return body_status(self.rows, self.objects).drop("body")

    def digest(self) -> DataFrame:
        return seal(self.rows)

    def stats(self) -> DataFrame:
        return stats(self.rows)

    def recall(self, query: Query, limit: int | None = None) -> DataFrame:
        return recall_audited(self.rows, self.objects, query, limit).where("status = 'MATCH'")

    def recall_audited(self, query: Query, limit: int | None = None) -> DataFrame:
        return recall_audited(self.rows, self.objects, query, limit)

    def add_record(self, record: DataFrame) -> None:
        record.select(*[c.split()[0] for c in RUNS.split(", ")]).write.mode("append").parquet(f"{self.path}/runs")

    def orphans(self) -> DataFrame:
        return orphans(self.objects, self.rows).orderBy("sha256")

    def prune(self, apply: bool = False) -> dict:
        """Report orphan bodies; delete them only with `apply`, and never while the catalog is empty but bodies exist.

        What stays is written to the next folder of bodies, which counts from when Spark marks it as finished; only then
        do the folders before it go.  A prune that ends halfway so loses nothing.
        """
        objects, rows = self.objects, self.rows
        gone = self.orphans()
        n = gone.count()
        if not apply or not n:
            return {"orphans": n, "pruned": 0}
        if rows.isEmpty():
            raise ValueError("the catalog is empty but bodies exist: nothing is pruned")
        kept = objects.join(rows.select("sha256"), "sha256", "left_semi")
        before = self._generations()
        kept.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/{self._folder(before[-1] + 1)}")
        for generation in before:
            fs, target = self._fs(self._folder(generation))
            fs.delete(target, True)
        return {"orphans": n, "pruned": n}



"""Availability rungs: what a later look at a source observed, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.checks import is_hash


def rung(observed_text: Column, checked_at: float) -> Column:
    """AVAILABLE with the hash of what was seen; UNAVAILABLE (null text) with no hash."""
    return F.struct(
        F.when(observed_text.isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("status"),
        F.lit(float(checked_at)).alias("checked_at"),
        F.coalesce(canon.sha256(observed_text), F.lit("")).alias("sha256"),
    )


def well_formed(r: Column) -> Column:
    bound = F.when(r["status"] == "AVAILABLE", is_hash(r["sha256"])).when(r["status"] == "UNAVAILABLE", r["sha256"] == "")
    return r.isNotNull() & r["checked_at"].isNotNull() & F.coalesce(bound, F.lit(False))


def checked_rung(r: Column) -> Column:
    return F.when(r.isNull() | well_formed(r), r).otherwise(F.raise_error(F.lit("malformed availability rung")).cast("struct<status:string,checked_at:double,sha256:string>"))


def assess(r: Column, sha256: Column) -> Column:
    return F.when(~well_formed(r), "UNWITNESSED").when(r["status"] == "UNAVAILABLE", "UNAVAILABLE").when(r["sha256"] == sha256, "AVAILABLE").otherwise("CHANGED")


def check_receipts(rows: DataFrame, probe: DataFrame, on: str, checked_at: float) -> DataFrame:
    """Receipt rows with a rung from a probe table (`on`, text); rows that it lacks are unavailable."""
    seen = probe.select(F.col(on), F.col("text").alias("_seen"))
    return rows.join(seen, on, "left").withColumn("availability", rung(F.col("_seen"), checked_at)).drop("_seen")


def stored_probe(objects: DataFrame) -> DataFrame:
    """The stored bodies as a probe on sha256."""
    return objects.select("sha256", "text")


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("outcome", assess(F.col("availability"), F.col("sha256")))

"""Shape checks and the method ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registered method labels.
DIRECT = (
    "yt-dlp", "auto-caption", "http-get", "file-read", "feed", "arxiv-api", "arxiv-api-id", "arxiv-api-search", "pdftotext",
    "api-get", "ocr", "transcribe", "browser-extract", "browser-evidence", "openalex-api", "semanticscholar-api", "crossref-api", "citation-edge",
)
DERIVED = ("compiled", "synthesized")


def is_hash(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def is_slug(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[a-z0-9][a-z0-9-]*\z"), F.lit(False))


def is_unit(c: Column) -> Column:
    return F.coalesce(c.between(0.0, 1.0), F.lit(False))


def directness(method: Column) -> Column:
    return F.when(method.isin(*DERIVED), F.lit("derived")).when(method.isin(*DIRECT), F.lit("direct")).otherwise(F.lit("unknown"))


def consistent(method: Column, has_inputs: Column) -> Column:
    """A derived method has inputs, a direct one has none, an unknown one makes no claim."""
    d = directness(method)
    return F.when(d == "derived", has_inputs).when(d == "direct", ~has_inputs).otherwise(F.lit(True))

"""Derived items: compiled statements, bounded prompts, and the chain back to their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.text import strip
from .items import make_items


def _head() -> Column:
    t = strip(F.col("title"))
    return F.when(t != "", t).otherwise(F.concat(F.col("source"), F.lit(":"), F.col("id")))


def _ordered(column: str, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(column)))), lambda s: s[column])


def compiled(items: DataFrame, by: str, order: str, prompt: str, max_chars: int | None = None, max_inputs: int | None = None) -> DataFrame:
    """One statement a group: the prompt, then `- head: text` of each input in order.

    With max_inputs it is a bounded prompt: "Sources:" follows the prompt, texts are cut, and what is left out is noted.
    Its input count bounds a group's line list; without, a group is a conversation or a kept set that one row can hold.
    """
    text = strip(F.col("text"))
    rows = items.withColumn("_line", F.concat(F.lit("- "), _head(), F.lit(": "), text if max_chars is None else F.substring(text, 1, max_chars)))
    grouped = rows.groupBy(by).agg(_ordered("_line", order).alias("_lines"), _ordered("sha256", order).alias("derived_from"))
    lead = [F.lit(prompt.strip())] if prompt.strip() else []
    if max_inputs is None:
        lines = F.col("_lines")
    else:
        lead.append(F.lit("Sources:"))
        over = F.size("_lines") - max_inputs
        note = F.concat(F.lit("... and "), over.cast("string"), F.lit(f" more input(s) omitted (cap {max_inputs})"))
        lines = F.concat(F.slice("_lines", 1, max_inputs), F.when(over > 0, F.array(note)).otherwise(F.array().cast("array<string>")))
    parts = F.concat(F.array(*lead), lines) if lead else lines
    return grouped.select(by, F.array_join(parts, "\n").alias("statement"), "derived_from")


def derived_items(statements: DataFrame, by: str, *, fetched_at: float, ref: Column, title: Column, method: str = "compiled", kind: str = "synthesis", source: str = "synthesis", id: Column | None = None) -> DataFrame:
    """Items from statements: the id is the statement's hash prefix, derived_from the inputs' hashes in order."""
    return make_items(statements, keep=(by,), kind=F.lit(kind), id=id if id is not None else F.substring(canon.sha256(F.col("statement")), 1, 16), title=F.when(title != "", title).otherwise(ref), text=F.col("statement"), source=F.lit(source), ref=ref, method=F.lit(method), fetched_at=fetched_at, derived_from=F.col("derived_from"))

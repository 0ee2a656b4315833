"""Scope terms and recall facets, compiled to predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(terms: list[str] | tuple[str, ...], title: str = "title", text: str = "text") -> Column:
    """Any term is a substring of title + newline + text, letters compared in lower case; no terms: all rows."""
    hay = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))
    found = F.lit(not terms)
    for t in terms:
        found = found | F.contains(hay, F.lower(F.lit(t)))
    return found


def filter_scope(items: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    return items.where(in_scope(terms))


def scope_counts(items: DataFrame, terms: list[str] | tuple[str, ...], *by: str) -> DataFrame:
    kept = in_scope(terms)
    return items.groupBy(*by).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()

    def facets(self) -> Column:
        """Or within a facet, and across facets; an empty facet lets all pass.  Reaches the Parquet scan as IN filters."""
        found = F.lit(True)
        for column, values in (("source", self.sources), ("kind", self.kinds), ("method", self.methods)):
            if values:
                found = found & F.col(column).isin(*values)
        return found

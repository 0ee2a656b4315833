"""Element tracking: fingerprints, scores, and relocation on the same tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.text import jaccard, tokens

FLOOR, SAMPLE = 0.35, 2000


def classes(attrs: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), lambda c: c != ""))


def fingerprints(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each node row (tag, path, attrs, text): what relocation needs, with a bounded sample of the text."""
    a = F.col("attrs")
    return nodes.select(*keep, "tag", F.coalesce(a["id"], F.lit("")).alias("node_id"), classes(a).alias("classes"), "path", canon.sha256(F.col("text")).alias("text_sha256"), F.length("text").cast("bigint").alias("text_len"), F.substring("text", 1, SAMPLE).alias("sample"))


def text_similarity(sha: Column, sample: Column, text: Column) -> Column:
    return F.when(canon.sha256(text) == sha, F.lit(1.0)).otherwise(jaccard(tokens(sample), tokens(text)))


def score(similarity: Column, same_id: Column, class_similarity: Column, same_path: Column) -> Column:
    return F.lit(0.55) * similarity + F.lit(0.25) * F.when(same_id, 1.0).otherwise(0.0) + F.lit(0.12) * class_similarity + F.lit(0.08) * F.when(same_path, 1.0).otherwise(0.0)


def relocate(prints: DataFrame, nodes: DataFrame, key: str, page: str, floor: float = FLOOR) -> DataFrame:
    """verdict, residual, score and found path of each fingerprint (key) among its page's nodes (ord gives their order).

    Candidates have the same page and tag; the best score wins, the first in order among equals.  The maximum is a
    partial aggregate over one struct, so candidates are never sorted or gathered.
    """
    c = nodes.select(F.col(page), "tag", F.col("ord").alias("c_ord"), F.col("path").alias("c_path"), F.coalesce(F.col("attrs")["id"], F.lit("")).alias("c_id"), classes(F.col("attrs")).alias("c_classes"), F.col("text").alias("c_text"))
    pairs = prints.join(c, [page, "tag"], "left")
    sim = text_similarity(F.col("text_sha256"), F.col("sample"), F.col("c_text"))
    pairs = pairs.withColumn("sim", sim)
    s = score(F.col("sim"), (F.col("node_id") != "") & (F.col("node_id") == F.col("c_id")), jaccard(F.col("classes"), F.col("c_classes")), F.col("c_path") == F.col("path"))
    best = F.max(F.struct(s.alias("score"), (-F.col("c_ord")).alias("o"), F.col("c_path").alias("path"), canon.sha256(F.col("c_text")).alias("sha"), F.col("sim").alias("sim")))
    g = pairs.groupBy(key).agg(best.alias("b"), F.count("c_ord").alias("candidates"), F.first("path").alias("old_path"), F.first("text_sha256").alias("old_sha"))
    gone = F.col("b.score").isNull() | (F.col("b.score") < floor)
    same = F.col("b.sha") == F.col("old_sha")
    verdict = F.when(gone, "GONE").when(same & (F.col("b.path") == F.col("old_path")), "MATCH").when(same, "RELOCATED").otherwise("DRIFT")
    residual = F.when(gone, 1.0).when(same, 0.0).otherwise(1.0 - F.col("b.sim"))
    blank = lambda x: F.when(gone, F.lit("")).otherwise(x)
    return g.select(key, verdict.alias("verdict"), F.round(residual, 6).alias("residual"), F.round(F.greatest(F.coalesce("b.score", F.lit(0.0)), F.lit(0.0)), 6).alias("score"), blank(F.col("b.path")).alias("found_path"), blank(F.col("b.sha")).alias("found_text_sha256"), "candidates")

"""Mixing sources to target weights: capped water-filling, then seeded repetitions (native)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096  # a source is dealt to seeded buckets of about so many rows; a bucket, not a source, is what one task orders


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _ranked(sizes: DataFrame) -> DataFrame:
    """`sizes` with rank0, the place of (src_null, src): sorted ranges, counted, and numbered each on their own."""
    ranges = materialize(sizes.repartitionByRange("src_null", "src").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = {r["part"]: r["count"] for r in ranges.groupBy("part").count().collect()}
    starts = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=0)))]
    start = F.expr(f"get(CAST(split('{','.join(map(str, starts))}', ',') AS ARRAY<BIGINT>), part)")
    return ranges.withColumn("rank0", start + F.row_number().over(Window.partitionBy("part").orderBy("src_null", "src")) - 1).drop("part")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget_ratio: float, max_epochs: int) -> DataFrame:
    """Targets by water-filling over (src_null, src, source_size) rows, one a source.

    Sources whose share is `max_epochs` times their size or more are clamped there, and what they leave is shared by weight
    among the others, until none is above.  Each round is one aggregate; no task holds all sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank0") % len(weights) + 1).cast("int"))
    ranked = _ranked(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ranked = materialize(ranked, "mix-weights")
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, every = float(total["size"] or 0) * budget_ratio, total["weight"] or 0.0
    spent = closed = 0.0
    clamped = F.lit(False)
    while closed < every:
        clamped = F.col("cap") <= F.col("weight") * F.lit((budget - spent) / (every - closed))
        now = ranked.where(clamped).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        if (now["weight"] or 0.0) == closed:
            break
        spent, closed = now["cap"], now["weight"]
    share = F.col("weight") * F.lit(budget - spent) / F.lit(every - closed) if closed < every else F.col("cap")
    return ranked.select("src_null", "src", "source_size", F.when(clamped, F.col("cap")).otherwise(share).alias("target"))


def mix_to_targets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget_ratio: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix-1",
    carry: bool = False,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, whole, extra (and `row` with `carry`).

    `size` counts words of the whole text.  Each document is repeated `whole` times; then, in seeded order, documents
    take one repetition more until the source has its target; the last of them takes only the words still missing
    (`extra`), so a source's taken words equal its rounded target.  A null text or one without words has size 0 and
    takes 0; a null source is a source of its own, after all others; an empty table gives no rows; repeated rows count
    each; other columns are ignored, whatever their names, but all are in the struct `row` with `carry`.
    """
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    whole_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    wide = docs.select(
        *whole_row,
        F.col(id_col).alias("doc_id"),
        F.col(source_col).isNull().alias("src_null"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        h.alias("h"),
    )
    slim = materialize(wide.drop("row"), "mix-sizes")
    n, digits = slim.count(), 1
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    wide, slim = (df.withColumn("bucket", F.substring("h", 1, digits)) for df in (wide, slim))
    by_bucket = slim.groupBy("src_null", "src", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(by_bucket.groupBy("src_null", "src").agg(F.sum("bucket_size").alias("source_size")), weights, budget_ratio, max_epochs)
    earlier = Window.partitionBy("src_null", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    plan = (
        starts.join(targets, ["src_null", "src"])
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("more", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size"))
        .drop("bucket_size")
    )
    inside = Window.partitionBy("src_null", "src", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (wide if carry else slim).join(plan, ["src_null", "src", "bucket"]).withColumn("before", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - F.col("before")))
    return placed.withColumn("extra", extra.cast("bigint")).select(
        "doc_id",
        F.when(~F.col("src_null"), F.col("src")).alias("source"),
        "size",
        F.col("source_size").cast("bigint").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
        F.col("whole").cast("bigint").alias("whole"),
        "extra",
        *(["row"] if carry else []),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix itself, in the columns of `docs`: a row for each repetition; the last of a source may be cut.

    Documents without words are taken nowhere.  A cut repetition has the first `extra` words of its text, and the
    number of its characters in `chars_col` where there is such a column.
    """
    placed = mix_to_targets(docs, text_col=text_col, carry=True, **how).where("taken > 0")
    times = F.sequence(F.lit(1).cast("bigint"), F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0))
    each = placed.withColumn("time", F.explode(times))
    cut = (F.col("time") > F.col("whole")) & (F.col("extra") < F.col("size"))
    text = F.when(cut, first_words(F.col("row").getField(text_col), F.col("extra"))).otherwise(F.col("row").getField(text_col))
    each = each.withColumn("cut", cut).withColumn("new_text", text)

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == text_col:
            return F.col("new_text").alias(c)
        if c == chars_col:
            return F.when(F.col("cut"), F.char_length("new_text").cast(docs.schema[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return each.select(*[column(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM src),
levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM ranked),
flagged AS (SELECT *, cap <= weight * ((budget - cap_before) / (weights - weight_before)) AS clamped FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap ELSE
    weight * (budget - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0)) / (weights - coalesce(sum(CASE WHEN clamped THEN weight END) OVER (), 0)) END AS target
  FROM flagged),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.*, p.source_size, p.target, p.whole, floor(p.target + 0.5)::BIGINT - p.whole * p.source_size AS more,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM slim s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target,
  (whole * size + greatest(0, least(size, more - before)))::BIGINT AS taken, whole, greatest(0, least(size, more - before))::BIGINT AS extra
FROM placed
"""

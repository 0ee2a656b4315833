"""I-Match document fingerprints over randomised lexicons (native)."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FIRST_KEY = -(2**63)
RANGE_BYTES = 128 << 20  # text that one task orders at most, where keys differ
TERM_HASHES = "array_distinct(transform(filter(split(lower(coalesce({0}, '')), '" + SEPARATORS.replace("\\", "\\\\") + "'), t -> t != ''), t -> xxhash64(t)))"


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body` with a value named that it uses more than once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _literal(values: list[int], kind: str) -> str:
    return f"CAST(split('{','.join(map(str, values))}', ',') AS ARRAY<{kind}>)"


@dataclass(frozen=True)
class IMatch:
    """Terms with low <= df / documents <= high and df >= 2 are the lexicon; randomised subsets of it are what texts are
    hashed over.

    Subset (seed, level) keeps a share of 2**-level of the lexicon, by a seeded hash of the term.  As documents hold `m`
    distinct terms on average, at most m / low terms can reach `low`: the lexicon does not grow with the corpus.  It is
    a table of 2**bits buckets, sized by its number of terms, with the hashes of its terms, the only thing sent to
    executors.
    """

    low: float = 0.005
    high: float = 0.2
    seeds: int = 6
    levels: int = 8
    bits: int = 0
    slots: int = 1
    table: tuple[int, ...] = (0,)

    def fit(self, docs: DataFrame, text_col: str = "text") -> "IMatch":
        """Document frequencies over every document; only the lexicon's hashes come to the driver."""
        n = docs.count()
        df = docs.select(F.explode(F.expr(TERM_HASHES.format(f"`{text_col}`"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        kept = df.where((F.col("df") >= 2) & (F.col("df") >= F.lit(self.low * n)) & (F.col("df") <= F.lit(self.high * n)))
        return self.of([r["h"] for r in kept.select("h").collect()])

    def of(self, hashes: list[int]) -> "IMatch":
        bits = max(0, (2 * len(hashes) - 1).bit_length())
        buckets: list[list[int]] = [[] for _ in range(1 << bits)]
        for h in sorted(hashes):
            buckets[h & ((1 << bits) - 1)].append(h >> 32)
        slots = max(1, max(map(len, buckets)))
        table = tuple(mark for b in buckets for mark in (*b, *[0] * (slots - len(b))))
        return IMatch(self.low, self.high, self.seeds, self.levels, bits, slots, table)

    def _known(self, table: str, h: str) -> str:
        """Whether the hash is in its bucket; a bucket is filled from its first slot."""
        mark, at = f"CAST(shiftright({h}, 32) AS INT)", f"CAST({h} & {(1 << self.bits) - 1}L AS INT) * {self.slots}"
        out = "false"
        for j in reversed(range(self.slots)):
            slot = f"get({table}, {at} + {j})"
            out = f"({slot} = {mark} OR ({slot} != 0 AND {out}))"
        return out

    def _subsets(self, ranks: str, seed: int, level: int = 1) -> str:
        """Hashes of the ranks that each level keeps, in their order; null where it keeps none."""
        if level > self.levels:
            return "CAST(array() AS ARRAY<BIGINT>)"
        own = f"s{level}"
        body = f"concat(array(CASE WHEN size({own}) > 0 THEN xxhash64({own}, {seed}L) END), {self._subsets(own, seed, level + 1)})"
        return _let(f"filter({ranks}, v -> v < {1 << (63 - level)}L)", own, body)

    def fingerprint(self, text: str) -> Column:
        """array<bigint> for the text in the column so named: the hash of its sorted distinct terms of the band, then one
        for each randomised lexicon over those that the lexicon keeps (null where it keeps none).

        Where no term is in the band, the first hash is over all distinct terms, so that only texts of the same terms
        agree; a text without terms has nulls alone.
        """
        ranks = [_let(f"transform(b, h -> shiftrightunsigned(xxhash64(h, {seed}L), 1))", "r", self._subsets("r", seed)) for seed in range(self.seeds)]
        whole = "CASE WHEN size(b) > 0 THEN xxhash64(b, -1L) WHEN size(d) > 0 THEN xxhash64(array_sort(d), -2L) END"
        band = _let(_literal(list(self.table), "INT"), "x", f"array_sort(filter(d, h -> {self._known('x', 'h')}))")
        return F.expr(_let(TERM_HASHES.format(f"`{text}`"), "d", _let(band, "b", f"concat(array({whole}), {', '.join(ranks)})")))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing hashes among the lexicons that keep a term of either text; two texts without terms are alike."""
    used = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"] == p["b"]))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used).cast("double")


def as_text(fp: Column) -> Column:
    """Hexadecimal hashes joined by -, nothing for a lexicon without terms; '' for a text without any."""
    joined = F.array_join(F.transform(fp, lambda v: F.coalesce(F.lower(F.hex(v)), F.lit(""))), "-")
    return F.when(F.exists(fp, lambda v: v.isNotNull()), joined).otherwise(F.lit(""))


def _last_at_most(values: list[int], k: str) -> str:
    """SQL for the place of the last of the sorted values that is at most k, by halving steps."""
    steps = [1 << i for i in reversed(range(max(1, len(values).bit_length())))]
    return _let(_literal(values, "BIGINT"), "x", f"aggregate(array({', '.join(map(str, steps))}), 0, (a, s) -> CASE WHEN get(x, a + s) <= {k} THEN a + s ELSE a END)")


def with_next(rows: DataFrame, key: str, text: str, ranges: int | None = None, dealt=lambda rows: (rows, [])) -> DataFrame:
    """`rows` with next_<text>, the text that follows by (key, hash of the text); the first row follows the last.

    Rows are dealt to ranges of the order, whose first keys are quantiles of the table; a key with more rows than a range
    gets several, by the texts' hashes.  There are about four ranges a shuffle partition, more where they would hold over
    RANGE_BYTES.  The first row of a range is known beforehand and also sent to the range before.  No task orders more
    than its ranges; only rows that equal each other in key and text always lie in one.  A null key sorts first.
    `dealt` may add columns to dealt rows; it gives them and the names of those whose next value is wanted too.
    """
    placed = rows.withColumn("_k", F.coalesce(F.col(key).cast("bigint"), F.lit(FIRST_KEY))).withColumn("_u", F.xxhash64(text))
    slim = materialize(placed.select("_k", "_u", F.octet_length(text).cast("bigint").alias("size")), "order")
    total = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("_k").alias("lo")).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(1, (total["bytes"] or 0) // RANGE_BYTES, min(4 * parts, total["n"] // 1000))
    starts = [total["lo"] or 0]
    if ranges > 1:
        starts += slim.select(F.percentile_approx("_k", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] or []
    keys = sorted(set(starts))
    found = Counter(starts)
    many = [found[k] for k in keys]
    first = [0, *accumulate(many[:-1])]
    share = "least(m - 1, CAST(floor((CAST(_u AS DOUBLE) / 18446744073709551616D + 0.5D) * m) AS INT))"
    of = lambda values, kind="INT": f"get({_literal(values, kind)}, j)"
    own = _let(_last_at_most(keys, "_k"), "j", _let(of(many), "m", f"{of(first)} + CASE WHEN _k > {of(keys, 'BIGINT')} THEN m - 1 ELSE {share} END"))
    slim = slim.withColumn("_own", F.expr(own))
    heads = {r["_own"]: r["h"] for r in slim.groupBy("_own").agg(F.min(F.struct("_k", "_u")).alias("h")).collect()}
    used = sorted(heads)
    before = dict(zip(used, [*used[-1:], *used[:-1]]))
    blank = (0, 0)
    table = [heads.get(i, blank) for i in range(len(starts))]
    at_head = f"_k = get({_literal([h[0] for h in table], 'BIGINT')}, _own) AND _u = get({_literal([h[1] for h in table], 'BIGINT')}, _own)"
    placed = placed.withColumn("_own", F.expr(own))
    placed = placed.withColumn("_ghost", F.explode(F.when(F.expr(at_head), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    earlier = F.expr(f"get({_literal([before.get(i, 0) for i in range(len(starts))], 'INT')}, _own)")
    placed = placed.withColumn("_range", F.when(F.col("_ghost") == 0, F.col("_own")).otherwise(earlier)).drop("_own").repartition("_range")
    placed, more = dealt(placed)
    w = Window.partitionBy("_range").orderBy("_ghost", "_k", "_u")
    for c in (text, *more):
        placed = placed.withColumn(f"next_{c}", F.lead(c).over(w))
    return placed.where("_ghost = 0").drop("_k", "_u", "_ghost", "_range")


def fingerprint_documents(docs: DataFrame, model: IMatch | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses.

    The edited text's last n // 4 code points are the first as many (or all) of the next document by ascending doc_id;
    after the last document comes the first.  Null texts are empty.  A null doc_id sorts first; rows with the same
    doc_id follow each other by a hash of their texts.  Equal texts have equal fingerprints.  Empty tables give no rows;
    other columns are ignored.
    """
    model = model or IMatch().fit(docs, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(base, "doc_id", "text", dealt=lambda rows: (rows.withColumn("fp", model.fingerprint("text")), ["fp"]))
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = rows.withColumn("edited_fp", model.fingerprint("edited"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )

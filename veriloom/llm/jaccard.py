"""Exact Jaccard join of word-shingle sets in their metric space: pivots, Voronoi cells, triangle-inequality windows.

Unrelated documents share no shingle, so their distance to any document used as a pivot is exactly 1 and a window around
them takes in everything.  Pivots alone would leave all of them in one cell.  The space is therefore cut first where it is
provably empty: sets within the radius are equal on one of a fixed number of parts of the universe (pigeonhole).  The
least document with a part is that part's pivot, and a pivot's region is all that share a part with it; sets on a border
are in several regions, and two linked sets meet in one.  Each region is then joined by pivots of its own: Voronoi cells,
boundary sets replicated by the triangle inequality, recursion, and exact intersections in the leaves.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_tables, materialize

U64 = np.uint64
CLASS_RATIO = 1.5  # sizes of one class differ by less than this
LEAF, PIVOTS = 2, 8
REGION_DOCS, REGION_SHINGLES = 1500, 800_000  # a region up to this size is joined within one task
ROUNDS = 2  # distributed cuts; what they leave large is joined in blocks
HOT_ROWS, HOT_SHARE = 64, 1 / 16  # keys with so many rows in this share of the sets are counted before anything is shuffled
TASK_DOCS = 300  # joined by one task, where no region is larger


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of word shingles; words are hashed once while they are remembered."""

    def __init__(self, width: int, remember: int = 200_000):
        self.width, self.remember, self.known = width, remember, {}
        self.factors = mix(np.arange(1, width + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

    def words(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        for w in (text or "").encode().lower().split():
            h = known.get(w)
            if h is None:
                if len(known) >= self.remember:
                    known.clear()
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=U64)

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        n = max(1, len(w) - self.width + 1)
        own = min(len(w), self.width)  # a shorter text is one shingle, marked by its length
        total = np.full(n, own, dtype=U64)
        for j in range(own):
            total += w[j : j + n] * self.factors[j]
        return np.unique(mix(total))


@dataclass(frozen=True)
class Radius:
    """Sets link when 100 * intersection >= percent * union."""

    percent: int

    @property
    def distance(self) -> float:
        return 1 - self.percent / 100

    def links(self, inter: int, a: int, b: int) -> bool:
        return a > 0 and b > 0 and 100 * inter >= self.percent * (a + b - inter)

    def size_class(self, n: int) -> int:
        c = int(math.log(n) / math.log(CLASS_RATIO))
        while self.class_start(c + 1) <= n:
            c += 1
        while self.class_start(c) > n:
            c -= 1
        return c

    @staticmethod
    def class_start(c: int) -> int:
        return math.ceil(CLASS_RATIO**c)

    def part_keys(self, hashes: np.ndarray) -> tuple[np.ndarray, int]:
        """Keys of the parts of a set, and how many of them it has in common with any set that it is linked to.

        In the class of the larger set linked sets differ in at most `apart` shingles, so of m parts at least m - apart
        are equal; m is chosen so that this is a sixth of them, more than chance or a shared passage brings together.
        Empty parts have no keys unless equal parts could all be empty; then the other set may still send none of its own, and
        but one common key is sure.  A set is also sent to the next class if a set
        there can be within the radius.
        """
        n, out, need = len(hashes), [], None
        if not n:
            return hashes, 0
        own = self.size_class(n)
        mixed = mix(hashes ^ U64(0x5851F42D4C957F2D))
        for c in (own, own + 1):
            if c > own and 100 * n < self.percent * self.class_start(c):
                break
            most = self.class_start(c + 1) - 1
            apart = 2 * most * (100 - self.percent) // (100 + self.percent)
            if not apart:
                continue  # only equal sets link
            equal = 3 + apart // 5
            m = apart + equal
            part = (hashes % U64(m)).astype(np.int64)
            count = np.bincount(part, minlength=m)
            total = np.zeros(m, dtype=U64)
            np.add.at(total, part, mixed)
            keys = mix(total + mix(np.arange(m, dtype=U64) * U64(0x2545F4914F6CDD1D) + U64(c)))
            empty = int((count == 0).sum())
            out.append(keys[count > 0] if empty < equal else keys)
            need = min(need or m, equal - empty if empty < equal else 1)
        return (np.concatenate(out), need) if out else (hashes[:0], 0)


class Region:
    """Joins the sets of one region; `find` gives the component of each."""

    def __init__(self, sets: list[np.ndarray], radius: Radius, labels: list[int] | None = None):
        self.sets, self.radius = sets, radius
        self.parent = list(range(len(sets)))
        self.counts: Counter = Counter()  # pivots, cells, rows in cells, and how often rows are in one cell more
        self.mark: np.ndarray | None = None  # made when a join begins
        first: dict[int, int] = {}
        for i, label in enumerate(labels or []):
            self.union(first.setdefault(label, i), i)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def inter(self, i: int, j: int) -> int:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0

    def index(self) -> None:
        """Numbers the shingles that two sets of the region hold: no other counts in an intersection."""
        self.sizes = np.array([len(s) for s in self.sets])
        ends = np.cumsum(self.sizes)
        _, column, count = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        shared = count > 1
        number = (np.cumsum(shared) - 1).astype(np.int32)
        self.columns = [number[c[shared[c]]] for c in np.split(column, ends[:-1])]
        self.mark = np.zeros(int(shared.sum()), dtype=bool)

    def distances(self, rows: list[int]) -> Callable[[int], np.ndarray]:
        """A function from a pivot to its distances from all rows; it unites rows within the radius with the pivot.

        Rows are sets that are not empty.
        """
        sizes = self.sizes[rows]
        joined = np.concatenate([self.columns[i] for i in rows])
        edges = np.concatenate([[0], np.cumsum([len(self.columns[i]) for i in rows])])
        before = np.zeros(len(joined) + 1, dtype=np.int64)

        def away(pivot: int) -> np.ndarray:
            self.mark[self.columns[pivot]] = True
            np.cumsum(self.mark[joined], out=before[1:])
            self.mark[self.columns[pivot]] = False
            inter, n = np.diff(before[edges]), len(self.sets[pivot])
            for k in np.flatnonzero(100 * inter >= self.radius.percent * (sizes + n - inter)):
                self.union(rows[k], pivot)
            return 1 - inter / (sizes + n - inter)

        return away

    def join(self, rows: list[int]) -> None:
        """Pivots cut the rows into Voronoi cells; a row goes to every cell on whose side of the border it is by less than
        twice the radius (of two linked rows both are then in the cells of both); cells are joined in the same way.

        A pivot is compared with all rows, so it is in no cell.  Pivots are far from each other, and of the smaller
        components known so far: rows of one component need no comparison.  Where cells overlap so much that they
        hardly part the rows, the rows stay one cell, without these pivots.
        """
        while True:
            roots = [self.find(i) for i in rows]
            known = Counter(roots)
            if len(known) < 2:
                return
            if self.mark is None:
                self.index()
            distances = self.distances(rows)
            if len(rows) <= LEAF:
                distances(rows[0])
                return
            weight = np.array([known[r] for r in roots])
            least = np.full(len(rows), 2.0)
            away, chosen = [], []
            for _ in range(min(PIVOTS, max(2, math.isqrt(len(rows))))):
                k = int(np.lexsort((np.arange(len(rows)), -least, weight))[0])
                chosen.append(k)
                away.append(distances(rows[k]))
                least = np.minimum(least, away[-1])
                weight[k] = len(rows) + 1
            near = np.stack(away, axis=1)
            member = near <= near.min(axis=1, keepdims=True) + 2 * self.radius.distance + 1e-9
            member[chosen] = False
            self.counts.update(pivots=len(chosen), cells=int(member.any(axis=0).sum()), rows=int(member.any(axis=1).sum()), replicas=int(np.maximum(member.sum(axis=1) - 1, 0).sum()))
            if member.sum() <= (len(rows) - len(chosen)) * len(chosen) / 2:
                for k in range(len(chosen)):
                    self.join([rows[i] for i in np.flatnonzero(member[:, k])])
                return
            out = set(chosen)
            rows = [r for i, r in enumerate(rows) if i not in out]


def shingle_table(docs: DataFrame, width: int, radius: Radius, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hash of the set), part keys and how many of them linked sets share; within a task keys
    are sent once for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(width), set()
        for batch in batches:
            n, h1, h2, keys, need = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler(text)
                a, b = int(mix(s).sum(dtype=U64)), int(mix(s ^ U64(0xD1B54A32D192ED03)).sum(dtype=U64))
                n.append(len(s))
                h1.append(a)
                h2.append(b)
                if (a, b) in sent:
                    keys.append(None)
                    need.append(0)
                else:
                    parts, shared = radius.part_keys(s)
                    keys.append(parts.view(np.int64))
                    need.append(shared)
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add((a, b))
            signed = lambda v: pa.array(np.array(v, dtype=U64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), signed(h1), signed(h2), pa.array(keys, pa.list_(pa.int64())), pa.array(need, pa.int32())], names=["doc_id", "n_shingles", "h1", "h2", "keys", "need"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, keys array<bigint>, need int")


def _hot_keys(table: DataFrame, made: list[str]) -> DataFrame:
    """(key, b): part keys of very many sets and the least document of each, over all rows, with partial sums.

    Which keys count as hot is seen in a seeded share of the sets; they are at most four a shuffle partition, and the links
    are the same whether a key is hot or not.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = table.sample(HOT_SHARE, seed=5).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = materialize(some.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "key").limit(4 * parts).select("key"), "hot-keys", made)
    every = table.select(F.explode("keys").alias("key"), "doc_id").join(F.broadcast(keys), "key")
    return materialize(every.groupBy("key").agg(F.min("doc_id").alias("b")), "hot-least", made)


def equal_part_links(table: DataFrame, made: list[str]) -> DataFrame:
    """(a, b): sets that share enough part keys with others, and the least document of a key; streamed, never gathered.

    A set with fewer shared keys than any set linked to it would share is linked to none.
    """
    table = table.where("doc_id IS NOT NULL AND keys IS NOT NULL")
    hot = _hot_keys(table, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, alone = None, None, False  # the key at the batch's end, its least document, whether it has but one
        for batch in batches:
            k, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            group = np.cumsum(new)  # 0 goes on from the batch before
            least = np.concatenate([[first if first is not None else d[0]], d[new]])[group]
            size = np.bincount(group, minlength=group[-1] + 1)
            shared = np.flatnonzero(size[1:] > 1) + 1
            heads = d[np.flatnonzero(new)[shared - 1]]
            if size[0] and alone:
                heads = np.append(heads, first)
            rest = ~new
            pair, count = np.unique(np.stack([np.append(d[rest], heads), np.append(least[rest], heads)], axis=1), axis=0, return_counts=True)
            alone = bool(new[-1]) if group[-1] else False
            key, first = k[-1], least[-1]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(count)], names=["a", "b", "shared"])

    keyed = table.select(F.explode("keys").alias("key"), "doc_id")
    ordered = keyed.join(F.broadcast(hot), "key", "left_anti").repartition("key").sortWithinPartitions("key", "doc_id")
    pairs = ordered.mapInArrow(run, "a bigint, b bigint, shared bigint")
    pairs = pairs.unionByName(keyed.join(F.broadcast(hot), "key").select(F.col("doc_id").alias("a"), "b", F.lit(1).cast("bigint").alias("shared")))
    counted = materialize(pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared")), "shared-parts", made)
    total = counted.groupBy("a").agg(F.sum("shared").alias("total"))
    needs = table.where("need > 0").groupBy(F.col("doc_id").alias("a")).agg(F.min("need").alias("need"))
    enough = total.join(needs, "a").where("total >= need").select("a")
    return counted.join(enough, "a").select("a", "b")


def _in_task(rows: DataFrame, texts: DataFrame, width: int, radius: Radius, n_docs: int) -> DataFrame:
    """Links (a, b) found within regions (region, doc_id, label), each joined whole; regions are dealt to tasks by hash."""
    dealt = max(1, -(-n_docs // TASK_DOCS))

    def run(t: pa.Table) -> pa.Table:
        shingler = Shingler(width)
        t = t.sort_by([("region", "ascending"), ("doc_id", "ascending")])
        region, ids, labels, text = (t[c].to_numpy() if c != "text" else t[c] for c in ("region", "doc_id", "label", "text"))
        a, b = [], []
        edges = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        for lo, hi in zip(edges, edges[1:]):
            sets = [shingler(text[int(i)].as_py()) for i in range(lo, hi)]
            known = labels[lo:hi].tolist()
            own = Region(sets, radius, known)
            own.join([i for i in range(hi - lo) if len(sets[i])])
            for i in range(hi - lo):
                root = own.find(i)
                if root != i:
                    a.append(int(ids[lo + i]))
                    b.append(int(ids[lo + root]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    placed = rows.join(texts.hint("merge"), "doc_id").withColumn("task", F.pmod(F.xxhash64("region"), F.lit(dealt)))
    return placed.select("task", "region", "doc_id", "label", "text").repartition(dealt, "task").groupBy("task").applyInArrow(run, "a bigint, b bigint")


def _pivot_round(rows: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, radius: Radius, seed: int) -> DataFrame:
    """One distributed cut of large regions: doc_id, label, pivots linked, and the cells that each set now is in.

    A region's pivots are, in each of PIVOTS classes by hash, a set of the smallest component known so far, by seeded
    hash among equals; its rows are dealt by hash to chunks of about REGION_DOCS / 2, and the pivots go to every chunk,
    so that no task holds a whole region.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    known = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("known"))
    least = F.min(F.struct("known", h.alias("h"), "doc_id")).getField("doc_id").alias("doc_id")
    chosen = rows.join(known, ["region", "label"]).groupBy("region", F.pmod(h, F.lit(PIVOTS)).alias("k")).agg(least)
    pivots = chosen.join(sizes, "region").join(texts, "doc_id").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    dealt = rows.join(sizes, "region").join(texts, "doc_id").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("chunks")))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        shingler = Shingler(width)
        pivot_ids = b["pivot"].to_pylist()
        order = np.argsort(pivot_ids)
        sets = [shingler(b["pivot_text"][int(i)].as_py()) for i in order]
        pivot_ids = [pivot_ids[int(i)] for i in order]
        near, links = [], []
        for text in a["text"]:
            s = shingler(text.as_py())
            region = Region([*sets, s], radius)
            inter = np.array([region.inter(len(sets), k) for k in range(len(sets))])
            away = 1 - inter / (np.array([len(p) for p in sets]) + len(s) - inter)
            links.append([p for p, q, x in zip(pivot_ids, sets, inter) if radius.links(int(x), len(q), len(s))])
            near.append([p for p, d in zip(pivot_ids, away) if d <= away.min() + 2 * radius.distance + 1e-9])
        return pa.table({"doc_id": a["doc_id"], "label": a["label"], "region": a["region"], "links": pa.array(links, pa.list_(pa.int64())), "cells": pa.array(near, pa.list_(pa.int64()))})

    left = dealt.select("region", "chunk", "doc_id", "label", "text").groupBy("region", "chunk")
    right = pivots.select(F.col("region").alias("pivot_region"), F.col("chunk").alias("pivot_chunk"), F.col("doc_id").alias("pivot"), F.col("text").alias("pivot_text")).groupBy("pivot_region", "pivot_chunk")
    return left.cogroup(right).applyInArrow(run, "doc_id bigint, label bigint, region bigint, links array<bigint>, cells array<bigint>")


def _spread_labels(linked: DataFrame, made: list[str], times: int = 2) -> DataFrame:
    """(doc_id, component): labels passed from sets to the pivots they link to, and back.  Two sets with one label are in
    one component; the links themselves settle which components there are in the end."""
    for _ in range(times):
        least = linked.groupBy("pivot").agg(F.min("label").alias("least"))
        linked = linked.join(least, "pivot").withColumn("label", F.least("label", "least")).drop("least")
        own = linked.groupBy("doc_id").agg(F.min("label").alias("label"))
        linked = linked.drop("label").join(own, "doc_id")
    return materialize(own.withColumnRenamed("label", "component"), "labels", made)


def _blocks(rows: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, radius: Radius, made: list[str]) -> DataFrame:
    """The exact way for regions that pivots do not part: sets outside the largest component known, in chunks, against
    all sets of the region, in chunks."""
    half = REGION_DOCS // 2
    known = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("known"))
    main = known.groupBy("region").agg(F.max_by("label", F.struct("known", "label")).alias("main"), F.max("known").alias("most"), F.sum("known").alias("docs"))
    both = rows.join(sizes.select("region", "chunks"), "region").join(main, "region")
    open_chunks = F.greatest(F.ceil((F.col("docs") - F.col("most")) / half), F.lit(1))
    chunk, own = F.pmod(F.xxhash64("doc_id"), F.col("chunks")), F.pmod(F.xxhash64("doc_id", F.lit(1)), open_chunks)
    every = both.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), open_chunks.cast("bigint") - 1))).withColumn("j", chunk)
    outside = both.where("label <> main").withColumn("i", own.cast("bigint")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    spread = every.unionByName(outside).select("doc_id", "label", F.xxhash64("region", "i", "j").alias("region")).distinct()
    spread = materialize(spread, "blocks", made)
    return _in_task(spread, texts, width, radius, spread.count())


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Sets are the distinct shingles of `width` words of the whole lower-cased (A-Z) text; a text with fewer words is one
    shingle; null texts and texts without words are empty sets and linked with nothing.  Sets link when
    100 * intersection >= percent * union.  Equal sets are one node.  Rows with one doc_id are in one component; a null
    doc_id is reached by none (component_id: that of its equals, else null).  Empty tables give no rows; other columns
    are ignored.  No cap anywhere: large regions are cut by distributed pivot rounds, then joined in blocks.
    """
    radius, spark, first, made = Radius(percent), docs.sparkSession, [], []
    table = materialize(shingle_table(docs, width, radius, id_col, text_col), "shingles", first)
    slim = materialize(table.select("doc_id", "n_shingles", "h1", "h2"), "shingle-sets")
    classes = materialize(slim.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    copies = classes.where("copies > 1").select("n_shingles", "h1", "h2", "node")
    to_node = materialize(slim.where("doc_id IS NOT NULL").join(copies, ["n_shingles", "h1", "h2"]).where("doc_id <> node").select("doc_id", "node").distinct(), "to-node", made)
    found = equal_part_links(table, first)
    for c in ("a", "b"):
        renamed = to_node.select(F.col("doc_id").alias(c), F.col("node").alias("to"))
        found = found.join(renamed, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    near = materialize(found.select("a", "b").distinct(), "regions-of", made)
    drop_tables(spark, first)
    inside = near.select(F.col("b").alias("region"), F.col("a").alias("doc_id"))
    sized = slim.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    members = materialize(inside.join(sized, "doc_id").withColumn("label", F.col("doc_id")), "regions", made)
    links = [to_node.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    inside = members.select("doc_id").distinct().hint("merge")  # ids of members have no bound: never broadcast, whatever their size
    texts = materialize(texts.join(inside, "doc_id", "left_semi"), "region-texts", made)  # read by each round
    rows = members
    for r in range(ROUNDS + 1):
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.countDistinct("label").alias("labels"))
        small = (F.col("docs") <= REGION_DOCS) & (F.col("n") <= REGION_SHINGLES)
        sizes = materialize(sizes.where("labels > 1").withColumn("small", small).withColumn("chunks", F.greatest(F.ceil(F.col("docs") * 2 / REGION_DOCS), F.ceil(F.col("n") * 2 / REGION_SHINGLES))).drop("n"), "region-sizes", made)
        count = {x["small"]: x["d"] for x in sizes.groupBy("small").agg(F.sum("docs").alias("d")).collect()}
        if count.get(True):
            own = rows.drop("n").join(sizes.where("small").select("region"), "region")
            links.append(materialize(_in_task(own, texts, width, radius, count[True]), "region-links", made))
        if not count.get(False):
            break
        large = sizes.where("NOT small").select("region", "chunks")
        if r == ROUNDS:
            links.append(materialize(_blocks(rows.drop("n").join(large.select("region"), "region"), large, texts, width, radius, made), "block-links", made))
            break
        cut = materialize(_pivot_round(rows.drop("n").join(large.select("region"), "region"), large, texts, width, radius, 100 + r), "cells", made)
        linked = cut.select(F.col("doc_id").alias("a"), F.explode("links").alias("b")).where("a <> b")
        links.append(linked)
        named = _spread_labels(cut.select("doc_id", "label", F.explode("links").alias("pivot")), made)
        sized = rows.select("doc_id", "n").distinct()
        # a region whose sets mostly lie within the windows of most pivots is not parted: it stays one, with better labels
        parted = cut.groupBy("region").agg((F.avg(F.size("cells")) <= PIVOTS / 2).alias("parted"))
        placed = cut.join(parted, "region").select("doc_id", "label", "region", F.explode(F.when(F.col("parted"), F.col("cells")).otherwise(F.array(F.lit(-1).cast("bigint")))).alias("cell"))
        placed = placed.join(named, "doc_id", "left")
        into = F.when(F.col("cell") == -1, F.col("region")).otherwise(F.xxhash64("region", "cell", F.lit(r)))
        rows = materialize(placed.select("doc_id", F.coalesce("component", "label").alias("label"), into.alias("region")).join(sized, "doc_id"), "cell-rows", made)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    named = components(every).withColumnRenamed("node", "doc_id")
    drop_tables(spark, made)
    out = slim.join(named, "doc_id", "left")
    nameless = slim.where("doc_id IS NULL AND n_shingles > 0").join(classes, ["n_shingles", "h1", "h2"], "left").select(F.col("node").alias("doc_id"), "n_shingles").join(named, "doc_id", "left")
    nameless = nameless.select(F.lit(None).cast("bigint").alias("doc_id"), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    empty = slim.where("doc_id IS NULL AND n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    known = out.where("doc_id IS NOT NULL").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return known.unionByName(nameless).unionByName(empty)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All columns of the documents that stay: of each component the one whose id names it.

    Rows whose id is null, or belongs to rows of different texts, stand for themselves: a hash of id and text is their id
    here.  Of rows with the same id and text one stays.  Rows without words (null, empty) are linked with nothing and
    all stay.  No column name clashes: the row is carried as one value.  Empty tables give no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wide = docs.select(row.alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    h = F.xxhash64("text")
    many = materialize(wide.where("id IS NOT NULL").groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("id", F.lit(True).alias("many")), "many-texts")
    wide = wide.join(many, "id", "left") if not many.isEmpty() else wide.withColumn("many", F.lit(False))
    own = F.col("id").isNull() | F.coalesce("many", F.lit(False))
    wide = wide.select("row", "text", F.when(own, F.xxhash64("id", "text")).otherwise(F.col("id")).alias("key"))
    found = jaccard_components(wide, id_col="key", text_col="text", **how)
    stay = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"))
    joined = wide.join(stay.where("key = component_id"), "key")
    each = joined.where("rows = 1 OR n = 0").select("row")
    one = joined.where("rows > 1 AND n > 0").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return each.unionByName(one).select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

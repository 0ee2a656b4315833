"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import materialize

CAPACITIES = (512, 1024, 2048, 4096)


@dataclass(frozen=True)
class Cost:
    """Of a sequence: a fixed share (its step, its padding to a batch), linear work, and a quadratic share for attention.

    With these values a full sequence of 1024 costs least a token; shorter ones pay the fixed share more often, longer ones
    more attention.
    """

    fixed: float = 256.0
    quadratic: float = 1 / 4096

    def __call__(self, capacity: int) -> float:
        return self.fixed + capacity * (1 + capacity * self.quadratic)


class Remaining:
    """Sizes that are still to be placed."""

    def __init__(self, sizes: list[int]):
        self.count = Counter(sizes)
        self.present = 0  # bit s: some piece of size s is left
        for s in self.count:
            self.present |= 1 << s

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.present &= ~(1 << s)

    def filled(self, room: int) -> int:
        """What a bin with so much room would hold of these pieces, always the largest that fits next."""
        full, below = room, self.present & ((1 << (room + 1)) - 1)
        while room and below:
            s = below.bit_length() - 1
            room -= s * min(self.count[s], room // s)
            below &= (1 << min(s, room + 1)) - 1
        return full - room


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Cost = Cost()) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing over several bin sizes: (bin, offset) of each piece, and the size of each bin.

    A piece goes to the open bin that it leaves least room in (of equals the first opened).  If none has room, each permitted size is tried on all that
    is still to be placed: a bin of that size would hold the piece and then the largest pieces that fit, and would end
    with the least size that holds those.  The size is opened whose bin so costs least a token (of equals the smaller).
    As bins opened before take some of these pieces first, a bin may hold less than was foreseen: in the end each
    shrinks to the least size that holds its contents.  Pieces must be from 1 to max(capacities).
    """
    caps = sorted(capacities)
    ends = [cost(caps[bisect_left(caps, f)]) for f in range(caps[-1] + 1)]  # by what a bin holds
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    open_rooms = 0  # bit r: some bin has room r
    left = Remaining(sizes)
    bins, fill, where, offset = [], [], [0] * len(sizes), [0] * len(sizes)
    for i in order:
        s = sizes[i]
        left.take(s)
        fits = open_rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = heappop(room[r])
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            best = None
            for cap in caps[bisect_left(caps, s) :]:
                holds = s + left.filled(cap - s)
                if best is None or ends[holds] / holds < best[0]:
                    best = (ends[holds] / holds, cap)
            b, r = len(bins), best[1]
            bins.append(r)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if r - s:
            heappush(room[r - s], b)
            open_rooms |= 1 << (r - s)
    return where, offset, [caps[bisect_left(caps, f)] for f in fill]


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, capacities: tuple[int, ...] = CAPACITIES, cost: Cost = Cost(), shard_pieces: int = 20_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, size, bin_id, bin_size, bin_offset.

    Sizes are words of the whole text, or `size_col` if named.  Longer documents are cut into pieces of the largest
    capacity and a rest.  Pieces are dealt by hash to shards of about `shard_pieces`, each packed by `best_fit` in one
    task; bins never span shards, so the loss is under one bin a size and shard.  Null, negative and zero sizes (null
    and empty texts) give one piece of size 0 in no bin (null).  Repeated rows are packed each; equal sizes go in
    order of doc_id, then piece; empty tables give no rows; other columns are ignored.
    """
    top = max(capacities)
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0)) if size_col else word_count(F.col(text_col))
    sized = materialize(docs.select(F.col(id_col).cast("string").alias("key"), F.col(id_col).alias("doc_id"), size.alias("total"), F.monotonically_increasing_id().alias("row")), "pack-sizes")
    # rows of one id are dealt to one shard, unless there are so many of them (or without an id) that they'd fill it
    many = materialize(sized.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_pieces // 10).select(F.col("key").alias("many")), "pack-many")
    sized = sized.join(many, F.col("key").eqNullSafe(F.col("many")), "left_semi").unionByName(sized.join(many, F.col("key").eqNullSafe(F.col("many")), "left_anti").withColumn("row", F.lit(-1).cast("bigint"))) if not many.isEmpty() else sized.withColumn("row", F.lit(-1).cast("bigint"))
    last = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / top))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("start", F.col("piece") * top)
    pieces = pieces.withColumn("size", F.least(F.lit(top).cast("bigint"), F.col("total") - F.col("start")))
    n = sized.select(F.sum(F.ceil(F.col("total") / top))).first()[0] or 0
    shards = max(1, -(-n // shard_pieces))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "size", "bin_id", "bin_size", "bin_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("doc_id", "piece", "size")])
        where, offset, bins = best_fit(table["size"].to_pylist(), capacities, cost)
        shard = table["shard"][0].as_py()
        columns = [table["doc_id"].combine_chunks(), table["piece"], table["start"], table["size"], pa.array([f"{shard}-{b}" for b in where], pa.string()), pa.array([bins[b] for b in where], pa.int64()), pa.array(offset, pa.int64())]
        yield from pa.table(columns, names=names).to_batches()

    full = pieces.where("size > 0").withColumn("shard", F.pmod(F.xxhash64("key", "piece", "row"), F.lit(shards)))
    packed = full.select("shard", "doc_id", "piece", "start", "size").groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece bigint, start bigint, size bigint, bin_id string, bin_size bigint, bin_offset bigint")
    none = pieces.where("size <= 0").select("doc_id", "piece", "start", "size", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_size"), F.lit(None).cast("bigint").alias("bin_offset"))
    return packed.unionByName(none)

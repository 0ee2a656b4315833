"""Approximate nearest neighbours over randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

BLOCK_BYTES = 32 << 20  # vectors, as doubles, that one task gets
QUERY_CELLS = 1 << 22  # estimates held at once
FOUND = "query bigint, query_id bigint, vec_id bigint, score double"


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """The part of a random orthogonal matrix that acts on `dim` components, for codes of `bits` a component; the same
    everywhere."""
    full = -(-dim * bits // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((full, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, the norms, and each code's inner product with its unit vector."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    norms = np.linalg.norm(vectors / top, axis=1) * top[:, 0]
    turned = (vectors / norms[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), norms, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])


class Estimator:
    """Inner products of coded vectors with queries, and how far they may be off."""

    def __init__(self, codes: np.ndarray, norms: np.ndarray, align: np.ndarray, turn: np.ndarray, confidence: float):
        full = turn.shape[0]
        self.signs = (np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(full))
        self.turn, self.scale = turn, norms / align
        # `confidence` standard deviations of the code's error, and the rounding of single precision
        self.off = norms * (confidence * np.sqrt(np.maximum(0.0, 1 - align**2)) / np.sqrt(full - 1) / align + 1e-5)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, how far off) of every vector for each query, a row a query."""
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        turned = ((queries / length) @ self.turn.T).astype(np.float32)
        return (turned @ self.signs.T) * (length * self.scale), length * self.off

    def parts(self, queries: np.ndarray) -> Iterator[slice]:
        step = max(1, QUERY_CELLS // max(1, len(self.scale)))
        for at in range(0, len(queries), step):
            yield slice(at, at + step)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _codes(t: pa.Table) -> np.ndarray:
    rows = t["code"].to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)


def code_table(table: DataFrame, bits: int, seed: int) -> DataFrame:
    """Rows (row, id, v) with dim, code, norm, align."""
    schema = f"row bigint, id bigint, v {table.schema['v'].dataType.simpleString()}, dim int, code binary, norm double, align double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length = np.diff(t["v"].combine_chunks().offsets.to_numpy())
            for dim in np.unique(length).tolist():
                own = t.filter(pa.array(length == dim))
                codes, norms, align = encode(_matrix(own["v"], dim), rotation(dim, bits, seed))
                more = [pa.array(np.full(len(norms), dim, dtype=np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(align)]
                yield from pa.table([*own.columns, *more], names=["row", "id", "v", "dim", "code", "norm", "align"]).to_batches()

    return table.mapInArrow(run, schema)


def search(table: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 1, confidence: float = 1.6, seed: int = 7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k rows of `table` with the largest inner product for each query: query_id, rank, vec_id, score.

    Vectors are coded once, with `bits` bits a component (one, unless longer codes are wanted for tighter bounds).  Codes
    in blocks of rows meet blocks of queries twice: first, the k largest lower bounds of all blocks give each query the
    value that a neighbour must reach; then the vectors whose upper bound reaches it are reranked exactly, in double
    precision on the original vectors.  `confidence` is the bound's width in standard deviations of the code's error.

    A query is searched among vectors of its length, without rows of its own id.  Ties go to the smaller id.  Vectors that
    are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id; rows with
    one id are candidates each, and queries each; fewer than k candidates give fewer rows; empty tables give none; other
    columns are ignored.
    """
    rows = materialize(code_table(_usable(table, id_col, vector_col), bits, seed), "codes")
    asks = materialize(_usable(queries, id_col, vector_col), "queries").select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"))
    n, m = (df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(8).cast("bigint") * F.size(v)).alias("bytes")).first() for df, v in ((rows, "v"), (asks, "q")))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(1, -(-(n["bytes"] or 0) // block_bytes), min(2 * parts, n["n"] // 4096))
    query_blocks = max(1, -(-(m["bytes"] or 0) // block_bytes))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    left = rows.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(row_blocks))).withColumn("qb", every(query_blocks))
    right = asks.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(query_blocks))).withColumn("rb", every(row_blocks))
    block = ("dim", "rb", "qb")

    def estimator(key: tuple, a: pa.Table) -> Estimator:
        turn = rotation(key[0].as_py(), bits, seed)
        return Estimator(_codes(a), a["norm"].to_numpy(), a["align"].to_numpy(), turn, confidence)

    def lowest(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        """The k largest lower bounds of each query in this block."""
        out_q, out_low = [np.array([], dtype=np.int64)], [np.array([])]
        if len(a) and len(b):
            own, ids = estimator(key, a), a["id"].to_numpy()
            asked, query, qids = _matrix(b["q"], key[0].as_py()), b["query"].to_numpy(), b["query_id"].to_numpy()
            for part in own.parts(asked):
                guess, off = own.bounds(asked[part])
                low = np.where(ids[None, :] == qids[part][:, None], -np.inf, guess - off)
                if low.shape[1] > k:
                    low = -np.partition(-low, k - 1, axis=1)[:, :k]
                out_q.append(np.repeat(query[part], low.shape[1]))
                out_low.append(low.ravel())
        q, low = np.concatenate(out_q), np.concatenate(out_low)
        keep = low > -np.inf
        return pa.table({"query": q[keep], "low": low[keep]})

    codes = left.select(*block, "id", "code", "norm", "align")
    bounds = codes.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(lowest, "query bigint, low double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    reach = materialize(bounds.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("query", F.col("low").alias("reach")), "reach")

    def rerank(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.array([], dtype=t)] for t in (np.int64, np.int64, np.int64, float)]
        if len(a) and len(b):
            dim = key[0].as_py()
            own, ids, vectors = estimator(key, a), a["id"].to_numpy(), _matrix(a["v"], dim)
            asked, query, qids = _matrix(b["q"], dim), b["query"].to_numpy(), b["query_id"].to_numpy()
            least = b["reach"].to_numpy(zero_copy_only=False).astype(float)
            for part in own.parts(asked):
                guess, off = own.bounds(asked[part])
                chosen = ~(guess + off < least[part][:, None]) & (ids[None, :] != qids[part][:, None])
                for i, hits in enumerate(chosen, part.start):
                    hits = np.flatnonzero(hits)
                    exact = (vectors[hits] * asked[i]).sum(axis=1)
                    best = np.lexsort((ids[hits], -exact))[:k]
                    for column, values in zip(out, (np.full(len(best), query[i]), np.full(len(best), qids[i]), ids[hits][best], exact[best])):
                        column.append(values)
        return pa.table(dict(zip(("query", "query_id", "vec_id", "score"), map(np.concatenate, out))))

    wanted = right.join(reach, "query", "left")
    found = left.drop("row").groupBy(*block).cogroup(wanted.groupBy(*block)).applyInArrow(rerank, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v) of the rows that take part; `row` numbers them as they lie, and is kept with the table written from it."""
    kind = df.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), v.alias("v"))

"""Exact top-k inner-product search on a bit-sliced index.

A block of rows keeps, per dimension, the upper bits of its quantised values as bitmaps over the rows (bit
slices). A query's scores are built by bitmap arithmetic alone: a slice counts with weight 2^(i+j) for bit i
of the query's value, and carry-save adders sum all slices into the bit slices of the score. The k-th
largest score is read from the most significant slice downward; the dropped low bits bound how far a score
can still rise, so the rows that might reach the top are known, and only these are scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read_table

SCALE = 256
#: Numbers up to it go through the bit slices: even 2^20 products of two of them fit 63 bits. Larger ones are scored
#: in whole numbers of any size.
NARROW = 1 << 21
#: Upper bits kept as slices.
SLICES = 6
BLOCK = 8192
QUERY_BLOCK = 8192


class BitSliced:
    """The index of one block: ``x`` (rows, dimensions) of integers."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        n, d = x.shape
        self.words = -(-n // 64)
        self.low = x.min(axis=0) if n and d else np.zeros(d, np.int64)
        u = x - self.low
        bits = int(u.max()).bit_length() if u.size else 0
        self.dropped = max(0, bits - SLICES)
        self.most = (1 << bits) - 1
        kept = bits - self.dropped
        self.slices = np.zeros((d, kept, self.words), dtype=np.uint64)
        for j in range(kept):
            self.slices[:, j] = self._pack((u >> (self.dropped + j)) & 1)
        self.present = self._pack(np.ones((n, 1), np.int64))[0]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        """(rows, columns) of 0 and 1 -> (columns, words)."""
        packed = np.zeros((bits.shape[1], self.words * 8), dtype=np.uint8)
        if bits.size:
            own = np.packbits(bits.T.astype(np.uint8), axis=1, bitorder="little")
            packed[:, : own.shape[1]] = own
        return packed.view(np.uint64)

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k best of the block surely are."""
        n = len(self.x)
        if n <= k or not self.slices.size:
            return np.arange(n)
        weight = np.abs(q)
        negative = q < 0
        signed = np.where(negative[:, None, None], ~self.slices, self.slices)  # -|q| u = |q| (most - u) - |q| most
        columns: dict[int, list[np.ndarray]] = {}
        for i in range(int(weight.max()).bit_length()):
            own = signed[(weight >> i) & 1 == 1]
            if len(own):
                for j in range(own.shape[1]):
                    columns.setdefault(i + j, []).append(own[:, j])
        score = _add_up(columns, self.words)
        count = lambda bitmap: int(np.bitwise_count(bitmap).sum())
        sure, open_, kth = np.zeros(self.words, np.uint64), self.present.copy(), 0
        for w in range(len(score) - 1, -1, -1):
            ones = open_ & score[w]
            if count(sure | ones) >= k:
                open_, kth = ones, kth | 1 << w
            else:
                sure, open_ = sure | ones, open_ & ~score[w]
        rise = ((1 << self.dropped) - 1) * int(weight.sum())
        least = -(-((kth << self.dropped) - rise) >> self.dropped) if rise else kth
        return np.flatnonzero(self._at_least(score, max(0, least)))

    def _at_least(self, score: list[np.ndarray], least: int) -> np.ndarray:
        above, equal = np.zeros(self.words, np.uint64), self.present.copy()
        for w in range(len(score) - 1, -1, -1):
            if least >> w & 1:
                equal &= score[w]
            else:
                above |= equal & score[w]
                equal &= ~score[w]
        return np.unpackbits((above | equal).view(np.uint8), bitorder="little")


def _add_up(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sums bitmaps by weight: columns[w] are stacks of bitmaps that count 2^w; returns the sum's bit slices."""
    out: list[np.ndarray] = []
    w = 0
    while columns:
        stack = np.concatenate(columns.pop(w)) if w in columns else np.zeros((0, words), np.uint64)
        while len(stack) > 1:
            if len(stack) == 2:
                a, b = stack
                columns.setdefault(w + 1, []).append((a & b)[None])
                stack = (a ^ b)[None]
                break
            m = len(stack) // 3
            a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
            t = a ^ b
            columns.setdefault(w + 1, []).append((a & b) | (t & c))
            stack = np.concatenate([t ^ c, stack[3 * m :]])
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        w += 1
    return out


def best(block: Block, queries: Block, k: int) -> list[tuple]:
    """(query row, row, score) of the k best rows of ``block`` for each of ``queries``, its own included."""
    small = block.narrow()
    narrow, wide = np.flatnonzero(small), np.flatnonzero(~small)
    index = BitSliced(block.x[narrow].astype(np.int64))
    far = [[int(v) for v in x] for x in block.x[wide]]
    out = []
    for row, q, fits in zip(queries.row.tolist(), queries.x, queries.narrow().tolist(), strict=True):
        if fits:
            own = q.astype(np.int64)
            at = index.candidates(own, k)
            rows, score = narrow[at], index.x[at] @ own
        else:
            rows, score = narrow, _exact(index.x.tolist(), q)
        if len(wide):
            rows, score = np.concatenate([rows, wide]), np.concatenate([score.astype(object), _exact(far, q)])
        order = sorted(range(len(rows)), key=lambda i: (-score[i], not block.named[rows[i]], block.ids[rows[i]])) if score.dtype == object else np.lexsort((block.ids[rows], ~block.named[rows], -score))
        top = order[:k]
        out += [(row, int(r), int(s)) for r, s in zip(block.row[rows[top]], score[top], strict=True)]
    return out


def _exact(rows: list[list[int]], q: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size."""
    own = [int(v) for v in q]
    out = np.empty(len(rows), dtype=object)
    out[:] = [sum(map(mul, own, x)) for x in rows]
    return out


@dataclass
class Block:
    """Vectors of one length: ``row`` numbers them, ``ids`` are their ids where they are ``named``."""

    row: np.ndarray
    ids: np.ndarray
    named: np.ndarray
    x: np.ndarray  # whole numbers, as doubles

    @staticmethod
    def of(table: pa.Table) -> Block:
        ids = table.column("vec_id")
        named = ids.is_valid().to_numpy().astype(bool)
        flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return Block(table.column("row").to_numpy(), ids.fill_null(0).to_numpy(), named, flat.reshape(len(named), -1))

    def narrow(self) -> np.ndarray:
        """Rows whose products with each other are sure to fit 63 bits in all."""
        n, d = self.x.shape
        return np.abs(self.x).max(axis=1, initial=0) <= NARROW if d else np.ones(n, bool)


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite components alone."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _floor(x: Column) -> Column:
    """As a double; from 2^53 on every double is whole."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def search(
    df: DataFrame, query_filter: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest integer inner product of the vectors
    floor(scale * x), against all rows but its own. ``query_filter`` is SQL on vec_id. Vectors are compared
    with those of the same length. Null vectors and vectors with null or non-finite components take no part; a
    vector of no components scores 0. Rows may repeat an id or lack one: a row is left out of its own
    answers alone, so a repeated row finds its copies, and each query row has k answers of its own; a row without an id
    comes last among equal scores. A score beyond 63 bits that would be among the answers is an error. An empty
    table gives an empty result."""
    scratch = Scratch(df.sparkSession, "topk")
    own = df.where(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector_col, lambda x: _floor(x.cast("double") * scale)).alias("x"),
    )
    # rows equal in id and numbers are one, with a count: their answers are the same
    rows = scratch.save(
        own.groupBy("vec_id", "x").agg(F.count("*").alias("copies")).select("vec_id", "copies", F.size("x").alias("length"), "x", F.monotonically_increasing_id().alias("row"))
    )
    queries = rows.where(query_filter)
    blocks = max(1, -(-rows.count() // BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    vector = ["row", "vec_id", "x"]
    left = rows.select(
        "length", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.explode(numbered(query_blocks)).alias("query_block"), *vector
    )
    right = queries.select(
        "length", F.explode(numbered(blocks)).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"), *vector
    )
    keys = ["length", "block", "query_block"]

    def find(a: pa.Table, b: pa.Table) -> pa.Table:
        found = best(Block.of(a), Block.of(b), k + 1) if a.num_rows and b.num_rows else []  # one more: the query itself
        if any(abs(f[2]) >= 1 << 63 for f in found):
            raise OverflowError("an inner product among the best does not fit 64 bits")
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query", "row", "score"))})

    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, "query long, row long, score long")
    # of each query's rows over all blocks the first k + 1, then as often as they are there
    told = parts.join(rows.select("row", "vec_id", "copies"), "row")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"]
    first = told.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("_n") <= k + 1)
    times = F.least(F.col("copies") - F.when(F.col("query") == F.col("row"), 1).otherwise(0), F.lit(k)).cast("int")
    each = first.withColumn("times", times).where("times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("times"))))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return ranked.join(asked, "query").select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

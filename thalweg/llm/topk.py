"""Exact top-k by inner product, block at a time.

Dimensions are terms, and a vector's components its weights. Rows are dealt to shards by
the hash of their number; inside a shard they are ordered so that like rows are near (by the
strongest component, then the next) and cut into blocks, each with the greatest and the
least weight of every term and a forward index of its rows. For a query the largest score
in a block is at most the sum of the term maxima (for a negative query weight, the term's
least weight), so blocks are visited by falling bound and the visit ends when the next
bound is under the query's kth score. The k best of each shard are merged.

Queries are cut into blocks too, and every block of queries meets every shard in a group of
bounded size, which is the work that exact search over a stated query set needs; nothing
is broadcast, and no group grows with the data. Shards and query blocks are large, so that
vectors are sent, and shards indexed, once for every QUERY_NUMBERS / width queries only.

Defined cases: a null vector, and one with a null or non-finite component, takes no part,
neither does a null id; every row is a candidate, and a query, of its own, also where rows
share an id; vectors of different length are compared over the components that both have;
components and scores that leave 64 bits are held at the ends of their range, and rank as
such; ties go to the smaller id; a query with fewer other rows gets them all; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Numbers in a shard's vectors and in those of a block of queries, and rows of a block in a shard.
SHARD_NUMBERS, QUERY_NUMBERS, BLOCK_ROWS = 1 << 21, 1 << 20, 128
SCALE = 1024.0
LEAST, MOST = -(1 << 63), (1 << 63) - 1
SCHEMA = "query_row long, query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): components times scale, rounded down, of the rows that take part."""
    x = F.col("embedding")
    wide = F.transform(x, lambda c: c.cast("double"))
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    used = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    v = F.transform(wide, lambda c: F.floor(c * F.lit(scale)))  # a whole number that leaves 64 bits stays at their end
    return used.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(1, width)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _largest(x: np.ndarray) -> int:
    """The largest absolute value; that of the least 64-bit number is none of them itself."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Shard:
    """Blocks of rows with their term maxima and minima, and a forward index each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, numbers: np.ndarray | None = None, block: int = BLOCK_ROWS):
        strong = np.argsort(-np.abs(rows.astype(np.float64)), axis=1, kind="stable")[:, :2]
        sign = np.take_along_axis(rows, strong, axis=1) < 0
        order = np.lexsort((ids, strong[:, 1] * 2 + sign[:, 1] if strong.shape[1] > 1 else ids, strong[:, 0] * 2 + sign[:, 0]))
        self.ids, self.rows, self.numbers = ids[order], rows[order], (ids if numbers is None else numbers)[order]
        self.cuts = np.arange(0, len(ids) + block, block).clip(max=len(ids))
        starts = self.cuts[:-1][self.cuts[:-1] < len(ids)]
        self.cuts = np.append(starts, len(ids))
        self.high = np.maximum.reduceat(self.rows, starts, axis=0)
        self.low = np.minimum.reduceat(self.rows, starts, axis=0)
        self.largest = _largest(self.rows)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
        """(query, vec_id, score) of the k best rows of each query but those numbered `own`, and how many blocks were scored."""
        width = min(self.rows.shape[1], queries.shape[1])
        q = queries[:, :width]
        exact = self.largest * _largest(q) * width < 1 << 53
        kind = np.float64 if exact else object  # doubles add whole numbers exactly below 2^53
        held = (lambda x: x) if exact else (lambda x: np.minimum(np.maximum(x, LEAST), MOST))
        rows, high, low = (m[:, :width].astype(kind) for m in (self.rows, self.high, self.low))
        q = q.astype(kind)
        found, scored = [], 0
        for i in range(len(q)):
            if not i % 256:
                bounds = held(np.maximum(q[i : i + 256], 0) @ high.T + np.minimum(q[i : i + 256], 0) @ low.T)
            bound = bounds[i % 256]
            order = np.argsort(-bound, kind="stable")
            best_id = np.zeros(0, dtype=np.int64)
            best = np.zeros(0, dtype=kind)
            for b in order:
                if len(best) >= k and bound[b] < best[k - 1]:
                    break
                lo, hi = self.cuts[b], self.cuts[b + 1]
                ids, scores = self.ids[lo:hi], held(rows[lo:hi] @ q[i])
                if (same := self.numbers[lo:hi] == own[i]).any():
                    ids, scores = ids[~same], scores[~same]
                scored += 1
                best_id, best = np.concatenate([best_id, ids]), np.concatenate([best, scores])
                top = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[top], best[top]
            found += [(i, int(d), int(s)) for d, s in zip(best_id, best)]
        return found, scored


def search(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows with the largest inner product with each query row."""
    small_batches(rows.sparkSession)
    # Rows are told apart by a number; the table is written first, so it does not change.
    vectors = cut(whole_vectors(rows)).withColumn("n", F.monotonically_increasing_id())
    queries = vectors.where(is_query)
    sizes = vectors.agg(F.count("*"), F.max(F.size("v")), F.count_if(is_query)).first()
    shards, blocks = (max(1, -(-n * (sizes[1] or 1) // most)) for n, most in ((sizes[0], SHARD_NUMBERS), (sizes[2], QUERY_NUMBERS)))
    number = lambda n, salt: F.pmod(F.xxhash64("n", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("shard", number(shards, "shard")).withColumn("block", each(blocks))
    right = queries.withColumn("q_block", number(blocks, "block")).withColumn("q_shard", each(shards))
    right = right.select("q_shard", "q_block", F.col("n").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def meet(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        if not len(some) or not len(asked):
            return pd.DataFrame(columns=columns, dtype=np.int64)
        shard = Shard(some["vec_id"].to_numpy(), _matrix(some["v"]), some["n"].to_numpy())
        own = asked["query_row"].to_numpy()
        found, _ = shard.search(own, _matrix(asked["q"]), k)
        i, d, s = np.array(found, dtype=np.int64).reshape(-1, 3).T
        return pd.DataFrame({"query_row": own[i], "query_id": asked["query_id"].to_numpy()[i], "vec_id": d, "score": s})

    met = left.groupBy("shard", "block").cogroup(right.groupBy("q_shard", "q_block")).applyInPandas(meet, SCHEMA)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL: `vec_id % 100 = 0` are the queries.
ORACLE = """
WITH whole AS (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         q.n AS n, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.n <> q.n
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rnk, vec_id, score
  FROM scored
)
SELECT query_id, CAST(rnk AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rnk <= 10
"""

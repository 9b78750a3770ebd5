"""Exact top-k by inner product: columnar branch and bound.

Vectors of a block stand in vertical layout, one row per dimension. Scores grow by a block of dimensions at a time;
what the remaining dimensions can add is at most the product of the remaining lengths, so candidates that
cannot reach the k-th best lower bound any more are compacted away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 512
ROW_BLOCK = 8_192
DIMENSIONS = 8


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def branch_and_bound(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int,
                     step: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query index, row indexes, scores) of the k best of ``rows`` for each query; ties to smaller ids.

    ``own`` are the queries' ids, which are no candidates. Whole-number vectors in double precision: exact while
    squared lengths stay below 2**53.
    """
    n, dim = rows.shape
    vertical = np.ascontiguousarray(rows.T)
    cuts = list(range(0, dim, step)) + [dim]

    def rest(x: np.ndarray) -> np.ndarray:  # length of what is left from each cut on
        squares = np.add.reduceat(x * x, cuts[:-1], axis=1) if dim else np.zeros((len(x), 0))
        tail = np.zeros((len(x), len(cuts)))
        tail[:, :-1] = np.sqrt(squares[:, ::-1].cumsum(axis=1)[:, ::-1])
        return tail

    left_q, left_r = rest(queries), np.ascontiguousarray(rest(rows).T)
    first = cuts[min(2, len(cuts) - 1)]
    opened = queries[:, :first] @ vertical[:first]
    for i in range(len(queries)):
        alive = np.flatnonzero(ids != own[i])
        scores = opened[i, alive]
        for c in range(min(2, len(cuts) - 1), len(cuts)):
            if c > 2:
                scores = scores + queries[i, cuts[c - 1]:cuts[c]] @ vertical[cuts[c - 1]:cuts[c], alive]
            if len(alive) <= k or c == len(cuts) - 1:
                continue
            reach = left_q[i, c] * left_r[c, alive]
            floor = np.partition(scores - reach, len(alive) - k)[len(alive) - k]
            keep = scores + reach >= floor - 1e-6 * (1 + abs(floor))
            alive, scores = alive[keep], scores[keep]
        if len(alive) > k:
            least = np.partition(scores, len(alive) - k)[len(alive) - k]
            keep = scores >= least
            alive, scores = alive[keep], scores[keep]
        best = np.lexsort((ids[alive], -scores))[:k]
        yield i, alive[best], scores[best]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id",
                vector: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k rows with the largest integer inner product for every query row: query_id, rank, vec_id, score.

    Components become floor(scale * x). Candidates are all usable rows but the query's own id; fewer than k
    candidates give fewer rows. Null vectors and vectors with null or non-finite components are left out, as are
    null ids; vectors must have one width, and their whole-number squared lengths must stay below 2**53 (else an
    error, never a rounded score). Repeated ids are repeated candidates. Empty tables give empty results. Query blocks
    meet row blocks in a grid of bounded cells; nothing is broadcast.
    """
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    good = vectors.where(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), whole.alias("v"), is_query.alias("q"))
    n, n_q = good.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-n_q // query_block))
    salted = good.withColumn("_h", F.xxhash64("id", "v"))
    q = salted.where("q").select(F.pmod("_h", F.lit(query_blocks)).cast("int").alias("qb"),
                                 F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), "id", "v")
    r = salted.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
                      F.pmod("_h", F.lit(row_blocks)).cast("int").alias("rb"), "id", "v")

    def cell(key_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            if max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max()) >= 2.0 ** 53:
                raise ValueError("vectors are too long for exact whole-number scores")
            own, ids = left["id"].to_numpy(), right["id"].to_numpy()
            for i, at, scores in branch_and_bound(a, b, own, ids, k):
                parts.append((np.full(len(at), own[i]), ids[at], scores.astype("int64")))
        if not parts:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        cols = [np.concatenate(x) for x in zip(*parts)]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(
        cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

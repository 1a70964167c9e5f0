"""Exact top-k inner products by no-random-access aggregation.

Rows are dealt by hash into blocks. A block keeps one list per dimension, sorted by component. For
a query with weight w in a dimension, the list is read from its best end (from the other end if w
is negative), all lists to the same depth, which doubles from round to round. What was read gives
every candidate a lower and an upper bound: components not yet read lie between the list's last
value read and its far end. A query stops once the k-th lower bound beats the upper bound of all
candidates outside the contenders; only then are the contenders' final scores resolved. Blocks'
winners are merged per query.

The query set against all rows is work of that product by its statement; both sides are dealt in
blocks of bounded size.

Defined results: vectors that are null, or hold null or non-finite components, take no part as
queries or candidates. Shorter vectors are as if padded by zeros. Ties go to the smaller vec_id.
A query never finds rows of its own vec_id. Rows that repeat a vec_id are candidates of their own;
repeated query rows give one answer, that of the row with the least vector. Empty tables give no
rows; extra columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import saved, table

CANDIDATES, QUERIES = 4096, 512


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max((len(v) for v in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def block_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """Query number, row number and score of every query's best k rows of one block."""
    width = max(queries.shape[1], rows.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    n = len(rows)
    c = rows.astype(float)
    order = np.argsort(-rows, axis=0, kind="stable")
    lists = np.take_along_axis(c, order, axis=0)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    plus, minus = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    slack = 1e-12 * width * (np.abs(c).max(initial=0) * np.abs(queries).max(initial=0)) if c.size and queries.size else 0.0
    open_, depth = np.arange(len(queries)), max(64, n // 16)
    out = []
    while len(open_):
        depth = min(depth, n)
        seen_top, seen_end = place < depth, place >= n - depth
        upper = np.where(seen_top, c, lists[depth - 1]) @ plus[open_].T + np.where(seen_end, c, lists[n - depth]) @ minus[open_].T
        lower = np.where(seen_top, c, lists[-1]) @ plus[open_].T + np.where(seen_end, c, lists[0]) @ minus[open_].T
        own = ids[:, None] == query_ids[open_][None, :]
        upper[own] = lower[own] = -np.inf
        bar = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(open_), -np.inf)
        contenders = (upper >= bar - slack) & (upper > -np.inf)
        # few contenders are resolved; else the lists are read on
        done = (contenders.sum(axis=0) <= max(4 * k, n // 64)) | (depth == n)
        for q in np.flatnonzero(done):
            found = np.flatnonzero(contenders[:, q])
            score = rows[found] @ queries[open_[q]]
            best = np.lexsort((ids[found], -score))[:k]
            out.append((np.full(len(best), open_[q]), found[best], score[best]))
        open_, depth = open_[~done], depth * 2
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score; both tables have id (long) and v (array<long>)."""
    ship(rows.sparkSession)
    rows, queries = saved(rows.select("id", "v"), "rows"), saved(queries.select("id", "v"), "queries")
    row_blocks, query_blocks = rows.count() // CANDIDATES + 1, queries.count() // QUERIES + 1
    # every block meets every block of queries: copies are dealt by the pair of block numbers
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(row_blocks)).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("qb"), "id", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, query_ids = left.id.to_numpy(np.int64), right.id.to_numpy(np.int64)
        q, r, score = block_top(_matrix(right.v), query_ids, _matrix(left.v), ids, k)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": score})

    found = dealt.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(run, "query_id long, vec_id long, score long")
    ordered = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", ordered.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 64))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v"))
    queries = rows.where("id % 20 = 0").groupBy("id").agg(F.min("v").alias("v"))
    return top_k(queries, rows, 20)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

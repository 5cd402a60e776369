"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become integer weights per term (component). Queries and candidates are dealt into blocks
of bounded size, and every pair of a query block and a candidate block is one group: there each
term's postings are multiplied with the query rows that hold the term and added to a dense score
array; a partition selection keeps each query's best k, and the blocks' winners are merged.
The work is (queries x rows), as the stated query set asks; no task holds more than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Scores held at once by the accumulator.
TILE_SCORES = 1 << 18
#: A term whose postings fill less of the block than this is scattered, else added whole.
SPARSE = 0.25


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, w array<long>): floor(scale * x) of each finite vector."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(
        "vec_id", F.when(F.col("vec_id").isNotNull() & good, F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("w")
    ).where("w is not null")
    return rows.groupBy("vec_id").agg(F.min("w").alias("w"))


def _matrix(rows: pd.Series) -> np.ndarray:
    lengths = rows.map(len).to_numpy()
    out = np.zeros((len(rows), int(lengths.max()) if len(rows) else 0), dtype=np.int64)
    if len(rows) and (lengths == lengths[0]).all():
        out[:] = np.stack(rows.to_numpy())
    else:
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
    return out


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of every query within one pair of blocks; ties to smaller ids."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    dims = min(q.shape[1], c.shape[1])
    top = (np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0)) * max(dims, 1)
    kind = np.int32 if top < 2**31 - 2 else np.int64
    lowest = np.iinfo(kind).min
    postings = []
    for t in range(dims):
        column = c[:, t].astype(kind)
        held = np.flatnonzero(column)
        postings.append((held, column[held]) if len(held) < SPARSE * len(column) else (None, column))
    tile = max(1, TILE_SCORES // max(1, len(c_ids)))
    scores, buffer = np.empty((tile, len(c_ids)), kind), np.empty((tile, len(c_ids)), kind)
    found = []
    for start in range(0, len(q_ids), tile):
        ids, rows = q_ids[start : start + tile], q[start : start + tile].astype(kind)
        acc, term = scores[: len(ids)], buffer[: len(ids)]
        acc[:] = 0
        for t, (held, weights) in enumerate(postings):
            column = rows[:, t]
            if not column.any():
                continue
            if held is None:
                np.multiply(column[:, None], weights[None, :], out=term)
                acc += term
            elif len(held):
                acc[:, held] += column[:, None] * weights[None, :]
        own = np.minimum(np.searchsorted(c_ids, ids), len(c_ids) - 1)
        at = np.flatnonzero(c_ids[own] == ids)
        acc[at, own[at]] = lowest
        keep = min(k, len(c_ids))
        edge = np.partition(acc, len(c_ids) - keep, axis=1)[:, len(c_ids) - keep]
        r, i = np.nonzero((acc >= edge[:, None]) & (acc != lowest))
        s = acc[r, i]
        best = np.lexsort((c_ids[i], -s.astype(np.int64), r))
        r, i, s = r[best], i[best], s[best]
        first = np.searchsorted(r, np.arange(len(ids)))
        kept = (np.arange(len(r)) - first[r]) < k
        found.append(pd.DataFrame({"query_id": ids[r[kept]], "vec_id": c_ids[i[kept]], "score": s[kept].astype(np.int64)}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def exact_topk(
    vectors: DataFrame,
    is_query,
    k: int = K,
    scale: int = SCALE,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the k best other rows of each query.

    is_query: a Column over vec_id. Vectors that are null or hold null or non-finite components
    take no part, nor do rows without an id. Shorter vectors lack the terms beyond their end.
    Of repeated ids the smallest vector counts. Ties go to smaller ids. Empty table: no rows.
    Weights beyond a long, or scores beyond one, are not supported. Other columns are ignored.
    """
    rows = quantised(vectors, scale)
    n, n_q = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, q_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_q / query_block))
    mine, other = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = rows.where(is_query).select(other.alias("qb"), every(blocks).alias("cb"), "vec_id", "w")
    right = rows.select(mine.alias("cb"), every(q_blocks).alias("qb"), "vec_id", "w")

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best_of_block(q["vec_id"].to_numpy(), _matrix(q["w"]), c["vec_id"].to_numpy(), _matrix(c["w"]), k)

    won = (
        left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(pair, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        won.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op4_topk(spark, sf_dir):
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 64)::bigint) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select * from r where rank <= 20
"""

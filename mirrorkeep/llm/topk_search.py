"""Exact top-k search by inner product: term-at-a-time accumulation over an inverted index.

A vector is a sparse row of terms (its places) and integer weights. Candidates are cut into blocks
and each block is inverted: per term, the rows that have it and their weights. A query's weights are
scattered term by term into a dense array with one score per row of the block; a partition of that
array gives the block's best rows, and the best rows of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 64
# Rows of a block of candidates and of queries: what one task holds.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 1024


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v: each component x as floor(scale * x). Rows with a null vector, component or id, or a component
    that is not finite, are left out. A vector without components takes part, with products of 0."""
    x = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull()
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    return vectors.where(usable & finite).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("v"))


def blocked(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows with the number of their block, spread by a hash of the id."""
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def postings(vectors: list[list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By term, the rows that have a weight there and the weights."""
    width = max(map(len, vectors), default=0)
    dense = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        dense[i, : len(v)] = v
    return {t: (rows, dense[rows, t]) for t in range(width) if len(rows := np.flatnonzero(dense[:, t]))}


def search_block(q_ids, q_vectors, c_ids, c_vectors, k: int) -> tuple[list, list, list]:
    """The k best of a block of candidates for each query; a query's own id is no candidate."""
    order = np.argsort(c_ids, kind="stable")
    ids = np.asarray(c_ids, dtype=np.int64)[order]
    index = postings([c_vectors[i] for i in order])
    out: tuple[list, list, list] = ([], [], [])
    for q, v in zip(q_ids, q_vectors, strict=True):
        scores = np.zeros(len(ids), dtype=np.int64)
        for term, weight in enumerate(v):
            if weight and term in index:
                rows, weights = index[term]
                if len(rows) == len(scores):
                    scores += weight * weights
                else:
                    scores[rows] += weight * weights
        own = slice(np.searchsorted(ids, q), np.searchsorted(ids, q, side="right"))
        allowed = np.delete(np.arange(len(ids)), own) if own.stop > own.start else None
        top = best(scores, k) if allowed is None else allowed[best(scores[allowed], k)]
        out[0].append(np.full(len(top), q))
        out[1].append(ids[top])
        out[2].append(scores[top])
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, all if there are fewer.

    ``queries`` and ``candidates`` have ``id`` and ``v`` as integer_vectors() gives them. Ties go to the smaller
    vec_id, further ones between equal ids to the higher score first. Vectors of different lengths agree on the
    terms they share. Ids should be unique: rows that repeat an id are searched and found as rows of their own. Every pair
    of a block of queries and one of candidates is a group, so no task holds more than two blocks.
    """
    n_q, n_c = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (candidates, CANDIDATE_BLOCK)))
    spread = F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))
    left = blocked(queries, n_q).select(F.col("block").alias("q_block"), spread.alias("c_block"), "id", "v", F.lit(True).alias("asks"))
    right = blocked(candidates, n_c).withColumnRenamed("block", "c_block")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q_block"), "c_block", "id", "v", F.lit(False).alias("asks"))

    def search(key, left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        found = search_block(
            left_table["id"].to_pylist(), left_table["v"].to_pylist(), right_table["id"].to_pylist(), right_table["v"].to_pylist(), k
        )
        columns = [np.concatenate([np.empty(0, dtype=np.int64), *x]).astype(np.int64) for x in found]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    pairs = left.groupBy("q_block", "c_block").cogroup(right.groupBy("q_block", "c_block"))
    found = pairs.applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact inner-product search of a query set against all vectors, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to every executor at once, at most; more are answered block by block.
QUERY_BLOCK = 8_192
#: Vectors that are compared with a block of queries in one matrix product.
ROW_BLOCK = 4_096


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _search(keys: np.ndarray, queries: np.ndarray, k: int, unit: bool):
    """The ``k`` best rows of a task for each query; a task keeps no more than these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(keys), 0), -np.inf)
        where = np.zeros((len(keys), 0), keys.dtype)
        kind = None
        for batch in batches:
            kind = batch.schema.field("x_key").type
            for part in (batch.slice(i, ROW_BLOCK) for i in range(0, batch.num_rows, ROW_BLOCK)):
                x_key = part.column("x_key").to_numpy(zero_copy_only=False)
                order = np.argsort(x_key, kind="stable")
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                x, x_key = (_unit(x) if unit else x)[order], x_key[order]
                score = np.round(queries @ x.T, 6)
                score[keys[:, None] == x_key[None, :]] = -np.inf  # a row does not find itself
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best = np.concatenate([best, np.take_along_axis(score, top, 1)], axis=1)
                where = np.concatenate([where, x_key[top]], axis=1)
                # By score, of ties the lesser key.
                rank = np.argsort(where, axis=1, kind="stable")
                best, where = np.take_along_axis(best, rank, 1), np.take_along_axis(where, rank, 1)
                rank = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, where = np.take_along_axis(best, rank, 1), np.take_along_axis(where, rank, 1)
        if kind is not None:
            ok = np.isfinite(best)
            q = np.broadcast_to(keys[:, None], best.shape)
            yield pa.RecordBatch.from_arrays([pa.array(q[ok], kind), pa.array(where[ok], kind), pa.array(best[ok])], ["query_id", "match_id", "score"])

    return run


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, unit: bool = True) -> DataFrame:
    """``query_id, match_id, score, rank``: the ``k`` nearest other rows of each query; ties by id.

    Queries are sent out in blocks of at most ``QUERY_BLOCK``; the rows stay
    where they are scanned, and each task gives ``k`` of them per query, so
    only those are shuffled.  Null and empty vectors are left out, a zero
    vector scores 0; vectors are of one length.
    """
    known = lambda d: d.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    q = known(queries).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    x = known(rows).select(F.col(key).alias("x_key"), F.col(vector).alias("x"))
    kind = rows.schema[key].dataType.simpleString()
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        own = q.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()
        if not own:
            continue
        keys, m = np.array([r.k for r in own]), np.array([r.v for r in own], np.float64)
        keys = keys.astype(object) if keys.dtype.kind == "U" else keys
        part = x.mapInArrow(_search(keys, _unit(m) if unit else m, k, unit), f"query_id {kind}, match_id {kind}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], f"query_id {kind}, match_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def broken_vectors(rows: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """``key, problem`` of vectors that are missing, of another length, not finite or zero."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    problem = (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dimension, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(norm < 1e-8, "zero")
    )
    return rows.select(key, problem.alias("problem")).where("problem is not null")

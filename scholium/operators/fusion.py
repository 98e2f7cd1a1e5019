"""Combining ranked channels: reciprocal ranks, caps per group, guards, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_ranks(channels: list[tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """``key, fusion_score, fusion_rank, best_rank`` of ``(key, rank)`` channels with weights; ties by best rank, then key."""
    parts = [d.select(key, (F.lit(w) / (k + F.col("rank"))).alias("s"), "rank") for d, w in channels]
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy(key).agg(F.sum("s").alias("s"), F.min("rank").alias("best_rank"))
    order = Window.orderBy(F.desc("fusion_score"), "best_rank", key)
    return fused.select(key, F.round("s", 8).alias("fusion_score"), "best_rank").withColumn("fusion_rank", F.row_number().over(order))


def diversified(ranked: DataFrame, group: list[str], rank: str, cap: int, k: int) -> DataFrame:
    """At most ``cap`` rows per group, then the first ``k``, ranked anew; the same as taking rows greedily."""
    within = Window.partitionBy(*group).orderBy(rank)
    kept = ranked.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= cap).drop("_n").orderBy(rank).limit(k)
    return kept.withColumn("new_rank", F.row_number().over(Window.orderBy(rank)))


def guarded(reranked: DataFrame, protected: DataFrame, key: str, rank: str, keep: int, k: int) -> DataFrame:
    """``k`` rows: the ``keep`` best of the protected ones first, then the others in order."""
    marked = reranked.join(F.broadcast(protected.select(key).distinct().withColumn("_p", F.lit(1))), key, "left")
    first = Window.partitionBy("_p").orderBy(rank)
    order = marked.withColumn("_f", F.when(F.col("_p").isNotNull() & (F.row_number().over(first) <= keep), 0).otherwise(1))
    top = order.orderBy("_f", rank).limit(k)
    return top.withColumn("guarded_rank", F.row_number().over(Window.orderBy("_f", rank))).drop("_p", "_f")


def two_corpora(a: DataFrame, b: DataFrame, key: str, k: int, names: tuple[str, str] = ("modern", "ancient")) -> DataFrame:
    """Fused ranks of two corpora with at least one row of the second, if it has any: its best takes the last place."""
    parts = [d.select(key, "rank", F.lit(n).alias("corpus")) for d, n in zip((a, b), names)]
    every = parts[0].unionByName(parts[1]).withColumn("score", 1.0 / (RRF_K + F.col("rank")))
    order = Window.orderBy(F.desc("score"), "corpus", key)
    placed = every.withColumn("place", F.row_number().over(order))
    one = Window.partitionBy("corpus").orderBy("place")
    best = placed.withColumn("_b", F.row_number().over(one))
    top = best.where(F.col("place") <= k).agg(F.count_if(F.col("corpus") == names[1]).alias("n_second"))
    out = best.crossJoin(F.broadcast(top))
    lone = (F.col("corpus") == names[1]) & (F.col("_b") == 1) & (F.col("n_second") == 0)
    some = best.where(F.col("corpus") == names[1]).agg(F.count(F.lit(1)).alias("n_any"))
    out = out.crossJoin(F.broadcast(some))
    most = F.when((F.col("n_second") == 0) & (F.col("n_any") > 0), k - 1).otherwise(k)
    kept = out.where((F.col("place") <= most) | lone)
    return kept.select(key, "corpus", F.round("score", 8).alias("score"), F.least("place", F.lit(k)).alias("place"))


def overlap_score(question: list[str], tokens: Column) -> Column:
    """Share of the question's tokens that a text has: the stand-in for a cross-encoder."""
    wanted = list(dict.fromkeys(question))
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))) / F.lit(float(len(wanted)))

"""Retrieval as a whole: channels of ranked units per question, fused, spread over groups, reranked, guarded and routed.

A channel is a table ``question_id, unit_id, rank`` (any further columns are
ignored).  All questions are answered together; a window never holds more than
one question's candidates, of which a channel has at most ``MOST_RESULTS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits and weights of retrieval.
MOST_RESULTS, WIDEN, PER_GROUP = 100, 4, 3
RRF_K, KEYWORD_WEIGHT, VECTOR_WEIGHT = 60, 1.5, 1.0
#: Score of a page named by a locator, to which the hits of its focus are added.
LOCATED = 100.0
MODES = ("keyword", "vector", "hybrid", "second_vector", "reranked_hybrid", "third_vector", "third_reranked_hybrid")


def wanted(k: int) -> int:
    """Results that may be asked for."""
    if k < 1:
        raise ValueError("at least one result must be asked for")
    return min(k, MOST_RESULTS)


def candidates(k: int) -> int:
    """Candidates that a channel gives for ``k`` results."""
    return min(max(WIDEN * k, k), MOST_RESULTS)


def _per_question(*order: Column | str):
    return Window.partitionBy("question_id").orderBy(*order)


def best(scored: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The ``k`` first rows of each question with their ``rank``."""
    return scored.withColumn("rank", F.row_number().over(_per_question(*order))).where(F.col("rank") <= k)


def fuse(keyword: DataFrame, vector: DataFrame, k: int, keyword_weight: float = KEYWORD_WEIGHT, vector_weight: float = VECTOR_WEIGHT) -> DataFrame:
    """``question_id, unit_id, fusion_score, keyword_rank, vector_rank, rank``: reciprocal ranks added up; ties by best rank, then unit."""
    parts = [
        d.select("question_id", "unit_id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("s"), F.col("rank").alias(name))
        for d, w, name in ((keyword, keyword_weight, "keyword_rank"), (vector, vector_weight, "vector_rank"))
    ]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True)
    fused = every.groupBy("question_id", "unit_id").agg(F.round(F.sum("s"), 10).alias("fusion_score"), F.min("keyword_rank").alias("keyword_rank"), F.min("vector_rank").alias("vector_rank"))
    return best(fused, k, F.desc("fusion_score"), F.least("keyword_rank", "vector_rank"), "unit_id")


def diversified(ranked: DataFrame, group: str | list[str], k: int, cap: int = PER_GROUP) -> DataFrame:
    """At most ``cap`` units of a group, the first ``k``, with ``rank`` anew; the same as taking them greedily."""
    groups = [group] if isinstance(group, str) else group
    within = Window.partitionBy("question_id", *groups).orderBy("rank")
    kept = ranked.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= cap).drop("_n")
    return best(kept, k, F.col("rank"))


def with_missing(chosen: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """The candidates and the ``k`` best of the keyword channel that are not among them (without a fusion score)."""
    first = keyword.where(F.col("rank") <= k).select("question_id", "unit_id").join(chosen.select("question_id", "unit_id"), ["question_id", "unit_id"], "left_anti")
    return chosen.select("question_id", "unit_id", "fusion_score").unionByName(first.withColumn("fusion_score", F.lit(None).cast("double")))


def reranked(chosen: DataFrame, scores: DataFrame) -> DataFrame:
    """All candidates by ``rerank`` (of ``scores``: question, unit, rerank), then fusion score, then unit."""
    known = chosen.join(scores.select("question_id", "unit_id", "rerank"), ["question_id", "unit_id"])
    return known.withColumn("rank", F.row_number().over(_per_question(F.desc("rerank"), F.desc(F.coalesce("fusion_score", F.lit(0.0))), "unit_id")))


def guarded(ranked: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """``k`` units: the keyword channel's ``k`` best first, as they are reranked, then the others; ``protected`` tells which."""
    marks = keyword.where(F.col("rank") <= k).select("question_id", "unit_id", F.lit(True).alias("_p"))
    marked = ranked.join(marks, ["question_id", "unit_id"], "left").withColumn("protected", F.coalesce("_p", F.lit(False))).drop("_p")
    return best(marked, k, F.desc("protected"), F.col("rank"))


def located(units: DataFrame, question_id: str, title: Column, text: Column, source: str, focus: list[str]) -> DataFrame:
    """``question_id, unit_id, score``: units whose title and the named one hold each other, by the hits of the focus's spellings."""
    hits = sum((F.size(F.split(text, _literal(v), -1)) - 1 for v in focus if v), F.lit(0))
    same = title.contains(source) | (F.lit(source).contains(title) & (title != ""))
    scored = units.select(F.lit(question_id).alias("question_id"), "unit_id", same.alias("_s"), hits.alias("_h"))
    return scored.where("_s and _h > 0").select("question_id", "unit_id", (F.lit(LOCATED) + F.col("_h")).alias("score"))


def _literal(v: str) -> str:
    return "\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def search(mode: str, k: int, group: DataFrame, keyword: DataFrame, vectors: dict[str, DataFrame], scores: DataFrame | None = None) -> DataFrame:
    """``question_id, unit_id, rank`` of a corpus in one of the ``MODES``.

    ``group`` (``unit_id, group_id``) names the document of a unit, ``vectors``
    the vector channels by encoder (``first``, ``second``, ``third``), ``scores``
    the reranker's.  Unknown modes are an error.
    """
    k, n = wanted(k), candidates(k)
    grouped = lambda d: d.join(group, "unit_id")
    encoder = {"second_vector": "second", "reranked_hybrid": "second", "third_vector": "third", "third_reranked_hybrid": "third"}.get(mode, "first")
    if mode == "keyword":
        out = diversified(grouped(keyword.where(F.col("rank") <= n)), "group_id", k)
    elif mode.endswith("vector"):
        out = diversified(grouped(vectors[encoder].where(F.col("rank") <= n)), "group_id", k)
    elif mode == "hybrid":
        out = diversified(grouped(fuse(keyword, vectors[encoder], MOST_RESULTS)), "group_id", k)
    elif mode.endswith("reranked_hybrid"):
        chosen = diversified(grouped(fuse(keyword, vectors[encoder], MOST_RESULTS)), "group_id", MOST_RESULTS).drop("group_id")
        out = diversified(grouped(reranked(chosen, scores)), "group_id", k)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return out.select("question_id", "unit_id", "rank")


def search_pages(mode: str, k: int, group: DataFrame, keyword: DataFrame, vector: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """The same for a corpus of pages: the keyword channel's best are never lost to the reranker."""
    k = wanted(k)
    grouped = lambda d: d.join(group, "unit_id")
    if mode == "keyword":
        out = diversified(grouped(keyword.where(F.col("rank") <= k)), "group_id", k)
    elif mode == "third_vector":
        out = diversified(grouped(vector.where(F.col("rank") <= k)), "group_id", k)
    elif mode == "third_reranked_hybrid":
        chosen = diversified(grouped(fuse(keyword, vector, MOST_RESULTS)), "group_id", MOST_RESULTS).drop("group_id")
        out = guarded(reranked(with_missing(chosen, keyword, k), scores), keyword, k)
    else:
        raise ValueError(f"unknown mode for pages: {mode}")
    return out.select("question_id", "unit_id", "rank")


def both_corpora(modern: DataFrame, ancient: DataFrame, group: DataFrame, k: int) -> DataFrame:
    """``question_id, unit_id, corpus, rank``: both corpora's results fused, spread over their documents; the second one has at least one place if it has a result.

    Unit ids of the two must differ.
    """
    k = wanted(k)
    fused = fuse(modern, ancient, 2 * candidates(k), 1.0, 1.0).withColumn("corpus", F.when(F.col("vector_rank").isNotNull(), "ancient").otherwise("modern"))
    chosen = diversified(fused.join(group, "unit_id"), ["corpus", "group_id"], k).select("question_id", "unit_id", "corpus", "rank")
    shown = chosen.groupBy("question_id").agg(F.max((F.col("corpus") == "ancient").cast("int")).alias("_shown"))
    lone = ancient.where(F.col("rank") == 1).select("question_id", "unit_id").join(shown, "question_id", "left").where(F.coalesce("_shown", F.lit(0)) == 0)
    place = chosen.groupBy("question_id").agg(F.least(F.count(F.lit(1)) + 1, F.lit(k)).cast("int").alias("rank"))
    last = lone.drop("_shown").join(place, "question_id", "left").select("question_id", "unit_id", F.lit("ancient").alias("corpus"), F.coalesce("rank", F.lit(1)).alias("rank"))
    kept = chosen.join(last.select("question_id", F.col("rank").alias("_last")), "question_id", "left").where(F.col("_last").isNull() | (F.col("rank") < F.col("_last"))).drop("_last")
    return kept.unionByName(last)


def source(units: DataFrame, pages: DataFrame, document: str, page: int, mode: str = "auto") -> DataFrame:
    """``corpus, unit_id, text`` of a document's page; the form of its id tells the corpus, unless ``mode`` does."""
    if mode not in ("auto", "modern", "ancient"):
        raise ValueError(f"unknown mode: {mode}")
    if mode != "modern" and document.startswith("ancient:"):
        held = pages.where((F.col("group_id") == document) & (F.col("page") == page))
        return held.select(F.lit("ancient").alias("corpus"), "unit_id", "text")
    held = units.where((F.col("group_id").cast("string") == document) & (F.col("page") == page))
    return held.select(F.lit("modern").alias("corpus"), "unit_id", "text")

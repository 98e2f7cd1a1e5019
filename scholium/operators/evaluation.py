"""Quality of retrieval: recall, reciprocal rank, refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_quality(ranked: DataFrame, questions: DataFrame, by: str | None = None) -> DataFrame:
    """``[by,] n_questions, recall_5, recall_10, mrr_10, refusal_accuracy``.

    ``ranked`` has ``question_id, unit_id, rank``; ``questions`` has
    ``question_id, expected`` (array of unit ids; empty if the question has no
    answer).  A question without an answer is right if nothing was returned.
    """
    wanted = questions.select("question_id", F.explode_outer("expected").alias("unit_id"))
    hit = ranked.join(wanted.where("unit_id is not null"), ["question_id", "unit_id"]).groupBy("question_id").agg(F.min("rank").alias("first"))
    returned = ranked.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    cols = [by] if by else []
    q = questions.select("question_id", *cols, (F.size("expected") > 0).alias("answerable")).join(hit, "question_id", "left").join(returned, "question_id", "left")
    within = lambda k: F.when(F.col("answerable"), F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)))
    rr = F.when(F.col("answerable"), F.coalesce(F.when(F.col("first") <= 10, 1.0 / F.col("first")), F.lit(0.0)))
    refused = F.when(~F.col("answerable"), F.col("n").isNull().cast("double"))
    return q.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.round(F.avg(within(5)), 6).alias("recall_5"),
        F.round(F.avg(within(10)), 6).alias("recall_10"),
        F.round(F.avg(rr), 6).alias("mrr_10"),
        F.round(F.avg(refused), 6).alias("refusal_accuracy"),
    )

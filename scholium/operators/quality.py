"""Rules over records, duplicates, conflicts, differences between snapshots, digests, ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, key: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """``record_id, severity, code``: one row for each rule a record breaks, in a single pass over the data."""
    broken = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, test in rules]))
    return df.select(key.cast("string").alias("record_id"), F.explode(broken).alias("i")).select("record_id", "i.severity", "i.code")


def duplicates(df: DataFrame, key: Column, code: str) -> DataFrame:
    """``record_id, severity, code`` of values that stand more than once; nulls never do."""
    many = df.select(key.cast("string").alias("record_id")).where("record_id is not null").groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.select("record_id", F.lit("error").alias("severity"), F.lit(code).alias("code"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def conflicts(df: DataFrame, key: str, *identity: str) -> DataFrame:
    """``key, n_identities`` of keys that stand for more than one combination of the identity columns."""
    same = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in identity])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(same).alias("n_identities")).where("n_identities > 1")


def snapshot_difference(old: DataFrame, new: DataFrame, key: str, content: Column) -> DataFrame:
    """``key, state``: added, missing, changed or unchanged between two snapshots (one row per key each)."""
    a, b = old.select(key, content.alias("_a")), new.select(key, content.alias("_b"))
    state = (
        F.when(F.col("_in_a").isNull(), "added")
        .when(F.col("_in_b").isNull(), "missing")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged")
        .otherwise("changed")
    )
    both = a.withColumn("_in_a", F.lit(1)).join(b.withColumn("_in_b", F.lit(1)), key, "full_outer")
    return both.select(key, state.alias("state"))


def corpus_digest(df: DataFrame, group: list[str], content: Column) -> DataFrame:
    """``group, n_rows, digest``: a digest of rows as a multiset, whatever their order.

    The digest is the hash of four sums, each of a quarter of the rows' hashes:
    sums are combined before the shuffle, so a group of any size is one row
    per task, and a repeated row counts as often as it stands there.
    """
    h = F.sha2(F.coalesce(content, F.lit("")), 256)
    quarters = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = df.select(*group, h.alias("h")).groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *quarters)
    return sums.select(*group, "n_rows", F.sha2(F.concat_ws("|", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def not_done(tasks: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Tasks that the ledger does not name."""
    return tasks.join(ledger.select(key).distinct(), key, "left_anti")


def equal_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side`` of keys that only one of two tables has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))

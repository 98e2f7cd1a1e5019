"""Enrichment, multiple testing, overlap of sets, weighted scores and their stability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of numbers from 1 on, to about 13 digits: Stirling's series, eight steps further up."""
    x = x.cast("double")
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    steps = F.lit(1.0)
    for i in range(8):
        steps = steps * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * F.log(F.lit(2 * math.pi)) + series - F.log(steps)


def log_factorial(n: Column) -> Column:
    """Logarithm of ``n!``; a closed expression, no table."""
    return log_gamma(n + 1)


#: Spreads of the distribution beyond which its terms no longer count (each is below 10^-30 of the greatest).
TAIL_SPREADS = 12


def hypergeometric_tail(tests: DataFrame, key: str) -> DataFrame:
    """``key, p``: chance of at least ``k`` hits among ``n`` drawn of a population ``N`` with ``K`` successes.

    ``tests`` has ``k, n, K_, N_``.  No hit needed gives 1, more hits than
    possible give 0.  The shorter side of the distribution is summed, from the
    nearest term on and as far as terms count: as many as a few spreads, which
    grow with the root of the numbers.
    """
    k, n, big, pop = (F.col(c).cast("long") for c in ("k", "n", "K_", "N_"))
    low, high = F.greatest(F.lit(0), n - (pop - big)), F.least(big, n)
    mean = n.cast("double") * big / pop
    spread = F.sqrt(mean * (1 - big / pop) * F.greatest(F.lit(0.0), (pop - n) / F.greatest(pop - 1, F.lit(1)))) * TAIL_SPREADS + 60
    upper = k > mean
    first = F.when(upper, F.greatest(k, low)).otherwise(F.greatest(low, F.floor(F.least(mean, k.cast("double")) - spread)))
    last = F.when(upper, F.least(high, F.ceil(k + spread))).otherwise(F.least(high, k - 1))
    comb = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    term = lambda i: F.exp(comb(big, i) + comb(pop - big, n - i) - comb(pop, n))
    steps = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(F.transform(steps, term), F.lit(0.0), lambda a, x: a + x)
    p = F.when(k <= low, 1.0).when(k > high, 0.0).when(upper, total).otherwise(1 - total)
    return tests.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))


def benjamini_hochberg(df: DataFrame, key: str, p: str, name: str = "q") -> DataFrame:
    """Adds the adjusted p-value: the running least of ``p * m / rank`` from the greatest p on.

    The tests of one family are few (terms, pathways), never the corpus.
    """
    up = Window.orderBy(p, key)
    down = Window.orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    m = df.agg(F.count(F.lit(1)).alias("_m"))
    ranked = df.withColumn("_r", F.row_number().over(up)).crossJoin(F.broadcast(m))
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")


def set_overlaps(members: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """``a, b, common, jaccard`` of groups (a < b) with at least ``least`` common items.

    Items of one group only are dropped before the join; groups are a
    catalogue's (terms, compounds), so pairs of groups are bounded by it.
    """
    pairs = members.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    sizes = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # All groups of an item on one row: bounded by the catalogue, and hot items cost a row, not a join.
    together = pairs.groupBy("i").agg(F.array_sort(F.collect_set("g")).alias("gs")).where(F.size("gs") > 1).groupBy("gs").agg(F.count(F.lit(1)).alias("w"))
    both = (
        together.select("w", F.posexplode("gs").alias("at", "a"), "gs")
        .select("a", "w", F.explode(F.slice("gs", F.col("at") + 2, F.size("gs"))).alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("w").alias("common"))
        .where(F.col("common") >= least)
    )
    a, b = sizes.select(F.col("g").alias("a"), F.col("n").alias("na")), sizes.select(F.col("g").alias("b"), F.col("n").alias("nb"))
    share = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return both.join(a, "a").join(b, "b").select("a", "b", "common", F.round(share, 6).alias("jaccard"))


def scenarios(weights: dict[str, float], step: float = 0.2, shift: tuple[str, str, float] | None = None) -> list[tuple[str, dict[str, float]]]:
    """The weights as they are, with each one lowered and raised by a share, and with an amount moved between two of them, all rescaled to sum to 1."""
    out = [("baseline", dict(weights))]
    if shift:
        a, b, by = shift
        out += [(f"{a}_to_{b}", weights | {a: weights[a] - by, b: weights[b] + by}), (f"{b}_to_{a}", weights | {a: weights[a] + by, b: weights[b] - by})]
    for d in weights:
        for label, by in (("minus", 1 - step), ("plus", 1 + step)):
            out.append((f"{d}_{label}", weights | {d: weights[d] * by}))
    return [(name, {d: w / sum(ws.values()) for d, w in ws.items()}) for name, ws in out]


def rank_stability(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """``key, rank_min, rank_max, rank_mean, score_min, score_max, top_share`` over all scenarios; ties by key."""
    cases = scenarios(weights)
    score = lambda ws: sum((F.coalesce(F.col(d), F.lit(0.0)) * F.lit(w) for d, w in ws.items()), F.lit(0.0))
    every = df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.round(score(ws), 8).alias("score")) for n, ws in cases])).alias("x")).select(key, "x.*")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("score"), key)))
    return ranked.groupBy(key).agg(
        F.min("rank").alias("rank_min"),
        F.max("rank").alias("rank_max"),
        F.round(F.avg("rank"), 4).alias("rank_mean"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("top_share"),
    )


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """``stage_no, stage, before_n, excluded_n, after_n``: how many rows pass each stage after all stages before it."""
    passed, cols = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, (_, test) in enumerate(stages, 1):
        passed = passed & F.coalesce(test, F.lit(False))
        cols.append(F.count_if(passed).alias(f"n{i}"))
    one = df.agg(*cols)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"n{i-1}").alias("before_n"), (F.col(f"n{i-1}") - F.col(f"n{i}")).alias("excluded_n"), F.col(f"n{i}").alias("after_n"))
            for i, (name, _) in enumerate(stages, 1)
        ]
    )
    return one.select(F.explode(rows).alias("x")).select("x.*")

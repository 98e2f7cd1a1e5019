"""What the stages of a pipeline share: task lists, status, locked keys, redo, guards, and the rules over policies and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_tasks(books: DataFrame, book: str, page_count: str, shards: int) -> DataFrame:
    """``book, page, shard``: every page of every book as a task, dealt out over shards; books without a page count have none."""
    n = F.col(page_count)
    return books.where(F.col(book).isNotNull() & (n >= 1)).select(book, F.explode(F.sequence(F.lit(1), n)).alias("page")).withColumn("shard", F.pmod(F.col("page"), F.lit(shards)))


def not_current(tasks: DataFrame, done: DataFrame, key: list[str], version: str, redo: DataFrame | None = None) -> DataFrame:
    """Tasks that ``done`` does not hold in their version, or that ``redo`` names again."""
    left = tasks.join(done.select(*key, version).distinct(), [*key, version], "left_anti")
    if redo is None:
        return left
    again = tasks.join(redo.select(*key).distinct(), key, "left_semi")
    return left.unionByName(again).dropDuplicates([*key, version])


def status(df: DataFrame, group: str, **states: Column) -> DataFrame:
    """``group, n`` and how many rows are in each state."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in states.items()])


def locked_keys(df: DataFrame, key: str) -> DataFrame:
    """``key, n, accepted``: keys that stand once are accepted, repeated ones rejected; nulls are no keys."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("accepted", F.col("n") == 1)


def guarded_number(c: Column, low: float, high: float) -> tuple[Column, Column]:
    """A number read from anything, null unless it is one within the range; and what is wrong with it (empty if nothing)."""
    x = c.cast("string").try_cast("double")
    bad = F.when(c.isNull(), "missing").when(x.isNull() | F.isnan(x), "not_a_number").when((x < low) | (x > high), "out_of_range").otherwise("")
    return F.when(bad == "", x), bad


def inherited(own: Column, primary: Column) -> Column:
    """A record's own value if it has one that is not blank, else its primary's."""
    return F.when(F.trim(F.coalesce(own, F.lit(""))) != "", own).otherwise(primary)


def denied(path: Column, suffixes: list[str], prefixes: list[str], names: list[str]) -> Column:
    """Why a path may not be published: ``name``, ``prefix``, ``suffix``, or empty."""
    p = F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"))
    one_of = lambda test, xs: F.exists(F.array(*map(F.lit, xs)), test)
    return (
        F.when(one_of(lambda x: F.substring_index(p, "/", -1) == x, names), "name")
        .when(one_of(lambda x: F.startswith(p, x), prefixes), "prefix")
        .when(one_of(lambda x: F.endswith(p, x), suffixes), "suffix")
        .otherwise("")
    )


def overridden(base: DataFrame, side: DataFrame, key: str, text: str, side_text: str, side_hash: str) -> DataFrame:
    """``key, text, layout``: a side table's text where it was made of the text at hand (``current``), the own one otherwise (``stale``, ``none``)."""
    s = side.select(key, F.col(side_text).alias("_t"), F.col(side_hash).alias("_h"))
    fits = F.col("_h") == F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    layout = F.when(F.col("_h").isNull(), "none").when(fits, "current").otherwise("stale")
    return base.select(key, text).join(s, key, "left").select(key, F.when(fits, F.col("_t")).otherwise(F.col(text)).alias(text), layout.alias("layout"))


def inside(edges: DataFrame, ends: tuple[str, str], nodes: DataFrame, node: str) -> DataFrame:
    """Edges with both ends among the nodes, without self-loops."""
    known = nodes.select(F.col(node).alias("_n")).distinct()
    for c in ends:
        edges = edges.join(known, F.col(c) == F.col("_n"), "left_semi")
    return edges.where(F.col(ends[0]) != F.col(ends[1]))


def completeness(df: DataFrame, group: str, required: list[str]) -> DataFrame:
    """``group, n, complete_share``: the share of records with every required field (blank text is none)."""
    full = F.lit(True)
    for c in required:
        kind = dict(df.dtypes)[c]
        full = full & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "" if kind == "string" else F.col(c).isNotNull())
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(full.cast("double")), 6).alias("complete_share"))


def key_sets(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """``present, n_keys``: by which tables have a key (names joined by ``+``); the sets are equal if there is one row, with all names."""
    every = None
    for name, df in tables.items():
        part = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.lit(name).alias("t")).distinct()
        every = part if every is None else every.unionByName(part)
    of = every.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("t")), "+").alias("present"))
    return of.groupBy("present").agg(F.count(F.lit(1)).alias("n_keys"))


def conserved(df: DataFrame, group: str, kept: Column, dropped: Column) -> DataFrame:
    """``group, candidates, kept, dropped, conserved``: whether each candidate was either kept or dropped."""
    test = lambda c: F.coalesce(c, F.lit(False))
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(test(kept)).alias("kept"), F.count_if(test(dropped)).alias("dropped"))
    return out.withColumn("conserved", F.col("candidates") == F.col("kept") + F.col("dropped"))


def collisions(forms: DataFrame, form: str, term: str) -> DataFrame:
    """``form, n_terms, terms`` of surface forms that name several terms."""
    seen = forms.where(F.col(form).isNotNull() & (F.trim(form) != "")).groupBy(F.lower(F.trim(form)).alias("form")).agg(F.array_sort(F.collect_set(term)).alias("t"))
    return seen.where(F.size("t") > 1).select("form", F.size("t").alias("n_terms"), F.array_join("t", ",").alias("terms"))


def tier(gates: list[Column], score: Column, high: float, middle: float) -> Column:
    """``eliminated`` if a gate failed, ``provisional`` while one is open, else the tier of the score."""
    failed, is_open = F.lit(False), F.lit(False)
    for g in gates:
        failed, is_open = failed | (F.coalesce(g, F.lit("open")) == "failed"), is_open | (F.coalesce(g, F.lit("open")) == "open")
    return F.when(failed, "eliminated").when(is_open, "provisional").when(score >= high, "high").when(score >= middle, "middle").otherwise("low")


def question_issues(questions: DataFrame) -> DataFrame:
    """``record_id, severity, code`` of an evaluation set (``question_id, category, question, expected``)."""
    from scholium.operators import quality

    rules = [
        ("error", "question_empty", F.trim(F.coalesce("question", F.lit(""))) == ""),
        ("error", "category_missing", F.trim(F.coalesce("category", F.lit(""))) == ""),
        ("error", "expected_repeated", F.size(F.array_distinct("expected")) < F.size("expected")),
    ]
    return quality.issues(questions, F.col("question_id"), rules).unionByName(quality.duplicates(questions, F.col("question_id"), "question_id_repeated"))

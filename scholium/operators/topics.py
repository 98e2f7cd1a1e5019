"""Topics of a text by patterns, and how relevant they make it; the topics are the caller's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a title adds, hits that count, the most of one topic, of all, of a text off topic, and of one without a topic.
TITLE_BONUS, MOST_HITS, MOST_PER_TOPIC, MOST, MOST_OFF_TOPIC, MOST_WITHOUT = 8, 5, 30, 100, 35, 10


@dataclass(frozen=True)
class Topic:
    """A topic's name, weight and patterns (over lower-case text); a core topic makes a text on topic."""

    tag: str
    weight: int
    patterns: tuple[str, ...]
    core: bool = False


def prepared(df: DataFrame, title: str, text: str, *kept: str) -> DataFrame:
    """``kept, low_title, hay``: what the patterns are tried on, made once per row."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return df.select(*kept, low.alias("low_title"), F.concat(low, F.lit("\n"), F.lower(F.coalesce(text, F.lit("")))).alias("hay"))


def topic_hits(topics: list[Topic]) -> Column:
    """``tag, points, core`` of each topic that occurs in a prepared row, in the order given: weight, title bonus and hits, up to the most of one topic."""
    found = []
    for t in topics:
        n = sum((F.regexp_count("hay", F.lit(p)) for p in t.patterns), F.lit(0))
        bonus = F.when(F.col("low_title").rlike("|".join(t.patterns)), TITLE_BONUS).otherwise(0)
        found.append(F.struct(F.lit(t.tag).alias("tag"), n.alias("n"), (F.lit(t.weight) + bonus).alias("base"), F.lit(t.core).alias("core")))
    hits = F.filter(F.array(*found), lambda h: h["n"] > 0)
    points = lambda h: F.least(h["base"] + F.least(h["n"], F.lit(MOST_HITS)), F.lit(MOST_PER_TOPIC))
    return F.transform(hits, lambda h: F.struct(h["tag"].alias("tag"), points(h).alias("points"), h["core"].alias("core")))


def relevance(hits: Column) -> Column:
    """0 to 100 from ``topic_hits``; texts without a core topic, or without any, reach less."""
    total = F.least(F.lit(MOST), F.aggregate(hits, F.lit(0), lambda a, h: a + h["points"]))
    most = F.when(F.size(hits) == 0, MOST_WITHOUT).when(~F.exists(hits, lambda h: h["core"]), MOST_OFF_TOPIC).otherwise(MOST)
    return F.least(total, most)


def tags(hits: Column) -> Column:
    """The topics' names, with ``off_topic`` last where no core topic is among them."""
    names = F.transform(hits, lambda h: h["tag"])
    return F.when(F.exists(hits, lambda h: h["core"]), names).otherwise(F.array_append(names, F.lit("off_topic")))

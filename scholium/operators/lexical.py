"""Keyword retrieval: BM25 with field weights, boolean groups, phrases, counted terms."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators.questions import plain
from scholium.session import durable

K1, B = 1.2, 0.75
# Weights of the indexed fields.
FIELD_WEIGHTS = {"title": 4.0, "text": 1.0, "grams": 1.8, "tags": 1.5}


def index_fields(title: Column, text: Column, tags: Column) -> dict[str, Column]:
    """The token arrays of a unit's fields."""
    both = F.concat_ws("\n", title, text)
    return {"title": T.tokens(title), "text": T.tokens(text), "grams": T.char_ngrams(both), "tags": T.tokens(tags)}


@dataclass(frozen=True)
class Index:
    """A kept index: ``token, key, f, len`` of every unit and token, sorted by token, and the units' number and mean length."""

    postings: DataFrame
    key: str
    n_units: int
    mean_len: float


#: Parts over which the postings of one token are spread, so that a frequent one is no task of its own.
TOKEN_PARTS = 8


def build_index(units: DataFrame, key: str, fields: dict[str, Column], weights: dict[str, float] = FIELD_WEIGHTS) -> Index:
    """Reads every unit once and keeps its postings in the shared folder, so that questions read only those of their tokens."""
    size = sum((F.size(f) for f in fields.values()), F.lit(0))
    every = F.concat(*[_weighed(f, weights[n]) for n, f in fields.items()])
    rows = units.select(key, size.alias("len"), every.alias("hits"))
    # A unit without tokens keeps a row, so that it counts.
    counted = rows.select(key, "len", F.explode_outer("hits").alias("h")).groupBy(key, "len", F.col("h.token").alias("token")).agg(F.sum("h.w").alias("f"))
    kept = durable(counted.repartition(F.col("token"), F.pmod(F.xxhash64(key), F.lit(TOKEN_PARTS))).sortWithinPartitions("token"))
    n, mean = kept.groupBy(key).agg(F.max("len").alias("len")).agg(F.count(F.lit(1)), F.avg("len")).first()
    return Index(kept, key, n, mean or 0.0)


def fingerprint(*tables: DataFrame) -> str:
    """What a kept index was made of: the names, sizes and times of the files read."""
    spark = tables[0].sparkSession
    conf, parts = spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in sorted({f for t in tables for f in t.inputFiles()}):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        parts.append(f"{f}|{s.getLen()}|{s.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


_kept: dict[tuple[str, str, str], Index] = {}


def kept_index(name: str, tables: list[DataFrame], make) -> Index:
    """The index ``make()`` gives, made again only if the files of ``tables`` have changed in this application."""
    at = (tables[0].sparkSession.sparkContext.applicationId, name, fingerprint(*tables))
    if at not in _kept:
        _kept[at] = make()
    return _kept[at]


def search_index(index: Index, questions: dict[str, list[str]]) -> DataFrame:
    """``question_id, key, score`` as ``bm25`` gives it, from a kept index: the tokens asked for are filtered in the scan."""
    asked = [(q, t) for q, terms in questions.items() for t in dict.fromkeys(terms)]
    terms = sorted({t for _, t in asked})
    tf = index.postings.where(F.col("token").isin(terms))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a row for each term asked for
    of = tf.sparkSession.createDataFrame(asked, "question_id string, token string")
    joined = tf.join(F.broadcast(df), "token")
    idf = F.greatest(F.log((F.lit(index.n_units) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * (F.col("f") * (K1 + 1)) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.lit(index.mean_len)))
    return joined.select(index.key, "token", part.alias("part")).join(F.broadcast(of), "token").groupBy("question_id", index.key).agg(F.round(F.sum("part"), 6).alias("score"))


def _count_of(tokens: Column, terms: list[str], weight: float) -> Column:
    """Weighted frequencies of the wanted terms as an array of (token, weight)."""
    return _weighed(F.filter(tokens, lambda t: t.isin(terms)), weight)


def _weighed(tokens: Column, weight: float) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(weight).alias("w")))


def bm25(units: DataFrame, key: str, fields: dict[str, Column], questions: dict[str, list[str]], weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """``question_id, key, score`` of every unit with one of a question's terms.

    A term's frequency is the weighted sum over the fields, a unit's length the
    tokens of all fields.  All questions are answered in one pass; only
    postings of wanted terms are shuffled.  The document frequencies (one row
    per term), the questions' terms and the totals (one row) are bounded by the
    questions and broadcast.  Null fields are empty.
    """
    asked = [(q, t) for q, terms in questions.items() for t in dict.fromkeys(terms)]
    terms = sorted({t for _, t in asked})
    size = sum((F.size(f) for f in fields.values()), F.lit(0))
    hits = F.concat(*[_count_of(f, terms, weights[n]) for n, f in fields.items()])
    base = durable(units.select(key, size.alias("len"), hits.alias("hits")))  # read three times; the texts only once
    total = base.agg(F.count(F.lit(1)).alias("n_units"), F.avg("len").alias("mean_len"))
    tf = base.where(F.size("hits") > 0).select(key, "len", F.explode("hits").alias("h")).groupBy(key, "len", F.col("h.token").alias("token")).agg(F.sum("h.w").alias("f"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    of = units.sparkSession.createDataFrame(asked, "question_id string, token string")
    joined = tf.join(F.broadcast(df), "token").crossJoin(F.broadcast(total))
    idf = F.greatest(F.log((F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * (F.col("f") * (K1 + 1)) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    return joined.select(key, "token", part.alias("part")).join(F.broadcast(of), "token").groupBy("question_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def ranked(scored: DataFrame, key: str, k: int, score: str = "score", group: list[str] | None = None, then: list[str] | None = None) -> DataFrame:
    """The ``k`` best of each group with their rank from 1; ties by ``then`` (falling), last by key."""
    order = [F.desc(score), *map(F.desc, then or []), key]
    if not group:
        return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def matches_groups(tokens: Column, groups: list[list[str]]) -> Column:
    """Whether every group has a token."""
    out = F.lit(True)
    for g in groups:
        out = out & F.arrays_overlap(tokens, F.array(*map(F.lit, g)))
    return out


def has_phrase(tokens: Column, phrase: str) -> Column:
    """Whether the phrase's tokens stand next to each other in this order."""
    wanted = " ".join(phrase.lower().split())
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {wanted} ")


def rescored(hits: DataFrame, title: Column, text: Column, relevance: Column, questions: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Adds ``relevance``: 5 for the whole question, 20 and 5 for an alias in title and text, a thousandth of the unit's own score.

    ``hits`` has ``question_id``; ``questions`` gives each one's text and aliases.
    """
    t, x = T.search_form(title), T.search_form(text)
    bonus = F.lit(0.0)
    for q, (question, aliases) in questions.items():
        any_in = lambda c, aliases=aliases: F.greatest(F.lit(0), *[c.contains(plain(a)).cast("int") for a in aliases]) if aliases else F.lit(0)
        exact = F.concat(t, F.lit(" "), x).contains(plain(question)).cast("int")
        bonus = F.when(F.col("question_id") == q, exact * 5.0 + any_in(t) * 20.0 + any_in(x) * 5.0).otherwise(bonus)
    return hits.withColumn("relevance", F.round(F.col("score") + bonus + F.coalesce(relevance, F.lit(0)) / 1000.0, 6))


def counted_terms(units: DataFrame, key: str, title: Column, text: Column, terms: list[str], question: str, aliases: list[str]) -> DataFrame:
    """``key, score`` by occurrences: one per term, 4 for the whole question, 15 and 4 for an alias in title and text; zero scores are left out."""
    low_t, low_x = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    both = F.concat(low_t, F.lit("\n"), low_x)
    score = sum((T.occurrences(both, t) for t in terms), F.lit(0)) + both.contains(question.lower()).cast("int") * 4
    if aliases:
        score = score + F.greatest(*[low_t.contains(a.lower()).cast("int") for a in aliases], F.lit(0)) * 15
        score = score + F.greatest(*[low_x.contains(a.lower()).cast("int") for a in aliases], F.lit(0)) * 4
    return units.select(key, score.alias("score")).where("score > 0")

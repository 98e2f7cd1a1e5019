"""Retrieval pipelines against plain lists, the kept index, and the odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from scholium.operators import lexical, retrieve, vectors
from scholium.functions import text as T

CHANNEL = "question_id string, unit_id string, rank int"


def channel(spark, lists):
    return spark.createDataFrame([(q, u, i) for q, us in lists.items() for i, u in enumerate(us, 1)], CHANNEL)


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.question_id, r["rank"])):
        out.setdefault(r.question_id, []).append(r.unit_id)
    return out


def fused(keyword, vector, wk=1.5, wv=1.0):
    s, best = {}, {}
    for us, w in ((keyword, wk), (vector, wv)):
        for i, u in enumerate(us, 1):
            s[u], best[u] = s.get(u, 0) + w / (60 + i), min(best.get(u, 999), i)
    return sorted(s, key=lambda u: (-round(s[u], 10), best[u], u))


def spread(us, group, k, cap=3):
    n, out = {}, []
    for u in us:
        n[group[u]] = n.get(group[u], 0) + 1
        if n[group[u]] <= cap:
            out.append(u)
    return out[:k]


@pytest.fixture(scope="module")
def data_(spark):
    rng = random.Random(3)
    units = [f"u{i:03d}" for i in range(60)]
    group = {u: f"d{rng.randint(0, 8)}" for u in units}
    kw = {q: rng.sample(units, 40) for q in ("q1", "q2")}
    ve = {q: rng.sample(units, 40) for q in ("q1", "q3")}
    scores = {(q, u): rng.randint(0, 4) / 4 for q in ("q1", "q2", "q3") for u in units}
    return units, group, kw, ve, scores


def test_modes(spark, data_):
    units, group, kw, ve, scores = data_
    g = spark.createDataFrame(list(group.items()), "unit_id string, group_id string")
    sc = spark.createDataFrame([(q, u, s) for (q, u), s in scores.items()], "question_id string, unit_id string, rerank double")
    k, v = channel(spark, kw), channel(spark, ve)
    run = lambda mode, n=10: listed(retrieve.search(mode, n, g, k, {"first": v, "second": v, "third": v}, sc))
    assert run("keyword") == {q: spread(us, group, 10) for q, us in kw.items()}
    assert run("vector") == run("second_vector") == run("third_vector") == {q: spread(us, group, 10) for q, us in ve.items()}
    both = {q: fused(kw.get(q, []), ve.get(q, [])) for q in ("q1", "q2", "q3")}
    assert run("hybrid") == {q: spread(us, group, 10) for q, us in both.items()}
    again = {}
    for q, us in both.items():
        chosen = spread(us, group, 100)
        fs = {u: -i for i, u in enumerate(us)}
        again[q] = spread(sorted(chosen, key=lambda u: (-scores[q, u], -fs[u], u)), group, 10)
    got = run("reranked_hybrid")
    assert {q: [scores[q, u] for u in us] for q, us in got.items()} == {q: [scores[q, u] for u in us] for q, us in again.items()}
    with pytest.raises(ValueError):
        run("other")
    with pytest.raises(ValueError):
        run("keyword", 0)
    assert retrieve.wanted(500) == 100 and retrieve.candidates(10) == 40 and retrieve.candidates(60) == 100


def test_pages_keep_the_keyword_hits(spark, data_):
    units, group, kw, ve, scores = data_
    g = spark.createDataFrame(list(group.items()), "unit_id string, group_id string")
    sc = spark.createDataFrame([(q, u, s) for (q, u), s in scores.items()], "question_id string, unit_id string, rerank double")
    got = listed(retrieve.search_pages("third_reranked_hybrid", 10, g, channel(spark, kw), channel(spark, ve), sc))
    for q, us in kw.items():
        assert set(got[q]) == set(us[:10]) and [scores[q, u] for u in got[q]] == sorted((scores[q, u] for u in us[:10]), reverse=True)
    assert len(got["q3"]) == 10


def test_second_corpus_has_a_place(spark):
    modern = channel(spark, {"q1": [f"m{i}" for i in range(40)], "q2": ["m1"]})
    ancient = channel(spark, {"q1": ["a0"], "q3": ["a1", "a2"]})
    g = spark.createDataFrame([(f"m{i}", f"d{i}") for i in range(40)] + [(f"a{i}", "b") for i in range(3)], "unit_id string, group_id string")
    got = listed(retrieve.both_corpora(modern, ancient, g, 10))
    assert "a0" in got["q1"] and len(got["q1"]) == 10 and got["q2"] == ["m1"] and got["q3"] == ["a1", "a2"]
    late = spark.createDataFrame([("q1", "a0", 1)], CHANNEL).withColumn("rank", F.lit(1))
    shown = retrieve.both_corpora(modern.withColumn("rank", F.col("rank") - 2), late, g, 2)
    assert listed(shown)["q1"][-1] == "a0"


def test_located_and_source(spark):
    units = spark.createDataFrame([("p1", "Book of Burns", "x.y x.y heat", "ancient:b", 3), ("p2", "Other", "x.y", "ancient:c", 3), ("p3", "Burns", "nothing", "7", 3), ("p4", None, "x.y", None, 3)], "unit_id string, title string, text string, group_id string, page int")
    got = retrieve.located(units, "q", T.search_form("title"), T.search_form("text"), "book of burns", ["x.y", "heat"])
    assert {(r.unit_id, r.score) for r in got.collect()} == {("p1", 103.0)}
    assert [r.unit_id for r in retrieve.source(units, units, "ancient:b", 3).collect()] == ["p1"]
    assert [r.corpus for r in retrieve.source(units, units, "7", 3).collect()] == ["modern"] and retrieve.source(units, units, "ancient:b", 3, "modern").count() == 1
    with pytest.raises(ValueError):
        retrieve.source(units, units, "7", 3, "x")


def test_index_gives_what_one_pass_gives(spark, data):
    rows = [("a", "Brûlure grave", "la brûlure et la peau 创面愈合"), ("b", None, "silver dressing, silver"), ("c", "", None), ("d", "x", "brulure brulure NF-κB")]
    units = spark.createDataFrame(rows, "k string, title string, text string").withColumn("tags", F.lit("skin"))
    fields = lexical.index_fields(F.col("title"), F.col("text"), F.col("tags"))
    asked = {"q1": ["brulure", "silver"], "q2": ["愈合", "skin"], "q3": ["absent"]}
    want = {tuple(r) for r in lexical.bm25(units, "k", fields, asked).collect()}
    index = lexical.build_index(units, "k", fields)
    assert {tuple(r) for r in lexical.search_index(index, asked).collect()} == want and any(r[1] == "a" for r in want)
    chunks, made = spark.read.parquet(f"{data}/chunks.parquet"), []
    for _ in range(2):
        lexical.kept_index("t", [chunks], lambda: made.append(1) or index)
    assert made == [1]


def test_nearest_by_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for i in range(300)] + [(900, None), (901, []), (902, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 50)
    got = {}
    for r in vectors.top_k(df.where("id % 10 = 0"), df, "id", "v", 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.match_id, r.score))
    known = {i: v for i, v in rows if v}
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1
    for q in (i for i in known if i % 10 == 0):
        s = sorted(((-round(sum(a * b for a, b in zip(known[q], v)) / norm(known[q]) / norm(v), 6), i) for i, v in known.items() if i != q))[:5]
        assert [(m, round(x, 5)) for _, m, x in sorted(got[q])] == [(i, round(-x, 5)) for x, i in s]
    assert vectors.top_k(df.where("id < 0"), df, "id", "v", 5).count() == 0

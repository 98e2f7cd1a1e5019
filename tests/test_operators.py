"""Components, chunks, matches, vectors, sequences, statistics on small cases."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholium.functions import ids, numeric
from scholium.functions import text as T
from scholium.operators import chunking, fusion, lexical, matching, quality, sequences, stats, vectors
from scholium.operators.components import connected_components
from scholium.plans import knowledge
from pyspark.sql import functions as F


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[root(a)] = root(b)
    least = {}
    for x in list(parent):
        least[root(x)] = min(x, least.get(root(x), x))
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {(x, least[root(x)]) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_the_graph(spark, data):
    def parts(edges):
        group = {}
        for a, b in {(e.subject_id.strip(" ").lower(), e.object_id.strip(" ").lower()) for e in edges if e.subject_id and e.object_id}:
            if a and b and a != b:
                both = group.get(a, {a}) | group.get(b, {b})
                group.update(dict.fromkeys(both, both))
        return {(x, min(g), len(g)) for x, g in group.items()}

    edges = knowledge._graph(spark, data)["edges"].collect()
    assert {tuple(r) for r in knowledge.graph_components_all(spark, data).collect()} == {p[:2] for p in parts(edges)}
    used = [e for e in edges if e.review_status == "approved" and e.confidence is not None and 0.7 <= e.confidence <= 1]
    assert {tuple(r) for r in knowledge.graph_modules(spark, data).collect()} == {p for p in parts(used) if p[2] >= 5}
    linked = sum(r.n_nodes for r in knowledge.graph_components(spark, data).collect())
    assert linked < len({p for p in parts(used) if p[2] >= 5}) <= len(parts(edges))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["burn wound heals. ", "创面愈合良好。", "word ", "\n\n", "，", "x" * 40]), max_size=400))
def test_chunks_keep_everything(parts):
    text = "".join(parts)
    for zh in (True, False):
        sizes = chunking.Sizes(30, 60, 60)
        chunks = chunking.pack(text, zh, sizes, 0.0, 0)
        assert (not chunks) == (not text.strip())
        squeeze = lambda t: "".join(t.split())
        assert squeeze("".join(c[0] for c in chunks)) == squeeze(text)
        for body, a, b, over in chunks:
            assert over == 0 and 0 <= a <= b <= len(text)


def test_chunk_overlap_and_ids(spark):
    text = "\n\n".join(f"Paragraph {i} " + "word " * 300 for i in range(8))
    df = spark.createDataFrame([("d", 1, text), ("e", 1, None), ("f", 2, "  ")], "doc string, page int, text string")
    got = chunking.chunk_pages(df, "doc", "page", "text", F.lit("en")).orderBy("chunk_index").collect()
    assert {r.doc_key for r in got} == {"d"} and len(got) > 1
    for before, after in zip(got, got[1:]):
        assert after.overlap_chars > 0 and before.text.endswith(after.text[: after.overlap_chars])
    assert got[0].chunk_id.endswith("_p0001_c000")


TERMS = [matching.Term("a", ("ab", "abc")), matching.Term("b", ("bc",), context=("x",)), matching.Term("no", ("zz",), exclude=True)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcxz ", max_size=40))
def test_matching_against_scan(text):
    got = matching.match(text, TERMS, matching._automaton(TERMS), 4)
    for term, surface, a, b, reason in got:
        assert text[a:b] == surface
        near = text[max(0, a - 4) : b + 4]
        if reason == "":
            assert term != "b" or "x" in near
    spans = sorted((a, b) for t, _, a, b, _ in got if t == "a")
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert sum(1 for t, *_ in got if t == "a") == text.count("ab")


def test_leftmost_longest():
    assert matching.leftmost_longest([(0, 2, "ab"), (1, 5, "bcde"), (0, 3, "abc"), (3, 4, "d")]) == [(0, 3, "abc"), (3, 4, "d")]
    assert matching.longest_first([(0, 2, "ab"), (1, 5, "bcde"), (0, 3, "abc")]) == [(1, 5, "bcde")]


def test_vectors_odd_cases(spark):
    schema = "id long, v array<float>, score double"
    rows = spark.createDataFrame([(0, [1.0, 0.0], 9.0), (1, [2.0, 0.0], 9.0), (2, [0.0, 1.0], 9.0), (3, None, 9.0), (4, [0.0, 0.0], 9.0), (5, [3.0, 0.0], 9.0)], schema)
    got = vectors.top_k(rows.where("id = 0"), rows, "id", "v", 2).orderBy("rank").collect()
    assert [(r.match_id, r.score) for r in got] == [(1, 1.0), (5, 1.0)]
    assert vectors.top_k(rows.where("id > 99"), rows, "id", "v", 2).count() == 0
    assert {(r.id, r.problem) for r in vectors.broken_vectors(rows, "id", "v", 2).collect()} == {(3, "missing"), (4, "zero")}


def test_text_functions(spark):
    df = spark.createDataFrame([("burns and Burn; 烧伤创面", "a"), (None, "b"), ("", "c"), ("unburnt", "d")], "t string, k string")
    got = {r.k: r for r in df.select("k", T.matched_terms("t", ["burn", "烧伤"]).alias("m"), T.language_class("t").alias("l"), T.char_ngrams("t").alias("g"), T.section_hint("t").alias("s")).collect()}
    assert got["a"].m == ["burn", "烧伤"] and got["b"].m == [] and got["d"].m == []
    assert got["b"].l == "" and got["d"].l == "en" and got["b"].g == [] and "创面" in got["a"].g and len(got["a"].g) == 7
    clean = spark.createDataFrame([("a  b\r\nhy-\nphen\n\n\n\nc",)], "t string").select(T.clean_page("t")).first()[0]
    assert clean == "a b\nhyphen\n\nc"


def test_ids(spark):
    df = spark.createDataFrame([("https://doi.org/10.1234/AbCd.", "F" * 64), (None, "A" * 64), ("10.1/x", "b" * 64), ("10.2147/abcd", "c" * 64)], "doi string, sha string")
    got = [tuple(r) for r in df.select(ids.doi_problem("doi"), ids.document_id("doi", "sha")).collect()]
    assert got[0] == ("", "doi:10.1234/abcd") and got[1][0] == "missing" and got[1][1] == "sha256:" + "a" * 64
    assert got[2][0] == "syntax_invalid" and got[3][0] == "publisher_pattern_incomplete"
    one = spark.sql("select array(named_struct('h', 'x'), named_struct('h', 'y')) a, array(named_struct('h', 'y'), named_struct('h', 'x')) b")
    assert one.select(ids.composition_fingerprint(F.col("a")) == ids.composition_fingerprint(F.col("b"))).first()[0]


def test_statistics(spark):
    tests = spark.createDataFrame([("a", 3, 5, 6, 20), ("b", 0, 5, 6, 20), ("c", 6, 5, 6, 20)], "t string, k long, n long, K_ long, N_ long")
    got = {r.t: r.p for r in stats.hypergeometric_tail(tests, "t").collect()}
    want = sum(math.comb(6, i) * math.comb(14, 5 - i) for i in range(3, 6)) / math.comb(20, 5)
    assert abs(got["a"] - want) < 1e-9 and got["b"] == 1.0 and got["c"] == 0.0
    cases = [(k, n, big, pop) for pop, big, n in ((1000, 300, 100), (5000, 40, 2500), (60, 60, 10), (400, 5, 399), (30_000, 9_000, 6_000)) for k in (0, 1, 4, 10, 29, 30, 31, 45, 1700, 1800, 1900)]
    long = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "t int, k long, n long, K_ long, N_ long")
    got = {r.t: r.p for r in stats.hypergeometric_tail(long, "t").collect()}
    for i, (k, n, big, pop) in enumerate(cases):
        top = sum(math.comb(big, j) * math.comb(pop - big, n - j) for j in range(max(k, n - (pop - big), 0), min(big, n) + 1))
        assert abs(got[i] - top / math.comb(pop, n)) < 1e-9, cases[i]
    q = {r.t: r.q for r in stats.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.9)], "t string, p double"), "t", "p").collect()}
    assert [round(q[k], 6) for k in "abc"] == [0.03, 0.03, 0.9]
    with pytest.raises(ValueError):
        numeric.weighted([F.lit(1)], [0.0])


def test_sequences_and_quality(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 3, 6), ("a", 6, 7), ("a", 9, 9), ("b", 0, None)], "g string, s int, e int")
    got = {tuple(r) for r in sequences.merged_intervals(df, ["g"], "s", "e").collect()}
    assert got == {("a", 1, 7, 3), ("a", 9, 9, 1)}
    one = quality.corpus_digest(df, ["g"], F.col("s").cast("string")).orderBy("g").collect()
    two = quality.corpus_digest(df.orderBy(F.desc("s")), ["g"], F.col("s").cast("string")).orderBy("g").collect()
    assert one == two
    twice = quality.corpus_digest(df.unionByName(df.limit(1)), ["g"], F.col("s").cast("string")).orderBy("g").collect()
    assert [a.digest == b.digest for a, b in zip(one, twice)] == [False, True]


def test_fusion_guarantees_second_corpus(spark):
    a = spark.createDataFrame([(f"a{i}", i + 1) for i in range(30)], "k string, rank int")
    b = spark.createDataFrame([("b0", 29)], "k string, rank int")
    got = fusion.two_corpora(a, b, "k", 10).collect()
    assert len(got) == 10 and sum(r.corpus == "ancient" for r in got) == 1
    none = fusion.two_corpora(a, b.where("rank > 99"), "k", 10).collect()
    assert len(none) == 10 and all(r.corpus == "modern" for r in none)


def test_bm25_odd_cases(spark):
    df = spark.createDataFrame([("u", None, None, 1.0), ("v", "burn", "burn burn 创面", 2.0)], "k string, title string, text string, score double")
    fields = lexical.index_fields(F.col("title"), F.col("text"), F.lit(None).cast("string"))
    got = lexical.bm25(df, "k", fields, {"q": ["burn", "burn", "创面"], "none": ["zebra"]}).collect()
    assert [(r.question_id, r.k) for r in got] == [("q", "v")]
    assert lexical.bm25(df.limit(0), "k", fields, {"q": ["burn"]}).count() == 0


def test_compile_question():
    from scholium.operators import questions as Q

    q = Q.compile_question("“创面” 《伤科》 silver dressing 烧伤治疗", {"烧伤": ["burn wound", "烧伤"]}, frozenset({"the"}), ("治疗",), ("彩票",))
    assert q.title == "伤科" and q.focus == "创面" and q.in_scope and q.groups == [["burn", "wound", "烧伤"]] and "burn wound" in q.aliases
    assert "治疗" not in q.terms and "silver" in q.terms
    assert Q.compile_question("what about NV-31123 now").groups == [["nv-31123"]]
    assert Q.compile_question("alpha beta").groups == [["alpha"], ["beta"]] and not Q.compile_question("彩票号码", out_of_scope=("彩票",)).in_scope
    with pytest.raises(ValueError):
        Q.compile_question(" ")


def test_embedding_is_resumed(spark):
    from scholium.operators import embedding as E

    df = spark.createDataFrame([(1, "burn wound"), (2, None), (3, "burn wound")], "id long, text string")
    enc = E.hashing_encoder(32)
    done = E.embed(df.where("id < 3"), "id", "text", enc, "m")
    got = {r.id: r.embedding for r in done.collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2])
    more = E.missing(df, "id", "text", done, enc, "m").collect()
    assert [r.id for r in more] == [3] and more[0].embedding == got[1]


def test_formulas():
    from scholium.operators import formula as M

    f = [M.Formula("a", ("甲湯",), (("x", ("蓮根", "根")), ("y", ("葵花",))), 30, 1), M.Formula("b", ("乙散",), (("x", ("蓮根",)),), 30, 1)]
    got = M.candidates("甲湯：葵花，蓮根三錢，葵花二兩。乙散蓮根。甲湯無", f)
    assert got == [("a", 0, [("x", "三", "钱"), ("y", "二", "两")], 2, 0.85)]


def test_vertical_columns_against_all_pairs():
    import numpy as np

    from scholium.operators import layout

    rng = np.random.default_rng(3)
    for _ in range(40):
        n = rng.integers(1, 14)
        x1 = rng.uniform(0, 300, n)
        x2 = x1 + rng.uniform(5, 40, n)
        got = layout.columns(x1, x2)
        w, c = np.maximum(x2 - x1, 1), (x1 + x2) / 2
        near = max(np.median(w) * 0.8, (c.max() - c.min()) * 0.008, 12)
        over = max(np.median(w) * 0.9, (c.max() - c.min()) * 0.01, 16)
        link = [[abs(c[i] - c[j]) <= near or (abs(c[i] - c[j]) <= over and (min(x2[i], x2[j]) - max(x1[i], x1[j])) / min(w[i], w[j]) >= 0.25) for j in range(n)] for i in range(n)]
        seen = list(range(n))
        for _ in range(n):
            seen = [min(seen[j] for j in range(n) if link[i][j] or i == j) for i in range(n)]
        assert all((got[i] == got[j]) == (seen[i] == seen[j]) for i in range(n) for j in range(n))


def test_repair(spark):
    from scholium.operators import repair

    rows = [(1, "10.1234/abcd", "a", "en", "T", "text here"), (2, None, "b", None, None, "1. Head\nsee 10.1234/wxyz."), (3, "10.1234/same", "c", "en", "T", ""), (4, "10.1234/same", "d", "en", "T", None)]
    got = {r.k: r for r in repair.repaired(spark.createDataFrame(rows, "k long, doi string, sha256 string, language string, title string, text string"), "k").collect()}
    assert got[1].stable_id == "doi:10.1234/abcd" and got[1].changes == ""
    assert got[2].stable_id == "doi:10.1234/wxyz" and got[2].title == "1. Head" and got[2].changes == "doi,language,title"
    assert got[3].doi_status == got[4].doi_status == "shared" and got[4].stable_id == "sha256:d"

"""Profiles on held-out texts, labels, mixed texts and odd rows."""

import numpy as np
import pytest

from scholium.llm import language as L


@pytest.fixture(scope="module")
def labelled(spark, data):
    rows = []
    for t, k in (("documents", "doc_id"), ("pages", "page_id")):
        df = spark.read.parquet(f"{data}/{t}.parquet").where("text is not null").select(L.label_language(L.F.col("language")).alias("l"), "text").collect()
        rows += [(r.l, r.text, t) for r in df if r.l in L.LANGUAGES]
    return rows


def place(lang, table):
    return len(L.LANGUAGES) if table == "pages" and lang == "zh" else L.LANGUAGES.index(lang)


def test_held_out(labelled):
    train, test = labelled[::2], labelled[1::2]
    judge = L.Judge(L.fit([(place(k, t), x) for k, x, t in train]))
    got = L.judge_texts(judge, [x for _, x, _ in test], [t == "pages" for *_, t in test], [0] * len(test))
    right = np.mean([g[0] == k for g, (k, _, _) in zip(got, test) if g[2] >= 20])
    assert right > 0.85  # about a tenth of the labels are wrong


EN = "The wound was covered with a clean dressing and the nurse changed it every day. "
ZH = "创面覆盖以湿性敷料为主，愈合时间平均为十二天。患者采用液体复苏治疗后明显改善。"
DE = "Der Apotheker reinigt die offene Wunde, weil sich sonst leicht Narben bilden können. "
JA = "薬剤師は煎じ薬の量をしばらく様子を見ることにしました。患者さんはやけどの手当を受けました。"


@pytest.fixture(scope="module")
def judge(labelled):
    return L.Judge(L.fit([(place(k, t), x) for k, x, t in labelled]))


def test_mixed_and_paragraphs(judge):
    texts = [EN * 3, ZH * 2, EN * 3 + "\n\n" + ZH * 2, DE * 3 + "\n \n" + EN * 3, "", "12 %", JA * 2, ZH + "\n\n" + JA, "tail of one.\n\n" + ZH * 2]
    got = L.judge_texts(judge, texts, [False] * len(texts), [0] * 8 + [150])
    assert [g[0] for g in got] == ["en", "zh", "mixed", "mixed", "", "", "ja", "mixed", "zh"]
    assert [x for x, _ in got[2][3]] == ["en", "zh"] and [x for x, _ in got[3][3]] == ["de", "en"]
    assert all(0 <= c <= 1 for g in got for _, c in g[3])


def test_same_result_in_any_batch(judge, monkeypatch):
    texts = [EN, ZH, DE, JA, EN + "\n\n" + DE] * 3
    one = L.judge_texts(judge, texts, [False] * 15, [0] * 15)
    monkeypatch.setattr(L, "_CHUNK", 100)
    assert L.judge_texts(judge, texts, [False] * 15, [0] * 15) == one
    fresh = L.Judge(judge.protos)
    fresh.SLOTS, fresh.key, fresh.val = 1 << 20, np.full(1 << 20, -1, np.int64), np.zeros((1 << 20, len(judge.protos)), np.float32)
    assert [g[0] for g in L.judge_texts(fresh, texts, [False] * 15, [0] * 15)] == [g[0] for g in one]


def test_labels(spark):
    labels = ["en", "EN_gb", "zh-Hans-CN", "lzh", "English", "mul", "Mixed", "ger", "la", "und", " ", "", None, "n/a", "unknown", "french"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(L.label_language(L.F.col("x"))).collect()]
    assert got == ["en", "en", "zh", "zh", "en", "mixed", "mixed", "de", None, None, None, None, None, None, None, "fr"]


def test_own_first_paragraph_of_a_chunk(spark, data):
    docs, chunks, pages = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "chunks", "pages"))
    own, long = "Die Wunde wurde gereinigt und mit einem sauberen Verband versorgt, danach blieb der Kranke im Bett.", EN * 3
    rows = [
        ("zero", 3, 0, None), ("fits", 3, len(own), None), ("null", 3, None, None), ("stale", 3, 7, None), ("negative", None, -4, None), ("first", 0, 40, None),
        ("by offsets", 3, 7, len(long)), ("all its own", 3, 7, len(long) + len(own) + 2), ("stale offsets", 3, len(own), 5),
    ]
    made = spark.createDataFrame(
        [(k, i, n, 100, None if e is None else 100 + e, "en", f"{own}\n\n{long}") for k, i, n, e in rows],
        "chunk_id string, chunk_index int, overlap_chars int, char_start int, char_end int, language string, text string",
    )
    got = {r.rec_key: r.lang for r in L.identify(docs, made, pages).where("rec_table = 'chunks'").collect()}
    assert got == {
        "zero": "mixed", "fits": "en", "null": "en", "stale": "en", "negative": "en", "first": "mixed", "by offsets": "en", "all its own": "mixed", "stale offsets": "en"
    }


def test_cosines_are_those_of_explicit_bundles(judge):
    texts = [EN, ZH, JA, EN * 3 + DE, "die Wunde die Wunde die Wunde", "a b"]
    for text in texts:
        points = np.array([ord(c) for c in text.lower()], np.int64)
        codes, seg, products = judge.bundles(points, np.zeros(len(points), np.int32))
        got, n = judge.cosines(codes, seg, products, 1)
        bundle = judge.space.vectors(codes).astype(np.float64).sum(axis=0)
        want = judge.protos @ bundle / np.linalg.norm(bundle)
        assert n[0] == len(codes) and np.allclose(got[0], want, rtol=0.2, atol=0.02) and got[0].argmax() == want.argmax()


def test_a_paragraph_of_two_languages_is_mixed(judge):
    got = L.judge_texts(judge, [f"{EN}{ZH}\n\n{EN * 2}", f"{ZH}{ZH}\r\n \r\nNF-κB and TNF-α.\n\n{ZH}"], [False] * 2, [0] * 2)
    assert [x for x, _ in got[0][3]] == ["mixed", "en"] and got[0][0] == "mixed" and got[1][0] == "zh"


def test_rows(spark, data):
    docs, chunks, pages = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "chunks", "pages"))
    rows = L.found(docs, chunks, pages).collect()
    assert len(rows) == len(set(rows)) and {r.rec_table for r in rows} == {"documents", "chunks", "pages"}
    assert {r.lang for r in rows} <= {*L.LANGUAGES, "mixed"} and {r.part_no for r in rows if r.rec_table != "documents"} == {0}
    every = L.identify(docs, chunks, pages).where("part_no = 0")
    assert every.count() == docs.count() + chunks.count() + pages.count()
    assert L.found(docs.limit(0), chunks.limit(0), pages.limit(0)).count() == 0

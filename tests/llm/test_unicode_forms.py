"""Forms, invisible characters and look-alikes; the result is stable."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scholium.llm import unicode_forms as U

CASES = {
    "ｆｕｌｌ １２": ("full 12", True), "ﬁne ﬂow": ("fine flow", True), "été": ("été", True), "が": ("が", True), "a​b﻿": ("ab", True), "a b　c": ("a b c", True),
    "⼈⽕": ("人火", True), "凉": ("凉", True), "𝗍𝖾st": ("test", True), "wоund": ("wound", True), "NF-κB TNF-α κb": ("NF-κB TNF-α κb", False), "，。！（）": ("，。！（）", False), "plain": ("plain", False),
    "": ("", False), "​": ("", True), "Привет мир": ("Привет мир", False), "石\U000e0100": ("石", True), "m²": ("m2", True), "Москвa и mир": ("Москва и мир", True), "Cлово": ("Слово", True), "Ꭺlpha": ("Alpha", True), "сoat а": ("coat а", True), "λόγoς": ("λόγoς", False), "сoat scоatсoat": ("coat scoatcoat", True), "ﾊﾟ": ("パ", True),
}


def run(texts):
    out = next(U._normalise([])(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["_text"])])))
    return list(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))


def test_cases():
    assert dict(zip(CASES, run(list(CASES)))) == CASES


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_stable(texts):
    texts = [t.replace("\x00", "") for t in texts]
    once = run(texts)
    for t, (plain, found) in zip(texts, once):
        assert found or plain == t
    assert [p for p, _ in run([p for p, _ in once])] == [p for p, _ in once]


def test_long_texts_go_in_parts(monkeypatch):
    texts = ["ｆｕｌｌ " * 50, None, "", "ok", "ﬁ" * 1000, "x"] * 5
    whole = run(texts)
    monkeypatch.setattr(U, "PART_BYTES", 300)
    parts = U._normalise([])(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["_text"])]))
    assert [x for out in parts for x in zip(out.column(0).to_pylist(), out.column(1).to_pylist())] == whole


def test_words_by_letters_and_in_sql_alike():
    words = ["Москвa", "mир", "Cлово", "wоund", "Ꭺlpha", "Αlphа", "οo"]
    assert [x for x, _ in run(words)] == [U.one_script(w) for w in words]


def test_tables(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    chunks = spark.createDataFrame([("a", "ｘ", t, 1), ("a", "ｘ", t, 1), ("b", None, t, 1), ("c", "ok", None, 1), (None, "ｘ", t, 1)], "chunk_id string, normalized_text string, loaded_at timestamp_ntz, found int")
    pages = spark.createDataFrame([("p", "é" * 100_000 + "é", t)], "page_id string, text string, loaded_at timestamp_ntz")
    assert {tuple(r) for r in U.found(chunks, pages).collect()} == {("chunks", "a"), ("pages", "p")}
    got = {(r.rec_table, r.rec_key): r.plain_text for r in U.canonical(chunks, pages).collect()}
    assert got["chunks", "a"] == "x" and got["chunks", "b"] is None and len(got["pages", "p"]) == 100_001 and len(got) == 4
    assert U.found(chunks.limit(0), pages.limit(0)).count() == 0

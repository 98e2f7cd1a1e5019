"""Pieces cover the text, stay within the limit, and repeat what they say."""

from hypothesis import given, settings
from hypothesis import strategies as st

from scholium.llm import split

TEXT = st.lists(st.sampled_from(["Word ", "sentence. ", "创面愈合。", "，", "\n\n", "x" * 90, "é", "\U00020000", " ", "」"]), max_size=300).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 80), st.integers(0, 30))
def test_pieces(text, limit, overlap):
    overlap = min(overlap, limit // 2)
    got = split.cut(text, limit, overlap)
    assert (not got) == (not text)
    if not text:
        return
    assert got[0][0] == got[0][1] == 0 and got[-1][2] == len(text)
    for a, own, b in got:
        assert 0 < b - a <= limit and a <= own < b
    for before, after in zip(got, got[1:]):
        assert after[1] == before[2] and after[1] - after[0] <= overlap


def test_natural_boundaries():
    text = ("Para one. " * 20).strip() + "\n\n" + "Next sentence here. " * 20
    first = split.cut(text, 260, 20)[0]
    assert text[: first[2]].endswith("\n\n")
    hard = split.cut("x" * 1000, 300, 50)
    assert [b - a for a, _, b in hard][:2] == [300, 300] and all(own - a == 50 for a, own, _ in hard[1:])


CHUNK = "chunk_id string, doc_id long, text string, char_start int, char_end int, overlap_chars int, loaded_at timestamp_ntz, piece_no int"


def test_offsets_into_documents(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    doc = "Head. " + "".join(f"Sentence number {i} is here. " for i in range(300)) + "Tail."
    own = doc[6:5000]
    rows = [
        ("good", 1, "Head.\n\n" + own, 6, 5000, 5, t, 0), ("good", 1, "Head.\n\n" + own, 6, 5000, 5, t, 0), ("stale", 1, own, 77, 99, None, t, 0), ("none", 1, own, None, None, 500, t, 0),
        ("alien", 1, "z " * 1000, 0, 10, 0, t, 0), ("lost", 9, own, 0, 10, 0, t, 0), ("short", 1, "abc", 0, 3, 0, t, 0), ("null", 1, None, 0, 3, 0, t, 0), (None, 1, own, 0, 3, 0, t, 0),
    ]
    chunks, docs = spark.createDataFrame(rows, CHUNK), spark.createDataFrame([(1, doc, "x")], "doc_id long, text string, base string")
    got = split.split_chunks(chunks, docs).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {"good", "stale", "none", "alien", "lost"}
    for name in ("good", "stale", "none"):
        mine = [r for r in got if r.chunk_id == name]
        assert mine[0].char_start == 6 and mine[-1].char_end == 5000 and len(mine) >= 4
        for r in mine:
            assert len(r.text) <= 1500 and r.text.endswith(doc[r.char_start : r.char_end])
        for a, b in zip(mine, mine[1:]):
            assert a.char_end == b.char_start and 60 < b.overlap_chars <= 120 and doc[b.char_start - b.overlap_chars : b.char_start] == b.text[: b.overlap_chars]
    assert all(r.char_start is None for r in got if r.chunk_id in ("alien", "lost"))
    assert split.split_chunks(chunks.limit(0), docs).count() == 0


def test_found_equals_sql(spark, data):
    from scholium.llm import queries
    from tests.oracle import rows, sql_rows

    assert rows(queries.p4_found(spark, data)) == sql_rows(queries.SQL["p4_found"], data)

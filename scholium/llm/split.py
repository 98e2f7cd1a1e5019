"""Splitting oversized items at natural boundaries.

A text is read once into token lengths; their prefix sums are the places where
a cut may fall, graded by how natural the boundary is.  The last boundary under
the limit is found by binary search in the sorted array of each grade, best
grade first; where no grade has one, the cut is hard.  The next piece steps
back by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import durable

LIMIT = 1_500
OVERLAP = 120
#: A boundary of a better grade is taken only if the piece then fills this share of what is free.
LEAST_FILL = (0.5, 0.4, 0.3, 0.0)

#: A token with the white space after it: a word, one ideograph or kana, or one mark.
_TOKEN = re.compile(
    r"(?:[^\W぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]+|[\W_]|\w)[̀-゙゚ͯ‍︀-️\U000e0100-\U000e01ef]*\s*"
)
_SENTENCE_CJK = "。！？；!?"
_CLOSING = "”’」』）)\"'"
_CLAUSE = ",;:，、：；"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted end offsets of the tokens and the grade of each: 0 paragraph, 1 sentence, 2 clause or line, 3 word."""
    tokens = _TOKEN.findall(text)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    lead = len(text) - int(lengths.sum())  # white space before the first token
    ends = lead + np.cumsum(lengths)
    grades = np.full(len(tokens), 3, np.int8)
    sentence = False
    for i, t in enumerate(tokens):
        core, gap = t.rstrip(), len(t) - len(t.rstrip())
        closes = core in _CLOSING and sentence
        sentence = closes or core in _SENTENCE_CJK or core == "."
        if t.count("\n") >= 2:
            grades[i] = 0
        elif sentence and (gap or core != "." and (i + 1 == len(tokens) or tokens[i + 1][:1] not in _CLOSING)):
            grades[i] = 1
        elif "\n" in t or core and core in _CLAUSE and (gap or ord(core[0]) > 0x2E7F):
            grades[i] = 2
    return ends, grades


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(from, own, to)`` of each piece: it is ``text[from:to]``, of which ``text[from:own]`` repeats the piece before."""
    if not text:
        return []
    n, out, own, start = len(text), [], 0, 0
    if n <= limit:
        return [(0, 0, n)]
    ends, grades = boundaries(text)
    by_grade = [ends[grades <= g] for g in range(4)]
    while True:
        most = start + limit
        if n <= most:
            out.append((start, own, n))
            return out
        to = 0
        for places, fill in zip(by_grade, LEAST_FILL):
            k = int(np.searchsorted(places, most, side="right")) - 1
            if k >= 0 and places[k] > own + fill * (most - own):
                to = int(places[k])
                break
        if not to:
            to = most  # nowhere to cut: one token is longer than the limit
        out.append((start, own, to))
        back = max(to - overlap, own if overlap < limit else to)
        k = int(np.searchsorted(ends, back, side="left"))
        # The repeated part starts at a token; where the token is too long for that it starts inside it.
        start = int(ends[k]) if k < len(ends) and ends[k] < to and ends[k] - back < overlap // 2 else back
        own = to


def _pieces(cols: list[str], limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            texts = batch.column("_text").to_pylist()
            for i, text in enumerate(texts):
                for k, (a, own, b) in enumerate(cut(text or "", limit, overlap)):
                    rows.append(i)
                    parts.append((k, a, b, own - a, text[a:b]))
            take = pa.array(rows, pa.int64())
            cut_up = list(zip(*parts)) or [()] * 5
            kinds = [pa.int32()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in cols] + [pa.array(x, t) for x, t in zip(cut_up, kinds)],
                [*cols, "piece_no", "from_char", "to_char", "repeated_chars", "piece_text"],
            )

    return run


def split_items(df: DataFrame, keep: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``keep``, ``piece_no, from_char, to_char, repeated_chars, piece_text`` of every item.

    ``piece_text`` is ``text[from_char:to_char]`` (code points), at most ``limit``
    long; its first ``repeated_chars`` characters end the piece before.  Items
    within the limit come out as one piece; null and empty texts have none;
    repeated rows are cut alike; an empty table gives an empty result.  Only
    ``keep`` and ``text`` are read.  One pass without a shuffle: an item is cut
    where it lies, whole, however long.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    picked = df.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(
        _pieces(keep, limit, overlap),
        f"{schema}, piece_no int, from_char int, to_char int, repeated_chars int, piece_text string",
    )


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The chunks above the limit, each once: of several deliveries the first loaded, of ties the least text."""
    long = chunks.where(F.col("chunk_id").isNotNull() & (F.length("text") > limit))
    row = F.struct("loaded_at", "text", "doc_id", "char_start", "char_end", "overlap_chars")
    return long.groupBy("chunk_id").agg(F.min(row).alias("r")).select("chunk_id", "r.*")


#: Documents with oversized chunks whose ids are sent to every executor; more are joined by shuffle.
BROADCAST_IDS = 500_000


def split_chunks(chunks: DataFrame, documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id, piece_no, text, char_start, char_end, overlap_chars`` of every chunk above the limit.

    ``char_start``/``char_end`` place a piece's own part (without what it
    repeats) in the document.  A chunk's own offsets are used only if the
    document has the chunk's text there; otherwise the text is looked up in the
    document, and if it is not there at all both are null.  Only documents with
    an oversized chunk are shuffled.
    """
    long = durable(oversized(chunks, limit))
    wanted = long.select("doc_id").where("doc_id is not null").distinct()
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    docs = documents.select("doc_id", F.col("text").alias("doc_text")).join(wanted, "doc_id", "left_semi")
    located = long.join(docs, "doc_id", "left").select(
        "chunk_id",
        "text",
        # What a chunk repeats from the one before ends with an empty line.
        F.when(
            (F.col("overlap_chars") > 0) & (F.substring("text", F.col("overlap_chars") + 1, F.lit(2)) == "\n\n"), F.col("overlap_chars") + 2
        )
        .otherwise(0)
        .alias("lead"),
        "char_start",
        "doc_text",
    )
    own = F.substring("text", F.col("lead") + 1, F.length("text"))
    based = located.select(
        "chunk_id",
        "text",
        "lead",
        F.when(F.substring("doc_text", F.col("char_start") + 1, F.length(own)) == own, F.col("char_start"))
        .when(F.instr("doc_text", own) > 0, F.instr("doc_text", own) - 1)
        .alias("base"),
    )
    pieces = split_items(based, ["chunk_id", "lead", "base"], "text", limit, overlap)
    begin = F.col("from_char") + F.col("repeated_chars")
    place = lambda at: F.col("base") + F.greatest(at - F.col("lead"), F.lit(0))
    return pieces.select(
        "chunk_id",
        "piece_no",
        F.col("piece_text").alias("text"),
        place(begin).cast("int").alias("char_start"),
        place(F.col("to_char")).cast("int").alias("char_end"),
        F.when(F.col("piece_no") == 0, F.greatest(F.col("lead") - 2, F.lit(0))).otherwise(F.col("repeated_chars")).cast("int").alias("overlap_chars"),
    )

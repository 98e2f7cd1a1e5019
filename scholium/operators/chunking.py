"""Packing a page's paragraphs into chunks with an overlap; chunks never cross a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import ids, text as T
from scholium.session import spread

_PARAGRAPH = re.compile(r"\n\s*\n+")
_WORD = re.compile(T.WORD)


@dataclass(frozen=True)
class Sizes:
    """Targets in characters for Chinese and in words otherwise, and the hard limit of a unit."""

    least: int
    most: int
    unit: int


# Chunk sizes.
CHINESE, OTHER = Sizes(800, 1500, 1500), Sizes(600, 1000, 1000)
OVERLAP, LEAST_CHARS = 0.08, 80


def _size(t: str, zh: bool) -> int:
    return len(t) if zh else sum(1 for _ in _WORD.finditer(t))


def hard_pieces(t: str, zh: bool, most: int) -> list[str]:
    """A text without boundaries cut every ``most`` characters or words."""
    t = t.strip()
    if not t or _size(t, zh) <= most:
        return [t] if t else []
    if zh:
        return [p for i in range(0, len(t), most) if (p := t[i : i + most].strip())]
    w = t.split()
    return [" ".join(w[i : i + most]) for i in range(0, len(w), most)]


def units(t: str, zh: bool, most: int) -> list[str]:
    """Paragraphs; one above the limit by its sentences, packed up to the limit, and those hard if need be."""
    out: list[str] = []
    for par in (p.strip() for p in _PARAGRAPH.split(t)):
        if not par:
            continue
        if _size(par, zh) <= most:
            out.append(par)
            continue
        sentences = [s.strip() for s in re.split(r"(?<=[。！？；])" if zh else r"(?<=[.!?])\s+", par) if s.strip()]
        held = ""
        for s in sentences:
            longer = f"{held}{'' if zh else ' '}{s}" if held else s
            if held and _size(longer, zh) > most:
                out += hard_pieces(held, zh, most)
                held = s
            else:
                held = longer
        out += hard_pieces(held, zh, most)
    return out


def _tail(t: str, zh: bool, share: float) -> str:
    if zh:
        return t[-max(1, int(len(t) * share)) :]
    w = t.split()
    return " ".join(w[-max(1, int(len(w) * share)) :])


def pack(t: str, zh: bool, sizes: Sizes, overlap: float = OVERLAP, least_chars: int = LEAST_CHARS) -> list[tuple[str, int, int, int]]:
    """``(text, char_start, char_end, overlap_chars)`` of the chunks of one page.

    Paragraphs are added while the chunk stays within the most; a chunk below
    the least takes the next paragraph all the same unless that alone is too
    long.  A chunk begins with the end of the one before.  A short last chunk
    is dropped unless it is the only one.
    """
    spans, at = [], 0
    for u in units(t, zh, sizes.unit):
        k = t.find(u, at)
        start = k if k >= 0 else at
        spans.append((start, start + len(u), u))
        at = max(start + len(u), at)
    done: list[tuple[str, int, int, int]] = []
    held: list[tuple[int, int, str]] = []
    prefix, size, before = "", 0, 0  # size: of the held units; before: of the prefix
    gap = 2 if zh else 0  # characters of the empty line between two units

    def close() -> None:
        core = "\n\n".join(u for _, _, u in held)
        b = (f"{prefix}\n\n{core}" if prefix else core).strip()
        if b and (len(b) >= least_chars or not done):
            done.append((b, held[0][0], held[-1][1], len(prefix)))

    for s in spans:
        own = _size(s[2], zh)
        if held and before + size + gap + own > sizes.most and (before + size >= sizes.least or own > sizes.most):
            close()
            prefix = _tail(done[-1][0], zh, overlap) if done and overlap > 0 else ""
            before = _size(prefix, zh) + gap if prefix else 0
            held, size = [s], own
        else:
            size += own + (gap if held else 0)
            held.append(s)
    if held:
        close()
    return done


def _run(keep: list[str], overlap: float, least_chars: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (t, lang) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist())):
                zh = lang == "zh"
                for k, c in enumerate(pack(t or "", zh, CHINESE if zh else OTHER, overlap, least_chars)):
                    rows.append(i)
                    out.append((k, *c))
            cols = list(zip(*out)) or [()] * 5
            take = pa.array(rows, pa.int64())
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], [*keep, "chunk_index", "text", "char_start", "char_end", "overlap_chars"]
            )

    return go


def chunk_pages(pages: DataFrame, document: str, page: str, text: str, language: Column, overlap: float = OVERLAP, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``document, page, chunk_id, chunk_index, text, section_hint, char_start, char_end, overlap_chars`` of every page; null and blank pages have none."""
    picked = spread(pages.select(F.col(document).cast("string").alias("doc_key"), F.col(page).cast("int").alias("page_no"), language.alias("_lang"), F.col(text).alias("_text")))
    cut = picked.mapInArrow(_run(["doc_key", "page_no"], overlap, least_chars), "doc_key string, page_no int, chunk_index int, text string, char_start int, char_end int, overlap_chars int")
    return cut.select(
        "doc_key", "page_no", ids.chunk_id("doc_key", "page_no", "chunk_index").alias("chunk_id"), "chunk_index", "text", T.section_hint("text").alias("section_hint"),
        "char_start", "char_end", "overlap_chars",
    )


def hard_split(c: Column, most: int) -> Column:
    """Pieces of ``most`` characters as an array, without Python."""
    n = F.length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(most)), lambda i: F.substring(c, i, F.lit(most)))).otherwise(F.array().cast("array<string>"))

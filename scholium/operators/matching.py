"""Dictionary matching with spans: longest or leftmost first, context, exclusion, doses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """An entry of a dictionary; an ``exclude`` entry takes matches near it away."""

    term_id: str
    surfaces: tuple[str, ...]
    exclude: bool = False
    context: tuple[str, ...] = ()


def _automaton(terms: list[Term]) -> ahocorasick.Automaton:
    a, owners = ahocorasick.Automaton(), {}
    for i, t in enumerate(terms):
        for s in t.surfaces:
            if s:
                owners.setdefault(s, []).append(i)
    for s, who in owners.items():
        a.add_word(s, (s, tuple(who)))
    a.make_automaton()
    return a


def _all_spans(text: str, automaton: ahocorasick.Automaton) -> dict[int, list[tuple[int, int, str]]]:
    out: dict[int, list[tuple[int, int, str]]] = {}
    for end, (s, who) in automaton.iter(text):
        for i in who:
            out.setdefault(i, []).append((end + 1 - len(s), end + 1, s))
    return out


def longest_first(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without overlap: a longer one is kept before any shorter one, of equals the first."""
    kept: list[tuple[int, int, str]] = []
    for a, b, s in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, s))
    return sorted(kept)


def leftmost_longest(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without overlap, taken from the left, of those at one place the longest."""
    kept: list[tuple[int, int, str]] = []
    for a, b, s in sorted(spans, key=lambda x: (x[0], x[0] - x[1], x[2])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, s))
    return kept


def match(text: str, terms: list[Term], automaton: ahocorasick.Automaton, window: int) -> list[tuple[str, str, int, int, str]]:
    """``(term_id, surface, from, to, reason)``; an empty reason is an accepted match."""
    spans = {i: longest_first(s) for i, s in _all_spans(text, automaton).items()}
    barred = [(a, b, terms[i].term_id) for i, s in spans.items() if terms[i].exclude for a, b, _ in s]
    out = []
    for i, found in spans.items():
        if terms[i].exclude:
            continue
        for a, b, s in found:
            left, right = max(0, a - window), min(len(text), b + window)
            near = sorted({t for x, y, t in barred if x < right and y > left and not (a < y and b > x)})
            if terms[i].context and not any(c in text[left:right] for c in terms[i].context):
                reason = "context_missing"
            elif near:
                reason = "excluded:" + ",".join(near)
            else:
                reason = ""
            out.append((terms[i].term_id, s, a, b, reason))
    return sorted(out, key=lambda r: (r[2], r[3], r[0]))


def _run(keep: list[str], terms: list[Term], window: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(terms)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                for m in match(text or "", terms, automaton, window):
                    rows.append(i)
                    out.append(m)
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], [*keep, "term_id", "surface", "from_char", "to_char", "reason"]
            )

    return go


def dictionary_matches(df: DataFrame, keep: list[str], text: str, terms: list[Term], window: int = 40) -> DataFrame:
    """``keep, term_id, surface, from_char, to_char, reason`` of every match; null text has none.

    All surfaces are found in one pass over each text, however many there are;
    the dictionary travels with the task.  No shuffle.
    """
    picked = df.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(_run(keep, terms, window), f"{schema}, term_id string, surface string, from_char int, to_char int, reason string")


# Separators, numerals and units of doses in old texts.
DOSE = r"^[\s，、：:（(]*([〇零一二三四五六七八九十百半两兩\d]+)\s*(两|兩|钱|錢|分|斤|升|枚|片|g|克)"
UNITS = {"兩": "两", "錢": "钱", "克": "g"}


def doses(df: DataFrame, keep: list[str], text: str, names: list[str], reach: int = 16) -> DataFrame:
    """``keep, name, n, value, unit``: each name's occurrences (leftmost, longest) with the dose that follows within ``reach`` characters."""
    pattern = regex.compile("|".join(regex.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n))))
    dose = regex.compile(DOSE)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                for k, m in enumerate(pattern.finditer(t or "")):
                    d = dose.match(t[m.end() : m.end() + reach])
                    rows.append(i)
                    out.append((m.group(), k, d.group(1) if d else None, UNITS.get(d.group(2), d.group(2)) if d else None))
            cols = list(zip(*out)) or [()] * 4
            take = pa.array(rows, pa.int64())
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], [*keep, "name", "n", "value", "unit"])

    picked = df.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(go, f"{schema}, name string, n int, value string, unit string")


def native_doses(c: Column, names: list[str]) -> Column:
    """The same without spans, as an array of ``name value unit`` texts: one expression, no Python."""
    alternatives = "|".join(sorted(set(names), key=lambda n: (-len(n), n)))
    return F.regexp_extract_all(c, F.lit(f"((?:{alternatives})[\\s，、：:（(]*[〇零一二三四五六七八九十百半两兩\\d]+\\s*(?:两|兩|钱|錢|分|斤|升|枚|片|g|克))"), F.lit(1))

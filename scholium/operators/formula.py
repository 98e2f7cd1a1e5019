"""Formulas in running text: a name, the herbs that follow up to the next name, their doses, a composition."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.operators.matching import UNITS, leftmost_longest

_DOSE = re.compile(r"[\s，、：:（(]*([〇零一二三四五六七八九十百半两兩\d]+)\s*(两|兩|钱|錢|分|斤|升|枚|片|g|克)")


@dataclass(frozen=True)
class Formula:
    """A formula's names, how far its composition reaches and how many dosed herbs it needs."""

    formula_id: str
    names: tuple[str, ...]
    herbs: tuple[tuple[str, tuple[str, ...]], ...]
    reach: int = 200
    least_dosed: int = 2


def _spans(text: str, names: tuple[str, ...]) -> list[tuple[int, int, str]]:
    return leftmost_longest([(m.start(), m.start() + len(n), n) for n in names for m in re.finditer(f"(?={re.escape(n)})", text)])


def _dose(text: str, end: int, reach: int = 16) -> tuple[str, str] | None:
    m = _DOSE.match(text[end : end + reach])
    return (m.group(1), UNITS.get(m.group(2), m.group(2))) if m else None


def candidates(text: str, formulas: list[Formula]) -> list[tuple[str, int, list[tuple[str, str | None, str | None]], int, float]]:
    """``(formula_id, place, composition, dosed, confidence)`` of every name with enough dosed herbs behind it.

    A herb that comes several times counts by its dosed mention, of those by
    the nearest.
    """
    starts = sorted(a for f in formulas for a, _, _ in _spans(text, f.names))
    out = []
    for f in formulas:
        for a, b, _ in _spans(text, f.names):
            later = [s for s in starts if s >= b]
            end = min(len(text), b + f.reach, later[0] if later else len(text))
            made = []
            for herb, names in f.herbs:
                found = [(_dose(text[:end], y) is None, x, y) for x, y, _ in _spans(text[b:end], names) for x, y in [(x + b, y + b)]]
                if found:
                    _, x, y = min(found)
                    made.append((herb, *(_dose(text[:end], y) or (None, None)), x))
            made.sort(key=lambda m: m[3])
            dosed = sum(m[1] is not None for m in made)
            if dosed >= f.least_dosed:
                sure = 0.4 + min(0.3, 0.1 * len(made)) + min(0.2, 0.1 * dosed) + (0.05 if dosed == len(f.herbs) else 0)
                out.append((f.formula_id, a, [m[:3] for m in made], dosed, round(min(1.0, sure), 6)))
    return sorted(out, key=lambda c: (c[1], c[0]))


def formulas_in(df: DataFrame, keep: list[str], text: str, formulas: list[Formula]) -> DataFrame:
    """``keep, formula_id, place, composition, dosed, confidence`` over all texts; null texts have none.  No shuffle."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                for c in candidates(t or "", formulas):
                    rows.append(i)
                    out.append((c[0], c[1], [dict(zip(("herb", "value", "unit"), m)) for m in c[2]], c[3], c[4]))
            cols = list(zip(*out)) or [()] * 5
            herb = pa.struct([("herb", pa.string()), ("value", pa.string()), ("unit", pa.string())])
            kinds = [pa.string(), pa.int32(), pa.list_(herb), pa.int32(), pa.float64()]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], [*keep, "formula_id", "place", "composition", "dosed", "confidence"]
            )

    picked = df.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(go, f"{schema}, formula_id string, place int, composition array<struct<herb:string,value:string,unit:string>>, dosed int, confidence double")

"""Reading band of documents from the acquisition grades of their words.

A word's acquisition grade is the mean of the bands in which graded passages use
it, each band weighted by the word's share of that band's words.  A document is
described by quantiles of the grades of the words it shares with the passages;
its band is the one whose calibrated quantiles (those of the graded passages,
each measured with grades to which it did not contribute) lie nearest.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm import language
from scholium.session import spread

BANDS = (1, 2, 3, 4)
QUANTILES = (0.2, 0.35, 0.5, 0.65, 0.8)
#: Code points that a text needs to be given a band.
LEAST_LENGTH = 300
#: Passages that know a word, at least.
LEAST_PASSAGES = 2
#: Graded passages that the grades are fitted on, at most (those with the least ids).
MOST_PASSAGES = 10_000
_STEPS = 20  # grade bins of a band

_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_HAN = (0x3400, 0x9FFF)


def english_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def chinese_codes(text: str) -> np.ndarray:
    """Two neighbouring ideographs as one number, for every place of ``text``."""
    p = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    han = (p >= _HAN[0]) & (p <= _HAN[1])
    both = han[1:] & han[:-1]
    return (p[:-1][both] << 21) | p[1:][both]


@dataclass
class Grades:
    """Grades of one language's words (as bins) and the calibrated quantiles of its bands."""

    words: dict | None
    codes: np.ndarray | None
    bins: np.ndarray
    bands: list[int]
    centres: np.ndarray

    def histogram(self, text: str) -> np.ndarray:
        size = (len(BANDS) - 1) * _STEPS + 1
        if self.words is not None:
            get = self.words.get
            found = [b for w in english_words(text) if (b := get(w)) is not None]
            return np.bincount(np.array(found, np.int64), minlength=size)
        codes = chinese_codes(text)
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        hit = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        return np.bincount(self.bins[at[hit]], minlength=size)

    def band(self, text: str) -> int | None:
        q = quantiles(self.histogram(text))
        if q is None or not len(self.centres):
            return None
        return self.bands[int(np.abs(self.centres - q).sum(axis=1).argmin())]


def quantiles(histogram: np.ndarray) -> np.ndarray | None:
    total = histogram.sum()
    if not total:
        return None
    at = np.searchsorted(np.cumsum(histogram), np.array(QUANTILES) * total)
    return 1 + at / _STEPS


def _bin(counts: Counter, totals: Counter) -> int:
    share = {b: counts[b] / totals[b] for b in counts if counts[b] > 0 and totals[b] > 0}
    grade = sum(b * s for b, s in share.items()) / sum(share.values())
    return int(round((grade - 1) * _STEPS))


def fit(passages: list[tuple[str, int, str]]) -> dict[str, Grades]:
    """Grades per language from ``(lang, band, text)``."""
    out = {}
    for lang in sorted({p[0] for p in passages}):
        split = english_words if lang == "en" else lambda t: chinese_codes(t).tolist()
        own = [(b, Counter(split(t))) for k, b, t in passages if k == lang and t and b in BANDS]
        totals: Counter = Counter()
        by_word: dict = defaultdict(Counter)
        spread: Counter = Counter()
        for b, words in own:
            totals[b] += sum(words.values())
            for w, n in words.items():
                by_word[w][b] += n
                spread[w] += 1
        known = sorted(w for w in by_word if spread[w] >= LEAST_PASSAGES)
        bins = np.array([_bin(by_word[w], totals) for w in known], np.int64)
        measured = defaultdict(list)
        for b, words in own:  # each passage by the grades that the others give
            hist = np.zeros((len(BANDS) - 1) * _STEPS + 1, np.int64)
            rest = totals.copy()
            rest[b] -= sum(words.values())
            for w, n in words.items():
                if spread[w] > LEAST_PASSAGES:
                    others = by_word[w].copy()
                    others[b] -= n
                    hist[_bin(others, rest)] += n
            q = quantiles(hist)
            if q is not None:
                measured[b].append(q)
        bands = sorted(measured)
        centres = np.array([np.median(measured[b], axis=0) for b in bands])
        if lang == "en":
            out[lang] = Grades(dict(zip(known, bins.tolist())), None, bins, bands, centres)
        else:
            out[lang] = Grades(None, np.array(known, np.int64), bins, bands, centres)
    return out


def _grade(prototypes: np.ndarray, grades: dict[str, Grades]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = language.worker_judge(prototypes)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            found = language.judge_texts(judge, texts, [False] * len(texts), [0] * len(texts))
            bands = [grades[f[0]].band(t) if f[0] in grades else None for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([f[0] or None for f in found], pa.string()), pa.array(bands, pa.int32())], ["doc_id", "lang", "band"]
            )

    return run


def reading_bands(documents: DataFrame, passages: DataFrame, pages: DataFrame | None = None, least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, lang, band`` of every document of at least ``least`` code points.

    ``band`` is null for documents not wholly in a language with graded
    passages and for those that share no word with them; shorter, null and
    empty texts are left out; repeated rows come out repeated; without
    passages every band is null.  The language profiles and the grades are
    fitted on bounded samples, every text is read whole.  No shuffle.
    """
    rows = passages.where("text is not null and band is not null").orderBy("passage_id").limit(MOST_PASSAGES).select("lang", "band", "text").collect()
    grades = fit([(r.lang, r.band, r.text) for r in rows])
    prototypes = language.fit(language.training_sample(documents, pages))
    long = spread(documents.where(F.length("text") >= least).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return long.mapInArrow(_grade(prototypes, grades), "doc_id long, lang string, band int")


def found(documents: DataFrame, passages: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``doc_id, band`` of the documents wholly in a graded language, each once."""
    return reading_bands(documents, passages, pages).where("band is not null").select("doc_id", "band").distinct()

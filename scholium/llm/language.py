"""Language of records and of the paragraphs of mixed ones, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A gram binds the vectors of its
letters, each permuted (rotated) by its place: three letters of an alphabet, an
ideograph or kana alone, and two of these.  A text or a language is the bundle (sum) of its grams,
and a text's language is the prototype with the highest cosine.

The cosine is computed without making each bundle.  The dot product with a
prototype is linear in the grams, so a worker keeps the products of each gram it
has met and adds them up: the sum is the product of the whole bundle.  The
length of a bundle follows from how often each gram stands in it, as the vectors
of different grams are all but orthogonal: ``sqrt(dimensions * sum of squared
counts)``.

A text, or a paragraph of one, is mixed if sentences that clearly stand in one
language meet sentences that clearly stand in another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.session import spread

LANGUAGES = ("en", "zh", "de", "fr", "ja")
#: One prototype for each language and, as old books write another Chinese, one more for that.
PROTOTYPES = (*LANGUAGES, "zh")
DIMENSIONS = 1024
#: Labelled documents, and Chinese pages, of each language that the prototypes are fitted on, at most.
SAMPLE_PER_LANGUAGE = 150
#: Letters of a sample text that are used, at most.
SAMPLE_LETTERS = 4_000
#: A record with fewer letters and digits is not judged against its label.
LEAST_LETTERS = 20
#: Characters that a chunk repeats from the one before, at most, where neither its count nor its offsets tell.
LONGEST_REPEAT = 150
_CHUNK = 400_000
_BOUNDARY = 1

# The codes and names that mean a language.
NAMES = {
    "en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "ger": "de", "german": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "ja": "ja", "jpn": "ja", "japanese": "ja",
    "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "lzh": "zh", "chinese": "zh", "classical chinese": "zh", "literary chinese": "zh",
    "mul": "mixed", "mixed": "mixed", "multiple": "mixed", "multilingual": "mixed", "multiple languages": "mixed",
}


def label_language(c: Column) -> Column:
    """The language a label means: a code with or without region or script, or a name; null if none of ours."""
    whole = F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))
    first = F.regexp_extract(whole, r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})*$", 1)
    table = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, whole), F.try_element_at(table, first))


_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    """Class of every code point of the first plane: 0 other, 1 letter of an alphabet, 2 ideograph or kana, 3 digit."""
    global _ALPHA
    if _ALPHA is None:
        a = np.zeros(65536, np.uint8)
        for p in range(65536):
            c = chr(p)
            if c.isalpha():
                a[p] = 2 if 0x2E80 <= p < 0xA000 or 0xF900 <= p < 0xFB00 or 0xFF66 <= p < 0xFFA0 else 1
            elif c.isalnum():
                a[p] = 3
        a[0x30FC] = 2
        _ALPHA = a
    return _ALPHA


def classes(points: np.ndarray) -> np.ndarray:
    a = _alpha()
    return np.where(points < 65536, a[np.minimum(points, 65535)], np.where(points < 0x40000, 2, 0)).astype(np.uint8)


def grams(points: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes (three fields of 21 bits) of lower-case code points and the segment of each."""
    kind = classes(points)
    letter = (kind == 1) | (kind == 2)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after each word
    p, k, s = np.where(letter, points, _BOUNDARY)[keep].astype(np.int64), np.where(letter, kind, 0)[keep], segment[keep]
    if len(p) < 1:
        return np.zeros(0, np.int64), np.zeros(0, segment.dtype)
    before = np.concatenate(([_BOUNDARY], p[:-1]))
    before2 = np.concatenate(([_BOUNDARY, _BOUNDARY], p[:-2]))[: len(p)]
    kb = np.concatenate(([0], k[:-1]))
    kb2 = np.concatenate(([0, 0], k[:-2]))[: len(p)]
    same = np.concatenate(([False], s[1:] == s[:-1]))
    same2 = np.concatenate(([False, False], s[2:] == s[:-2]))[: len(p)] & same
    wide = k == 2
    b = np.where(same & ((kb == 2) == wide), before, _BOUNDARY)
    a = np.where(wide, 0, np.where(same2 & (kb2 != 2) & (kb != 2), before2, _BOUNDARY))
    code = a << 42 | b << 21 | p
    # A run of one letter says nothing; an ideograph or kana also counts by itself.
    ok = wide | (((k == 1) | (kb == 1)) & ~((a == b) & (b == p)))
    pair = wide & (b != _BOUNDARY)
    at = np.repeat(np.arange(len(p)), ok.astype(np.int8) + pair)
    code, twice = code[at], np.concatenate(([False], at[1:] == at[:-1]))
    lone = twice | (wide & ~pair)[at]
    return np.where(lone, p[at], code), s[at]


class Space:
    """Letter and gram vectors; the same on every machine."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self._letters: dict[int, np.ndarray] = {0: np.ones(dimensions, np.int8)}

    def letter(self, p: int) -> np.ndarray:
        v = self._letters.get(p)
        if v is None:
            bits = np.random.Generator(np.random.PCG64(p)).integers(0, 2, self.d, np.int8)
            v = self._letters[p] = (bits * 2 - 1).astype(np.int8)
        return v

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.d), np.int8)
        for shift, turn in ((42, 2), (21, 1), (0, 0)):
            used, where = np.unique((codes >> shift) & 0x1FFFFF, return_inverse=True)
            table = np.stack([np.roll(self.letter(int(p)), turn) for p in used]) if len(used) else np.zeros((0, self.d), np.int8)
            out *= table[where]
        return out

    def products(self, codes: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
        """Dot product of each gram's vector with each prototype."""
        out = np.empty((len(codes), len(prototypes)), np.float32)
        for i in range(0, len(codes), 2048):
            out[i : i + 2048] = self.vectors(codes[i : i + 2048]).astype(np.float32) @ prototypes.T
        return out


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return grams(points, np.zeros(len(points), np.int32))[0]


def fit(samples: list[tuple[int, str]], rounds: int = 3) -> np.ndarray:
    """Prototypes ``[place in PROTOTYPES, dimension]`` from ``(place, text)``; wrong labels are outvoted.

    A first bundle per label is made of all samples; each further round uses
    only the samples that the last prototypes agree with.  Prototypes have the
    mean of all languages taken off and unit length.
    """
    space = Space()
    counted = [(place, *np.unique(_codes(text[:SAMPLE_LETTERS]), return_counts=True)) for place, text in samples]
    used = np.unique(np.concatenate([c for _, c, _ in counted])) if counted else np.zeros(0, np.int64)
    table = np.concatenate([space.vectors(used[i : i + 4096]) for i in range(0, len(used), 4096)] or [np.zeros((0, space.d), np.int8)])
    bundles = [(k, n.astype(np.float32) @ table[np.searchsorted(used, c)].astype(np.float32)) for k, c, n in counted]
    bundles = [(k, v / n) for k, v in bundles if (n := np.linalg.norm(v)) > 0]
    agreed, protos = bundles, np.zeros((len(PROTOTYPES), space.d))
    for _ in range(rounds):
        raw = np.zeros((len(PROTOTYPES), space.d))
        for k, v in agreed:
            raw[k] += v
        norm = np.linalg.norm(raw, axis=1, keepdims=True)
        raw = np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0)
        present = norm[:, 0] > 0
        protos = np.where(present[:, None], raw - raw[present].mean(axis=0) if present.any() else raw, 0)
        length = np.linalg.norm(protos, axis=1, keepdims=True)
        protos = np.divide(protos, length, out=np.zeros_like(protos), where=length > 0)
        agreed = [(k, v) for k, v in bundles if int(np.argmax(protos @ v)) == k]
    return protos.astype(np.float32)


class Judge:
    """Scores of many segments at once; remembers the products of grams."""

    SLOTS = 1 << 20

    def __init__(self, prototypes: np.ndarray):
        self.space, self.protos = Space(prototypes.shape[1]), prototypes
        self.key = np.full(self.SLOTS, -1, np.int64)
        self.val = np.zeros((self.SLOTS, len(prototypes)), np.float32)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def products(self, codes: np.ndarray) -> np.ndarray:
        slots = self._slots(codes)
        miss = np.flatnonzero(self.key[slots] != codes)
        if len(miss):
            new, back = np.unique(codes[miss], return_inverse=True)
            made = self.space.products(new, self.protos)
            at = self._slots(new)
            free = self.key[at] == -1
            self.key[at[free]], self.val[at[free]] = new[free], made[free]
            bad = self.key[at] != new  # another gram of the batch took the place
            again = free & bad
            self.key[at[again]] = -1
            out = self.val[slots]
            out[miss] = made[back]
            return out
        return self.val[slots]

    def bundles(self, points: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every gram with its segment and its products with the prototypes."""
        codes, seg = grams(points, segment)
        return codes, seg, self.products(codes) if len(codes) else np.zeros((0, len(self.protos)), np.float32)

    def cosines(self, codes: np.ndarray, seg: np.ndarray, products: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of the bundle of each of ``n`` segments (rising, -1 for none) with each prototype, and its number of grams."""
        if len(seg) and seg.min() < 0:
            keep = seg >= 0
            codes, seg, products = codes[keep], seg[keep], products[keep]
        total, count = np.zeros((n, len(self.protos))), np.bincount(seg, minlength=n)
        if len(codes):
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            total[seg[starts]] = np.add.reduceat(products, starts, axis=0, dtype=np.float64)
        return total / np.sqrt(self.space.d * np.maximum(squared_counts(codes, seg, n), 1))[:, None], count


def squared_counts(codes: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Sum of the squared counts of the different grams of each of ``n`` segments."""
    if not len(codes):
        return np.zeros(n)
    # A segment's grams by 40 bits of their hash: two of one segment fall together once in 10^12.
    key = seg.astype(np.uint64) << np.uint64(40) | (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    key.sort()
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.concatenate((starts, [len(key)]))).astype(np.float64)
    return np.bincount((key[starts] >> np.uint64(40)).astype(np.int64), times * times, n)


def segments(texts: list[str], paged: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts with the sentence and paragraph of each and the text of each paragraph."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    text = np.repeat(np.arange(len(lowered)), lengths)
    n = len(points)
    if not n:
        return points, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    first = np.concatenate(([True], text[1:] != text[:-1]))
    line = points == 10
    space = line | (points == 32) | (points == 13) | (points == 9) | (points == 0x3000) | (points == 0xA0)
    # An empty line: a line end, then nothing but space up to the next line end.
    at = np.arange(n)
    last_solid = np.maximum.accumulate(np.where(~space | first, at, -1))
    lines_before = np.cumsum(line)
    parted = ~space & ~first
    prev_solid = np.concatenate(([-1], last_solid[:-1]))
    gap = np.where(parted & (prev_solid >= 0), lines_before - lines_before[np.maximum(prev_solid, 0)], 0)
    new_par = (parted & (gap >= 2)) | first
    wide_end = (points == 0x3002) | (points == 0xFF01) | (points == 0xFF1F)
    dot = (points == 46) | (points == 33) | (points == 63)
    after_wide = np.concatenate(([False], wide_end[:-1]))
    after_dot = np.concatenate(([False, False], (dot[:-2] & space[1:-1]))) if n > 2 else np.zeros(n, bool)
    new_sen = new_par | after_wide | after_dot
    on_page = np.repeat(np.asarray(paged, bool), lengths)
    if on_page.any():
        # A page has no empty line between every two paragraphs; a line that changes script starts a segment.
        line_no = np.cumsum(line | first)
        kind = classes(points)
        wide_n, thin_n = np.bincount(line_no, kind == 2), np.bincount(line_no, kind == 1)
        script = np.where(wide_n * 2 > thin_n, 2, np.where(thin_n > 0, 1, 0))
        start_line = np.concatenate(([False], line[:-1]))
        change = np.concatenate(([0], script[1:] != script[:-1]))
        new_sen |= on_page & start_line & change[line_no].astype(bool)
    return points, (np.cumsum(new_sen) - 1).astype(np.int32), (np.cumsum(new_par) - 1).astype(np.int32), text[new_par]


#: What a sentence needs to count as clearly in a language: so many grams (of an alphabet, of ideographs or kana),
#: and a cosine so much above that of any other language.  Two unrelated bundles differ by about 0.03.
THIN_GRAMS, WIDE_GRAMS, LEAD = 16, 8, 0.12
_WIDE = (LANGUAGES.index("zh"), LANGUAGES.index("ja"))


def judge_texts(judge: Judge, texts: list[str], paged: list[bool], repeats: list[int]) -> list[tuple[str, float, int, list[tuple[str, float]]]]:
    """For each text its language (or ``mixed``), a confidence, its letters and digits, and its paragraphs' languages.

    ``repeats``: characters at the start that another record has already; they
    are not held against the record.  A negative number is a guess: then only
    a first paragraph no longer than that is left out.
    """
    out = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (size == 0 or size + len(texts[upto]) <= _CHUNK):
            size += len(texts[upto])
            upto += 1
        out += _judge_some(judge, texts[at:upto], paged[at:upto], repeats[at:upto])
        at = upto
    return out


def _per_language(x: np.ndarray) -> np.ndarray:
    """Columns of the prototypes to columns of the languages; of two of one language the better."""
    out = x[..., : len(LANGUAGES)].copy()
    for k in range(len(LANGUAGES), len(PROTOTYPES)):
        j = LANGUAGES.index(PROTOTYPES[k])
        out[..., j] = np.maximum(out[..., j], x[..., k])
    return out


def _clear(cosine: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The language that each sentence clearly stands in, -1 for none."""
    rows = np.arange(len(cosine))
    best = cosine.argmax(axis=1)
    rest = cosine.copy()
    rest[rows, best] = -np.inf
    enough = count >= np.where(np.isin(best, _WIDE), WIDE_GRAMS, THIN_GRAMS)
    return np.where(enough & (cosine[rows, best] - rest.max(axis=1) >= LEAD), best, -1)


def _judge_some(judge: Judge, texts, paged, repeats):
    points, sen, par, par_text = segments(texts, paged)
    if not len(points):
        return [("", 0.0, 0, []) for _ in texts]
    n_sen, n_par, n = int(sen[-1]) + 1, int(par[-1]) + 1, len(texts)
    kind = classes(points)
    text_len = np.fromiter((len(t.lower()) for t in texts), np.int64, n)
    text_of = np.repeat(np.arange(n), text_len)
    letters = np.bincount(text_of, kind > 0, n).astype(int)
    first_par, last_par = np.searchsorted(par_text, np.arange(n)), np.searchsorted(par_text, np.arange(n), side="right")
    par_start = np.flatnonzero(np.concatenate(([True], par[1:] != par[:-1])))
    text_start = np.cumsum(text_len) - text_len
    own = first_par.copy()  # the first paragraph that is the record's own
    for i in np.flatnonzero(np.asarray(repeats) != 0):
        a, b, said = first_par[i], last_par[i], repeats[i]
        if said > 0:
            own[i] = a + np.searchsorted(par_start[a:b] - text_start[i], said)
        elif b - a > 1 and par_start[a + 1] - text_start[i] <= 2 - said:
            own[i] = a + 1
        if own[i] >= b:
            own[i] = a
    sen_par = np.zeros(n_sen, np.int64)
    sen_par[sen] = par
    codes, seg, products = judge.bundles(points, sen)
    cosine, count = judge.cosines(codes, seg, products, n_sen)
    clear = _clear(_per_language(cosine), count)
    gram_par = sen_par[seg]
    par_cos, par_count = judge.cosines(codes, gram_par, products, n_par)
    par_cos = _per_language(par_cos)
    kept = np.arange(n_par) >= own[par_text]
    for i in np.flatnonzero(np.bincount(par_text, par_count * kept, n) == 0):  # nothing of its own but marks
        own[i], kept[first_par[i] : last_par[i]] = first_par[i], True
    gram_text = np.where(kept[gram_par], par_text[gram_par], -1)
    whole, whole_count = judge.cosines(codes, gram_text, products, n)
    whole = _per_language(whole)
    # Which languages clear sentences of a paragraph, and of a record, stand in.
    said = np.zeros((n_par, len(LANGUAGES)), bool)
    said[sen_par[clear >= 0], clear[clear >= 0]] = True
    par_mixed = said.sum(axis=1) > 1
    of_text = np.zeros((n, len(LANGUAGES)), bool)
    np.logical_or.at(of_text, par_text[kept], said[kept])
    mixed = of_text.sum(axis=1) > 1
    best = par_cos.argmax(axis=1)
    out = []
    for i in range(n):
        a, b = int(first_par[i]), int(last_par[i])
        if a == b or not whole_count[i]:
            out.append(("", 0.0, int(letters[i]), []))
            continue
        pars = [("mixed" if par_mixed[q] else LANGUAGES[best[q]], _confidence(par_cos[q])) for q in range(a, b)] if not paged[i] else []
        out.append(("mixed" if mixed[i] else LANGUAGES[int(whole[i].argmax())], _confidence(whole[i]), int(letters[i]), pars))
    return out


#: Spread of the difference of two cosines that come about by chance, in this many dimensions.
_CHANCE = (2 / DIMENSIONS) ** 0.5


def _confidence(cos: np.ndarray) -> float:
    """Share of the best language among all, by how far each cosine lies behind in units of chance."""
    e = np.exp((cos - cos.max()) / _CHANCE)
    return round(float(e.max() / e.sum()), 4)


def _sample(df: DataFrame, key: str, places: dict[str, int], most: int) -> list[tuple[int, str]]:
    label = label_language(F.col("language"))
    named = df.where(label.isin(list(places)) & F.col(key).isNotNull() & (F.length("text") > 0))
    # The limit per label is applied before the shuffle, so a label of a third of all rows costs no more than others.
    order = Window.partitionBy("lang").orderBy("h", key)
    ids = named.select(key, label.alias("lang"), F.xxhash64(key).alias("h")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    wanted = [r[0] for r in ids.select(key).collect()]
    if not wanted:
        return []
    rows = named.where(F.col(key).isin(wanted)).select(label.alias("lang"), F.substring("text", 1, SAMPLE_LETTERS).alias("t")).collect()
    return sorted((places[r.lang], r.t) for r in rows)[: 2 * most * len(places)]


def training_sample(documents: DataFrame, pages: DataFrame | None = None, most: int = SAMPLE_PER_LANGUAGE) -> list[tuple[int, str]]:
    """About ``most`` labelled texts for each prototype, at most twice as many: those with the least hash of their id."""
    out = _sample(documents, "doc_id", {lang: k for k, lang in enumerate(LANGUAGES)}, most)
    if pages is not None:
        out += _sample(pages, "page_id", {"zh": len(LANGUAGES)}, most)
    return out


_judges: dict[bytes, Judge] = {}


def worker_judge(prototypes: np.ndarray) -> Judge:
    key = prototypes.tobytes()
    if key not in _judges:
        _judges.clear()
        _judges[key] = Judge(prototypes)
    return _judges[key]


def _identify(prototypes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = worker_judge(prototypes)
        for batch in batches:
            tables, keys, labels = (batch.column(c).to_pylist() for c in ("rec_table", "rec_key", "label"))
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            repeats = batch.column("repeats").to_pylist()
            found = judge_texts(judge, texts, [t == "pages" for t in tables], repeats)
            rows = []
            for t, k, label, (lang, conf, letters, pars) in zip(tables, keys, labels, found):
                rows.append((t, k, 0, lang or None, conf, letters, label))
                if lang == "mixed" and t == "documents":
                    rows += [(t, k, j + 1, x, c, letters, label) for j, (x, c) in enumerate(pars)]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["rec_table", "rec_key", "part_no", "lang", "confidence", "letters", "label"]
            )

    return run


def identify(documents: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``rec_table, rec_key, part_no, lang, confidence, letters, label`` of every record.

    ``part_no`` 0 is the record (``lang`` may be ``mixed``), 1, 2, ... are the
    paragraphs of a mixed document.  ``label`` is the language its label means.
    Null, empty and letterless texts have a null ``lang`` and confidence 0;
    repeated rows come out repeated; an empty table adds no rows.  Only the
    named columns are read.  No shuffle.
    """
    prototypes = fit(training_sample(documents, pages))
    none = F.lit(0)
    said, length, own = F.col("overlap_chars"), F.length("text"), F.col("char_end") - F.col("char_start")
    # What a chunk repeats ends with an empty line, where its offsets or its own count say.
    fits = lambda n: (n > 0) & (F.substring("text", n + 1, F.lit(2)) == "\n\n")
    repeat = (
        F.when(F.col("chunk_index") <= 0, 0)
        .when(fits(length - own - 2), length - own - 2)
        .when(fits(said), said)
        .when((said == 0) | (own == length), 0)
        .otherwise(-LONGEST_REPEAT)
    )
    parts = [
        df.select(F.lit(t).alias("rec_table"), F.col(k).cast("string").alias("rec_key"), label_language(F.col("language")).alias("label"), r.cast("int").alias("repeats"), F.col("text").alias("_text"))
        for t, df, k, r in (("documents", documents, "doc_id", none), ("chunks", chunks, "chunk_id", repeat), ("pages", pages, "page_id", none))
    ]
    parts = [spread(p.where("rec_key is not null")) for p in parts]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.mapInArrow(
        _identify(prototypes), "rec_table string, rec_key string, part_no int, lang string, confidence double, letters int, label string"
    )


def found(documents: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Records whose label is missing or wrong, and every paragraph of mixed documents; each row once."""
    rows = identify(documents, chunks, pages)
    wrong = (F.col("part_no") == 0) & F.col("lang").isNotNull() & (F.col("letters") >= LEAST_LETTERS) & ~F.col("label").eqNullSafe(F.col("lang"))
    return rows.where(wrong | (F.col("part_no") > 0)).select("rec_table", "rec_key", "part_no", "lang").distinct()

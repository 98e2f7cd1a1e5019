"""One consistent form for text that looks alike but differs in its characters.

Each Arrow batch of a partition is handed to an embedded DuckDB, whose SQL
removes invisible characters, turns every space into U+0020, maps compatibility
forms with ``translate`` (one to one) and ``replace`` (one to many), composes
accents with ``nfc_normalize`` and writes look-alike letters inside a word in
the script that most of the word's letters have (Latin where two scripts have
as many), so that a Cyrillic or Greek word stays one.  Punctuation and Greek
letters that name a substance stay as they are.

The classes are built by rule from the character database; only the
look-alikes, which no database of the standard library has, are listed.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q",
    "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "τ": "t", "χ": "x", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# The same for scripts whose letters seldom stand beside Latin ones.
RARE_LOOK_ALIKES = {
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "յ": "j", "Տ": "S", "Օ": "O", "Լ": "L",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲥ": "c",
}
_LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
_LATIN_ = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


@cache
def _to_latin() -> dict[int, str]:
    return {ord(c): x for c, x in (LOOK_ALIKES | RARE_LOOK_ALIKES).items()}


@cache
def _from_latin(script: str) -> dict[int, str]:
    """Latin letters to the look-alikes of a script; of several the one of the plain alphabet."""
    own = sorted((c for c in LOOK_ALIKES | RARE_LOOK_ALIKES if _script(c) == script), key=lambda c: (not "А" <= c <= "я", c), reverse=True)
    return {ord((LOOK_ALIKES | RARE_LOOK_ALIKES)[c]): c for c in own}


def one_script(word: str) -> str:
    """A word with letters of several scripts in the one that most of them have; Latin where two have as many."""
    scripts = Counter("LATIN" if _LATIN_.match(c) else _script(c) for c in word)
    most = max(scripts, key=lambda s: (scripts[s], s == "LATIN", s))
    return word.translate(_to_latin() if most == "LATIN" else _from_latin(most))


#: Characters without width: soft hyphen, joiners, marks of direction, variation selectors and the like.
_INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
]
_SPACES = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Sound marks that take a place of their own.
_MARKS = [(0x309B, 0x309C)]
#: What half-width sound marks stand for; they join the kana before them.
_SOUND = ("\u3099", "\u309a")


def _class(spans: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in spans)


def _spans(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


@cache
def compatibility_forms() -> dict[str, str]:
    """Every variant of a letter, digit or ideograph, with the common form."""
    hidden = {p for a, b in _INVISIBLE for p in range(a, b + 1)}
    out = {}
    for p in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= p < 0xD7B0 or 0xD800 <= p < 0xE000 or p in hidden:
            continue
        c = chr(p)
        if unicodedata.category(c)[0] in "PZCM":
            continue
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and (plain in _SOUND or any(x.isalnum() for x in plain) and plain[0] != " "):
            out[c] = plain
    return out


@cache
def patterns() -> dict[str, str]:
    forms = _class(_spans(sorted(map(ord, compatibility_forms()))))
    latin = _LATIN
    greek = "".join(c for c in LOOK_ALIKES if _script(c) == "GREEK")
    foreign = rf"\p{{Cyrillic}}\p{{Cherokee}}\p{{Armenian}}\p{{Coptic}}{greek}"
    mixed = f"[{latin}][{foreign}]|[{foreign}][{latin}]"
    return {
        "invisible": f"[{_class(_INVISIBLE)}]",
        "spaces": f"[{_class(_SPACES)}]",
        "forms": f"[{forms}]",
        "greek": greek,
        "found": rf"[\p{{M}}{_class(_MARKS)}{_class(_INVISIBLE)}{_class(_SPACES)}{forms}]|{mixed}",
        "word": rf"[{latin}{foreign}]*(?:{mixed})[{latin}{foreign}]*",
    }


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def statement(present: str) -> str:
    """The SQL over the rows ``dirty(i, x)`` whose compatibility forms are those in ``present``."""
    p, forms = patterns(), compatibility_forms()
    single = [c for c in present if len(forms[c]) == 1]
    x = f"regexp_replace(regexp_replace(x, {_text(p['invisible'])}, '', 'g'), {_text(p['spaces'])}, ' ', 'g')"
    if single:
        x = f"translate({x}, {_text(''.join(single))}, {_text(''.join(forms[c] for c in single))})"
    for c in present:
        if len(forms[c]) > 1:
            x = f"replace({x}, {_text(c)}, {_text(forms[c])})"
    x = f"nfc_normalize({x})"
    share = lambda s: f"len(regexp_replace(word, {_text(f'[^{s}]')}, '', 'g'))"
    table = lambda t: f"translate(word, {_text(''.join(map(chr, t)))}, {_text(''.join(t.values()))})"
    # Of the scripts of a word the one with most letters; the order decides between equals.
    scripts = [("LATIN", _LATIN), ("GREEK", p["greek"]), *((s.upper(), rf"\p{{{s}}}") for s in ("Cyrillic", "Coptic", "Cherokee", "Armenian"))]
    most = f"greatest({', '.join(share(c) for _, c in scripts)})"
    cases = " ".join(f"WHEN {share(c)} = {most} THEN {table(_to_latin() if s == 'LATIN' else _from_latin(s))}" for s, c in scripts)
    return f"""
        WITH plain AS (SELECT i, {x} AS x FROM dirty),
             words AS (SELECT i, x, list_distinct(regexp_extract_all(x, {_text(p['word'])})) AS w FROM plain),
             known AS (SELECT word, CASE {cases} ELSE word END AS right_word FROM (SELECT DISTINCT unnest(w) AS word FROM words)),
             pairs AS (SELECT i, list(struct_pack(a := word, b := right_word) ORDER BY length(word) DESC, word DESC) AS ps
                       FROM (SELECT i, unnest(w) AS word FROM words) JOIN known USING (word) GROUP BY i)
        SELECT i, CASE WHEN ps IS NULL THEN x
                       ELSE list_reduce(list_prepend(struct_pack(a := x, b := ''), ps), lambda acc, q: struct_pack(a := replace(acc.a, q.a, q.b), b := '')).a
                  END AS x
        FROM words LEFT JOIN pairs USING (i) ORDER BY i"""


#: Characters of text handed to the embedded database at once; a single longer text goes alone.
PART_BYTES = 8_000_000


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each part's texts have at most ``PART_BYTES`` bytes together, or are a single one."""
    for batch in batches:
        if batch.nbytes <= PART_BYTES:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and held + n > PART_BYTES:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def _normalise(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # No folder to spill to: a part of a batch is small, and the machine's own disk is not ours.
        db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        p = patterns()
        for batch in _by_size(batches):
            texts = batch.column("_text")
            rows = pa.table({"i": pa.array(range(len(texts)), pa.int64()), "x": texts.cast(pa.string())})
            db.register("rows_in", rows)
            db.execute(f"CREATE OR REPLACE TEMP TABLE dirty AS SELECT i, x FROM rows_in WHERE regexp_matches(x, {_text(p['found'])})")
            seen = db.execute(f"SELECT DISTINCT unnest(regexp_extract_all(x, {_text(p['forms'])})) FROM dirty").fetchall()
            found = db.execute(statement("".join(sorted(c for (c,) in seen)))).fetchall()
            db.unregister("rows_in")
            plain, flags = texts.to_pylist(), [False] * len(texts)
            for i, x in found:
                plain[i], flags[i] = x, True
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(plain, pa.string()), pa.array(flags)], [*keep, "plain_text", "found"])

    return run


def normalise(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep``, ``plain_text`` (the text in the one form) and ``found`` (whether it was not).

    Null stays null and empty stays empty, neither is found; a text of only
    invisible characters becomes empty; repeated rows are treated alike; an
    empty table gives an empty result.  Only ``keep`` and ``text`` are read.
    The result in turn is in the one form.  No shuffle.
    """
    picked = df.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(_normalise(keep), f"{schema}, plain_text string, found boolean")


def records(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Both tables' fields in the one form, a row per delivery: ``rec_table, rec_key, loaded_at, plain_text, found``."""
    both = [
        df.select(F.lit(table).alias("rec_table"), F.col(key).cast("string").alias("rec_key"), "loaded_at", F.col(text).alias("raw_text"))
        for table, df, key, text in (("chunks", chunks, "chunk_id", "normalized_text"), ("pages", pages, "page_id", "text"))
    ]
    return normalise(both[0].unionByName(both[1]).where("rec_key is not null"), ["rec_table", "rec_key", "loaded_at"], "raw_text")


def found(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``rec_table, rec_key`` of the records that were not in the one form, each once."""
    return records(chunks, pages).where("found").select("rec_table", "rec_key").distinct()


def canonical(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``rec_table, rec_key, plain_text`` of every record, of several deliveries the first loaded, of ties the least text."""
    row = F.struct("loaded_at", "plain_text")
    return records(chunks, pages).groupBy("rec_table", "rec_key").agg(F.min_by("plain_text", row).alias("plain_text"))

"""Text columns: cleaning, tokens, n-grams, language class, snippets, dictionary terms.

All are built-in expressions, so they stay inside generated code.  Null text
counts as empty unless stated otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges, words and thresholds of the text rules.
CJK = r"[㐀-䶿一-鿿]"
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:\.\d+)?"
HEADING = (
    r"(?i)^(abstract|introduction|methods?|results?|discussion|conclusion|references|acknowledg|摘要|引言|方法|结果|讨论|结论|参考文献)"
)
NUMBERED = r"^(\d+(\.\d+)*|[IVXLC]+)[\s\.、]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def count(c: Column | str, pattern: str) -> Column:
    """Matches of a pattern; 0 for null."""
    return F.regexp_count(_text(c), F.lit(pattern))


def count_words(c: Column | str) -> Column:
    return count(c, WORD)


def char_ngrams(c: Column | str, least: int = 1, most: int = 2) -> Column:
    """All ideograph n-grams of every run, as an array; runs shorter than n give none."""
    runs = F.regexp_extract_all(_text(c), F.lit(f"({CJK}+)"), F.lit(1))

    def grams(n: int):
        return lambda r: F.when(
            F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - (n - 1), F.lit(1))), lambda i: F.substring(r, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.concat(*[F.transform(runs, grams(n)) for n in range(least, most + 1)]))


def _accents() -> tuple[str, str]:
    """Small letters of the Latin alphabet with accents, and the same letters without; by rule from the character database."""
    out = {}
    for p in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(p)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(plain) == 1 and plain != c and plain.isascii() and plain.isalpha():
            out[c] = plain
    return "".join(out), "".join(out.values())


ACCENTED, BARE = _accents()
#: Accents that stand as characters of their own.
ACCENTS = "[\u0300-\u036f]"
#: Full-width letters, digits and marks, and the common ones.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "


def without_accents(c: Column) -> Column:
    """Small letters of the Latin alphabet without their accents."""
    return F.translate(F.regexp_replace(c, ACCENTS, ""), ACCENTED, BARE)


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits without accents, in order; ideographs part words and are left to ``char_ngrams``."""
    bare = without_accents(F.regexp_replace(F.lower(_text(c)), CJK, " "))
    return F.regexp_extract_all(bare, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def search_form(c: Column | str) -> Column:
    """Lower case without accents, full-width forms, dashes and white space made one."""
    plain = without_accents(F.lower(F.translate(_text(c), WIDE, NARROW)))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[‐-―]", "-"), r"\s+", " "))


def language_class(c: Column | str) -> Column:
    """``zh``, ``en``, ``mixed`` or empty by the shares of ideographs and Latin letters of one text."""
    cjk, latin = count(c, CJK), count(c, "[A-Za-z]")
    ratio = F.try_divide(cjk, cjk + latin)
    return (
        F.when((cjk + latin) == 0, "")
        .when((cjk >= 50) & (latin >= 50) & (ratio >= 0.10) & (ratio <= 0.70), "mixed")
        .when((cjk >= 20) & (ratio >= 0.20), "zh")
        .when((cjk >= 20) & (latin >= 20) & (ratio >= 0.05), "mixed")
        .when(latin > 0, "en")
        .otherwise("zh")
    )


def language_of_counts(cjk: Column, latin: Column) -> Column:
    """The same for a document's summed counts."""
    ratio = F.try_divide(cjk, cjk + latin)
    return (
        F.when((cjk + latin) == 0, "")
        .when((cjk >= 200) & (ratio >= 0.20), "zh")
        .when((cjk >= 100) & (latin >= 100) & (ratio >= 0.05), "mixed")
        .when(latin > 0, "en")
        .otherwise("zh")
    )


def clean_page(c: Column | str) -> Column:
    """Line ends, ligatures and inner white space made plain, words broken by a hyphen joined, at most one empty line in a row."""
    x = F.regexp_replace(_text(c), "\u0000", "")
    x = F.regexp_replace(x, "\r\n?", "\n")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("­", "")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"[ \t\f\x0B]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    x = F.regexp_replace(x, r"-\n(?=[A-Za-z])", "")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def garbled_share(c: Column | str, first: int = 5000) -> Column:
    """Share of replacement, control and private characters among the first ones (the rule's own window)."""
    head = F.substring(_text(c), 1, first)
    bad = F.regexp_count(head, F.lit(r"[\x{FFFD}\p{Cc}\p{Co}\p{Cs}]")) - F.regexp_count(head, F.lit(r"[\n\r\t]"))
    return F.coalesce(F.try_divide(bad.cast("double"), F.length(head)), F.lit(0.0))


def section_hint(c: Column | str) -> Column:
    """The first line: whole up to 120 if it is a heading or numbered, else its first 80 characters."""
    bare = F.regexp_replace(_text(c), r"^\s+|\s+$", "")
    line = F.regexp_replace(F.substring_index(bare, "\n", 1), r"^\s+|\s+$", "")
    head = (F.length(line) <= 120) & (line.rlike(HEADING) | line.rlike(NUMBERED))
    return F.when(head, F.substring(line, 1, 120)).otherwise(F.substring(line, 1, 80))


def occurrences(c: Column | str, term: str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    x = _text(c)
    return ((F.length(x) - F.length(F.replace(x, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def snippet(c: Column | str, terms: list[str], size: int) -> Column:
    """``size`` characters from a third before the first term on, ellipses where text is left out."""
    x = _text(c)
    first = F.coalesce(first_match(x, terms), F.lit(1)) - 1
    start = F.greatest(F.lit(0), first - size // 3)
    body = F.regexp_replace(F.substring(x, start + 1, F.lit(size)), "\n", " ")
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + size < F.length(x), "…").otherwise(""))


def around(c: Column | str, terms: list[str], reach: int = 220) -> Column:
    """The text ``reach`` characters before and behind the first term, white space collapsed; null without a term."""
    x = _text(c)
    at = first_match(x, terms) - 1
    longest = F.lit(max(map(len, terms)))
    start = F.greatest(F.lit(0), at - reach)
    return F.trim(F.regexp_replace(F.substring(x, start + 1, at - start + longest + reach), r"\s+", " "))


def work_title(c: Column | str) -> Column:
    """A file's name as a work's title: without extension, leading number and what follows the first mark of a part."""
    x = F.regexp_replace(_text(c), r"\.[A-Za-z0-9]{1,5}$", "")
    x = F.regexp_replace(x, r"^[0-9]+[\s._-]*", "")
    return F.trim(F.regexp_replace(x, r"\s*[(\[_（［【].*$", ""))


def graph_text(c: Column | str) -> Column:
    """A name as it is compared in the graph: full-width forms and white space made one."""
    return F.trim(F.regexp_replace(F.translate(_text(c), WIDE, NARROW), r"\s+", " "))


def graph_key(c: Column | str) -> Column:
    """The same with case folded (sharp s and final sigma as well)."""
    return F.replace(F.replace(F.lower(graph_text(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def without_space(c: Column | str) -> Column:
    """The text without any white space, as quotes are compared."""
    return F.regexp_replace(_text(c), r"\s+", "")


def quote_match(quote: Column, text: Column) -> Column:
    """How a quote stands in a text: ``exact``, ``normalized_whitespace``, ``missing``, or ``no_quote``."""
    return (
        F.when(F.trim(_text(quote)) == "", "no_quote")
        .when(_text(text).contains(_text(quote)), "exact")
        .when(without_space(text).contains(without_space(quote)), "normalized_whitespace")
        .otherwise("missing")
    )


def labels(*cs: Column) -> Column:
    """The labels that are not empty, joined by semicolons."""
    return F.array_join(F.filter(F.array(*[F.trim(_text(c)) for c in cs]), lambda x: x != ""), ";")


def term_pattern(term: str) -> str:
    """A term as a pattern: Latin terms end at letters and digits, others are literal."""
    escaped = "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in term.lower())
    return f"(^|[^a-z0-9]){escaped}($|[^a-z0-9])" if term.isascii() else escaped


def matched_terms(c: Column | str, terms: list[str]) -> Column:
    """The terms that occur, in the order given."""
    low = F.lower(_text(c))
    return F.array_compact(F.array(*[F.when(low.rlike(term_pattern(t)), F.lit(t)) for t in terms]))


def first_match(c: Column | str, terms: list[str]) -> Column:
    """Place (from 1) of the earliest term; null if none."""
    low = F.lower(_text(c))
    return F.array_min(F.filter(F.array(*[F.instr(low, t.lower()) for t in terms]), lambda p: p > 0))


def numbers_with_unit(c: Column | str, units: str, most: int = 8) -> Column:
    """Values with one of the units (a pattern), in order, ``most`` of them."""
    return F.slice(F.regexp_extract_all(F.lower(_text(c)), F.lit(rf"(\d+(?:\.\d+)?\s*(?:{units}))"), F.lit(1)), 1, most)

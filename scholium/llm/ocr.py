"""Repair of text from scanned pages: furniture, broken words, misread characters, reflow.

Running heads are lines that recur at the edge of a book's pages and hardly
anywhere else, or that resemble the book's title; page numbers are numerals at
an edge, and where a numeral may be text they must keep the distance to the
page's place that recurs in the book.

Words are the words of alphabets and the single ideographs.  Skip-gram vectors
are learned from the whole corpus: the pointwise information of linkable words
with the frequent words around them, factorised by the eigenvectors of its
second moments.  A rare word is linked to the frequent ones that a plausible
glyph edit leads to; which of them is meant, and whether a word that is no
rarity is another one misread, is decided for each occurrence by the vectors of
the words around it.  An ideograph is corrected only where its neighbours call
for the other one.  Words that are rare in any spelling are judged by their
character grams.  Then furniture is removed, broken words are joined and lines
reflowed.

What is sent to every executor is bounded by ``VOCABULARY``.  What a larger
corpus has beyond it, counts and vectors alike, stays in tables and is joined to
the pages that ask for it, so the outcome is that of an unbounded vocabulary.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm import unicode_forms
from scholium.session import durable

# What a printed glyph (right) is taken for (left).
LATIN_EDITS = [
    ("c", "e"), ("f", "t"), ("@", "a"), ("u", "n"), ("0", "o"), ("5", "s"), ("!", "i"), ("1", "l"), ("cl", "d"), ("li", "h"), ("rn", "m"),
    ("q", "g"), ("vv", "w"), ("6", "b"), ("6", "é"), ("h", "li"), ("ii", "ü"), ("9", "g"), ("8", "B"), ("3", "e"), ("|", "l"), ("$", "s"),
]
# The same for mistakes so seldom that only a frequent word vouches for them.
SELDOM_EDITS = [("d", "cl"), ("h", "b"), ("e", "c"), ("n", "u"), ("m", "rn"), ("i", "l"), ("l", "i"), ("t", "f"), ("g", "q"), ("w", "vv")]


def _by_letter(edits: list[tuple[str, str]]) -> dict[str, list[tuple[str, str, int]]]:
    out: dict[str, list[tuple[str, str, int]]] = {}
    for wrong, right in edits:
        out.setdefault(wrong[0], []).append((wrong, right, len(wrong)))
    return out


_USUAL_BY_LETTER, _SELDOM_BY_LETTER = _by_letter(LATIN_EDITS), _by_letter(SELDOM_EDITS)
# Ideographs of like shape, misread (left) and printed (right).
HAN_EDITS = [
    "熟熱", "波皮", "木水", "炭灰", "大火", "太大", "大太", "日曰", "曰日", "每毒", "雨兩", "汗汁", "板根", "冶治", "瘖瘡", "揚湯", "場傷", "甚其", "沈洗",
    "人入", "入人", "巳已", "己已", "已己", "末未", "未末", "剪煎", "万方", "老者", "眼服", "右石", "石右", "肯青", "自白", "白自", "士土", "土士", "千干",
    "干千", "鳥烏", "烏鳥", "牛午", "午牛", "刀力", "力刀", "貝見", "見貝", "目日", "田由", "由田", "申甲", "甲申", "天夫", "夫天", "王玉", "玉王", "戊戌",
    "戌戊", "侯候", "候侯", "免兔", "兔免", "休体", "末木", "本木", "木本", "大犬", "犬大", "住往", "往住", "辛幸", "幸辛", "卷券", "微徵", "徵微", "折析",
    "析折", "侍待", "待侍", "撥發", "睛晴", "晴睛", "槁稿", "枝技", "技枝", "肓盲", "盲肓", "臍濟", "濟臍", "杳查", "查杳", "口囗", "囗口", "叉又", "又叉",
]
UNREADABLE = "〓□■�"
BREAK_MARKS = "-¬‐⸗\xad"

#: A word is frequent from this many occurrences, and this share of all words, on.
FREQUENT, FREQUENT_SHARE = 8, 1e-6
#: A misread form is at most this share of the right one.
MOST_SHARE = 0.12
#: Least cosine of a misread word's vector with the right one's, where both have LEAST_SEEN contexts.
LEAST_COSINE, LEAST_SEEN = 0.15, 60
VECTOR, CONTEXTS = 64, 512
#: Weight of the cosine with the words around against the log counts, and how often a glyph is misread.
PULL, MISREAD = 12.0, 0.002
#: Words, and ideograph triples, that are sent to every executor, at most.
VOCABULARY = 1_000_000
#: Gain in log probability per character gram that makes a rare word's other spelling the right one.
LEAST_GAIN = 3.5

_LETTER = "[^\\W_\u2e80-\uffef\U00020000-\U0003ffff]"
_TOKEN = re.compile(f"[@!|$]?{_LETTER}+(?:[@!|$]+{_LETTER}+)*[@!]?|@")
# The same for texts without characters beyond: their letters stand in a table, which is looked at faster than a category.
_BEYOND = re.compile("[\ufff0-\U0001ffff\U00040000-\U0010ffff]")
_FEW = "".join(filter(re.compile(_LETTER).match, map(chr, range(0x2E80))))
_QUICK_TOKEN = re.compile(f"[@!|${_FEW}](?:(?:(?<=[{_FEW}])[{_FEW}]*+|[{_FEW}]++)(?:[@!|$]++[{_FEW}]++)*+[@!]?|(?<=@))")
_HAN = re.compile(r"[㐀-䶿一-鿿〓□■�]")
_KANA = re.compile(r"[ぁ-ヾ]")
_HAN_RUN = re.compile(_HAN.pattern + "+")
_MARKED = re.compile(f"[{re.escape(BREAK_MARKS)}]\\n")
_BROKEN = re.compile(rf"(?<={_LETTER})[{re.escape(BREAK_MARKS)}]\n[ \t]*(?={_LETTER})")
_SPECIAL = re.compile(
    "[\u00a0\u00ad\u0300-\u036f\u0370-\u04ff\u2000-\u200f\u202f\u2060\u2e80-\u2fdf\u3000\ufe00-\ufe0f\ufeff\uf900-\ufaff\ufb00-\ufb4f"
    "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f\U0001d400-\U0001d7ff\U000e0100-\U000e01ef]"
)
_OTHER = "\u0370-\u03ff\u0400-\u052f\u0531-\u058f\u13a0-\u13ff\u2c80-\u2cff"
_TWO_SCRIPTS = re.compile(f"[A-Za-zÀ-ɏ{_OTHER}]*(?:[A-Za-zÀ-ɏ][{_OTHER}]|[{_OTHER}][A-Za-zÀ-ɏ])[A-Za-zÀ-ɏ{_OTHER}]*")
_BOTH = re.compile(f"[A-Za-zÀ-ɏ][{_OTHER}]|[{_OTHER}][A-Za-zÀ-ɏ]")
_table: dict[int, str | None] | None = None


def words_of(text: str) -> list[str]:
    """The words of alphabets of a text in small letters."""
    return (_QUICK_TOKEN if text.isascii() or not _BEYOND.search(text) else _TOKEN).findall(text)


def plain(text: str) -> str:
    """``text`` with look-alike characters in their common form; line ends stay, and so do soft hyphens at them."""
    global _table
    if not _SPECIAL.search(text):
        return text
    if _table is None:
        _table = {ord(c): x for c, x in unicode_forms.compatibility_forms().items()}
        _table |= {p: None for a, b in unicode_forms._INVISIBLE for p in range(a, min(b, a + 0x1000) + 1)}
        _table |= {p: " " for a, b in unicode_forms._SPACES for p in range(a, b + 1)}
    kept = re.sub("\xad(?=[ \t]*(?:\n|$))", "‐", text) if "\xad" in text else text
    # Of the table only what the text has: few characters, whose common forms are none that it replaces.
    for c in _table.keys() & set(map(ord, set(kept))):
        kept = kept.replace(chr(c), _table[c] or "")
    same = unicodedata.normalize("NFC", kept)
    return _TWO_SCRIPTS.sub(lambda m: unicode_forms.one_script(m.group()), same) if _BOTH.search(same) else same


# --- furniture -----------------------------------------------------------------------------------------------

_NUMBER = re.compile(
    r"[-–—·•\[(（〔【]*\s*(?:p{1,2}\.\s*)?(?:第\s*)?(?:[0-9oOlI]{1,4}|[ivxlcdmIVXLCDM]{1,9}|[〇零一二三四五六七八九十百]{1,6})(?:\s*[頁页])?\s*[-–—·•\])）〕】.]*"
)
_DIGITS = re.compile(r"\d+")
_ROMAN = re.compile(r"(?=.)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_NUMERAL_WORDS = re.compile(r"卷[〇一二三四五六七八九十上中下]+|第[〇一二三四五六七八九十百\d]+[章回篇頁页]")
_EDGE = 2
#: Letters of a running head, at most and at least.
HEAD_LETTERS = (4, 40)
#: Pages of a book on which a head, and a distance between number and place, recurs, and the share of a head's lines that are outermost.
RECURRING, RECURRING_DISTANCE, EDGE_SHARE = 5, 3, 0.8
#: Share of the page's widest line that a recurring head fills, at most; lines of the body fill more.
HEAD_WIDTH = 0.7
#: Pages that books number in Roman numerals, at most; a greater one must keep a recurring distance.
FRONT_MATTER = 200
# Glyphs that are taken for each other fall together when lines are compared, so that a misread head recurs as well.
_FOLDED = ("cf@u05!169|$3", "etanosilbglse")
_LIGATED = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"))


_LETTERS = re.compile(r"[^\W\d_]+")


def _only_letters(x: str) -> str:
    got = "".join(_LETTERS.findall(x))
    return got if not got or got.isalpha() else "".join(filter(str.isalpha, got))


def _letters(line: str) -> str:
    return _only_letters(line.lower())


_FOLD = str.maketrans(*_FOLDED)


def head_key(line: str) -> str:
    """What is compared of a line: its letters, in small, without numerals and differences of misreading."""
    x = _NUMERAL_WORDS.sub("", line).lower().strip(" 0123456789.·-\u3000\t\r").translate(_FOLD)
    for wrong, right in _LIGATED:
        x = x.replace(wrong, right)
    return _only_letters(x)


def is_page_number(line: str, page: int | None, label: str | None, offsets: frozenset[int] = frozenset()) -> bool:
    """``offsets``: the distances between number and place that recur in the book."""
    s = line.strip()
    if not s or len(s) > 14 or not _NUMBER.fullmatch(s):
        return False
    bare = s.rstrip(".")
    if bare.isalpha() and bare.isascii():  # letters only: a Roman numeral, or a word
        if not _ROMAN.fullmatch(bare):
            return False
        if s != bare or bare == "I" or _roman_value(bare) > FRONT_MATTER:
            return page is not None and _roman_value(bare) - page in offsets
        return True
    m = _DIGITS.search(s)
    if m and s.endswith(".") and not s.startswith(("p", "P", "[")) and page is not None:  # may be the end of a sentence
        return int(m.group()) - page in offsets or (label or "").strip() == m.group()
    return True


_WORTH = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _roman_value(s: str) -> int:
    worth = [_WORTH.get(c, 0) for c in s.lower()]
    return sum(-v if v < w else v for v, w in zip(worth, [*worth[1:], 0]))


def _resembles(own: str, name: str, grams: frozenset) -> bool:
    if not name or not 0 < len(own) <= len(name) + 8 or len(own) < 0.5 * len(name):
        return False
    return len({own[i : i + 2] for i in range(len(own) - 1)} & grams) >= 0.45 * len(grams)


def _grams(name: str) -> frozenset:
    return frozenset(name[i : i + 2] for i in range(len(name) - 1))


def is_header(line: str, title: str, heads: frozenset[str] = frozenset()) -> bool:
    """``title``: the letters of the book's title; ``heads``: the keys of the lines that recur at the edges of its pages."""
    s = line.strip()
    if len(s) > max(36, len(title) + 16):
        return False
    # An ideograph at the start begins the key as well.
    if heads and not ("一" <= s[:1] <= "鿿" and s[0] not in "卷第" and s[0] not in _starts(heads)) and head_key(s) in heads:
        return True
    low, grams = s.lower(), _title_grams(title)
    if title and len(low) >= 0.5 * len(title) and not (grams and _characters(title).isdisjoint(low)) and _resembles(_letters(_NUMERAL_WORDS.sub("", s)), title, grams):
        return True
    # A head that does not recur among the pages at hand: capitals only.
    if low == s or _HAN.search(s):
        return False
    alpha = [c for c in s if c.isalpha()]
    return 4 <= len(alpha) <= 30 and sum(c.isupper() for c in alpha) >= 0.8 * len(alpha) and not s.endswith((",", ";", ")")) and len(s.split()) <= 5 and not any(c in s for c in "(-")


@lru_cache(10_000)
def _title_grams(title: str) -> frozenset:
    return _grams(title)


@lru_cache(10_000)
def _characters(title: str) -> frozenset[str]:
    return frozenset(title)


@lru_cache(10_000)
def _starts(heads: frozenset[str]) -> frozenset[str]:
    return frozenset(x[:1] for x in heads)


@dataclass
class Page:
    """A page's lines in the plain form, the furniture among them, and its body lines."""

    lines: list[str]
    headers: list[int] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    body: list[int] = field(default_factory=list)


def read_page(text: str, title: str | None, number: int | None, label: str | None, native: bool, heads=(), offsets=()) -> Page:
    lines = plain(text).split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    page = Page(lines)
    if not native:
        name, heads, offsets = _letters(title or ""), frozenset(heads or ()), frozenset(offsets or ())
        for at in dict.fromkeys(filled[:_EDGE] + filled[-_EDGE:]):
            if is_page_number(lines[at], number, label, offsets):
                page.numbers.append(at)
        for at in dict.fromkeys(filled[: _EDGE + 1] + filled[-_EDGE:]):
            if at not in page.numbers and is_header(lines[at], name, heads):
                page.headers.append(at)
    out = {*page.headers, *page.numbers}
    page.body = [i for i in filled if i not in out]
    return page


def breaks(page: Page) -> list[tuple[int, int]]:
    """Body lines whose last word goes on in the next body line behind a break mark, with that line."""
    out = []
    lines = page.lines
    for a, b in zip(page.body, page.body[1:]):
        x = lines[a].rstrip()
        if len(x) > 1 and x[-1] in BREAK_MARKS and x[-2].isalnum():
            y = lines[b].lstrip()
            if y[:1].isalnum() and not _HAN.match(y) and not _KANA.search(x + y):
                out.append((a, b))
    return out


class Body:
    """The body of a page as one text: broken words joined, and the line of every place."""

    def __init__(self, page: Page):
        raw = "\n".join([page.lines[i].rstrip() for i in page.body])
        self.page, self.raw = page, raw
        self.kana = not raw.isascii() and bool(_KANA.search(raw))
        text = raw.lower()
        self.cased = raw
        if len(text) != len(raw):  # a letter whose small form is longer
            text = raw
        self.cuts: list[tuple[int, int]] = []  # place in the joined text from which on so many characters are gone
        if not self.kana and _MARKED.search(raw):
            out, cased, at, gone = [], [], 0, 0
            for m in _BROKEN.finditer(text):
                out.append(text[at : m.start()])
                cased.append(raw[at : m.start()])
                gone += m.end() - m.start()
                at = m.end()
                self.cuts.append((at - gone, gone))
            text = "".join(out) + text[at:]
            self.cased = "".join(cased) + raw[at:]
        self.text = text
        self._starts: list[int] | None = None

    def line(self, place: int) -> int:
        """The page's line on which the character at ``place`` of the joined text stands."""
        k = bisect_right(self.cuts, (place, len(self.raw) + 1))
        return self._line_of(place + (self.cuts[k - 1][1] if k else 0))

    def _line_of(self, at: int) -> int:
        if self._starts is None:
            starts, n = [], 0
            for i in self.page.body:
                starts.append(n)
                n += len(self.page.lines[i].rstrip()) + 1
            self._starts = starts
        return self.page.body[bisect_right(self._starts, at) - 1]

    def latin(self) -> str:
        """The text for its words of alphabets; none where lines end inside words without a mark."""
        return "" if self.kana else self.text

    def ideographs(self) -> str:
        """The ideographs in a row, everything else left out."""
        return "".join(_HAN_RUN.findall(self.raw)) if not self.raw.isascii() else ""


def ideograph_lines(page: Page, places: list[int]) -> list[int]:
    """The page's lines on which the ideographs at ``places`` of the body's row stand."""
    ends, n = [], 0
    for i in page.body:
        n += sum(map(len, _HAN_RUN.findall(page.lines[i])))
        ends.append(n)
    return [page.body[bisect_right(ends, p)] for p in places]


# --- what the corpus knows -----------------------------------------------------------------------------------


class _Logs(dict):
    """Log probability of the last of four characters of a padded word after the others, from the counts of grams."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams

    def __missing__(self, four: str) -> float:
        g = self.grams.get
        back = (g(four[1:], 0) + 0.2) / (g("<" + four[1:3], 0) + 8)
        got = self[four] = math.log((g(four, 0) + 4 * back) / (g("<" + four[:3], 0) + 4))
        return got

    def __reduce__(self):
        return _Logs, (self.grams,)


@dataclass
class Model:
    """``counts`` and ``triples`` hold what occurs at least ``floor`` times (words, ideographs in a row); a page's own are the verdicts (``more``) and the frequent ``words`` beyond that."""

    counts: dict[str, int]
    vectors: dict[str, np.ndarray]
    grams: dict[str, int]
    triples: dict[str, int]
    contexts: dict[str, np.ndarray] = field(default_factory=dict)
    floor: tuple[int, int] = (0, 0)
    more: dict[str, tuple[str, tuple[int, ...], list]] = field(default_factory=dict)
    words: frozenset[str] = frozenset()
    memo: dict = field(default_factory=dict)
    logs: _Logs | None = None
    right: frozenset[str] | None = None
    #: Tells a worker whether it has this model, and what it remembers of it, already.
    token: str = ""

    def __post_init__(self):
        if self.logs is None:
            self.logs = _Logs(self.grams)

    def near(self, a: str, b: str) -> bool:
        """Whether a rare word's vector lies near a frequent one's; words that are no rarity themselves are left to their context."""
        x, y = self.vectors.get(a), self.vectors.get(b)
        if self.counts.get(a, 0) > MOST_SHARE * self.counts.get(b, 0):
            return True
        return x is None or y is None or float(x @ y) >= LEAST_COSINE

    def knows(self, w: str) -> bool:
        """Whether nothing below the floor bears on ``w``: no word there is much more frequent, and a rival needs a vector of ``w``."""
        if self.floor == (0, 0):
            return True
        if _of_rows(w):
            return not self.floor[1] or all(x in self.triples for x in _needs(w))
        n, floor = self.counts.get(w, 0), self.floor[0]
        return not floor or n * MOST_SHARE >= floor or n >= floor and w not in self.vectors

    def frequent(self, w: str) -> bool:
        return self.counts.get(w, 0) >= FREQUENT or w in self.words

    def sound(self) -> frozenset[str]:
        """Frequent words that no frequent word could be meant by: most of any text, and nothing to look at."""
        if self.right is None:
            get = self.counts.get
            doubtful = lambda w, n: any(n <= MOST_SHARE * m or self._rivals(w, v, n, m) for v, _ in self.linked(w) if (m := get(v, 0)))
            self.right = frozenset(w for w, n in self.counts.items() if n >= FREQUENT and w.isalpha() and self.knows(w) and not doubtful(w, n))
        return self.right

    def _rivals(self, w: str, v: str, n: int, m: int) -> bool:
        """Whether two frequent words are near enough in number that only their contexts can tell them apart."""
        return n > MOST_SHARE * m and m > MOST_SHARE * n and w in self.vectors and v in self.vectors

    def meant(self, w: str, around: list[str]) -> tuple[str, tuple[int, ...]]:
        """The word meant by ``w`` between the words ``around``, and the places in ``w`` that are not as printed."""
        got, choice = self.spelling(w), self.chosen(w)
        if not choice:
            return got
        context = [self.contexts[c] for c in around if c in self.contexts]
        if not context:
            return got
        c = np.sum(context, axis=0)
        length = float(np.sqrt(c @ c))
        if not length:
            return got
        best, most = got, -math.inf
        for v, at, prior, vector in choice:
            score = prior + (PULL * float(vector @ c) / length if vector is not None else 0.0)
            if score > most:
                best, most = (v, at), score
        return best

    def chosen(self, w: str) -> list[tuple[str, tuple[int, ...], float, np.ndarray | None]]:
        """The words between which the context of ``w`` decides, where they differ, log prior and vector; none if there is nothing to choose."""
        self.spelling(w)
        return self.memo.get((w,), [])

    def _choice(self, w: str, n: int, linked: list[tuple[str, int, int]]) -> list[tuple[str, tuple[int, ...], float, np.ndarray | None]]:
        """Of the words ``linked`` to ``w`` (with place and count) those it may stand for, and itself, if it is no rarity."""
        out, rare = [], False
        for v, at, m in linked:
            if n <= MOST_SHARE * m:
                rare = True
                out.append((v, (at,), math.log(m), self.vectors.get(v)))
            elif self._rivals(w, v, n, m):
                # No rarity: taken for another word only as seldom as glyphs are misread at all.
                out.append((v, (at,), math.log(m * MISREAD), self.vectors.get(v)))
        if out and n >= FREQUENT and not rare:
            out.append((w, (), math.log(n), self.vectors.get(w)))
        return out if len(out) > 1 and any(vector is not None for *_, vector in out) else []

    def linked(self, w: str) -> list[tuple[str, int]]:
        return [*self._variants(w, _USUAL_BY_LETTER), *self._variants(w, _SELDOM_BY_LETTER)]

    def _gain(self, w: str, v: str, at: int) -> float:
        """What the log probability gains by spelling ``w`` as ``v``, which differ from ``at`` on for a few letters."""
        x, y = f"^^^{w}$", f"^^^{v}$"
        i = at + 3
        a, b = len(x), len(y)
        while a > i and b > i and x[a - 1] == y[b - 1]:
            a, b = a - 1, b - 1
        a, b = min(a + 3, len(x)), min(b + 3, len(y))
        logs = self.logs
        return sum([logs[y[k - 3 : k + 1]] for k in range(i, b)]) - sum([logs[x[k - 3 : k + 1]] for k in range(i, a)])

    def spelling(self, w: str) -> tuple[str, tuple[int, ...]]:
        """The word meant by ``w`` and the places in ``w`` that are not as printed."""
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[w] = self._spelling(w)
        return got

    @staticmethod
    def _variants(w: str, edits: dict[str, list[tuple[str, str, int]]]) -> list[tuple[str, int]]:
        """Every spelling that one glyph edit leads to, and where the edit is."""
        return [(w[:i] + right + w[i + n :], i) for i, c in enumerate(w) if c in edits for wrong, right, n in edits[c] if n == 1 or w.startswith(wrong, i)]

    def _spelling(self, w: str) -> tuple[str, tuple[int, ...]]:
        plain_word = w.isalpha()
        letters = len(w) if plain_word else sum(map(str.isalpha, w))
        if len(w) > 60 or not letters and w != "@":
            return w, ()
        if not self.knows(w):
            to, at, choice = self.more.get(w, (w, (), ()))
            if choice:
                self.memo[w,] = choice
            return to, at
        n, get = self.counts.get(w, 0), self.counts.get
        best, places = None, ()
        variants = self._variants(w, _USUAL_BY_LETTER)
        linked = [(v, at, m) for v, at in (*variants, *self._variants(w, _SELDOM_BY_LETTER)) if (m := get(v, 0))]
        if len(linked) > 1 or linked and n >= FREQUENT:
            if choice := self._choice(w, n, linked):
                self.memo[w,] = choice
        for v, at, m in linked:
            if n <= MOST_SHARE * m and (best is None or m > get(best, 0)) and self.near(w, v):
                best, places = v, (at,)
        if best is not None:
            return best, places
        if not plain_word:
            odd = tuple(i for i, c in enumerate(w) if not c.isalpha())
            if letters < 3 or len(odd) > 2 + len(w) // 5 or re.search(r"\d\d", w):
                return w, ()
            return w.translate(_SYMBOLS), odd
        if n >= FREQUENT or letters < 5:
            return w, ()
        gain, to, where = LEAST_GAIN, w, ()
        for v, at in variants:
            more = self._gain(w, v, at) - 0.7 * (len(w) - len(v))
            if more > gain:
                gain, to, where = more, v, (at,)
        return to, where

    def ideograph_errors(self, row: str) -> list[tuple[int, str]]:
        """Places of a row of ideographs that are not as printed, and what is (unknown for an unreadable one)."""
        out, memo = [], self.memo
        row = f"^{row}$"
        for m in _SUSPECT.finditer(row):
            i = m.start()
            three = row[i - 1 : i + 2]
            right = memo.get(three)
            if right is None:
                right = memo[three] = self._printed(*three)
            if right != three[1]:
                out.append((i - 1, right))
        return out

    def _printed(self, a: str, c: str, b: str) -> str:
        if c in UNREADABLE:
            return ""
        if self.floor[1] and not self.knows(a + c + b):
            return self.more[a + c + b][0] if a + c + b in self.more else c
        best, most, get = c, 0.0, self.triples.get
        for f in _GLYPHS[c]:
            if not self.near(c, f):
                continue
            here, there = get(a + c + b, 0), get(a + f + b, 0)
            l0, l1, r0, r1 = get(a + c, 0), get(a + f, 0), get(c + b, 0), get(f + b, 0)
            left = l1 >= 20 and l0 <= MOST_SHARE * l1
            right = r1 >= 20 and r0 <= MOST_SHARE * r1
            if there >= 10:
                # Of few rows the misread ones may be a larger share by chance; then a neighbour, or both, must call for the other one.
                most_here = MOST_SHARE * there
                call = here <= most_here or here <= most_here + 2 * math.sqrt(most_here) and (left or right) or here < there / 2 and left and right
                sure = there
            else:
                # The triple is rare (a neighbour may be misread itself): either pair must call for the other one.
                call = left and right or (left and r0 + r1 < 20) or (right and l0 + l1 < 20)
                sure = min(l1, r1)
            if call and sure >= most:
                best, most = f, sure
        return best


_SYMBOLS = str.maketrans({wrong: right for wrong, right in reversed(LATIN_EDITS) if len(wrong) == 1 and not wrong.isalpha() and len(right) == 1})
_GLYPHS: dict[str, list[str]] = {}
for _pair in HAN_EDITS:
    _GLYPHS.setdefault(_pair[0], []).append(_pair[1])
_SUSPECT = re.compile("[" + "".join(_GLYPHS) + UNREADABLE + "]")


def misread(page: Page, model: Model, words: list[str] | None = None, row: str | None = None) -> tuple[set[int], dict[int, list[tuple[str, str]]], dict[int, str]]:
    """Body lines with misread characters; the words to replace in each line; the ideographs to replace by place."""
    lines: set[int] = set()
    fixes: dict[int, list[tuple[str, str]]] = {}
    body = None
    if words is None or row is None:
        body = Body(page)
        words, row = words_of(body.latin()), body.ideographs()
    odd = set(words) - model.sound()
    if odd:
        memo, spelling = model.memo, model.spelling
        odd = {w for w in odd if (memo.get(w) or spelling(w))[1] or (w,) in memo}
    if odd:
        body = body or Body(page)
        text, end = body.latin(), 0
        for k, w in enumerate(words):
            # Between two words stands nothing that a word begins with, so this is its place.
            start = text.index(w, end)
            end = start + len(w)
            if w not in odd or (len(w) <= 5 and body.cased[start:end].isupper()):  # the letters of a code
                continue
            to, places = model.meant(w, words[max(k - 2, 0) : k] + words[k + 1 : k + 3])
            if not places:
                continue
            at = [body.line(start + p) for p in places]
            lines.update(at)
            if body.line(start) == body.line(end - 1):
                fixes.setdefault(at[0], []).append((w, to))
    wrong = model.ideograph_errors(row) if row else []
    if wrong:
        lines.update(ideograph_lines(page, [i for i, _ in wrong]))
    return lines, fixes, dict(wrong)


_WORD_END, _WORD_START = re.compile(r"[^\W_]+$"), re.compile(r"[^\W_]+")


def _respelt(line: str, w: str, to: str) -> str:
    """``line`` with every ``w``, in whatever case, spelt ``to``; a capital at its start stays one."""
    low = line.lower()
    if len(low) != len(line):
        return re.sub(re.escape(w), lambda m: to.capitalize() if m.group()[:1].isupper() else to, line, flags=re.I)
    out, at = [], 0
    while (k := low.find(w, at)) >= 0:
        out += (line[at:k], to.capitalize() if line[k].isupper() else to)
        at = k + len(w)
    return "".join(out) + line[at:]


def repair(page: Page, model: Model | None, words: list[str] | None = None, row: str | None = None, asked: set[str] | None = None) -> str:
    """One continuous text in paragraphs; to ``asked`` are added the words whose being frequent decides on hyphens, which all go then."""
    lines = list(page.lines)
    if model is not None:
        _, fixes, right = misread(page, model, words, row)
        for at, pairs in fixes.items():
            for w, to in pairs:
                lines[at] = _respelt(lines[at], w, to)
        if right:
            at = 0
            for i in page.body:
                n = len(_HAN.findall(lines[i]))
                if any(at <= place < at + n for place in right):
                    counter = itertools.count(at)
                    lines[i] = _HAN.sub(lambda m, c=counter: right.get(next(c)) or m.group(), lines[i])
                at += n
    goes_on = dict(breaks(page))
    unspaced = bool(_KANA.search("".join(lines[i] for i in page.body)))  # lines end anywhere, words included
    pars: list[str] = []
    widest = max((len(lines[i].rstrip()) for i in page.body), default=0)
    before, last = None, ""
    for i in page.body:
        x = lines[i].rstrip()
        new = before is None or lines[i][:1].isspace() or i - before > 1 and any(not lines[j].strip() for j in range(before + 1, i))
        new = new or last[-1:] in ".。！？!?」" and len(last) < 0.75 * widest
        x = x.lstrip()
        if new:
            pars.append(x)
        elif before in goes_on:
            joined = pars[-1][:-1]
            # A word's first half stands on the line before, so it is looked for no further back.
            half, rest = _WORD_END.search(joined[-len(lines[before]) - 1 :]), _WORD_START.match(x)
            stays = False
            if model is not None and pars[-1][-1] == "-" and half:
                one, two = half.group(), rest.group()
                if asked is None:
                    stays = not model.frequent((one + two).lower()) and model.frequent(one.lower()) and model.frequent(two.lower())
                else:
                    # A hyphen that stays before this line makes the half shorter, down to what stands on the line.
                    own = _WORD_END.search(lines[before].rstrip()[:-1])
                    halves = [one[k:] for k in range(len(one) - (len(own.group()) if own else 1) + 1)]
                    asked.update(x.lower() for x in (two, *halves, *(x + two for x in halves)))
            pars[-1] = (pars[-1] if stays else joined) + x
        elif unspaced or x and pars[-1] and (ord(x[0]) > 0x2E7F or ord(pars[-1][-1]) > 0x2E7F):
            pars[-1] += x
        else:
            pars[-1] += " " + x
        before, last = i, lines[i].rstrip()
    return "\n\n".join(pars)


# --- over the corpus -----------------------------------------------------------------------------------------

_COLUMNS = ("page_id", "text", "title", "physical_page", "pdf_page_label", "reading_direction", "recurring")
_PARSED = "page_id string, native boolean, lines string, headers array<int>, numbers array<int>, words string, ideographs string"


@lru_cache(10_000)
def _split_recurring(recurring: str) -> tuple[frozenset[str], frozenset[int]]:
    keys = recurring.split("\n") if recurring else []
    return frozenset(k for k in keys if not k.startswith("#")), frozenset(int(k[1:]) for k in keys if k.startswith("#"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for pid, text, title, number, label, direction, recurring in zip(*(batch.column(c).to_pylist() for c in _COLUMNS)):
            if text and text.strip():
                native = direction == "native"
                heads, offsets = _split_recurring(recurring or "")
                page = read_page(text, title, number, label, native, heads, offsets)
                body = Body(page)
                rows.append((pid, native, "\n".join(page.lines), page.headers, page.numbers, " ".join(words_of(body.latin())), body.ideographs()))
        cols = list(zip(*rows)) or [()] * 7
        ints = pa.list_(pa.int32())
        kinds = [pa.string(), pa.bool_(), pa.string(), ints, ints, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "native", "lines", "headers", "numbers", "words", "ideographs"])


def _choices(rows: list[dict] | None) -> list[tuple[str, tuple[int, ...], float, np.ndarray | None]]:
    return [(r["to"], tuple(r["places"]), r["prior"], None if r["vector"] is None else np.frombuffer(r["vector"], np.float32)) for r in rows or ()]


def _ints(column: pa.Array) -> list[list[int]]:
    flat, ends = column.values.to_numpy().tolist(), column.offsets.to_numpy().tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _parsed(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[str, Page, bool, list[str], str]]:
    """The pages of a batch; what the model cannot know by itself stands in ``more`` and ``frequent``."""
    names = ("page_id", "native", "lines", "words", "ideographs")
    own = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in ("more", "frequent")]
    for pid, native, lines, words, row, headers, numbers, more, frequent in zip(*(batch.column(c).to_pylist() for c in names), *(_ints(batch.column(c)) for c in ("headers", "numbers")), *own):
        page = Page(lines.split("\n"), headers, numbers)
        out = {*headers, *numbers}
        page.body = [i for i, x in enumerate(page.lines) if i not in out and x and not x.isspace()]
        model.more = {m["item"]: (m["to"], tuple(m["places"]), _choices(m["choice"])) for m in more} if more else {}
        model.words = frozenset(frequent or ())
        yield pid, page, native, words.split(" ") if words else [], row


def _triples(row: str) -> np.ndarray:
    """Codes (up to three fields of 21 bits) of the ideographs, pairs and triples of a row."""
    p = np.frombuffer(f"^{row}$".encode("utf-32-le"), np.uint32).astype(np.int64)
    pairs = p[:-1] << 21 | p[1:]
    return np.concatenate([p, pairs, pairs[:-1] << 21 | p[2:]])


def _spell(code: int) -> str:
    return "".join(chr(x) for x in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if x)


def _split(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch's pages, and of each the number of its page among those that have any."""
    column = batch.column("words")
    pages = pc.split_pattern(column.filter(pc.not_equal(column, "")), " ")
    return pages.flatten(), pc.list_parent_indices(pages).to_numpy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (``item``) and of ideographs, pairs and triples (``code``), summed within the task."""
    seen: list[pa.StructArray] = []
    codes: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if seen:
            item, n = (pa.concat_arrays([x.field(k) for x in seen]) for k in (0, 1))
            seen.clear()
            for part in pa.table([item, n], ["item", "n"]).group_by("item").aggregate([("n", "sum")]).to_batches():
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.nulls(part.num_rows, pa.int64()), part.column("n_sum")], ["item", "code", "n"])
        if codes:
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            codes.clear()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["item", "code", "n"])

    for batch in batches:
        words = _split(batch)[0]
        if len(words):
            seen.append(pc.value_counts(words))
        rows = list(filter(None, batch.column("ideographs").to_pylist()))
        if rows:
            codes.append(_triples("$^".join(rows)))
        if sum(map(len, seen)) > 500_000 or sum(map(len, codes)) > 8_000_000:
            yield from flush()
    yield from flush()


def _cooccur(known: dict[str, int], wanted: np.ndarray, contexts: int):
    """Counts of (word, context word) within two places, of the wanted among known words with the most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ranked = pa.array(list(known), pa.string())  # in the order of their ids
        of_point = np.full(0x30000, -1, np.int64)  # the ids of ideographs by code point
        for w, k in known.items():
            if len(w) == 1 and ord(w) < len(of_point):
                of_point[ord(w)] = k

        def flush() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

        size = 0
        for batch in batches:
            words, of = _split(batch)
            ids = np.full(len(words) + 2 * (of[-1] + 1 if len(of) else 0), -1, np.int64)  # two unknown words behind each page
            ids[np.arange(len(words)) + 2 * of] = pc.index_in(words, ranked).fill_null(-1).to_numpy()
            rows = "  ".join(filter(None, batch.column("ideographs").to_pylist()))
            points = np.frombuffer(f"  {rows}".encode("utf-32-le"), np.uint32).astype(np.int64)
            a = np.concatenate([ids, np.where(points < len(of_point), of_point[np.minimum(points, len(of_point) - 1)], -1)])
            for d in (1, 2):
                x, y = a[d:], a[:-d]
                for one, two in ((x, y), (y, x)):
                    ok = wanted[one] & (two >= 0) & (two < contexts)
                    held.append(one[ok] << 32 | two[ok])
                    size += len(held[-1])
            if size > 4_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _cooccur_others(known: dict[str, int], contexts: int):
    """Counts of (word, context word) as by ``_cooccur``, of all words that are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words, c = zip(*seen)
            out = pa.RecordBatch.from_arrays([pa.array(words), pa.array(c, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["w", "c", "n"])
            seen.clear()
            return out

        for batch in batches:
            for words in filter(None, batch.column("words").to_pylist()):
                tokens = words.split(" ")
                ids = [known.get(w, -1) for w in tokens]
                for k, w in enumerate(tokens):
                    if ids[k] < 0:
                        seen.update([(w, c) for c in ids[max(k - 2, 0) : k] + ids[k + 1 : k + 3] if 0 <= c < contexts])
                if len(seen) > 500_000:
                    yield flush()
        if seen:
            yield flush()

    return run


def _information(words: np.ndarray, n: np.ndarray, starts: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Positive pointwise information of cells (context ``words``, counts ``n``) of rows that begin at ``starts``, given the contexts' totals."""
    smooth = np.maximum(column, 1) ** 0.75
    row = np.repeat(np.add.reduceat(n, starts), np.diff(np.concatenate((starts, [len(n)]))))
    return np.maximum(np.log(n / row / (smooth[words] / smooth.sum())), 0)


def _cells(batch: pa.RecordBatch, column: np.ndarray) -> np.ndarray:
    """The information of the batch's words (rows) with the contexts (columns)."""
    cells = batch.column("cells")
    flat, sizes = cells.flatten(), np.diff(cells.offsets.to_numpy())
    c, n = flat.field("c").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((batch.num_rows, CONTEXTS))
    out[np.repeat(np.arange(batch.num_rows), sizes), c] = _information(c, n, starts, column)
    return out


def _moments(column: np.ndarray):
    """Second moments of the information between contexts, one matrix for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CONTEXTS, CONTEXTS))
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                x = _cells(batch.slice(k, 2_000), column)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _project(column: np.ndarray, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2_000) for k in range(0, batch.num_rows, 2_000)):
                v = _cells(part, column) @ basis
                length = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, length, out=np.zeros_like(v), where=length > 0).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("w"), pa.array([r.tobytes() for r in v], pa.binary())], ["w", "v"])

    return run


def skipgram_vectors(pairs: DataFrame, ranked: list[str], others: DataFrame | None = None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], DataFrame | None]:
    """Unit vectors of the words with enough contexts, the vectors of the contexts, and a table of the others' vectors.

    From counted ``pair`` (word, context) of ranked words and counted ``w, c, n``
    of others.  The information matrix (words by contexts) is factorised by the
    leading eigenvectors of its second moments, which are summed on the
    executors; the words are projected there, too.  To the driver come the
    contexts' totals, a matrix per task, and one vector for each ranked word.
    """
    cells = [pairs.select(F.shiftright("pair", 32).alias("w"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("c"), "n")]
    cells += [others] if others is not None else []
    column = np.zeros(CONTEXTS)
    for r in (r for x in cells for r in x.groupBy("c").agg(F.sum("n").alias("n")).collect()):
        column[r.c] += r.n
    rows = [durable(x.groupBy("w").agg(F.collect_list(F.struct("c", "n")).alias("cells"), F.sum("n").alias("seen")).where(F.col("seen") >= LEAST_SEEN).drop("seen")) for x in cells]
    parts = [r for x in rows for r in x.coalesce(_PARTS).mapInArrow(_moments(column), "m binary").collect()]
    moments = sum((np.frombuffer(r.m).reshape(CONTEXTS, CONTEXTS) for r in parts), np.zeros((CONTEXTS, CONTEXTS)))
    values, vectors = np.linalg.eigh(moments)
    basis = vectors[:, ::-1][:, :VECTOR] * np.sign(vectors[:, ::-1][:, :VECTOR].sum(axis=0) + 1e-12)
    known = {ranked[r.w]: np.frombuffer(r.v, np.float32) for r in rows[0].mapInArrow(_project(column, basis), "w long, v binary").collect()}
    # A context counts by what it tells: a word that stands beside all others points nowhere.
    around = {w: basis[k].astype(np.float32) for k, w in enumerate(ranked[:CONTEXTS]) if column[k]}
    return known, around, rows[1].mapInArrow(_project(column, basis), "w string, v binary") if others is not None else None


#: Tasks over which the second moments are summed; each sends one matrix to the driver.
_PARTS = 16


def _floor(df: DataFrame, least: int) -> int:
    """The least count from which on at most ``VOCABULARY`` rows remain."""
    if df.where(F.col("n") >= least).limit(VOCABULARY + 1).count() <= VOCABULARY:
        return least
    steps = {r.k: r.c for r in df.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    held, k = 0, max(steps) + 1
    while k - 1 >= min(steps) and held + steps.get(k - 1, 0) <= VOCABULARY:
        k -= 1
        held += steps.get(k, 0)
    return max(least, math.ceil(2 ** (k / 8)))


def _point(shift: int):
    return F.shiftright("code", shift).bitwiseAND(F.lit(0x1FFFFF))


def learn(parsed: DataFrame) -> tuple[Model, DataFrame]:
    """The model of parsed pages, and its counts, with the vectors (``v``) of words that the model does not hold.

    Everything is counted over all pages.  The words and ideograph triples that
    come to the driver and from there to every executor are all that are
    frequent, or the ``VOCABULARY`` most frequent ones, besides the contexts and
    the single ideographs; the rest is looked up by ``beyond``.
    """
    counts = durable(parsed.select("words", "ideographs").mapInArrow(_count, "item string, code long, n long").groupBy("item", "code").agg(F.sum("n").alias("n")))
    glyphs = sorted({ord(c) for pair in HAN_EDITS for c in pair})
    mark = lambda c: c.isin(glyphs)
    # Only what an ideograph of like shape stands in is ever asked for.
    asked = F.when(F.shiftright("code", 42) > 0, mark(_point(21))).when(F.shiftright("code", 21) > 0, mark(_point(21)) | mark(_point(0))).otherwise(True)
    words, rows = counts.where(F.col("code").isNull()), counts.where(F.col("item").isNull() & asked)
    least = _floor(words, FREQUENT), _floor(rows, 2)
    floor = least[0] if least[0] > FREQUENT else 0, least[1] if least[1] > 2 else 0
    words_ = {r.item: r.n for r in words.where(F.col("n") >= least[0]).select("item", "n").collect()}
    triples = {_spell(r.code): r.n for r in rows.where(F.col("n") >= least[1]).select("code", "n").collect()}
    single = triples
    if floor[1]:
        single = {_spell(r.code): r.n for r in rows.where((F.col("code") < 1 << 21) & (F.col("n") >= FREQUENT)).select("code", "n").collect()}
    words_ |= {c: n for c, n in single.items() if len(c) == 1 and n >= FREQUENT and c not in "^$"}
    suspects, others, extra = set(), None, []
    if floor[0]:
        frequent = words.where(F.col("n") >= FREQUENT).select("item", "n")
        first = {r.item: r.n for r in frequent.orderBy(F.desc("n"), "item").limit(CONTEXTS).collect()}
        extra = [w for w in first if w not in words_]
        words_ |= first
        held = (F.col("n") >= least[0]) | F.col("item").isin(extra)
        linkable = durable(_linkable_words(frequent))
        suspects = {r.item for r in linkable.where(held).collect()}
        others = linkable.where(~held).select(F.col("item").alias("w"))
    ranked = sorted(words_, key=lambda w: (-words_[w], w))
    known = {w: i for i, w in enumerate(ranked)}
    suspects |= _linkable(words_)
    wanted = np.zeros(len(known) + 1, bool)  # the last place stands for unknown words
    wanted[[known[w] for w in suspects]] = True
    vectors, contexts = {}, {}
    if suspects or floor[0]:
        pairs = parsed.select("words", "ideographs").mapInArrow(_cooccur(known, wanted, CONTEXTS), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        if floor[0]:
            beside = parsed.select("words").mapInArrow(_cooccur_others(known, CONTEXTS), "w string, c int, n long")
            others = durable(beside.join(others, "w", "left_semi").groupBy("w", "c").agg(F.sum("n").alias("n")))
        vectors, contexts, rest = skipgram_vectors(durable(pairs), ranked, others)
        if rest is not None:
            counts = durable(words.join(rest.withColumnRenamed("w", "item"), "item", "left").unionByName(counts.where("code is not null"), allowMissingColumns=True))
    # Four-letter grams of words, each word counted at most 30 times so that no word outweighs its kind.
    spread = words.where((F.length("item") >= 4) & F.col("item").rlike("^[a-zà-ÿœß]+$"))
    padded = F.concat(F.lit("^^^"), "item", F.lit("$"))
    grams = (
        spread.select(padded.alias("p"), F.least("n", F.lit(30)).alias("n"))
        .select(F.explode(F.expr("transform(sequence(1, length(p) - 3), i -> substring(p, i, 4))")).alias("g"), "n")
        .groupBy("g")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .collect()
    )
    table: dict[str, int] = {}
    for g, n in ((r.g, r.n) for r in grams):
        table[g] = table.get(g, 0) + n
        table[g[1:]] = table.get(g[1:], 0) + n
        table["<" + g[:3]] = table.get("<" + g[:3], 0) + n
        table["<" + g[1:3]] = table.get("<" + g[1:3], 0) + n
    return Model(words_, vectors, table, triples, contexts, floor, token=uuid.uuid4().hex), counts


def _linkable(counts: dict[str, int]) -> set[str]:
    """Frequent words that a glyph edit links to a frequent one, and those; the ideographs of like shape."""
    probe, out = Model({}, {}, {}, {}), set()
    for w in counts:
        for v, _ in probe.linked(w):
            if v in counts:
                out |= {w, v}
    for pair in HAN_EDITS:
        out |= {c for c in pair if c in counts}
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    probe = Model({}, {}, {}, {})
    for batch in batches:
        for k in range(0, batch.num_rows, 2_000):
            pairs = [(w, v) for w in batch.column("item").slice(k, 2_000).to_pylist() for v, _ in probe.linked(w)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*pairs) if pairs else ((), ()))], ["w", "v"])


def _linkable_words(frequent: DataFrame) -> DataFrame:
    """``item, n`` of frequent words that a glyph edit links to a frequent one, and of those: as ``_linkable``, by joins."""
    links = frequent.select("item").mapInArrow(_links, "w string, v string").join(frequent.select(F.col("item").alias("v")), "v", "left_semi")
    return frequent.join(links.select(F.explode(F.array("w", "v")).alias("item")), "item", "left_semi")


def _of_rows(item: str) -> bool:
    """Whether an item is a triple of ideographs; else it is a word."""
    return len(item) == 3 and item[1] in _GLYPHS


def _needs(item: str) -> list[str]:
    """What must be counted to judge an item: a word's linked words, or an ideograph's rows with those of like shape."""
    if not _of_rows(item):
        return [item, *dict.fromkeys(v for v, _ in Model({}, {}, {}, {}).linked(item) if v != item)]
    a, c, b = item
    return list(dict.fromkeys(x for f in (c, *_GLYPHS[c]) for x in (a + f + b, a + f, f + b)))


def _unknown(model: Model):
    """``page_id, item``: what the model alone cannot judge, once for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items = [], []
            for pid, words, row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "words", "ideographs"))):
                own = {w for w in set(words.split(" ")) if w and len(w) <= 60 and not model.knows(w)}
                if row and model.floor[1]:
                    row = f"^{row}$"
                    three = {row[m.start() - 1 : m.start() + 2] for m in _SUSPECT.finditer(row)}
                    own |= {t for t in three if _of_rows(t) and not model.knows(t)}
                ids += [pid] * len(own)
                items += own
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, items)], ["page_id", "item"])

    return run


def _needed(model: Model):
    """``item, need``: the item itself, and what else of its needs the model does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                items, needs = [], []
                for item in batch.column("item").slice(k, 2_000).to_pylist():
                    held = model.triples if _of_rows(item) else model.counts
                    own = [x for x in _needs(item) if x == item or x not in held]
                    items += [item] * len(own)
                    needs += own
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (items, needs)], ["item", "need"])

    return run


_CHOICE = "array<struct<to:string,places:array<int>,prior:double,vector:binary>>"


def _settle(learned: Model):
    """Judges each item by what the model holds of its needs, and by what was joined; what is as printed gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lambda known, needs: {x: known[x] for x in needs if x in known}
        ints = pa.list_(pa.int32())
        choices = pa.list_(pa.struct([("to", pa.string()), ("places", ints), ("prior", pa.float64()), ("vector", pa.binary())]))
        for batch in batches:
            out = []
            for item, cells in zip(batch.column("item").to_pylist(), batch.column("cells").to_pylist()):
                needs, n = _needs(item), {c["need"]: c["n"] for c in cells}
                if _of_rows(item):
                    model = Model(learned.counts, learned.vectors, {}, n | held(learned.triples, needs))
                    if (to := model._printed(*item)) != item[1]:
                        out.append((item, to, (), ()))
                    continue
                vectors = {c["need"]: np.frombuffer(c["v"], np.float32) for c in cells if c["v"] is not None}
                model = Model(n | held(learned.counts, needs), vectors | held(learned.vectors, needs), learned.grams, {}, logs=learned.logs)
                choice = [{"to": v, "places": at, "prior": prior, "vector": None if x is None else x.tobytes()} for v, at, prior, x in model.chosen(item)]
                to, places = model.spelling(item)
                if places or choice:
                    out.append((item, to, places, choice))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), ints, choices))], ["item", "to", "places", "choice"])

    return run


def beyond(parsed: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``parsed`` with the verdicts on each page's words and ideographs that the model alone cannot judge, where they are not as printed.

    What it does not hold of them and of what they may stand for, counts and
    vectors, is joined by shuffle; each is then judged by the same rules as with
    the model, and where the context decides, by the same vectors.
    """
    if model.floor == (0, 0):
        return parsed
    asked = durable(parsed.where("not native").mapInArrow(_unknown(model), "page_id string, item string"))
    needs = asked.select("item").distinct().mapInArrow(_needed(model), "item string, need string")
    spelt = F.concat(*[F.when(_point(k) > 0, F.decode(F.unhex(F.lpad(F.hex(_point(k)), 8, "0")), "UTF-32")).otherwise("") for k in (42, 21, 0)])
    # What is rarer than the model would hold without a bound counts as none here, too.
    counted = F.col("n") >= F.when(F.col("item").isNull(), 2).otherwise(FREQUENT)
    vector = F.col("v") if "v" in counts.columns else F.lit(None).cast("binary").alias("v")
    number = counts.where(counted).select(F.coalesce("item", spelt).alias("need"), "n", vector)
    cells = needs.join(number, "need", "left").groupBy("item").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("need", "n", "v"))).alias("cells"))
    verdicts = cells.mapInArrow(_settle(model), f"item string, to string, places array<int>, choice {_CHOICE}")
    per_page = durable(asked.join(verdicts, "item").groupBy("page_id").agg(F.collect_list(F.struct("item", "to", "places", "choice")).alias("more")))
    return parsed.join(per_page, "page_id", "left")


def _halves(learned: Model):
    """``page_id, item``: the words that decide on a page's hyphens and that the model does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _at_worker(learned)
        for batch in batches:
            ids, items = [], []
            for pid, page, _, words, row in _parsed(batch, model):
                if not any(page.lines[a].rstrip().endswith("-") for a, _ in breaks(page)):
                    continue
                asked: set[str] = set()
                repair(page, model, words, row, asked)
                asked -= model.counts.keys()
                ids += [pid] * len(asked)
                items += asked
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, items)], ["page_id", "item"])

    return run


def beyond_hyphens(pages: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``pages`` (of ``beyond``) with those frequent words beyond the model that decide whether a hyphen stays."""
    if not model.floor[0]:
        return pages
    hyphens = pages.where("not native").where(F.col("lines").rlike(r"-[^\p{L}\p{N}]*\n"))
    asked = hyphens.mapInArrow(_halves(model), "page_id string, item string")
    frequent = counts.where(F.col("item").isNotNull() & (F.col("n") >= FREQUENT)).select("item")
    per_page = durable(asked.join(frequent, "item", "left_semi").groupBy("page_id").agg(F.collect_list("item").alias("frequent")))
    return pages.join(per_page, "page_id", "left")


_held: dict[str, Model] = {}


def _at_worker(model: Model) -> Model:
    """The model as an earlier task of this worker left it, with all words it has spelt."""
    if model.token not in _held:
        _held.clear()
        _held[model.token] = model
    return _held[model.token]


def _find(learned: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _at_worker(learned)
        for batch in batches:
            ids, nos, kinds = [], [], []
            for pid, page, _, words, row in _parsed(batch, model):
                marks = [(i, "header") for i in page.headers] + [(i, "page_number") for i in page.numbers]
                marks += [(a, "hyphen") for a, _ in breaks(page)] + [(i, "misread") for i in misread(page, model, words, row)[0]]
                for no, kind in marks:
                    ids.append(pid)
                    nos.append(no)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(kinds, pa.string())], ["page_id", "line_no", "kind"])

    return run


def _repair(learned: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _at_worker(learned)
        for batch in batches:
            out = [(pid, repair(page, None if native else model, words, row)) for pid, page, native, words, row in _parsed(batch, model)]
            ids, texts = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["page_id", "text"])

    return run


#: Books, and their recurring lines, that are sent to every executor instead of shuffled to the pages.
BROADCAST_BOOKS = 100_000


def recurring_lines(pages: DataFrame) -> DataFrame:
    """``book_id, recurring``: the keys of lines that recur at the edges of a book's scanned pages, and (``#``) recurring distances of page numbers.

    A line is a head if it stands at an edge of at least ``RECURRING`` pages,
    leaves some of the page's width free, does not mostly end as a sentence
    does, and of its lines near the edges ``EDGE_SHARE`` are outermost (but for
    a page number); lines of the body stand anywhere.  Of each page only the
    lines at its edges are looked at, and counted before they are shuffled.
    """
    scanned = pages.where(F.col("book_id").isNotNull() & F.col("text").isNotNull() & ~F.col("reading_direction").eqNullSafe("native"))
    filled = lambda part: F.split(F.btrim(part, F.lit(" \n\r\t\u3000")), r"\s*\n\s*")
    near = 3 * (_EDGE + 1)  # lines of a page's ends, empty ones included
    edges = scanned.select("book_id", "page_id", "physical_page", filled(F.substring_index("text", "\n", near)).alias("top"), filled(F.substring_index("text", "\n", -near)).alias("foot"))
    line = lambda side, at: F.coalesce(F.try_element_at(side, F.lit(at)), F.lit(""))
    is_number = lambda x: (F.length(x) <= 14) & x.rlike(r"^[^\p{L}\d]*\d{1,4}[^\p{L}\d]*$")
    first, last = line("top", 1), line("foot", -1)
    places = [(first, F.lit(True)), (line("top", 2), is_number(first)), (line("top", 3), F.lit(False)), (last, F.lit(True)), (line("foot", -2), is_number(last))]
    widest = F.greatest(*[F.length(x) for x, _ in places])
    rows = edges.select("book_id", "page_id", "physical_page", widest.alias("widest"), F.inline(F.array(*[F.struct(x.alias("line"), outer.alias("outer")) for x, outer in places])))
    numbered = F.col("line").contains("卷") | F.col("line").contains("第")
    x = F.btrim(F.lower(F.when(numbered, F.regexp_replace("line", _NUMERAL_WORDS.pattern, "")).otherwise(F.col("line"))), F.lit(" 0123456789.·-\u3000\t\r"))
    x = F.translate(x, *_FOLDED)
    for wrong, right in _LIGATED:
        x = F.replace(x, F.lit(wrong), F.lit(right))
    number = F.when(F.length("line") <= 14, F.regexp_extract("line", r"^[^\p{L}\d]*(\d{1,4})[^\p{L}\d]*$", 1)).otherwise("")
    key = F.when(number != "", F.concat(F.lit("#"), (number.cast("int") - F.col("physical_page")).cast("string"))).otherwise(F.regexp_replace(x, r"\P{L}+", ""))
    ends = F.col("line").rlike(r"[.,;:!?。，、；：！？)）」』]\s*$|^\s*[，。、；：）」』]")
    # Generated, not selected: a condition on a selected column is moved before it, and makes the key anew at each mention.
    keyed = rows.where((F.col("line") != "") & (F.length("line") <= F.greatest(HEAD_WIDTH * F.col("widest"), F.lit(6)))).select(
        "book_id", "page_id", F.explode(F.array(key)).alias("key"), F.col("outer").cast("int").alias("outer"), ends.cast("int").alias("ends")
    )
    per = keyed.where(F.col("key").startswith("#") | F.length("key").between(*HEAD_LETTERS)).groupBy("book_id", "key", "page_id").agg(F.max("outer").alias("outer"), F.max("ends").alias("ends"))
    of = per.groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("pages"), F.sum("outer").alias("outer"), F.sum("ends").alias("ends"))
    head = (F.col("pages") >= RECURRING) & (F.col("outer") >= EDGE_SHARE * F.col("pages")) & (F.col("ends") * 2 <= F.col("pages"))
    kept = of.where(F.when(F.col("key").startswith("#"), F.col("pages") >= RECURRING_DISTANCE).otherwise(head))
    return kept.groupBy("book_id").agg(F.collect_list("key").alias("recurring"))


def delivered(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Each page once (the first loaded, of ties the least text) with its book's title and recurring lines, one below the other."""
    row = F.struct("loaded_at", "text", "book_id", "physical_page", "pdf_page_label", "reading_direction")
    once = pages.where("page_id is not null").groupBy("page_id").agg(F.min(row).alias("r")).select("page_id", "r.*")
    titles = books.where("book_id is not null").groupBy("book_id").agg(F.min("title").alias("title"))
    known = durable(titles.join(recurring_lines(pages), "book_id", "full_outer"))
    size = known.agg(F.count(F.lit(1)).alias("books"), F.sum(F.coalesce(F.size("recurring"), F.lit(0))).alias("lines")).first()
    known = known.withColumn("recurring", F.array_join("recurring", "\n"))  # keys are letters or numbers
    if size.books <= BROADCAST_BOOKS and (size.lines or 0) <= 10 * BROADCAST_BOOKS:
        known = F.broadcast(known)
    return once.join(known, "book_id", "left").select(*_COLUMNS)


def found(pages: DataFrame, books: DataFrame) -> DataFrame:
    """``page_id, line_no, kind`` of the furniture, broken words and misread lines of scanned pages, each once.

    Null and blank pages and native text have none; repeated deliveries count
    once; a page without a known title can still show page numbers and heads;
    empty tables give an empty result.
    """
    parsed = durable(delivered(pages, books).mapInArrow(_parse, _PARSED))
    model, counts = learn(parsed)
    return beyond(parsed, model, counts).where("not native").mapInArrow(_find(model), "page_id string, line_no int, kind string").distinct()


def repaired(pages: DataFrame, books: DataFrame) -> DataFrame:
    """``page_id, text``: one continuous text in paragraphs per page that has any."""
    parsed = durable(delivered(pages, books).mapInArrow(_parse, _PARSED))
    model, counts = learn(parsed)
    return beyond_hyphens(beyond(parsed, model, counts), model, counts).mapInArrow(_repair(model), "page_id string, text string")

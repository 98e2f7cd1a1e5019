"""Compiling a question: terms, alternatives, identifiers, title and focus, and whether it is in scope.

A question is one short text, so this runs on the driver; its result is what
the retrieval operators take.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, field

_TOKEN = re.compile(r"[a-z0-9]+(?:[._/-][a-z0-9]+)*")
_RUN = re.compile(r"[㐀-䶿一-鿿]+")
_TITLE, _FOCUS = re.compile(r"《([^》]+)》"), re.compile(r"[“\"「]([^”\"」]+)[”\"」]")
#: Terms of a question that are used, at most: the feature's own limit.
MOST_TERMS = 40


@dataclass(frozen=True)
class Question:
    """What a question asks for; ``groups`` are alternatives of which each group needs one."""

    text: str
    terms: list[str] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    title: str = ""
    focus: str = ""
    in_scope: bool = True


def plain(text: str) -> str:
    """Compatibility form, case folded, without accents, dashes and white space unified."""
    x = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text or "").casefold())
    x = "".join(c for c in x if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[‐-―]", "-", x)).strip()


def _grams(run: str) -> list[str]:
    return [run] if len(run) <= 2 else [run[i : i + 2] for i in range(len(run) - 1)]


def _words(text: str, stop: frozenset[str] = frozenset(), stop_phrases: tuple[str, ...] = ()) -> list[str]:
    out = [t for t in _TOKEN.findall(plain(text)) if len(t) > 1 and t not in stop]
    for run in _RUN.findall(text):
        for phrase in stop_phrases:
            run = run.replace(phrase, " ")
        out += [g for part in run.split() for g in _grams(part)]
    return out


def compile_question(
    text: str, concepts: Mapping[str, list[str]] | None = None, stop: frozenset[str] = frozenset(), stop_phrases: tuple[str, ...] = (), out_of_scope: tuple[str, ...] = ()
) -> Question:
    """A question's parts.

    An identifier (letters and digits, six or more) overrides everything else;
    known concepts become groups of their names' words; without either every
    term is its own group, so that all are needed.
    """
    if not text or not text.strip():
        raise ValueError("the question is empty")
    named = {k: v for k, v in (concepts or {}).items() if k in text}
    aliases = [plain(a) for names in named.values() for a in names]
    terms = list(dict.fromkeys(w for part in (text, *(a for names in named.values() for a in names)) for w in _words(part, stop, stop_phrases)))[:MOST_TERMS]
    identifiers = [t for t in _TOKEN.findall(plain(text)) if len(t) >= 6 and re.search(r"[a-z]", t) and re.search(r"\d", t)]
    if identifiers:
        groups = [[t] for t in identifiers]
    elif named:
        groups = [g for names in named.values() if (g := list(dict.fromkeys(w for a in names for w in _words(a))))]
    else:
        groups = [[t] for t in terms]
    title, focus = _TITLE.search(text), _FOCUS.search(text)
    return Question(
        text, terms, groups, identifiers, aliases, title.group(1) if title else "", focus.group(1) if focus else "", not any(m in text for m in out_of_scope)
    )

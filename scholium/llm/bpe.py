"""Byte-level BPE encoding of whole corpora with a public vocabulary.

The merge loop keeps the symbols of a piece in a doubly linked list and the
mergeable neighbours in a priority queue ordered by merge rank; an entry whose
symbols have changed since it was queued is stale and is skipped.  Decoding
concatenates the vocabulary strings.

Two exact shortcuts keep the Python side linear in the text:

* a piece is cut wherever two adjacent bytes stand together in no vocabulary
  string, because no merge can ever cross such a place;
* pieces and cut segments are remembered per worker, up to ``MEMO_ENTRIES``
  (the memo is emptied when full; it never changes a result).
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from scholium.session import spread

#: Directory of the public vocabulary files; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("SCHOLIUM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO_ENTRIES = 400_000

# Fixed value: the pattern that splits text before the merges of the rank file.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same split in the built-in engine's classes, right for every text without
#: a character on which the two engines' classes differ (``_odd`` finds those).
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_FULL = regex.compile(
    SPLIT_PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
)


def _odd_class() -> str:
    odd = [
        c
        for c in range(sys.maxunicode + 1)
        if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) in ("No", "Nl") or 0x1C <= c <= 0x1F)
    ]
    spans, start = [], odd[0]
    for a, b in zip(odd, odd[1:] + [odd[-1] + 2]):
        if b != a + 1:
            spans.append((start, a))
            start = b
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


_odd: re.Pattern | None = None


def pieces(text: str) -> list[str]:
    """The pieces of ``text`` inside which merges may happen."""
    global _odd
    if _odd is None:
        _odd = re.compile(_odd_class())
    if not text.isascii() and _odd.search(text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return _FULL.findall(text)
    return _PLAIN.findall(text)


class ByteBPE:
    """Encoder and decoder over a rank file (base64 vocabulary string, id)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.strings = {i: s for s, i in self.ranks.items()}
        self._together = bytearray(65536)
        for s in self.ranks:
            for a, b in zip(s, s[1:]):
                self._together[a << 8 | b] = 1
        self._pieces: dict[str, bytes] = {}
        self._segments: dict[bytes, bytes] = {}

    def merge(self, seg: bytes) -> list[int]:
        """Ids of one segment by rank-ordered merging."""
        n, ranks = len(seg), self.ranks
        if n == 1:
            return [ranks[seg]]
        sym: list[bytes | None] = [seg[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get(seg[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            r, i = heappop(queue)
            a, j = sym[i], right[i]
            if a is None or j >= n:
                continue
            both = a + sym[j]
            if ranks.get(both) != r:  # stale: one of the two has grown since
                continue
            sym[i], sym[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(both + sym[k])) is not None:
                    heappush(queue, (r, i))
            if (h := left[i]) >= 0 and (r := ranks.get(sym[h] + both)) is not None:
                heappush(queue, (r, h))
        return [ranks[s] for s in sym if s is not None]

    def _piece(self, piece: str) -> bytes:
        b, together, segments = piece.encode("utf-8", "surrogatepass"), self._together, self._segments
        out, start = [], 0
        for i in range(1, len(b) + 1):
            if i == len(b) or not together[b[i - 1] << 8 | b[i]]:
                seg = b[start:i]
                ids = segments.get(seg)
                if ids is None:
                    if len(segments) >= MEMO_ENTRIES:
                        segments.clear()
                    ids = segments[seg] = np.array(self.merge(seg), np.int32).tobytes()
                out.append(ids)
                start = i
        return b"".join(out)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian int32; null and empty texts give none."""
        if not text:
            return b""
        memo, toks = self._pieces, pieces(text)
        try:
            return b"".join([memo[p] for p in toks])
        except KeyError:
            pass
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        out = []
        for p in toks:
            ids = memo.get(p)
            if ids is None:
                ids = memo[p] = self._piece(p)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids) -> str:
        return b"".join(self.strings[int(i)] for i in ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The encoder of ``path``, loaded once per worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def vocabulary_path(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> str:
    return os.path.join(directory, name)


_sent: set[tuple[str, str]] = set()


def _send(df: DataFrame, path: str) -> str:
    """Give the vocabulary file to every executor, once per application; its name there."""
    context = df.sparkSession.sparkContext
    if (context.applicationId, path) not in _sent:
        _sent.add((context.applicationId, path))
        context.addFile(path)
    return os.path.basename(path)


def _batches(key: str, text: str, name: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(SparkFiles.get(name))
        for batch in batches:
            coded = [bpe.encode_bytes(t) for t in batch.column(text).to_pylist()]
            lengths = np.fromiter((len(c) >> 2 for c in coded), np.int32, len(coded))
            if count_only:
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(lengths)], [key, "n_tokens"])
                continue
            # An Arrow list column has 32-bit offsets, which 2**31 ids would overrun; batches are far smaller.
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    return run


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, ids``: the token ids of every row's whole text.

    Null and empty texts give the empty list, an empty table an empty result;
    repeated rows give repeated rows; other columns are not read, so clashing
    names (``ids``) in the input do no harm.  No shuffle: rows stay where they
    were scanned.
    """
    kind = df.schema[key].dataType.simpleString()
    picked = spread(df.select(key, df[text].cast("string").alias("_text")))
    return picked.mapInArrow(_batches(key, "_text", _send(df, path or vocabulary_path()), False), f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, n_tokens`` of every row; 0 for null and empty texts."""
    kind = df.schema[key].dataType.simpleString()
    picked = spread(df.select(key, df[text].cast("string").alias("_text")))
    return picked.mapInArrow(_batches(key, "_text", _send(df, path or vocabulary_path()), True), f"`{key}` {kind}, n_tokens int")

"""Near-duplicate records with small edits: an LSH forest over character runs.

Every text becomes the set of its runs of consecutive letters and digits, and
that a signature of one-byte minhashes.  The forest consists of several sorted
orders of the signatures, each by its own selection of their bytes.  In a sorted
order a record's candidates are all others that agree in the first
``LEAST_DEPTH`` bytes, however many they are and however far away they stand, so
that a pair is found in a large family as surely as in a small one.  Candidates
that a second, independent part of the signature supports are then checked
exactly on their runs.

Exact copies (equal letters and digits) are one class with one signature; a hot
group of copies costs one row in the forest.  A crowded bucket of an order (many
different texts that agree so far) is cut into blocks, and every two blocks are
one group of bounded size that carries its texts: its pairs are counted exactly
by a product of matrices where they lie, so that neither a bucket nor a pair's
texts are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.operators.components import connected_components
from scholium.session import durable, spread

SIGNATURE, SKETCH = 128, 32
TREES, DEPTH, LEAST_DEPTH = 20, 12, 4
#: Share of equal sketch bytes that a candidate needs (the expected share is its similarity).
LEAST_SKETCH = 14 / 32
_BLOCK = 2_000_000
#: Candidate pairs that are held at once.
_PAIRS = 200_000
#: Rows, and letters, of a bucket from which on it is cut into blocks of about that size.
BLOCK_ROWS, BLOCK_LETTERS = 512, 2_000_000
#: Copies of one text that are joined to others, or to each other, in one task.
BLOCK_COPIES = 2_000
#: Rows that may be sent to every executor.
BROADCAST_ROWS = 200_000
_WORD = 2**64 - 1


@dataclass(frozen=True)
class Rule:
    """What makes two texts of a table near duplicates."""

    run: int
    least_letters: int
    similarity: float = 0.7
    bins: int = 32  # minhash values drawn from one hash of the runs


CHUNK_TEXT = Rule(run=5, least_letters=150, bins=32)
TITLE = Rule(run=3, least_letters=20, bins=2)


def letters(text: str) -> str:
    return "".join(filter(str.isalnum, text.lower()))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def run_hashes(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every run of every text, and the text of each."""
    p = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), n)
    if len(p) < run:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(p) - run + 1, np.uint64)
    for i in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + p[i : len(p) - run + 1 + i]
        h = h ^ (h >> np.uint64(31))
    inside = owner[: len(h)] == owner[run - 1 :]
    return _mix(h[inside]), owner[: len(h)][inside]


def signatures(texts: list[str], rule: Rule) -> np.ndarray:
    """``[text, SIGNATURE]`` bytes; of two texts each byte is equal with about the chance of their similarity."""
    h, owner = run_hashes(texts, rule.run)
    out = np.empty((len(texts), SIGNATURE), np.uint8)
    bins = rule.bins
    top = np.iinfo(np.uint64).max
    for k in range(SIGNATURE // bins):
        g = _mix(h + np.uint64(0xA0761D6478BD642F * (k + 1) & _WORD))
        cell = owner * bins + (g % np.uint64(bins)).astype(np.int64)
        least = np.full(len(texts) * bins, top, np.uint64)
        np.minimum.at(least, cell, g >> np.uint64(6))
        least = least.reshape(len(texts), bins)
        empty = least == top
        for turn in range(1, bins):  # an empty bin borrows from the next one that is not
            if not empty.any():
                break
            lent = np.roll(least, -turn, axis=1)
            use = empty & (lent != top)
            least[use] = lent[use] + np.uint64(0x9E3779B97F4A7C15 * turn & _WORD)
            empty &= ~use
        out[:, k * bins : (k + 1) * bins] = (_mix(least) & np.uint64(0xFF)).astype(np.uint8)
    return out


def _grouped(texts: list[str]) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= _BLOCK):
            size += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end


def _sketch(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [letters(t) for t in batch.column("_text").to_pylist()]
            keep = [i for i, t in enumerate(plain) if len(t) >= rule.least_letters]
            part = batch.take(pa.array(keep, pa.int64()))
            plain = [plain[i] for i in keep]
            sig: list[bytes] = []
            for s in _grouped(plain):
                sig += [r.tobytes() for r in signatures(plain[s], rule)]
            cls = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in plain]
            yield pa.RecordBatch.from_arrays(
                [part.column("rec_key"), part.column("loaded_at"), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(map(len, plain), pa.int64())],
                ["rec_key", "loaded_at", "cls", "sig", "size"],
            )

    return run


def _orders() -> np.ndarray:
    return np.stack([np.random.Generator(np.random.PCG64(t)).permutation(SIGNATURE - SKETCH)[:DEPTH] + SKETCH for t in range(TREES)])


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, SIGNATURE)


def _buckets(sig: np.ndarray) -> np.ndarray:
    """``[row, tree]``: the bucket of each row in each order, different from order to order."""
    tops = sig[:, _orders()[:, :LEAST_DEPTH]].astype(np.int64)
    return tops @ np.array([1 << 8 * i for i in range(LEAST_DEPTH)]) * TREES + np.arange(TREES)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, cls, size`` of every row in every order."""
    for batch in batches:
        if batch.num_rows:
            at = pa.array(np.repeat(np.arange(batch.num_rows), TREES))
            yield pa.RecordBatch.from_arrays([pa.array(_buckets(_bytes(batch)).ravel()), batch.column("cls").take(at), batch.column("size").take(at)], ["bucket", "cls", "size"])


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = _orders()
    for batch in batches:
        cls = batch.column("cls")
        n = len(cls)
        if not n:
            continue
        sig = _bytes(batch)
        sketch, buckets = pa.array([r.tobytes() for r in sig[:, :SKETCH]], pa.binary()), _buckets(sig)
        for t in range(TREES):
            order = np.empty((n, DEPTH + 1), np.uint8)
            order[:, 0], order[:, 1:] = t, sig[:, orders[t]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(buckets[:, t])), pa.array([r.tobytes() for r in order], pa.binary()), cls, sketch], ["bucket", "place", "cls", "sketch"]
            )


def _common(place: np.ndarray) -> np.ndarray:
    """Bytes in which each row of a sorted order agrees with the next; the first byte of a row is the tree."""
    same = place[:-1] == place[1:]
    return np.where(same.all(axis=1), place.shape[1], same.argmin(axis=1)) - 1


def _walk(place: np.ndarray, sketch: np.ndarray, old: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``neighbours`` in parts of about ``_PAIRS``, each pair once."""
    deep = _common(place) >= LEAST_DEPTH
    right, w = np.arange(max(old, 1), len(place)), 1
    held, size = [], 0
    while True:
        right = right[right >= w]
        right = right[deep[right - w]]
        if not len(right):
            break
        for k in range(0, len(right), _PAIRS):
            j = right[k : k + _PAIRS]
            j = j[np.count_nonzero(sketch[j] == sketch[j - w], axis=1) >= LEAST_SKETCH * SKETCH]
            held.append((j - w, j))
            size += len(j)
            if size >= _PAIRS or len(held) >= _PAIRS // 100:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        w += 1
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def neighbours(place: np.ndarray, sketch: np.ndarray, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a sorted order that agree deeply enough; those of the first ``old`` rows among themselves are known."""
    parts = list(_walk(place, sketch, old))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = map(np.concatenate, zip(*parts))
    return left, right


def _open_end(place: np.ndarray) -> int:
    """Rows at the end that may still pair with rows to come."""
    short = np.flatnonzero(_common(place)[::-1] < LEAST_DEPTH)
    return 1 + (int(short[0]) if len(short) else len(place) - 1)


def _harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.zeros((0, DEPTH + 1), np.uint8)
    sketch = np.zeros((0, SKETCH), np.uint8)
    cls: list[bytes] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        old = len(cls)
        place = np.concatenate([place, np.frombuffer(b"".join(batch.column("place").to_pylist()), np.uint8).reshape(-1, DEPTH + 1)])
        sketch = np.concatenate([sketch, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)])
        cls = cls + batch.column("cls").to_pylist()
        if len(cls) > 1:
            for a, b in _walk(place, sketch, old):
                found = [(x, y) if x < y else (y, x) for x, y in zip((cls[i] for i in a), (cls[i] for i in b))]
                if found:
                    xs, ys = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["a", "b"])
        keep = _open_end(place)
        place, sketch, cls = place[-keep:], sketch[-keep:], cls[-keep:]


def shares(left: list[str], right: list[str], run: int) -> np.ndarray:
    """Share of common runs among all different runs, of each text of ``left`` with that of ``right``."""
    n = len(left)
    h, owner = run_hashes(left + right, run)
    # A text's runs by 40 bits of their hash, each once; then the pair's runs, common ones twice.
    key = np.sort(owner.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    pair = (key >> np.uint64(40)).astype(np.int64) % max(n, 1)
    total = np.bincount(pair, minlength=n)
    key = np.sort(pair.astype(np.uint64) << np.uint64(40) | key & np.uint64((1 << 40) - 1))
    both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64), minlength=n)
    return both / np.maximum(total - both, 1)


def _verify(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([letters(t) for t in batch.column(c).to_pylist()] for c in ("text_a", "text_b"))
            share, at = np.zeros(len(left)), 0
            while at < len(left):
                end, size = at, 0
                while end < len(left) and (size == 0 or size + len(left[end]) + len(right[end]) <= _BLOCK):
                    size += len(left[end]) + len(right[end])
                    end += 1
                share[at:end] = shares(left[at:end], right[at:end], rule.run)
                at = end
            ok = pa.array(share >= rule.similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(share).filter(ok)], ["a", "b", "similarity"])

    return run


def _common_runs(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Common runs of every two of some texts, and the different runs of each."""
    h, owner = run_hashes(texts, run)
    words, word = np.unique(h, return_inverse=True)
    key = np.unique(owner * max(len(words), 1) + word)
    owner, word = key // max(len(words), 1), key % max(len(words), 1)
    size = np.bincount(owner, minlength=len(texts))
    often = np.bincount(word, minlength=len(words)) > 1
    place = np.cumsum(often) - 1
    keep = often[word]
    owner, word = owner[keep], place[word[keep]]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    common, slab = np.zeros((len(texts), len(texts)), np.float32), 4096
    for start in range(0, int(often.sum()), slab):
        a, b = np.searchsorted(word, (start, start + slab))
        x = np.zeros((len(texts), slab), np.float32)
        x[owner[a:b], word[a:b] - start] = 1
        common += x @ x.T
    return common, size


def _crowd(rule: Rule):
    """Exact pairs of two blocks of a crowded bucket that no earlier order has in one bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("cls")
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(table.num_rows, SIGNATURE)
        buckets, tree = _buckets(sig), int(table.column("bucket")[0].as_py() % TREES)
        side, own = table.column("side").to_numpy(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        new = np.triu(np.ones((len(sig), len(sig)), bool), 1)
        if not own:
            new &= side[:, None] != side[None, :]
        for t in range(tree):
            new &= buckets[:, t][:, None] != buckets[:, t][None, :]
        cls = table.column("cls")
        a = b = np.zeros(0, np.int64)
        share = np.zeros(0)
        if new.any():
            common, size = _common_runs([letters(t) for t in table.column("t").to_pylist()], rule.run)
            a, b = np.nonzero(new)
            both = common[a, b].astype(np.float64)
            share = both / np.maximum(size[a] + size[b] - both, 1)
            ok = share >= rule.similarity - 1e-12
            a, b, share = a[ok], b[ok], share[ok]
        return pa.table([cls.take(pa.array(a)), cls.take(pa.array(b)), pa.array(share)], ["a", "b", "similarity"])

    return run


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


_LINKS = "a binary, b binary, similarity double"


def similar_classes(df: DataFrame, key: str, text: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """``rec_key, cls`` of every record long enough, and ``a, b, similarity`` of every two similar classes.

    Of several deliveries of a key the first loaded counts, of ties the least
    class.  Null, empty and short texts belong to no class; repeated rows
    count once; an empty table gives empty results.
    """
    loaded = F.col("loaded_at").cast("timestamp_ntz") if "loaded_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("string").alias("rec_key"), loaded.alias("loaded_at"), F.col(text).cast("string").alias("_text")
    )
    sketched = durable(spread(rows).mapInArrow(_sketch(rule), "rec_key string, loaded_at timestamp_ntz, cls binary, sig binary, size long"))
    members = durable(sketched.groupBy("rec_key").agg(F.min(F.struct("loaded_at", "cls")).alias("m")).select("rec_key", "m.*"))
    # Copies are combined before the shuffle, so a hot class is a row from the start.
    spokesmen = durable(members.groupBy("cls").agg(F.min(F.struct("rec_key", "loaded_at")).alias("s")).select("cls", "s.*"))
    classes = durable(sketched.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("size").alias("size")).join(spokesmen, "cls", "left_semi"))
    places = classes.mapInArrow(_places, "bucket long, cls binary, size long")
    count = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_LETTERS)).cast("int")
    crowded = durable(count.where((F.col("n") > 1) & (blocks > 1)).select("bucket", blocks.alias("blocks")))
    forest = classes.mapInArrow(_plant, "bucket long, place binary, cls binary, sketch binary")
    any_crowd = crowded.limit(1).count() > 0
    if any_crowd:
        apart = F.broadcast(crowded) if _small(crowded) else crowded
        forest = forest.join(apart, "bucket", "left_anti")
    ordered = forest.repartition("bucket").sortWithinPartitions("place")
    candidates = durable(ordered.mapInArrow(_harvest, "a binary, b binary").distinct())
    ends = candidates.select(F.explode(F.array("a", "b")).alias("cls"))
    if any_crowd:
        held = durable(places.drop("size").join(apart, "bucket"))
        ends = ends.unionByName(held.select("cls"))
    texts = (
        spokesmen.join(ends.distinct(), "cls", "left_semi")
        .withColumnRenamed("loaded_at", "first_at")
        .join(rows, "rec_key")
        .where(F.col("first_at").eqNullSafe(F.col("loaded_at")))
        .groupBy("cls")
        .agg(F.min("_text").alias("t"))
    )
    texts = durable(texts)
    side = [texts.select(F.col("cls").alias(x), F.col("t").alias(f"text_{x}")) for x in "ab"]
    pairs = candidates.join(side[0], "a").join(side[1], "b").select("a", "b", "text_a", "text_b")
    linked = pairs.mapInArrow(_verify(rule), _LINKS)
    if any_crowd:
        own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        other = held.select("bucket", "cls", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
        blocked = other.select("bucket", "cls", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"))
        whole = blocked.join(classes.select("cls", "sig"), "cls").join(texts, "cls")
        crowd = whole.groupBy("bucket", "i", "j").applyInArrow(_crowd(rule), _LINKS)
        linked = linked.unionByName(crowd).dropDuplicates(["a", "b"])
    return members.select("rec_key", "cls"), durable(linked)


def _blocked(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cls, rec_key, block`` of every member, and ``cls, blocks`` of the classes with more than one block."""
    many = durable(members.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / BLOCK_COPIES).cast("int").alias("blocks")).where("blocks > 1"))
    sized = members.join(F.broadcast(many) if _small(many) else many, "cls", "left")
    return sized.select("cls", "rec_key", F.coalesce(F.pmod(F.xxhash64("rec_key"), F.col("blocks")).cast("int"), F.lit(0)).alias("block"), F.coalesce("blocks", F.lit(1)).alias("blocks")), many


def _over_blocks(df: DataFrame, many: DataFrame, cls: str, name: str) -> DataFrame:
    """``df`` once for every block of its class."""
    of = many.select(F.col("cls").alias(cls), F.col("blocks").alias("_n"))
    wide = df.join(F.broadcast(of) if _small(many) else of, cls, "left")
    return wide.withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n") - 1, F.lit(0))))).drop("_n")


def pairs(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """``key_a, key_b`` (as text, in order) of every two records that are similar, copies included."""
    members, linked = similar_classes(df, key, text, rule)
    held, many = _blocked(members)
    one = held.select(F.col("cls").alias("a"), F.col("block").alias("i"), F.col("rec_key").alias("x"))
    two = held.select(F.col("cls").alias("b"), F.col("block").alias("j"), F.col("rec_key").alias("y"))
    between = _over_blocks(linked.select("a", "b"), many, "a", "i").join(one, ["a", "i"])
    between = _over_blocks(between.select("b", "x"), many, "b", "j").join(two, ["b", "j"]).select("x", "y")
    # Copies: every two blocks of a class, and each block with itself, are a group of their own.
    left = held.select("cls", F.col("rec_key").alias("x"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = held.select("cls", F.col("rec_key").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    copies = left.join(right, ["cls", "i", "j"]).where("i < j or x < y").select("x", "y")
    return between.unionByName(copies).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def groups(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """``rec_key, group_id, n_links``: the least key of each record's group and its links to other texts' classes.

    Every record long enough has a row; copies share a class and its links.
    """
    members, linked = similar_classes(df, key, text, rule)
    spokesman = members.groupBy("cls").agg(F.min("rec_key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    a, b = (spokesman.select(F.col("cls").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("copies").alias(f"copies_{x}")) for x in "ab")
    edges = durable(linked.join(a, "a").join(b, "b").select("rep_a", "rep_b", "copies_a", "copies_b"))
    parts = connected_components(edges, "rep_a", "rep_b")
    n = edges.select(F.col("rep_a").alias("rep"), F.col("copies_b").alias("n")).union(edges.select("rep_b", "copies_a")).groupBy("rep").agg(F.sum("n").alias("n"))
    of_class = (
        spokesman.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .join(n, "rep", "left")
        .select("cls", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    held, many = _blocked(members)
    return held.join(_over_blocks(of_class, many, "cls", "block"), ["cls", "block"]).select("rec_key", "group_id", "n_links")


def found(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``rec_table, key_a, key_b`` of the similar chunks by text and documents by title."""
    both = [
        pairs(df, key, text, rule).select(F.lit(table).alias("rec_table"), "key_a", "key_b")
        for table, df, key, text, rule in (("chunks", chunks, "chunk_id", "text", CHUNK_TEXT), ("documents", documents, "doc_id", "title", TITLE))
    ]
    return both[0].unionByName(both[1])


def all_groups(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``rec_table, rec_key, group_id, n_links`` of chunks by text and documents by title."""
    both = [
        groups(df, key, text, rule).select(F.lit(table).alias("rec_table"), "rec_key", "group_id", "n_links")
        for table, df, key, text, rule in (("chunks", chunks, "chunk_id", "text", CHUNK_TEXT), ("documents", documents, "doc_id", "title", TITLE))
    ]
    return both[0].unionByName(both[1])

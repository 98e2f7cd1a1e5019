"""The forest against all pairs, copies, odd rows, and a long crowded region."""

import random

import numpy as np
import pyarrow as pa

from scholium.llm import neardup as N

RULE = N.Rule(run=5, least_letters=40, bins=8)


def runs(t, k=5):
    t = N.letters(t)
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def brute(items):
    keep = [(k, runs(t)) for k, t in items if t and len(N.letters(t)) >= 40]
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(keep) for b, y in keep[:i] if len(x & y) >= 0.7 * len(x | y)}


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(30)]
        out.append((f"k{i}", " ".join(w)))
        for j in range(rng.choice([0, 0, 1, 2])):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append((f"k{i}_{j}", " ".join(v)))
    return out


def test_against_all_pairs(spark):
    items = corpus(random.Random(5), 120)
    df = spark.createDataFrame([(k, t, 1) for k, t in items], "id string, text string, cls int")
    got = {(r.key_a, r.key_b) for r in N.pairs(df, "id", "text", RULE).collect()}
    want = brute(items)
    assert not got - want and len(got & want) >= 0.98 * len(want) and len(want) > 50


def test_crowds_and_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    monkeypatch.setattr(N, "BLOCK_COPIES", 3)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    base, items = [rng.choice(words) for _ in range(40)], []
    for i in range(150):  # one family of edited copies, some of them exact
        v = list(base)
        for j in rng.sample(range(40), i % 5):
            v[j] = rng.choice(words)
        items.append((f"f{i}", " ".join(v)))
    items += corpus(rng, 40)
    df = spark.createDataFrame(items, "id string, text string")
    got = [(r.key_a, r.key_b) for r in N.pairs(df, "id", "text", RULE).collect()]
    want = brute(items)
    assert len(got) == len(set(got)) and not set(got) - want and len(set(got) & want) >= 0.99 * len(want) and len(want) > 5_000
    links = {}
    for a, b in got:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert {r.rec_key: r.n_links for r in N.groups(df, "id", "text", RULE).collect()} == {k: links.get(k, 0) for k, _ in items}


def test_shares_against_sets():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(5, 80))) for _ in range(60)]
    left, right = texts[:30], texts[30:]
    want = [len(runs(a) & runs(b)) / len(runs(a) | runs(b)) for a, b in zip(left, right)]
    assert np.allclose(N.shares(left, right, 5), want)
    common, size = N._common_runs(texts, 5)
    assert all(common[i, j] == len(runs(a) & runs(b)) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j) and list(size) == [len(runs(t)) for t in texts]


def test_copies_and_groups(spark):
    base = "the quick brown fox jumps over the lazy dog and runs home again"
    items = [("a", base), ("b", base.upper() + "!!"), ("c", base + "s"), ("d", "something else entirely, with other words in every single place"), ("e", None), ("f", ""), ("g", "short"), ("a", base), (None, base)]
    df = spark.createDataFrame(items, "id string, text string")
    got = {(r.key_a, r.key_b) for r in N.pairs(df, "id", "text", RULE).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = {r.rec_key: (r.group_id, r.n_links) for r in N.groups(df, "id", "text", RULE).collect()}
    assert groups == {"a": ("a", 2), "b": ("a", 2), "c": ("a", 2), "d": ("d", 0)}
    assert N.pairs(df.limit(0), "id", "text", RULE).count() == 0 and N.groups(df.limit(0), "id", "text", RULE).count() == 0


def test_long_text(spark):
    long = " ".join(str(i * 7919) for i in range(60_000))
    df = spark.createDataFrame([("a", long), ("b", long + " tail")], "id string, text string")
    assert N.pairs(df, "id", "text", RULE).count() == 1


def test_signature_estimates_similarity():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefghijklmnop") for _ in range(600))
    b = a[:480] + "".join(rng.choice("qrstuvwxyz") for _ in range(120))
    s = N.signatures([a, b], N.CHUNK_TEXT)
    x, y = runs(a), runs(b)
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.2


def test_neighbours_across_batches_and_in_crowds():
    rng = np.random.default_rng(1)
    n = 900
    place = rng.integers(0, 2, (n, N.DEPTH + 1)).astype(np.uint8)
    place[:, 0], place[:400, 1:] = 0, 7  # a crowd that agrees at full depth
    order = np.lexsort(place.T[::-1])
    place, sketch = place[order], np.zeros((n, N.SKETCH), np.uint8)
    whole = set(zip(*map(list, N.neighbours(place, sketch))))
    crowd = np.flatnonzero((place[:, 1:] == 7).all(axis=1))
    assert len([1 for a, b in whole if a in set(crowd) and b in set(crowd)]) == 400 * 399 // 2
    pieces, start, at = set(), 0, 0
    while at < n:
        end = min(at + 100, n)
        a, b = N.neighbours(place[start:end], sketch[start:end], at - start)
        pieces |= {(int(x) + start, int(y) + start) for x, y in zip(a, b)}
        start = end - N._open_end(place[start:end])
        at = end
    assert pieces == {(int(a), int(b)) for a, b in whole}


def test_a_large_family_is_paired_whole():
    rng = np.random.default_rng(4)
    n = 1_200
    place = rng.integers(0, 256, (n, N.DEPTH + 1)).astype(np.uint8)
    place[:, 0], place[:, 1 : 1 + N.LEAST_DEPTH] = 0, 7  # edited copies: the first bytes agree, the others do not
    place, sketch = place[np.lexsort(place.T[::-1])], np.zeros((n, N.SKETCH), np.uint8)
    cls = [i.to_bytes(16, "big") for i in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[s : s + 500]], pa.binary()) for x in (place, sketch)] + [pa.array(cls[s : s + 500], pa.binary())], ["place", "sketch", "cls"]) for s in range(0, n, 500)]
    got = [p for b in N._harvest(iter(batches)) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    assert len(got) == len(set(got)) == n * (n - 1) // 2


def test_links_of_a_family_of_edited_copies():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    base, texts = [rng.choice(words) for _ in range(100)], []
    for _ in range(1_500):
        v = list(base)
        for i in rng.sample(range(len(v)), 5):
            v[i] = rng.choice(words)
        texts.append("".join(v))
    sig, found = N.signatures(texts, N.CHUNK_TEXT), set()
    for order in N._orders():
        place = np.concatenate([np.zeros((len(texts), 1), np.uint8), sig[:, order]], axis=1)
        at = np.lexsort(place.T[::-1])
        found |= {(min(a, b), max(a, b)) for a, b in zip(*(at[x].tolist() for x in N.neighbours(place[at], sig[at][:, : N.SKETCH])))}
    some = [sorted(rng.sample(range(len(texts)), 2)) for _ in range(4_000)]
    linked = [(a, b) for a, b in some if len(runs(texts[a]) & runs(texts[b])) >= 0.7 * len(runs(texts[a]) | runs(texts[b]))]
    assert len(linked) > 1_000 and len([p for p in linked if p in found]) >= 0.98 * len(linked)

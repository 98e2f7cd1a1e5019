"""Bounds, packings and exchange between partitions."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholium.llm import packing


def best(sizes, capacity):
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            if all(sum(s for s, w in zip(sizes, where) if w == k) <= capacity for k in range(n)):
                return n
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=6))
def test_bound_is_below_best_and_packing_above(sizes):
    where, load = packing.best_fit_decreasing(np.array(sizes, np.int64), 20)
    assert all(load <= 20) and sum(load) == sum(sizes)
    assert packing.lower_bound(np.array(sizes), 20) <= best(sizes, 20) <= len(load)


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([11] * 7), 20) == 7


def test_exchange_between_partitions(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 1, 300, 1700, 2100, 4096, 4097, 9000, None, rng.randint(1, 4096)])) for i in range(3000)]
    df = spark.createDataFrame(sizes, "item long, size int")
    rows = packing.pack(df, 4096, 300).collect()
    total = {}
    for r in rows:
        total.setdefault(r.item, []).append(r)
    want = {i: s for i, s in sizes if s}
    assert {i: sum(r.size for r in rs) for i, rs in total.items()} == want
    assert all(len(rs) == 1 or want[i] > 4096 for i, rs in total.items())
    held = {}
    for r in rows:
        held.setdefault(r.container_id, []).append(r)
    for rs in held.values():
        rs.sort(key=lambda r: r.position)
        assert [r.position for r in rs] == list(range(len(rs)))
        at = 0
        for r in rs:
            assert r.start == at
            at += r.size
        assert at <= 4096
    parts = np.array([r.size for r in rows])
    assert len(held) <= 1.02 * packing.lower_bound(parts)
    packed = packing.pack(df, 4096, 300).withColumnRenamed("size", "n_tokens")
    proof = {r.home: r for r in packing.certificates(packed).collect()}
    assert proof["all"].n_containers == len(held) and proof["all"].bound == packing.lower_bound(parts) and len(proof) > 2
    for home, r in proof.items():
        own = [x for x in rows if home == "all" or x.container_id.startswith(home + ":")]
        assert r.n_items == len(own) and r.bound == packing.lower_bound(np.array([x.size for x in own])) and r.gap == r.n_containers - r.bound >= 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)
    assert packing.pack(df.limit(0)).count() == 0


def test_documents(spark, data):
    from scholium.llm import queries

    p = queries.p8_containers(spark, data).cache()
    n = spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 0").count()
    assert p.select("doc_id").distinct().count() == n
    f = queries.p8_fill(spark, data).first()
    assert f.least_possible <= f.n_containers <= f.least_possible + 2 and p.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] <= 4096

"""Orphan references against a brute-force judge, and the odd cases."""

import random
from datetime import datetime, timedelta

from scholium.operators import orphans as O

T0 = datetime(2024, 1, 1)
EDGE = "edge_id string, subject_id string, object_id string, evidence_ids array<string>, loaded_at timestamp_ntz, reason string"
NODE = "node_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
REFS = [O.Reference("graph_edges", "edge_id", "subject_id", "graph_nodes"), O.Reference("graph_edges", "edge_id", "evidence_ids", "graph_nodes")]
KEYS = {"graph_nodes": "node_id"}


def judge(edges, nodes):
    first = {}
    for e in edges:
        if e[0] is not None and e[4] is not None:
            k = (e[4], str(e[1]), str(e[3]))
            if e[0] not in first or k < first[e[0]][0]:
                first[e[0]] = (k, e)
    out = set()
    clean = lambda x: (x or "").strip().lower()
    for _, e in first.values():
        for field, ids in (("subject_id", [e[1]]), ("evidence_ids", e[3] or [])):
            for i in {clean(i) for i in ids} - {""}:
                mine = [n for n in nodes if clean(n[0]) == i and n[1] is not None]
                seen = sorted((n[1], n[2] or datetime.min) for n in mine if n[1] <= e[4])
                if not mine:
                    why = "missing"
                elif not seen:
                    why = "late"
                elif seen[-1][1] != datetime.min and seen[-1][1] <= e[4]:
                    why = "deleted"
                else:
                    continue
                out.add(("graph_edges", e[0], field, i, why, e[4].strftime("%Y-%m")))
    return out


def found(spark, edges, nodes):
    t = {"graph_edges": spark.createDataFrame(edges, EDGE), "graph_nodes": spark.createDataFrame(nodes, NODE)}
    return [tuple(r) for r in O.orphans(t, KEYS, REFS).select("rec_table", "rec_id", "field_name", "ref_id", "reason", "period").collect()]


def counted(spark, edges, nodes):
    t = {"graph_edges": spark.createDataFrame(edges, EDGE), "graph_nodes": spark.createDataFrame(nodes, NODE)}
    return {(r.rec_table, r.field_name, r.period, r.reason): (r.n_refs, r.n_ids) for r in O.orphan_counts(t, KEYS, REFS).collect()}


def summed(judged):
    out = {}
    for table, _, field, ref, why, period in judged:
        out.setdefault((table, field, period, why), []).append(ref)
    return {k: (len(v), len(set(v))) for k, v in out.items()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "HEAVY_KEY_ROWS", 20)
    rng = random.Random(4)
    nodes = []
    for i in range(40):
        at = T0 + timedelta(days=rng.randint(0, 300))
        for _ in range(rng.choice([1, 1, 2, 3])):
            nodes.append((f"n{i}", at, at + timedelta(days=rng.randint(1, 60)) if rng.random() < 0.4 else None))
            at += timedelta(days=rng.randint(1, 120), seconds=rng.randint(1, 9))
    pick = lambda: rng.choice(["n0", "n0", " N0 ", f"n{rng.randint(0, 60)}", "", None])
    edges = []
    for i in range(300):
        e = (f"e{i}", pick(), None, [pick() for _ in range(rng.randint(0, 4))], T0 + timedelta(days=rng.randint(0, 400), seconds=rng.randint(1, 9)), "x")
        edges.append(e)
        if rng.random() < 0.1:
            edges.append((*e[:4], e[4] + timedelta(days=rng.choice([0, 9])), "y"))
    got = found(spark, edges, nodes)
    assert len(got) == len(set(got)) and set(got) == judge(edges, nodes)
    assert counted(spark, edges, nodes) == summed(got)


def test_odd_cases(spark):
    assert found(spark, [], []) == [] and counted(spark, [], []) == {}
    assert found(spark, [], [("a", T0, None)]) == []
    edges = [("e", None, None, None, T0, None), ("f", " ", None, ["A ", "a", None, ""], T0, "r"), (None, "z", None, ["z"], T0, "r"), ("g", "z", None, [], None, "r")]
    assert found(spark, edges, []) == [("graph_edges", "f", "evidence_ids", "a", "missing", "2024-01")]
    long = "x" * 100_000
    assert found(spark, [("h", long.upper(), None, [], T0, "r")], [])[0][3] == long


def test_many_heavy_keys_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(O, "HEAVY_KEY_ROWS", 1)
    monkeypatch.setattr(O, "BROADCAST_ROWS", 2)
    edges = [(f"e{i}", f"n{i % 9}", None, ["q"], T0, "r") for i in range(60)]
    nodes = [(f"n{i}", T0 + timedelta(days=i - 4), None) for i in range(7)]
    assert set(found(spark, edges, nodes)) == judge(edges, nodes)
    assert counted(spark, edges, nodes) == summed(judge(edges, nodes))

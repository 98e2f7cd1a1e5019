"""Stages, guards and rules on small tables with the odd cases."""

from pyspark.sql import functions as F

from scholium.functions import ids
from scholium.functions import text as T
from scholium.operators import graph as G
from scholium.operators import stages as S
from scholium.operators import stats


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tasks_and_redo(spark):
    books = spark.createDataFrame([("a", 3), ("b", None), (None, 2), ("c", 0)], "b string, n int")
    tasks = S.page_tasks(books, "b", "n", 2)
    assert rows(tasks) == [("a", 1, 1), ("a", 2, 0), ("a", 3, 1)]
    v = tasks.select("b", "page", F.lit("v1").alias("v"))
    done = spark.createDataFrame([("a", 1, "v1"), ("a", 2, "v0"), ("a", 1, "v1")], "b string, page int, v string")
    assert rows(S.not_current(v, done, ["b", "page"], "v")) == [("a", 2, "v1"), ("a", 3, "v1")]
    redo = spark.createDataFrame([("a", 1)], "b string, page int")
    assert len(rows(S.not_current(v, done, ["b", "page"], "v", redo))) == 3


def test_guards(spark):
    x, bad = S.guarded_number(F.col("c"), 0, 1)
    df = spark.createDataFrame([("0.5",), ("2",), ("x",), (None,), ("NaN",), ("1e0",)], "c string")
    assert [tuple(r) for r in df.select(x, bad).collect()] == [(0.5, ""), (None, "out_of_range"), (None, "not_a_number"), (None, "missing"), (None, "not_a_number"), (1.0, "")]
    why = S.denied(F.col("c"), [".env"], ["tmp/"], ["thumbs.db"])
    paths = spark.createDataFrame([("a\\b\\Thumbs.db",), ("tmp/x",), ("x/.env",), ("x/y",), (None,)], "c string")
    assert [r[0] for r in paths.select(why).collect()] == ["name", "prefix", "suffix", "", ""]
    assert [r[0] for r in spark.createDataFrame([(" ", "p"), ("o", "p"), (None, None)], "a string, b string").select(S.inherited(F.col("a"), F.col("b"))).collect()] == ["p", "o", None]
    gates = [F.col("g"), F.col("h")]
    cases = spark.createDataFrame([("passed", "failed", 1.0), ("passed", None, 1.0), ("passed", "passed", 0.8), ("passed", "passed", 0.6), ("passed", "passed", 0.1)], "g string, h string, s double")
    assert [r[0] for r in cases.select(S.tier(gates, F.col("s"), 0.75, 0.6)).collect()] == ["eliminated", "provisional", "high", "middle", "low"]


def test_sets_and_overrides(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(S.key_sets({"a": a, "b": b}, "k")) == [("a", 1), ("a+b", 1), ("b", 1)]
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, t string")
    side = base.select("k", F.lit("new").alias("n"), F.sha2(F.when(F.col("k") == 2, "old").otherwise(F.coalesce("t", F.lit(""))), 256).alias("h")).where("k < 3")
    assert rows(S.overridden(base, side, "k", "t", "n", "h")) == [(1, "new", "current"), (2, "y", "stale"), (3, None, "none")]
    forms = spark.createDataFrame([("A ", "t1"), ("a", "t2"), ("b", "t1"), (None, "t3"), ("", "t4")], "f string, t string")
    assert rows(S.collisions(forms, "f", "t")) == [("a", 2, "t1,t2")]
    q = spark.createDataFrame([("1", "c", "q", ["a", "a"]), ("1", None, " ", ["a"]), ("2", "c", "q", [])], "question_id string, category string, question string, expected array<string>")
    assert {r.code for r in S.question_issues(q).collect()} == {"expected_repeated", "category_missing", "question_empty", "question_id_repeated"}
    e = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "z"), (None, "a")], "s string, o string")
    assert rows(S.inside(e, ("s", "o"), spark.createDataFrame([("a",), ("b",)], "n string"), "n")) == [("a", "b")]


def test_shift_scenarios():
    got = dict(stats.scenarios({"a": 0.5, "b": 0.3, "c": 0.2}, shift=("a", "b", 0.1)))
    assert len(got) == 9 and all(abs(sum(w.values()) - 1) < 1e-12 for w in got.values()) and abs(got["a_to_b"]["a"] - 0.4) < 1e-12


def test_each_schema_rule(spark):
    schema = G.Schema({"Herb": "L5", "Book": "L1"}, {"IN": (["Herb"], ["Book"], ["E1"], ["explicit"], False), "SAME": ([], [], [], [], True)})
    nodes = spark.createDataFrame([("h", "Herb", "L5"), ("b", "Book", "L5"), ("x", "Odd", "L1"), ("n", None, None)], "node_id string, entity_type string, layer string")
    ev = spark.createDataFrame([("e1", "E1", "direct_ancient", '{"status": "approved"}', '{"pdf_page": 1}'), ("e2", "E1", "x", "broken", "{}"), ("e3", "E5", "direct_ancient", None, None)], "evidence_id string, evidence_grade string, evidence_class string, review string, locator string")
    edges = spark.createDataFrame(
        [("ok", "H ", "IN", "b", "E1", "explicit", "approved"), ("1", "b", "IN", "h", "E2", "inferred", "pending"), ("2", "h", "SAME", "b", "E1", "x", "approved"), ("3", "h", "NEW", "gone", None, None, None)],
        "edge_id string, subject_id string, predicate string, object_id string, evidence_grade string, assertion_mode string, review_status string",
    )
    got = {(r.record_id, r.code) for r in G.schema_issues(schema, nodes, ev, edges).collect()}
    assert got == {
        ("b", "node_layer_mismatch"), ("x", "unknown_entity_type"), ("n", "unknown_entity_type"), ("e2", "e1_page_locator_missing"), ("e2", "evidence_not_approved"), ("e3", "evidence_not_approved"), ("e3", "direct_ancient_grade_invalid"),
        ("1", "predicate_source_type_invalid"), ("1", "predicate_target_type_invalid"), ("1", "predicate_grade_invalid"), ("1", "predicate_mode_invalid"), ("1", "edge_not_approved"), ("2", "predicate_same_type_required"), ("3", "unknown_predicate"), ("3", "edge_not_approved"),
    }
    assert {r.severity for r in G.schema_issues(schema, nodes, ev, edges, release=True).where("code like '%not_approved'").collect()} == {"error"}
    assert G.schema_issues(schema, nodes.limit(0), ev.limit(0), edges.limit(0)).count() == 0


def test_ids_and_forms(spark):
    df = spark.createDataFrame([("S", "IN", "O", ["b", "a", "b"], "explicit"), ("S", "IN", "O", ["a", "b"], "explicit")], "s string, p string, o string, e array<string>, m string")
    one, two = (r[0] for r in df.select(ids.edge_id("s", "p", "o", "e", "m")).collect())
    assert one == two and one.startswith("kg:assertion:") and len(one) == 37
    names = spark.createDataFrame([("Ｈerb  x",), ("herb X",), (None,)], "n string")
    got = [r[0] for r in names.select(ids.node_id(F.lit("Herb"), "n")).collect()]
    assert got[0] == got[1] != got[2] and got[0].startswith("kg:herb:")
    assert spark.range(1).select(T.work_title(F.lit("12_Book of burns (part 2).pdf")), T.graph_key(F.lit(" Straße ")), T.labels(F.lit("a"), F.lit(None), F.lit(" b"))).first() == ("Book of burns", "strasse", "a;b")
    q = spark.createDataFrame([("a b", "x a b"), ("a  b", "xa b"), ("z", "a"), (" ", "a"), (None, None)], "q string, t string")
    assert [r[0] for r in q.select(T.quote_match(F.col("q"), F.col("t"))).collect()] == ["exact", "normalized_whitespace", "missing", "no_quote", "no_quote"]
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "p string, h string")
    assert ids.folder_fingerprint(files, "p", "h").first() == ids.folder_fingerprint(files.orderBy("p"), "p", "h").first()
    long = spark.createDataFrame([("x" * 300 + " needle " + "y" * 300,), ("none",)], "t string").select(T.around("t", ["needle"], 20)).collect()
    assert "needle" in long[0][0] and len(long[0][0]) < 60 and long[1][0] is None

"""Sources, sinks and incremental ingest."""

import json

import pytest
from pyspark.sql import functions as F

from scholium import cli
from scholium.sinks import writers
from scholium.sources import readers
from scholium.streaming import ingest


def test_records_tolerate_broken_lines_and_no_file(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\nbroken\n{"a": 2}\n')
    assert readers.records(spark, str(p), "a int, b string").count() == 2
    assert readers.records(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_mapping_last_wins(spark, tmp_path):
    (tmp_path / "m.csv").write_text("new,orig,title\nn1,o1,one\nn2,o1,two\n")
    got = {r.name: r.title for r in readers.mapping(spark, str(tmp_path / "m.csv"), ["new", "orig"], "new string, orig string, title string").collect()}
    assert got == {"n1": "one", "n2": "two", "o1": "two"}


def test_pages_of_files_with_fallback(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first page with some words\fsecond")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe broken")

    def refuses(content):
        raise ValueError("cannot read")

    got = {(r.path.rsplit("/", 1)[1], r.page_no): r for r in readers.file_pages(spark, str(tmp_path), [refuses, readers.text_engine], "*.txt").collect()}
    assert got["a.txt", 1].status == "ok" and got["a.txt", 2].is_empty and got["a.txt", 1].engine == 1
    assert got["b.txt", None].status == "failed"
    assert readers.files(spark, str(tmp_path), "*.txt").count() == 2


def test_anchored_pages(spark, tmp_path):
    (tmp_path / "t.txt").write_text("#+TITLE: x\n<pb:K_WYG_001>上 文¶下<pb:K_OTHER_1>同頁\n<pb:K_WYG_002>終")
    got = readers.anchored_pages(spark, str(tmp_path / "t.txt"), "WYG").orderBy("n").collect()
    assert [(r.anchor, r.text) for r in got] == [("K_WYG_001", "上文\n下同頁"), ("K_WYG_002", "終")]
    (tmp_path / "u.txt").write_text("<pb:K_WYG_1>a<pb:K_WYG_1>b")
    with pytest.raises(Exception, match="anchor comes twice"):
        readers.anchored_pages(spark, str(tmp_path / "u.txt"), "WYG").collect()


def test_boxes(spark):
    good = json.dumps({"rec_texts": ["a", " "], "rec_scores": [0.9, 0.1], "rec_polys": [[[1, 2], [5, 2], [5, 9], [1, 9]], [[0, 0]]]})
    got = spark.createDataFrame([(good,), ("{broken",), (None,)], "p string").select(readers.boxes(F.col("p")).alias("b")).collect()
    assert [len(r.b) for r in got] == [1, 0, 0] and (got[0].b[0].x1, got[0].b[0].y2) == (1.0, 9.0)


def test_bundle(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"sources": [{"key": "s"}], "entities": [{"key": "e", "name": "n"},\n {"key": "f"}]}')
    got = readers.bundle(spark, str(tmp_path / "b.json"), {"sources": "struct<key:string>", "entities": "struct<key:string, name:string>"})
    assert got["sources"].count() == 1 and {r.key for r in got["entities"].collect()} == {"e", "f"}


def test_graph_round_trip_and_tampering(spark, tmp_path):
    nodes = spark.createDataFrame([("a", ["x"]), ("b", None)], "node_id string, aliases array<string>")
    path = str(tmp_path / "g")
    writers.graph({"nodes": nodes}, path, {"version": 1})
    assert writers.load_graph(spark, path, {"nodes": nodes.schema})["nodes"].count() == 2
    with pytest.raises(Exception):
        writers.graph({"nodes": nodes}, path, {})
    nodes.limit(1).write.mode("append").json(f"{path}/nodes")
    with pytest.raises(ValueError):
        writers.load_graph(spark, path, {"nodes": nodes.schema})


def test_csv_publish_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], 'q"x')], "k string, v array<int>, t string")
    writers.flat_csv(df, str(tmp_path / "staged"))
    writers.publish(spark, str(tmp_path / "staged"), str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()
    assert got.v == "[1,2]" and got.t == 'q"x' and not (tmp_path / "staged").exists()
    writers.linked_data({"Node": (df, "k")}, str(tmp_path / "ld"))
    assert json.loads(spark.read.text(str(tmp_path / "ld")).first().value)["@id"] == "a"


def test_incremental_ingest(spark, tmp_path):
    src, target, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n')
    run = lambda: ingest.ingest(spark, str(src), "k string, v int", check, target, lambda d: d, "k")
    assert run() == 2 and run() == 0
    (src / "2.json").write_text('{"k": "b", "v": 9}\n{"k": "c", "v": 3}\n')
    assert run() == 1
    assert {r.k for r in spark.read.parquet(target).collect()} == {"a", "b", "c"}
    assert ingest.changed(spark, "f1", str(tmp_path / "print"))
    ingest.remember(spark, "f1", str(tmp_path / "print"))
    assert not ingest.changed(spark, "f1", str(tmp_path / "print"))


def test_cli(spark, data, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "p1_found" in capsys.readouterr().out
    assert cli.main(["run", "ret_point_lookup", data, str(tmp_path / "o"), "--format", "json"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["show", "no_such_query", data])


def test_an_anchor_in_two_files(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text("<pb:K_WYG_1-1a>text")
    with pytest.raises(Exception, match="anchor comes twice"):
        readers.anchored_pages(spark, str(tmp_path), "WYG").collect()

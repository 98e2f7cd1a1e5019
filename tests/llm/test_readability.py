"""Bands of passages that the grades were not fitted on, and odd rows."""

import random

from scholium.llm import readability as R


def test_held_out_passages(spark, data):
    rows = [(r.lang, r.band, r.text) for r in spark.read.parquet(f"{data}/graded_passages.parquet").orderBy("passage_id").collect()]
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    right = 0
    for f in range(4):
        test = set(order[f::4])
        grades = R.fit([rows[i] for i in order if i not in test])
        right += sum(grades[rows[i][0]].band(rows[i][2]) == rows[i][1] for i in test)
    assert right >= 0.95 * len(rows)


def test_rows(spark, data):
    docs, passages = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/graded_passages.parquet")
    got = R.found(docs, passages).collect()
    assert len(got) == len({r.doc_id for r in got}) > 50 and {r.band for r in got} <= {1, 2, 3, 4}
    lang = {r.doc_id: r.lang for r in R.reading_bands(docs, passages).where("band is not null").collect()}
    assert set(lang.values()) == {"en", "zh"}
    assert R.found(docs.limit(0), passages).count() == 0
    assert R.found(docs, passages.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "短", 3), (4, "qqq zzz " * 100, 3)], "doc_id long, text string, band int")
    assert R.found(docs.select("doc_id", "text", "language").unionByName(odd.drop("band"), True), passages).where("doc_id < 10").count() == 0


def test_quantiles():
    import numpy as np

    assert R.quantiles(np.zeros(61)) is None
    h = np.zeros(61, int)
    h[20] = 10
    assert R.quantiles(h).tolist() == [2.0] * 5

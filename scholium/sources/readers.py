"""Reading the file formats of a corpus: records, mappings, pages, transcriptions, boxes, nested bundles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from scholium.operators.quality import union


def records(spark: SparkSession, path: str, schema: str | S.StructType, tolerant: bool = True) -> DataFrame:
    """One JSON object per line; a line that is none is dropped if ``tolerant``, an error otherwise.  No file is no row."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if "*" not in path and not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def mapping(spark: SparkSession, path: str, names: list[str], schema: str) -> DataFrame:
    """A CSV keyed by several columns: ``name`` and the row, for each key column; the last row of a name wins."""
    rows = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8").withColumn("_n", F.monotonically_increasing_id())
    first = rows.columns[0]
    rows = rows.withColumnRenamed(first, first.lstrip("﻿"))
    keyed = union([rows.withColumn("name", F.trim(F.col(c))) for c in names]).where("name is not null and name <> ''")
    last = Window.partitionBy("name").orderBy(F.desc("_n"))
    return keyed.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_n")


def files(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """``path, length, sha256, name``: the files of a directory, each name once whatever its letter case."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = found.select("path", "length", F.sha2("content", 256).alias("sha256"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return rows.groupBy(F.lower("name").alias("_k")).agg(F.min_by(F.struct("*"), "path").alias("r")).select("r.*")


#: An engine takes a file's bytes and yields ``(page number, label, text)``; it may raise.
Engine = Callable[[bytes], Iterator[tuple[int, str | None, str]]]


def file_pages(spark: SparkSession, path: str, engines: list[Engine], pattern: str = "*.{pdf,PDF}", empty_below: int = 20) -> DataFrame:
    """``path, sha256, page_no, page_label, text, is_empty, engine, status`` of every page.

    Engines are tried in turn on a file; the first that reads it counts.  A
    file that none can read has one row with status ``failed`` and no page.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, sha, content in zip(*(batch.column(c).to_pylist() for c in ("path", "sha256", "content"))):
                for k, engine in enumerate(engines):
                    try:
                        pages = [(n, label, text or "") for n, label, text in engine(content)]
                    except Exception:
                        continue
                    out += [(p, sha, n, label, text, len(text.strip()) < empty_below, k, "ok") for n, label, text in pages] or [(p, sha, None, None, None, None, k, "empty")]
                    break
                else:
                    out.append((p, sha, None, None, None, None, None, "failed"))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()]
            names = ["path", "sha256", "page_no", "page_label", "text", "is_empty", "engine", "status"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(
        go, "path string, sha256 string, page_no int, page_label string, text string, is_empty boolean, engine int, status string"
    )


def text_engine(content: bytes) -> Iterator[tuple[int, str | None, str]]:
    """Pages of a plain text, parted by form feeds."""
    for n, page in enumerate(content.decode("utf-8").split("\f"), 1):
        yield n, None, page


# The anchor of a page in a transcription and its org-mode lines.
ANCHOR = r"<pb:([^>]+)>"
ORG_LINE = r"(?m)^#.*(?:\n|$)"


def transcription(c: Column) -> Column:
    """A transcription's text without anchors, org-mode lines, blanks and empty lines; a pilcrow ends a line."""
    x = F.regexp_replace(F.regexp_replace(c, ORG_LINE, ""), ANCHOR, "")
    x = F.regexp_replace(F.regexp_replace(x, "\r\n?|¶", "\n"), r"[ \t　]+", "")
    return F.regexp_replace(F.regexp_replace(x, r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def quality_of_text(c: Column) -> Column:
    """Confidence in a transcribed page: half for its anchor, then ideographs, length and unbroken characters."""
    visible = F.length(F.regexp_replace(c, r"\s", ""))
    cjk = F.regexp_count(c, F.lit(r"[㐀-䶿一-鿿]"))
    semantic = F.length(F.regexp_replace(c, r"[\s\p{P}\p{S}]", ""))
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(cjk.cast("double"), semantic), F.lit(0.0)))
    bad = F.regexp_count(c, F.lit(r"[\x{FFFD}\x00-\x08\x0E-\x1B]"))
    whole = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(bad.cast("double"), visible), F.lit(0.0)) * 20)
    score = 0.5 + 0.25 * share + 0.15 * F.least(F.lit(1.0), visible / 40.0) + 0.10 * whole
    return F.when(visible == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 6))


def anchored_pages(spark: SparkSession, path: str, edition: str) -> DataFrame:
    """``file, anchor, n, text, confidence``: transcriptions cut at the page anchors of one edition; an anchor that comes twice, in one file or in two, is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    mark = f"<pb:([^>]*_{edition}_[^>]*)>"
    anchors = F.regexp_extract_all("raw", F.lit(mark), F.lit(1))
    parts = F.slice(F.split("raw", mark), 2, F.size(anchors))
    pages = raw.select("file", F.posexplode(F.arrays_zip(anchors.alias("a"), parts.alias("t"))).alias("n", "x"))
    text = transcription(F.col("x.t"))
    out = pages.select("file", F.col("x.a").alias("anchor"), "n", text.alias("text"), quality_of_text(text).alias("confidence"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("anchor"))
    return out.withColumn("anchor", F.when(twice > 1, F.raise_error(F.concat(F.lit("anchor comes twice: "), "anchor"))).otherwise(F.col("anchor")))


def boxes(c: Column) -> Column:
    """Recognised text from a JSON payload with parallel arrays: an array of (text, score, x1, y1, x2, y2); blanks are left out.

    The arrays may be called ``rec_texts``/``rec_scores``/``rec_polys`` or
    ``texts``/``scores``/``polygons``; broken JSON gives the empty array.
    """
    shape = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>,texts:array<string>,scores:array<double>,polygons:array<array<array<double>>>>"
    p = F.from_json(c, shape)
    texts, scores = F.coalesce(p["rec_texts"], p["texts"]), F.coalesce(p["rec_scores"], p["scores"])
    polys = F.coalesce(p["rec_polys"], p["polygons"])
    side = lambda q, i: F.transform(q, lambda v: v[i])
    box = F.transform(
        F.arrays_zip(texts.alias("t"), scores.alias("s"), polys.alias("q")),
        lambda x: F.struct(
            x["t"].alias("text"), x["s"].alias("score"), F.array_min(side(x["q"], 0)).alias("x1"), F.array_min(side(x["q"], 1)).alias("y1"), F.array_max(side(x["q"], 0)).alias("x2"), F.array_max(side(x["q"], 1)).alias("y2"),
        ),
    )
    return F.coalesce(F.filter(box, lambda b: F.trim(b["text"]) != ""), F.array().cast("array<struct<text:string,score:double,x1:double,y1:double,x2:double,y2:double>>"))


def bundle(spark: SparkSession, path: str, sections: dict[str, str]) -> dict[str, DataFrame]:
    """The lists of a nested JSON document as tables; ``sections`` gives each one's element type."""
    schema = ", ".join(f"{n} array<{t}>" for n, t in sections.items())
    whole = spark.read.schema(schema).json(path, multiLine=True)
    return {n: whole.select(F.explode(n).alias("x")).select("x.*") for n in sections}

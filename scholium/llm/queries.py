"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholium.llm import bpe, language, neardup, ocr, packing, readability, split, unicode_forms
from scholium.session import durable, read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.found(read_table(spark, d, "pages"), read_table(spark, d, "books"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repaired(read_table(spark, d, "pages"), read_table(spark, d, "books"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(*(read_table(spark, d, t) for t in ("documents", "chunks", "pages")))


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = language.identify(*(read_table(spark, d, t) for t in ("documents", "chunks", "pages")))
    return rows.select("rec_table", "rec_key", "part_no", "lang", "confidence").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_items(split.oversized(read_table(spark, d, "chunks")), ["chunk_id"], "text")
    return pieces.where("piece_no > 0").select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_chunks(read_table(spark, d, "chunks"), read_table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(read_table(spark, d, "chunks"), read_table(spark, d, "documents"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_groups(read_table(spark, d, "chunks"), read_table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unicode_forms.found(read_table(spark, d, "chunks"), read_table(spark, d, "pages"))


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    return unicode_forms.canonical(read_table(spark, d, "chunks"), read_table(spark, d, "pages"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(read_table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(durable(packing.pack_documents(read_table(spark, d, "documents"))))


def p8_certificates(spark: SparkSession, d: str) -> DataFrame:
    return packing.certificates(durable(packing.pack_documents(read_table(spark, d, "documents"))))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return readability.found(read_table(spark, d, "documents"), read_table(spark, d, "graded_passages"))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    bands = readability.reading_bands(read_table(spark, d, "documents"), read_table(spark, d, "graded_passages"))
    return bands.distinct().groupBy("lang", "band").count().withColumnRenamed("count", "n_documents")


QUERIES = {
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_languages": p3_languages,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_canonical": p6_canonical,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_certificates": p8_certificates,
    "p9_found": p9_found,
    "p9_profile": p9_profile,
}
_NOT_PLAIN = unicode_forms.patterns()["found"].replace("'", "''")
SQL = {
    "p4_found": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND length(text) > 1500",
    "p6_found": f"""SELECT DISTINCT 'chunks' AS rec_table, chunk_id AS rec_key FROM chunks WHERE chunk_id IS NOT NULL AND regexp_matches(normalized_text, '{_NOT_PLAIN}')
      UNION ALL SELECT DISTINCT 'pages', page_id FROM pages WHERE page_id IS NOT NULL AND regexp_matches(text, '{_NOT_PLAIN}')""",
}

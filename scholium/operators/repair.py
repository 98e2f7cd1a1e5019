"""Repair of document records: identifiers, identity, language, title, with what was changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import ids
from scholium.functions import text as T


def repaired(docs: DataFrame, key: str) -> DataFrame:
    """``key, doi, doi_status, stable_id, language, title, changes``.

    The identifier is the declared one if valid, else the first valid one in
    the text; an identifier that several files share identifies none of them,
    so these go by their hash.  A missing title is the text's first line.
    """
    in_text = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), r"(10\.\d{4,9}/[-._;()/:a-z0-9]+[a-z0-9])", 1)
    declared = ids.normalize_doi("doi")
    doi = F.when(ids.doi_problem("doi") == "", declared).when((in_text != "") & (ids.doi_problem(in_text) == ""), in_text).otherwise("")
    x = docs.select(key, declared.alias("declared"), doi.alias("doi"), F.lower("sha256").alias("sha"), "language", "title", T.language_class("text").alias("found_language"), T.section_hint("text").alias("first_line"))
    # Only real identifiers are grouped; the many records without one never meet.
    shared = x.where("doi <> ''").groupBy("doi").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("doi", F.lit(True).alias("shared"))
    x = x.join(shared, "doi", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    language = F.when(F.col("found_language") != "", F.col("found_language")).otherwise(F.coalesce("language", F.lit("")))
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(F.col("first_line"))
    status = F.when(F.col("doi") == "", "missing").when(F.col("shared"), "shared").otherwise("valid")
    changes = F.array_compact(
        F.array(
            F.when(F.col("doi") != F.col("declared"), F.lit("doi")),
            F.when(language != F.coalesce("language", F.lit("")), F.lit("language")),
            F.when(~title.eqNullSafe(F.col("title")), F.lit("title")),
        )
    )
    stable = F.when(status == "valid", F.concat(F.lit("doi:"), "doi")).otherwise(F.concat(F.lit("sha256:"), "sha"))
    return x.select(key, "doi", status.alias("doi_status"), stable.alias("stable_id"), language.alias("language"), title.alias("title"), F.array_join(changes, ",").alias("changes"))

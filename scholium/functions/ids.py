"""Content-derived identifiers and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T

# Syntax of digital object identifiers and the prefixes with a known form.
DOI = r"^10\.\d{4,9}/[-._;()/:a-z0-9]+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_doi(c: Column | str) -> Column:
    """Without resolver and final dots, in lower case; empty for null."""
    x = F.regexp_replace(F.trim(F.coalesce(_c(c), F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(F.regexp_replace(F.trim(x), r"\.+$", ""))


def doi_problem(c: Column | str) -> Column:
    """``missing``, ``syntax_invalid``, ``suffix_too_short``, ``publisher_pattern_incomplete`` or empty."""
    d = normalize_doi(c)
    suffix = F.regexp_extract(d, r"^[^/]+/(.*)$", 1)
    incomplete = (
        (d.startswith("10.1371/") & ~d.rlike(r"^10\.1371/journal\.[a-z0-9]+\.\d+$"))
        | (d.startswith("10.2147/") & ~suffix.contains("."))
        | (d.startswith("10.3390/") & ~suffix.rlike(r"\d"))
        | (d.startswith("10.1016/") & suffix.startswith("j.") & (F.regexp_count(suffix, F.lit(r"\.")) < 2))
    )
    return (
        F.when(d == "", "missing")
        .when(~d.rlike(DOI), "syntax_invalid")
        .when(F.length(suffix) < 4, "suffix_too_short")
        .when(incomplete, "publisher_pattern_incomplete")
        .otherwise("")
    )


def document_id(doi: Column | str, sha256: Column | str) -> Column:
    """``doi:`` and the identifier if it is valid, else ``sha256:`` and the file's hash; null without either."""
    return F.when(doi_problem(doi) == "", F.concat(F.lit("doi:"), normalize_doi(doi))).otherwise(F.concat(F.lit("sha256:"), F.lower(_c(sha256))))


def chunk_id(document: Column | str, page: Column | str, index: Column | str) -> Column:
    raw = F.concat(_c(document), F.lit("|p"), _c(page).cast("string"), F.lit("|c"), _c(index).cast("string"))
    return F.concat(F.substring(F.sha2(raw, 256), 1, 24), F.format_string("_p%04d_c%03d", _c(page), _c(index)))


def book_id(sha256: Column | str) -> Column:
    return F.concat(F.lit("ancient:"), F.substring(_c(sha256), 1, 20))


def page_id(book: Column | str, page: Column | str) -> Column:
    return F.concat(_c(book), F.format_string(":p%06d", _c(page)))


def canonical_json(**fields: Column) -> Column:
    """A compact object with its keys in order; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(namespace: str, body: Column) -> Column:
    """24 hex digits of a namespace and a canonical text."""
    return F.substring(F.sha2(F.concat(F.lit(namespace + "\n"), body), 256), 1, 24)


def source_id(source_type: Column | str, title: Column | str, file_sha256: Column | str, doi: Column | str, work: Column | str, edition: Column | str) -> Column:
    parts = {"source_type": source_type, "title": title, "file_sha256": file_sha256, "doi": doi, "work_id": work, "edition_id": edition}
    return F.concat(F.lit("kg:source:"), digest("source", canonical_json(**{k: T.graph_key(v) for k, v in parts.items()})))


def node_id(entity_type: Column | str, name: Column | str, namespace: str = "graph", **identity: Column) -> Column:
    """Of a type, a name and whatever else tells nodes of one name apart (a composition's fingerprint, a place)."""
    kind = _c(entity_type)
    body = canonical_json(entity_type=kind, namespace=T.graph_key(F.lit(namespace)), canonical_name=T.graph_key(name), **identity)
    return F.concat(F.lit("kg:"), F.lower(kind), F.lit(":"), F.substring(F.sha2(F.concat(F.lit("node:"), kind, F.lit("\n"), body), 256), 1, 24))


def evidence_id(source: Column | str, locator: Column | str, quote_sha256: Column | str) -> Column:
    """``locator`` is an object's text and is taken as it stands, so it must be canonical."""
    body = F.concat(F.lit('{"locator":'), F.coalesce(_c(locator), F.lit("{}")), F.lit(","), F.substring(canonical_json(quote_sha256=_c(quote_sha256), source_id=_c(source)), 2, 1 << 30))
    return F.concat(F.lit("kg:evidence:"), digest("evidence", body))


def edge_id(subject: Column | str, predicate: Column | str, object_: Column | str, evidence: Column | str, mode: Column | str) -> Column:
    """The order and repetition of the evidence do not count."""
    parts = {"subject_id": _c(subject), "predicate": _c(predicate), "object_id": _c(object_), "assertion_mode": _c(mode)}
    return F.concat(F.lit("kg:assertion:"), digest("edge", canonical_json(evidence_ids=F.array_sort(F.array_distinct(_c(evidence))), **parts)))


def normalized_composition(items: Column) -> Column:
    """An array of ingredients (name, value, unit, processing, role) with its texts in one form, in order."""
    fields = ("name", "value", "unit", "processing", "role")
    return F.array_sort(F.transform(items, lambda x: F.struct(*[T.graph_key(x[f].cast("string")).alias(f) for f in fields])))


def folder_fingerprint(files: DataFrame, path: str, sha256: str) -> DataFrame:
    """``fingerprint`` of a folder's files (paths and hashes) in the order of their paths; a folder has few files."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(sha256).alias("h"))))
    return files.agg(F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(F.length(x["p"]).cast("string"), F.lit(":"), x["p"], F.lit(":"), x["h"])), "\n"), 256).alias("fingerprint"))


def composition_fingerprint(items: Column) -> Column:
    """Hash of an array of structs as a multiset: the order does not count."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: F.to_json(x))), "\n"), 256)


def year_in_name(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^((?:19|20)\d{2})[_-]", 1)

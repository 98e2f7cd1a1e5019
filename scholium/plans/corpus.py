"""Queries over documents, chunks and pages: text, identifiers, quality, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions import ids, numeric
from scholium.functions import text as T
from scholium.operators import chunking, embedding, formula, layout, matching, quality, repair, sequences, stats, topics, vectors
from scholium.operators.topics import Topic
from scholium.plans.common import CJK, once, sql_list, sql_once
from scholium.session import read_table

_N = "coalesce(text, '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def txt_char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """How often each ideograph and pair of ideographs stands in the titles."""
    grams = _docs(spark, d).select(F.explode(T.char_ngrams("title")).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def txt_language_class(spark: SparkSession, d: str) -> DataFrame:
    """Language of each chunk by its shares of scripts."""
    return once(read_table(spark, d, "chunks"), "chunk_id", "text").select("chunk_id", T.language_class("text").alias("language_class"))


def _sql_class(cjk: str, latin: str) -> str:
    r = f"({cjk} / nullif({cjk} + {latin}, 0))"
    return f"""CASE WHEN {cjk} + {latin} = 0 THEN '' WHEN {cjk} >= 50 AND {latin} >= 50 AND {r} >= 0.10 AND {r} <= 0.70 THEN 'mixed' WHEN {cjk} >= 20 AND {r} >= 0.20 THEN 'zh'
      WHEN {cjk} >= 20 AND {latin} >= 20 AND {r} >= 0.05 THEN 'mixed' WHEN {latin} > 0 THEN 'en' ELSE 'zh' END"""


def txt_document_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of each book from the summed counts of its pages."""
    pages = once(read_table(spark, d, "pages"), "page_id", "book_id", "text")
    counts = pages.groupBy("book_id").agg(F.sum(T.count("text", T.CJK)).alias("cjk"), F.sum(T.count("text", "[A-Za-z]")).alias("latin"))
    return counts.select("book_id", "cjk", "latin", T.language_of_counts(F.col("cjk"), F.col("latin")).alias("language_class"))


def txt_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text cleaned, by length and hash."""
    clean = T.clean_page("text")
    return _docs(spark, d).select("doc_id", clean.alias("c")).select("doc_id", F.length("c").alias("n_chars_clean"), F.sha2("c", 256).alias("clean_sha256"))


_SQL_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(coalesce(text, ''), chr(0), ''), '\\r\\n?', chr(10), 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(173), ''), "
    "'[ \\t\\f\\v]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '-\\n([A-Za-z])', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
)


def txt_measures(spark: SparkSession, d: str) -> DataFrame:
    """Words, ideographs, share of broken characters and first line of each document."""
    return _docs(spark, d).select(
        "doc_id", T.count_words("text").alias("n_words"), T.count("text", T.CJK).alias("n_ideographs"), F.round(T.garbled_share("text"), 6).alias("garbled_share"), T.section_hint("text").alias("section_hint")
    )


#: Topics of the query: what this collection's documents are about, by words of its languages.
TOPICS = [
    Topic("dressings", 15, ("dressing", "gauze", "敷料", "纱布", "pansement", "verband", "包帯"), core=True),
    Topic("skin", 12, ("skin", "epithel", "皮肤", "peau", "haut", "皮膚"), core=True),
    Topic("pain", 9, ("pain", "疼痛", "douleur", "schmerz")),
    Topic("scars", 9, ("scar(s|red)?[^a-z]", "瘢痕", "cicatric", "narbe")),
    Topic("plants", 7, ("herbal", "leaves", "草", "tisane", "kräuter")),
    Topic("laboratory", 5, ("assay", "culture of", "高效液相", "nf-κb", "tnf-α")),
    Topic("advice", 4, ("read the label", "remember that", "记得", "先看说明书")),
]


def txt_topic_score(spark: SparkSession, d: str) -> DataFrame:
    """Topics and relevance of each document."""
    rows = topics.prepared(_docs(spark, d), "title", "text", "doc_id")
    return rows.select("doc_id", topics.topic_hits(TOPICS).alias("hits")).select("doc_id", topics.relevance(F.col("hits")).alias("relevance"), F.array_join(topics.tags(F.col("hits")), ",").alias("tags"))


def _sql_topics() -> str:
    count = lambda t: " + ".join(f"len(regexp_extract_all(hay, '{p}'))" for p in t.patterns)
    rows = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS i, '{t.tag}' AS tag, {str(t.core).lower()} AS core, least({t.weight} + CASE WHEN regexp_matches(title_, '{'|'.join(t.patterns)}') THEN 8 ELSE 0 END + least({count(t)}, 5), 30) AS points FROM h WHERE {count(t)} > 0"
        for i, t in enumerate(TOPICS)
    )
    return f"""WITH h AS (SELECT doc_id, lower(coalesce(title, '')) AS title_, lower(coalesce(title, '')) || chr(10) || lower(coalesce(text, '')) AS hay FROM documents),
      f AS (SELECT doc_id, sum(points)::INT AS total, bool_or(core) AS core, string_agg(tag, ',' ORDER BY i) AS tags FROM ({rows}) GROUP BY 1)
      SELECT h.doc_id, CASE WHEN f.doc_id IS NULL THEN 0 WHEN core THEN least(total, 100) ELSE least(total, 35) END AS relevance,
        CASE WHEN f.doc_id IS NULL THEN 'off_topic' WHEN core THEN tags ELSE tags || ',off_topic' END AS tags FROM h LEFT JOIN f USING (doc_id)"""


def txt_json_tags(spark: SparkSession, d: str) -> DataFrame:
    """Documents by tag; a malformed list counts as one tag of that name."""
    arr = F.from_json("topic_tags", "array<string>", {"mode": "PERMISSIVE"})
    good = F.col("topic_tags").rlike(r'^\s*\[\s*("[^"\\]*"(\s*,\s*"[^"\\]*")*)?\s*\]\s*$')
    tags = F.when(F.col("topic_tags").isNull(), F.array()).when(good, arr).otherwise(F.array(F.lit("malformed")))
    return _docs(spark, d).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def ids_documents(spark: SparkSession, d: str) -> DataFrame:
    """Identifier, its problem and the stable id of each document."""
    return _docs(spark, d).select("doc_id", ids.normalize_doi("doi").alias("doi_norm"), ids.doi_problem("doi").alias("doi_problem"), ids.document_id("doi", "sha256").alias("stable_id"))


_SQL_DOI = r"lower(regexp_replace(trim(regexp_replace(trim(coalesce(doi, '')), '^https?://(dx\.)?doi\.org/', '', 'i')), '\.+$', ''))"
_SQL_PROBLEM = r"""CASE WHEN n = '' THEN 'missing' WHEN NOT regexp_matches(n, '^10\.\d{4,9}/[-._;()/:a-z0-9]+$') THEN 'syntax_invalid' WHEN length(s) < 4 THEN 'suffix_too_short'
  WHEN (starts_with(n, '10.1371/') AND NOT regexp_matches(n, '^10\.1371/journal\.[a-z0-9]+\.\d+$')) OR (starts_with(n, '10.2147/') AND NOT contains(s, '.')) OR (starts_with(n, '10.3390/') AND NOT regexp_matches(s, '\d'))
    OR (starts_with(n, '10.1016/') AND starts_with(s, 'j.') AND length(s) - length(replace(s, '.', '')) < 2) THEN 'publisher_pattern_incomplete' ELSE '' END"""


def ids_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stable chunk ids and a namespaced digest, computed from keys."""
    chunks = once(read_table(spark, d, "chunks"), "chunk_id", "doc_id", "pdf_page", "chunk_index").where("doc_id is not null and pdf_page is not null and chunk_index is not null")
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    body = ids.canonical_json(document=key, page=F.col("pdf_page"))
    return chunks.select("chunk_id", ids.chunk_id(key, "pdf_page", "chunk_index").alias("made_id"), ids.digest("page", body).alias("page_digest"))


def doc_hard_split(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in pieces of 800 characters: number and last length."""
    pieces = _docs(spark, d).select("doc_id", chunking.hard_split(F.coalesce("text", F.lit("")), 800).alias("p"))
    return pieces.select("doc_id", F.size("p").alias("n_pieces"), F.coalesce(F.length(F.try_element_at("p", F.lit(-1))), F.lit(0)).alias("last_length"))


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages, packed into chunks."""
    docs = _docs(spark, d).withColumn("page", F.lit(1))
    return chunking.chunk_pages(docs, "doc_id", "page", "text", T.language_class("text"))


def qual_documents(spark: SparkSession, d: str) -> DataFrame:
    """Quality rules over documents: one row per broken rule."""
    docs = _docs(spark, d)
    n = F.length(F.coalesce("text", F.lit("")))
    rules = [
        ("error", "title_missing", F.trim(F.coalesce("title", F.lit(""))) == ""),
        ("warning", "title_abnormal", F.length(F.trim("title")).between(1, 4)),
        ("warning", "year_missing", ~F.coalesce(F.col("year"), F.lit("")).rlike("(19|20)[0-9]{2}")),
        ("warning", "doi_missing", ids.doi_problem("doi") == "missing"),
        ("error", "doi_invalid", ~ids.doi_problem("doi").isin("", "missing")),
        ("error", "page_count_abnormal", F.col("page_count") <= 0),
        ("warning", "abnormally_short_text", n < 200),
        ("error", "n_chars_wrong", F.col("n_chars").isNotNull() & (F.col("n_chars") != n)),
        ("warning", "low_relevance", F.coalesce(F.col("relevance_score"), F.lit(0)) <= 25),
        ("error", "garbled_text", T.garbled_share("text") >= 0.15),
    ]
    return quality.union([quality.issues(docs, F.col("doc_id"), rules), quality.duplicates(docs, F.col("sha256"), "sha256_duplicate"), quality.duplicates(docs.where(ids.doi_problem("doi") == ""), ids.normalize_doi("doi"), "doi_duplicate")])


def _sql_quality() -> str:
    base = f"(SELECT *, {_SQL_DOI} AS n, regexp_extract({_SQL_DOI}, '^[^/]+/(.*)$', 1) AS s, length({_N}) AS len, left({_N}, 5000) AS head FROM documents)"
    rules = [
        ("error", "title_missing", "trim(coalesce(title, '')) = ''"), ("warning", "title_abnormal", "length(trim(title)) BETWEEN 1 AND 4"),
        ("warning", "year_missing", "NOT regexp_matches(coalesce(year, ''), '(19|20)[0-9]{2}')"), ("warning", "doi_missing", f"({_SQL_PROBLEM}) = 'missing'"),
        ("error", "doi_invalid", f"({_SQL_PROBLEM}) NOT IN ('', 'missing')"), ("error", "page_count_abnormal", "page_count <= 0"), ("warning", "abnormally_short_text", "len < 200"),
        ("error", "n_chars_wrong", "n_chars IS NOT NULL AND n_chars <> len"), ("warning", "low_relevance", "coalesce(relevance_score, 0) <= 25"),
        ("error", "garbled_text", r"len > 0 AND (len(regexp_extract_all(head, '[\x{FFFD}\p{Cc}\p{Co}]')) - len(regexp_extract_all(head, '[\n\r\t]'))) / length(head) >= 0.15"),
    ]
    parts = [f"SELECT doc_id::VARCHAR AS record_id, '{s}' AS severity, '{c}' AS code FROM {base} WHERE {t}" for s, c, t in rules]
    parts.append("SELECT sha256, 'error', 'sha256_duplicate' FROM documents WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
    parts.append(f"SELECT n, 'error', 'doi_duplicate' FROM {base} WHERE ({_SQL_PROBLEM}) = '' GROUP BY 1 HAVING count(*) > 1")
    return " UNION ALL ".join(parts)


def qual_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Quality rules over chunks, orphans and chunks whose page cannot be, included."""
    chunks = read_table(spark, d, "chunks")
    own = once(chunks, "chunk_id", "doc_id", "pdf_page", "text", "char_start", "char_end")
    n = F.length(F.coalesce("text", F.lit("")))
    rules = [
        ("warning", "chunk_too_short", n < 50),
        ("warning", "chunk_too_long", n > 1500),
        ("error", "chunk_invalid_page", ~F.coalesce(F.col("pdf_page") >= 1, F.lit(False))),
        ("error", "chunk_invalid_span", F.coalesce(F.col("char_end") <= F.col("char_start"), F.lit(False))),
    ]
    docs = _docs(spark, d).select("doc_id", "page_count")
    orphan = own.where("doc_id is null").unionByName(own.join(docs, "doc_id", "left_anti").where("doc_id is not null"))
    beyond = own.join(docs, "doc_id").where(F.col("pdf_page") > F.col("page_count"))
    tell = lambda df, code: df.select(F.col("chunk_id").alias("record_id"), F.lit("error").alias("severity"), F.lit(code).alias("code"))
    return quality.union([quality.issues(own, F.col("chunk_id"), rules), tell(orphan, "chunk_without_document"), tell(beyond, "chunk_page_beyond_document"), quality.duplicates(chunks, F.col("chunk_id"), "chunk_delivered_again")])


_SQL_QUAL_CHUNKS = f"""WITH own AS {sql_once('chunks', 'chunk_id', 'doc_id', 'pdf_page', 'text', 'char_start', 'char_end')}
  SELECT chunk_id AS record_id, 'warning' AS severity, 'chunk_too_short' AS code FROM own WHERE length({_N}) < 50
  UNION ALL SELECT chunk_id, 'warning', 'chunk_too_long' FROM own WHERE length({_N}) > 1500
  UNION ALL SELECT chunk_id, 'error', 'chunk_invalid_page' FROM own WHERE coalesce(pdf_page < 1, true)
  UNION ALL SELECT chunk_id, 'error', 'chunk_invalid_span' FROM own WHERE char_end <= char_start
  UNION ALL SELECT chunk_id, 'error', 'chunk_without_document' FROM own WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT chunk_id, 'error', 'chunk_page_beyond_document' FROM own JOIN documents d USING (doc_id) WHERE pdf_page > d.page_count
  UNION ALL SELECT chunk_id, 'error', 'chunk_delivered_again' FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING count(*) > 1"""


def qual_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule is broken."""
    return qual_documents(spark, d).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def qual_doi_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that stand for several files or titles."""
    docs = _docs(spark, d).where(ids.doi_problem("doi") == "").withColumn("doi_norm", ids.normalize_doi("doi"))
    return quality.conflicts(docs, "doi_norm", "sha256", "title")


def qual_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What an earlier load of the documents (before 2025) and all of them differ in, by state."""
    docs = _docs(spark, d)
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    old = docs.where(F.col("loaded_at") < F.lit("2025-01-01").cast("timestamp_ntz"))
    return quality.snapshot_difference(old, docs, "doc_id", content).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def qual_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each source's texts, whatever the order of rows."""
    return quality.corpus_digest(_docs(spark, d), ["source"], F.concat_ws("|", "doc_id", "text"))


_SQL_DIGEST = f"""SELECT source, count(*) AS n_rows, sha256(concat_ws('|', {', '.join(f"sum(('0x' || substring(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))})) AS digest
  FROM (SELECT source, sha256(concat_ws('|', doc_id, text)) AS h FROM documents) GROUP BY source"""


def qual_not_done(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have no chunk yet."""
    return quality.not_done(_docs(spark, d).select("doc_id"), read_table(spark, d, "chunks").where("doc_id is not null"), "doc_id")


def qual_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Books rolled up from their pages: characters, empty pages, confidence, status."""
    pages = once(read_table(spark, d, "pages"), "page_id", "book_id", "text", "average_confidence", "low_confidence")
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    conf = F.when(F.col("average_confidence").between(0, 1), F.col("average_confidence"))
    g = pages.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.count_if(empty).alias("n_empty"),
        F.round(F.avg(conf), 9).alias("mean_confidence"), F.count_if(F.col("low_confidence") == 1).alias("n_low"),
    )
    return g.withColumn("status", F.when(F.col("n_empty") == F.col("n_pages"), "no_text").when(F.col("n_empty") / F.col("n_pages") >= 0.5, "partial").otherwise("ok"))


def qual_page_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Pages by book and reading direction, the directions as columns."""
    pages = once(read_table(spark, d, "pages"), "page_id", "book_id", "reading_direction")
    kinds = ["native", "vertical-rtl", "horizontal-ltr"]
    table = pages.groupBy("book_id").pivot("reading_direction", kinds).agg(F.count(F.lit(1)))
    return table.select("book_id", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k.replace("-", "_")) for k in kinds])


TERMS = ["silver dressing", "hydrogel", "escharotomy", "scald", "VEGF", "负压引流", "创面", "愈合", "烫伤"]
BURN, WOUND = ["burn", "scald", "烧伤", "烫伤"], ["wound", "创面", "伤口"]


def _scanned(spark: SparkSession, d: str, *kept: str) -> DataFrame:
    docs = _docs(spark, d).where("text is not null")
    context = F.when(F.size(T.matched_terms("text", BURN)) > 0, "burn").when(F.size(T.matched_terms("text", WOUND)) > 0, "wound").otherwise("only")
    return docs.select("doc_id", F.explode(T.matched_terms("text", TERMS)).alias("term"), context.alias("context"), *kept)


def dict_scan(spark: SparkSession, d: str) -> DataFrame:
    """Terms found in each document, with the context they stand in."""
    return _scanned(spark, d)


def _pat(t: str) -> str:
    return f"regexp_matches(lower(text), '{T.term_pattern(t)}')"


_SQL_CONTEXT = f"CASE WHEN {' OR '.join(map(_pat, BURN))} THEN 'burn' WHEN {' OR '.join(map(_pat, WOUND))} THEN 'wound' ELSE 'only' END"
_SQL_SCAN = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, {_SQL_CONTEXT} AS context FROM documents WHERE text IS NOT NULL AND {_pat(t)}" for t in TERMS)


def dict_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sources of each term by context; terms that nothing has come with zeros."""
    hits = _scanned(spark, d, "source")
    g = hits.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.count_if(F.col("context") == "burn").alias("n_burn"), F.count_if(F.col("context") != "only").alias("n_burn_or_wound"),
    )
    catalogue = spark.createDataFrame([(t,) for t in [*TERMS, "no such term"]], "term string")
    return catalogue.join(g, "term", "left").na.fill(0).withColumn("burn_rank", F.row_number().over(Window.orderBy(F.desc("n_burn"), F.desc("n_burn_or_wound"), F.desc("n_documents"), "term")))


_SQL_COVERAGE = f"""SELECT term, coalesce(n_documents, 0) AS n_documents, coalesce(n_sources, 0) AS n_sources, coalesce(n_burn, 0) AS n_burn, coalesce(n_bw, 0) AS n_burn_or_wound,
  row_number() OVER (ORDER BY coalesce(n_burn, 0) DESC, coalesce(n_bw, 0) DESC, coalesce(n_documents, 0) DESC, term) AS burn_rank
  FROM (SELECT unnest({sql_list([*TERMS, 'no such term'])}) AS term) LEFT JOIN (SELECT term, count(*) AS n_documents, count(DISTINCT source) AS n_sources, count(*) FILTER (context = 'burn') AS n_burn, count(*) FILTER (context <> 'only') AS n_bw
    FROM ({_SQL_SCAN}) JOIN documents USING (doc_id) GROUP BY term) USING (term)"""


def dict_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many documents pass each stage of a screening."""
    docs = _docs(spark, d)
    x = T.search_form("text")
    return stats.funnel(docs, [("has_text", F.trim(F.coalesce("text", F.lit(""))) != ""), ("on_burns", x.rlike("burn|scald|烧伤|烫伤")), ("names_dressing", x.rlike("dressing|敷料|纱布")), ("relevant", F.col("relevance_score") >= 50)])


_SQL_FUNNEL = f"""WITH f AS (SELECT trim({_N}) <> '' AS a, regexp_matches(lower({_N}), 'burn|scald|烧伤|烫伤') AS b, regexp_matches(lower({_N}), 'dressing|敷料|纱布') AS c, coalesce(relevance_score >= 50, false) AS e FROM documents),
  n AS (SELECT count(*) AS n0, count(*) FILTER (a) AS n1, count(*) FILTER (a AND b) AS n2, count(*) FILTER (a AND b AND c) AS n3, count(*) FILTER (a AND b AND c AND e) AS n4 FROM f)
  SELECT 1 AS stage_no, 'has_text' AS stage, n0 AS before_n, n0 - n1 AS excluded_n, n1 AS after_n FROM n UNION ALL SELECT 2, 'on_burns', n1, n1 - n2, n2 FROM n
  UNION ALL SELECT 3, 'names_dressing', n2, n2 - n3, n3 FROM n UNION ALL SELECT 4, 'relevant', n3, n3 - n4, n4 FROM n"""


def dict_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    """Confidence that a page treats of burns, from the terms it has (each counts once)."""
    weights = {"熱毒": 0.5, "燙傷": 0.8, "湯火傷": 0.9, "burn": 0.6, "scald": 0.7, "Verbrennung": 0.7, "brûlure": 0.7}
    pages = once(read_table(spark, d, "pages"), "page_id", "text")
    found = F.array_compact(F.array(*[F.when(F.coalesce("text", F.lit("")).contains(t), F.lit(w)) for t, w in weights.items()]))
    return pages.select("page_id", F.size(found).alias("n_terms"), F.round(numeric.noisy_or(found), 6).alias("confidence")).where("n_terms > 0")


_W = {"熱毒": 0.5, "燙傷": 0.8, "湯火傷": 0.9, "burn": 0.6, "scald": 0.7, "Verbrennung": 0.7, "brûlure": 0.7}
_SQL_NOISY = f"""SELECT page_id, {' + '.join(f"contains(t, '{k}')::INT" for k in _W)} AS n_terms, round(1 - {' * '.join(f"(CASE WHEN contains(t, '{k}') THEN 1e0 - {w}e0 ELSE 1e0 END)" for k, w in _W.items())}, 6) AS confidence
  FROM (SELECT page_id, coalesce(text, '') AS t FROM {sql_once('pages', 'page_id', 'text')}) WHERE n_terms > 0"""

DICTIONARY = [
    matching.Term("burn", ("湯火傷", "燙傷", "火瘡")),
    matching.Term("toxin", ("熱毒", "毒"), context=("治", "主")),
    matching.Term("ulcer", ("瘡瘍", "癰腫", "瘡")),
    matching.Term("caution", ("不可輕用", "虛者慎之"), exclude=True),
]


def dict_spans(spark: SparkSession, d: str) -> DataFrame:
    """Matches of a dictionary in pages by term and whether its context admits them."""
    pages = once(read_table(spark, d, "pages"), "page_id", "text")
    found = matching.dictionary_matches(pages, ["page_id"], "text", DICTIONARY, 12)
    return found.groupBy("term_id", "surface", "reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


def dict_doses(spark: SparkSession, d: str) -> DataFrame:
    """Herbs with the dose that follows, over all pages."""
    herbs = ["蓮根", "葵花", "蒿汁", "芍皮", "蘆灰", "薊葉", "棘子", "嵐草"]
    pages = once(read_table(spark, d, "pages"), "page_id", "text")
    found = pages.select(F.explode(matching.native_doses(F.coalesce("text", F.lit("")), herbs)).alias("dose"))
    return found.groupBy("dose").agg(F.count(F.lit(1)).alias("n"))


_SQL_DOSES = f"""SELECT dose, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '((?:蓮根|葵花|蒿汁|芍皮|蘆灰|薊葉|棘子|嵐草)[\\s，、：:（(]*[〇零一二三四五六七八九十百半两兩\\d]+\\s*(?:两|兩|钱|錢|分|斤|升|枚|片|g|克))', 1)) AS dose
  FROM {sql_once('pages', 'page_id', 'text')}) GROUP BY dose"""


def dict_measures(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with a unit in each document, the first eight."""
    return _docs(spark, d).select("doc_id", F.array_join(T.numbers_with_unit("text", "percent|days|hours|mg|units"), ";").alias("amounts")).where("amounts <> ''")


_SQL_MEASURES = rf"SELECT doc_id, array_to_string(a[1:8], ';') AS amounts FROM (SELECT doc_id, regexp_extract_all(lower({_N}), '(\d+(?:\.\d+)?\s*(?:percent|days|hours|mg|units))', 1) AS a FROM documents) WHERE len(a) > 0"


def seq_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The spans that a document's chunks cover, overlapping ones as one."""
    chunks = once(read_table(spark, d, "chunks"), "chunk_id", "doc_id", "char_start", "char_end").where("doc_id is not null")
    return sequences.merged_intervals(chunks, ["doc_id"], "char_start", "char_end")


_SQL_INTERVALS = f"""WITH c AS (SELECT * FROM {sql_once('chunks', 'chunk_id', 'doc_id', 'char_start', 'char_end')} WHERE doc_id IS NOT NULL AND char_start IS NOT NULL AND char_end IS NOT NULL),
  f AS (SELECT *, coalesce(char_start > max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM c),
  i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) AS k FROM f)
  SELECT doc_id, min(char_start) AS char_start, max(char_end) AS char_end, count(*) AS n FROM i GROUP BY doc_id, k"""


def seq_gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's events: a new one after more than an hour."""
    events = read_table(spark, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    found = sequences.gap_clusters(events, ["user_id"], F.col("sec"), F.lit(3600.0), ["ts", "event_id"])
    return found.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


_SQL_GAPS = """WITH f AS (SELECT *, coalesce(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w > 3600, false)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  k AS (SELECT *, 1 + sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM f)
  SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, min(event_id) AS first_event FROM k GROUP BY 1, 2"""


def seq_until_next(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with the start of the next one of its document."""
    chunks = once(read_table(spark, d, "chunks"), "chunk_id", "doc_id", "chunk_index", "char_start").where("doc_id is not null")
    return sequences.until_next(chunks, ["doc_id"], ["chunk_index", "chunk_id"], "char_start", "next_start").select("chunk_id", "char_start", "next_start")


def seq_first_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first four pages of each book."""
    pages = once(read_table(spark, d, "pages"), "page_id", "book_id", "physical_page").where("book_id is not null")
    return sequences.first_per(pages, ["book_id"], ["physical_page", "page_id"], 4).select("book_id", "page_id", "n_in_group")


def seq_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Boxes (events of a user as places on a page) in columns from right to left."""
    boxes = read_table(spark, d, "events").select("user_id", "event_id", F.round("value", 2).alias("x"), (F.col("event_id") % 97).alias("y")).where("x is not null")
    return sequences.reading_order(boxes, ["user_id"], "x", "y", ["event_id"]).select("user_id", "event_id", "col", "place")


_SQL_READING = """WITH b AS (SELECT user_id, event_id, round(value, 2) AS x, event_id % 97 AS y FROM events WHERE value IS NOT NULL),
  m AS (SELECT *, greatest((max(x) OVER (PARTITION BY user_id) - min(x) OVER (PARTITION BY user_id)) * 0.18e0, 18e0) AS most FROM b),
  f AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) > most, false)::INT AS new FROM m),
  k AS (SELECT *, 1 + sum(new) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM f),
  c AS (SELECT *, CASE WHEN max(cluster) OVER (PARTITION BY user_id) > 6 THEN 1 ELSE cluster END AS col FROM k)
  SELECT user_id, event_id, col::BIGINT AS col, row_number() OVER (PARTITION BY user_id ORDER BY col DESC, y, event_id) AS place FROM c"""


def qual_repair(spark: SparkSession, d: str) -> DataFrame:
    """Repaired identifier, identity, language and title of each document, and what was changed."""
    return repair.repaired(_docs(spark, d), "doc_id").withColumn("title", F.sha2("title", 256))


_IN_TEXT = r"regexp_extract(lower(coalesce(text, '')), '(10\.\d{4,9}/[-._;()/:a-z0-9]+[a-z0-9])', 1)"
_SQL_LINE = r"""CASE WHEN length(l) <= 120 AND (regexp_matches(l, '^(abstract|introduction|methods?|results?|discussion|conclusion|references|acknowledg|摘要|引言|方法|结果|讨论|结论|参考文献)', 'i') OR regexp_matches(l, '^(\d+(\.\d+)*|[IVXLC]+)[\s\.、]')) THEN left(l, 120) ELSE left(l, 80) END"""
_SQL_REPAIR = f"""WITH b AS (SELECT doc_id, n AS declared, ({_SQL_PROBLEM}) AS p, t AS in_text, (SELECT {_SQL_PROBLEM} FROM (SELECT t AS n, regexp_extract(t, '^[^/]+/(.*)$', 1) AS s)) AS q, lower(sha256) AS sha, language, title,
    {_sql_class('cjk', 'latin')} AS fl, {_SQL_LINE} AS line
  FROM (SELECT *, {_SQL_DOI} AS n, regexp_extract({_SQL_DOI}, '^[^/]+/(.*)$', 1) AS s, {_IN_TEXT} AS t, len(regexp_extract_all({_N}, '{CJK}')) AS cjk, len(regexp_extract_all({_N}, '[A-Za-z]')) AS latin,
    regexp_replace(split_part(regexp_replace({_N}, '^\\s+|\\s+$', '', 'g'), chr(10), 1), '^\\s+|\\s+$', '', 'g') AS l FROM documents)),
  c AS (SELECT *, CASE WHEN p = '' THEN declared WHEN in_text <> '' AND q = '' THEN in_text ELSE '' END AS doi FROM b),
  e AS (SELECT *, CASE WHEN doi = '' THEN 'missing' WHEN min(sha) OVER (PARTITION BY doi) <> max(sha) OVER (PARTITION BY doi) THEN 'shared' ELSE 'valid' END AS doi_status,
    CASE WHEN fl <> '' THEN fl ELSE coalesce(language, '') END AS l2, CASE WHEN trim(coalesce(title, '')) <> '' THEN title ELSE line END AS t2 FROM c)
  SELECT doc_id, doi, doi_status, CASE WHEN doi_status = 'valid' THEN 'doi:' || doi ELSE 'sha256:' || sha END AS stable_id, l2 AS language, sha256(t2) AS title,
    concat_ws(',', CASE WHEN doi <> declared THEN 'doi' END, CASE WHEN l2 <> coalesce(language, '') THEN 'language' END, CASE WHEN t2 IS DISTINCT FROM title THEN 'title' END) AS changes FROM e"""


def qual_doctor(spark: SparkSession, d: str) -> DataFrame:
    """The store's health in one row of counts, and whether all of them are right."""
    docs, chunks, pages = (read_table(spark, d, t) for t in ("documents", "chunks", "pages"))
    one = (
        docs.agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("doc_id").alias("n_document_ids"))
        .crossJoin(chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("chunk_id").alias("n_chunk_ids"), F.count_if(F.col("text").isNull()).alias("n_empty_chunks")))
        .crossJoin(pages.agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("page_id").alias("n_page_ids")))
        .crossJoin(chunks.where("doc_id is not null").join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans")))
    )
    fine = (F.col("n_documents") == F.col("n_document_ids")) & (F.col("n_chunks") == F.col("n_chunk_ids")) & (F.col("n_pages") == F.col("n_page_ids")) & (F.col("n_orphans") == 0) & (F.col("n_empty_chunks") == 0)
    return one.withColumn("healthy", fine)


_SQL_DOCTOR = """SELECT *, n_documents = n_document_ids AND n_chunks = n_chunk_ids AND n_pages = n_page_ids AND n_orphans = 0 AND n_empty_chunks = 0 AS healthy FROM (SELECT count(*) AS n_documents, count(DISTINCT doc_id) AS n_document_ids FROM documents),
  (SELECT count(*) AS n_chunks, count(DISTINCT chunk_id) AS n_chunk_ids, count(*) FILTER (text IS NULL) AS n_empty_chunks FROM chunks), (SELECT count(*) AS n_pages, count(DISTINCT page_id) AS n_page_ids FROM pages),
  (SELECT count(*) AS n_orphans FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM documents))"""

FORMULAS = [
    formula.Formula("wash", ("古法治", "又方"), (("lotus", ("蓮根",)), ("mallow", ("葵花",)), ("wormwood", ("蒿汁",)), ("peony", ("芍皮",)), ("reed", ("蘆灰",))), 60, 1),
    formula.Formula("question", ("問曰",), (("thistle", ("薊葉",)), ("jujube", ("棘子",))), 60, 1),
]


def dict_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas in pages with their dosed herbs, by composition."""
    pages = once(read_table(spark, d, "pages"), "page_id", "text").withColumn("text", F.regexp_replace("text", r"\s+", ""))
    found = formula.formulas_in(pages, ["page_id"], "text", FORMULAS)
    return found.groupBy("formula_id", F.array_join(F.transform("composition", lambda c: c["herb"]), "+").alias("herbs"), "dosed", "confidence").agg(F.count(F.lit(1)).alias("n"))


def dict_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """How many pages name a disease and a treatment together."""
    pages = once(read_table(spark, d, "pages"), "page_id", "text").select("page_id", F.coalesce("text", F.lit("")).alias("t"))
    named = lambda terms: F.array_compact(F.array(*[F.when(F.col("t").contains(x), F.lit(x)) for x in terms]))
    pairs = pages.select("page_id", F.explode(named(["湯火傷", "燙傷", "熱毒", "癰腫", "scald", "burn"])).alias("disease"), named(["浸酒", "煎湯", "研末", "dressing", "debridement"]).alias("m"))
    return pairs.select("disease", F.explode("m").alias("method")).groupBy("disease", "method").agg(F.count(F.lit(1)).alias("n_pages"))


_SQL_COOC = f"""WITH p AS (SELECT page_id, {_N} AS t FROM {sql_once('pages', 'page_id', 'text')}) SELECT disease, method, count(*) AS n_pages FROM p, (SELECT unnest(['湯火傷', '燙傷', '熱毒', '癰腫', 'scald', 'burn']) AS disease),
  (SELECT unnest(['浸酒', '煎湯', '研末', 'dressing', 'debridement']) AS method) WHERE contains(t, disease) AND contains(t, method) GROUP BY 1, 2"""


def seq_vertical_columns(spark: SparkSession, d: str) -> DataFrame:
    """Boxes (events of a user as tall boxes) clustered into columns and put in reading order."""
    x = F.coalesce("value", F.lit(0.0))
    boxes = read_table(spark, d, "events").select("user_id", "event_id", x.alias("x1"), (F.col("event_id") % 97).cast("double").alias("y1"), (x + 20).alias("x2"), (F.col("event_id") % 97 + 60).cast("double").alias("y2"))
    return layout.reading_order(boxes, "user_id").select("user_id", "event_id", "col", "place")


def ret_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Documents near every fiftieth one by hashed words of their titles."""
    made = embedding.embed(_docs(spark, d).where("title is not null"), "doc_id", "title", embedding.hashing_encoder(128), "hash-128")
    return vectors.top_k(made.where("doc_id % 50 = 0"), made, "doc_id", "embedding", 5, unit=False)


QUERIES = {k: f for k, f in list(globals().items()) if k.split("_")[0] in ("txt", "ids", "doc", "qual", "dict", "seq", "ret") and callable(f)}
SQL = {
    "txt_char_ngrams": f"""SELECT gram, count(*) AS n FROM (SELECT unnest(flatten(list_transform(regexp_extract_all(coalesce(title, ''), '{CJK}+'), lambda r: list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)) || list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))) AS gram FROM documents) GROUP BY gram""",
    "txt_language_class": f"SELECT chunk_id, {_sql_class('cjk', 'latin')} AS language_class FROM (SELECT chunk_id, len(regexp_extract_all({_N}, '{CJK}')) AS cjk, len(regexp_extract_all({_N}, '[A-Za-z]')) AS latin FROM {sql_once('chunks', 'chunk_id', 'text')})",
    "txt_document_language": f"""SELECT book_id, cjk, latin, CASE WHEN cjk + latin = 0 THEN '' WHEN cjk >= 200 AND cjk / (cjk + latin) >= 0.20 THEN 'zh' WHEN cjk >= 100 AND latin >= 100 AND cjk / (cjk + latin) >= 0.05 THEN 'mixed' WHEN latin > 0 THEN 'en' ELSE 'zh' END AS language_class
      FROM (SELECT book_id, sum(len(regexp_extract_all({_N}, '{CJK}')))::BIGINT AS cjk, sum(len(regexp_extract_all({_N}, '[A-Za-z]')))::BIGINT AS latin FROM {sql_once('pages', 'page_id', 'book_id', 'text')} GROUP BY book_id)""",
    "txt_clean": f"SELECT doc_id, length(c) AS n_chars_clean, sha256(c) AS clean_sha256 FROM (SELECT doc_id, {_SQL_CLEAN} AS c FROM documents)",
    "txt_measures": rf"""SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z]+(?:''[A-Za-z]+)?|\d+(?:\.\d+)?')) AS n_words, len(regexp_extract_all(t, '{CJK}')) AS n_ideographs,
      CASE WHEN t = '' THEN 0e0 ELSE round((len(regexp_extract_all(left(t, 5000), '[\x{{FFFD}}\p{{Cc}}\p{{Co}}]')) - len(regexp_extract_all(left(t, 5000), '[\n\r\t]'))) / length(left(t, 5000)), 6) END AS garbled_share,
      CASE WHEN length(l) <= 120 AND (regexp_matches(l, '^(abstract|introduction|methods?|results?|discussion|conclusion|references|acknowledg|摘要|引言|方法|结果|讨论|结论|参考文献)', 'i') OR regexp_matches(l, '^(\d+(\.\d+)*|[IVXLC]+)[\s\.、]')) THEN left(l, 120) ELSE left(l, 80) END AS section_hint
      FROM (SELECT doc_id, {_N} AS t, regexp_replace(split_part(regexp_replace({_N}, '^\s+|\s+$', '', 'g'), chr(10), 1), '^\s+|\s+$', '', 'g') AS l FROM documents)""",
    "txt_topic_score": _sql_topics(),
    "txt_json_tags": r"""SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN topic_tags IS NULL THEN []::VARCHAR[] WHEN regexp_matches(topic_tags, '^\s*\[\s*("[^"\\]*"(\s*,\s*"[^"\\]*")*)?\s*\]\s*$') THEN from_json(topic_tags, '["VARCHAR"]') ELSE ['malformed'] END) AS tag FROM documents) GROUP BY tag""",
    "ids_documents": f"SELECT doc_id, n AS doi_norm, {_SQL_PROBLEM} AS doi_problem, CASE WHEN ({_SQL_PROBLEM}) = '' THEN 'doi:' || n ELSE 'sha256:' || lower(sha256) END AS stable_id FROM (SELECT *, {_SQL_DOI} AS n, regexp_extract({_SQL_DOI}, '^[^/]+/(.*)$', 1) AS s FROM documents)",
    "ids_chunks": f"""SELECT chunk_id, left(sha256('doc:' || doc_id || '|p' || pdf_page || '|c' || chunk_index), 24) || printf('_p%04d_c%03d', pdf_page, chunk_index) AS made_id, left(sha256('page' || chr(10) || '{{"document":"doc:' || doc_id || '","page":' || pdf_page || '}}'), 24) AS page_digest
      FROM {sql_once('chunks', 'chunk_id', 'doc_id', 'pdf_page', 'chunk_index')} WHERE doc_id IS NOT NULL AND pdf_page IS NOT NULL AND chunk_index IS NOT NULL""",
    "doc_hard_split": f"SELECT doc_id, ceil(length({_N}) / 800)::INT AS n_pieces, CASE WHEN length({_N}) = 0 THEN 0 ELSE (length({_N}) - 1) % 800 + 1 END AS last_length FROM documents",
    "qual_documents": _sql_quality(),
    "qual_chunks": _SQL_QUAL_CHUNKS,
    "qual_issue_counts": f"SELECT severity, code, count(*) AS n FROM ({_sql_quality()}) GROUP BY 1, 2",
    "qual_doi_conflicts": f"SELECT n AS doi_norm, count(DISTINCT (coalesce(sha256, ''), coalesce(title, ''))) AS n_identities FROM (SELECT *, {_SQL_DOI} AS n, regexp_extract({_SQL_DOI}, '^[^/]+/(.*)$', 1) AS s FROM documents) WHERE ({_SQL_PROBLEM}) = '' GROUP BY n HAVING count(DISTINCT (coalesce(sha256, ''), coalesce(title, ''))) > 1",
    "qual_snapshot": "SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'missing' WHEN sha256(coalesce(o.text, '')) = sha256(coalesce(n.text, '')) THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM (SELECT * FROM documents WHERE loaded_at < TIMESTAMP '2025-01-01') o FULL JOIN documents n USING (doc_id) GROUP BY 1",
    "qual_digest": _SQL_DIGEST,
    "qual_not_done": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL)",
    "qual_extraction": f"""SELECT *, CASE WHEN n_empty = n_pages THEN 'no_text' WHEN n_empty / n_pages >= 0.5 THEN 'partial' ELSE 'ok' END AS status FROM (SELECT book_id, count(*) AS n_pages, sum(length({_N}))::BIGINT AS n_chars, count(*) FILTER (trim({_N}) = '') AS n_empty,
      round(avg(CASE WHEN average_confidence BETWEEN 0 AND 1 THEN average_confidence END), 9) AS mean_confidence, count(*) FILTER (low_confidence = 1) AS n_low FROM {sql_once('pages', 'page_id', 'book_id', 'text', 'average_confidence', 'low_confidence')} GROUP BY book_id)""",
    "qual_page_matrix": f"SELECT book_id, count(*) FILTER (reading_direction = 'native') AS native, count(*) FILTER (reading_direction = 'vertical-rtl') AS vertical_rtl, count(*) FILTER (reading_direction = 'horizontal-ltr') AS horizontal_ltr FROM {sql_once('pages', 'page_id', 'book_id', 'reading_direction')} GROUP BY book_id",
    "qual_repair": _SQL_REPAIR,
    "qual_doctor": _SQL_DOCTOR,
    "dict_cooccurrence": _SQL_COOC,
    "dict_scan": _SQL_SCAN,
    "dict_coverage": _SQL_COVERAGE,
    "dict_funnel": _SQL_FUNNEL,
    "dict_noisy_or": _SQL_NOISY,
    "dict_doses": _SQL_DOSES,
    "dict_measures": _SQL_MEASURES,
    "seq_intervals": _SQL_INTERVALS,
    "seq_gap_clusters": _SQL_GAPS,
    "seq_until_next": f"SELECT chunk_id, char_start, lead(char_start) OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS next_start FROM {sql_once('chunks', 'chunk_id', 'doc_id', 'chunk_index', 'char_start')} WHERE doc_id IS NOT NULL",
    "seq_first_pages": f"SELECT book_id, page_id, row_number() OVER (PARTITION BY book_id ORDER BY physical_page NULLS FIRST, page_id) AS n_in_group FROM {sql_once('pages', 'page_id', 'book_id', 'physical_page')} WHERE book_id IS NOT NULL QUALIFY n_in_group <= 4",
    "seq_reading_order": _SQL_READING,
}

"""Queries over the stages of a pipeline, their guards and their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import numeric
from scholium.functions import text as T
from scholium.operators import evaluation, stages
from scholium.plans import retrieval
from scholium.plans.common import once, sql_once
from scholium.session import read_table


def stage_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Every page of every book as a task of one of four shards."""
    return stages.page_tasks(read_table(spark, d, "books"), "book_id", "page_count", 4)


def stage_open_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose page is not there yet, and all of one book again."""
    tasks = stage_tasks(spark, d).select("book_id", "page", F.lit(1).alias("version"))
    done = read_table(spark, d, "pages").where("book_id is not null").select("book_id", F.col("physical_page").alias("page"), F.lit(1).alias("version"))
    redo = read_table(spark, d, "books").agg(F.min("book_id").alias("book_id"))
    return stages.not_current(tasks, done, ["book_id", "page"], "version", redo.join(tasks.select("book_id", "page"), "book_id")).select("book_id", "page")


def stage_status(spark: SparkSession, d: str) -> DataFrame:
    """How far the documents of each source are."""
    docs = read_table(spark, d, "documents")
    return stages.status(docs, "source", with_text=F.length("text") > 0, extracted=F.col("extraction_status") == "ok", named=F.length(F.trim("title")) > 0, with_layer=F.col("has_text_layer"))


def stage_locked(spark: SparkSession, d: str) -> DataFrame:
    """Evidence ids that stand once, and those that are rejected as repeated."""
    return stages.locked_keys(read_table(spark, d, "graph_evidence"), "evidence_id")


def stage_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Confidences of edges by what is wrong with them."""
    x, bad = stages.guarded_number(F.col("confidence"), 0.0, 1.0)
    rows = read_table(spark, d, "graph_edges").select(x.alias("x"), bad.alias("problem"))
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


def stage_denied(spark: SparkSession, d: str) -> DataFrame:
    """Files of books and documents that may not be published, by reason."""
    files = read_table(spark, d, "books").select(F.col("source_path").alias("path")).unionByName(read_table(spark, d, "documents").select(F.col("source_filename").alias("path")))
    why = stages.denied(F.col("path"), [".pdf", ".env", ".sqlite"], ["/private/", "secrets/"], ["thumbs.db"])
    return files.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def stage_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose later delivery may take the place of the first: only if the text is still the same."""
    pages = read_table(spark, d, "pages")
    side = pages.where("page_id is not null").groupBy("page_id").agg(F.max(F.struct("loaded_at", "text")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    side = side.select("page_id", F.concat("m.text", F.lit("*")).alias("side_text"), F.sha2(F.coalesce("m.text", F.lit("")), 256).alias("side_hash"))
    return stages.overridden(once(pages, "page_id", "text"), side, "page_id", "text", "side_text", "side_hash").groupBy("layout").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def stage_inside(spark: SparkSession, d: str) -> DataFrame:
    """Edges between herbs and formulas only, by predicate."""
    clean = lambda c: F.lower(F.trim(c))
    edges = once(read_table(spark, d, "graph_edges"), "edge_id", "subject_id", "predicate", "object_id").select("predicate", clean("subject_id").alias("a"), clean("object_id").alias("b"))
    nodes = read_table(spark, d, "graph_nodes").where(F.col("entity_type").isin("Herb", "FormulaVariant", "FormulaConcept")).select(clean("node_id").alias("id"))
    return stages.inside(edges, ("a", "b"), nodes, "id").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def qual_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Share of the documents of each source with title, year, hash and page count."""
    return stages.completeness(read_table(spark, d, "documents"), "source", ["title", "year", "sha256", "page_count"])


def qual_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Which of three tables know a document."""
    docs, chunks = read_table(spark, d, "documents"), read_table(spark, d, "chunks")
    return stages.key_sets({"documents": docs, "chunks": chunks, "titled": docs.where("title is not null")}, "doc_id")


def qual_conserved(spark: SparkSession, d: str) -> DataFrame:
    """Whether each edge of a predicate was either kept (0.7 on) or dropped."""
    c = F.col("confidence")
    return stages.conserved(once(read_table(spark, d, "graph_edges"), "edge_id", "predicate", "confidence"), "predicate", c >= 0.7, c < 0.7)


def dict_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Names that several nodes bear."""
    nodes = read_table(spark, d, "graph_nodes")
    forms = nodes.select("node_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_name"))).alias("form"))
    return stages.collisions(forms, "form", "node_id")


def stat_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by the tier of its grade, once its review and its quote let it through."""
    e = once(read_table(spark, d, "graph_evidence"), "evidence_id", "evidence_grade", "review", "quote")
    review = F.get_json_object("review", "$.status")
    gates = [F.when(review == "rejected", "failed").when(review == "approved", "passed").otherwise("open"), F.when(F.length(F.trim("quote")) > 0, "passed").otherwise("failed")]
    score = numeric.weighted([F.try_element_at(F.create_map(*[F.lit(x) for kv in {"E1": 1.0, "E2": 0.8, "E3": 0.6, "E4": 0.4}.items() for x in kv]), F.col("evidence_grade"))], [1.0])
    return e.groupBy(stages.tier(gates, F.coalesce(score, F.lit(0.0)), 0.75, 0.6).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


# The categories of the questions.
CATEGORIES = {"q1": "treatment", "q2": "symptom", "q3": "healing", "q4": "mechanism", "q5": "none"}


def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the keyword retrieval for each category of questions."""
    ranked = retrieval.ret_keyword_bm25(spark, d).select("question_id", F.col("chunk_id").alias("unit_id"), "rank")
    kind = spark.createDataFrame(list(CATEGORIES.items()), "question_id string, category string")
    return evaluation.retrieval_quality(ranked, retrieval.expected_units(spark, d).join(F.broadcast(kind), "question_id"), "category")


def eval_question_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with questions made of the first chunk of each document (by its section)."""
    first = once(read_table(spark, d, "chunks").where("chunk_index = 0"), "chunk_id", "doc_id", "section_hint", "language")
    made = first.select(F.col("doc_id").cast("string").alias("question_id"), F.col("language").alias("category"), F.col("section_hint").alias("question"), F.array("chunk_id").alias("expected"))
    return stages.question_issues(made)


def txt_quotes(spark: SparkSession, d: str) -> DataFrame:
    """How the search form of each chunk stands in its text."""
    rows = once(read_table(spark, d, "chunks"), "chunk_id", "text", "normalized_text")
    return rows.groupBy(T.quote_match(F.col("normalized_text"), F.lower(F.coalesce("text", F.lit("")))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def txt_titles(spark: SparkSession, d: str) -> DataFrame:
    """Works by the names of their files, names in the graph's form, and where terms stand."""
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", T.work_title("source_filename").alias("work"), T.graph_key("title").alias("title_key"), T.labels(F.col("lang"), F.col("language"), F.col("source")).alias("labels"))


QUERIES = {
    f.__name__: f
    for f in (
        stage_tasks, stage_open_tasks, stage_status, stage_locked, stage_confidences, stage_denied, stage_overrides, stage_inside, qual_completeness, qual_key_sets, qual_conserved,
        dict_collisions, stat_tiers, eval_by_category, eval_question_issues, txt_quotes, txt_titles,
    )
}

_TASKS = "(SELECT book_id, unnest(range(1, page_count + 1)) AS page FROM books WHERE book_id IS NOT NULL AND page_count >= 1)"
_BLANK = "trim(coalesce({}, '')) = ''"
_EDGES = sql_once("graph_edges", "edge_id", "subject_id", "predicate", "object_id")
_CONF = sql_once("graph_edges", "edge_id", "predicate", "confidence")
_SQUEEZED = "regexp_replace(coalesce({}, ''), '\\s+', '', 'g')"
_KEY = f"replace(replace(lower(trim(regexp_replace(translate(coalesce(title, ''), '{T.WIDE.replace(chr(39), chr(39) * 2)}', '{T.NARROW.replace(chr(39), chr(39) * 2)}'), '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"
SQL = {
    "stage_tasks": f"SELECT book_id, page, page % 4 AS shard FROM {_TASKS}",
    "stage_open_tasks": f"SELECT book_id, page FROM {_TASKS} t WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.book_id = t.book_id AND p.physical_page = t.page) OR book_id = (SELECT min(book_id) FROM books)",
    "stage_status": "SELECT source, count(*) AS n, count(*) FILTER (length(text) > 0) AS with_text, count(*) FILTER (extraction_status = 'ok') AS extracted, count(*) FILTER (length(trim(title)) > 0) AS named, count(*) FILTER (has_text_layer) AS with_layer FROM documents GROUP BY source",
    "stage_locked": "SELECT evidence_id, count(*) AS n, count(*) = 1 AS accepted FROM graph_evidence WHERE evidence_id IS NOT NULL GROUP BY 1",
    "stage_confidences": "SELECT problem, count(*) AS n, min(x) AS least, max(x) AS most FROM (SELECT CASE WHEN confidence IS NULL THEN 'missing' WHEN isnan(confidence) THEN 'not_a_number' WHEN confidence < 0 OR confidence > 1 THEN 'out_of_range' ELSE '' END AS problem, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS x FROM graph_edges) GROUP BY 1",
    "stage_denied": """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN split_part(p, '/', -1) = 'thumbs.db' THEN 'name' WHEN starts_with(p, '/private/') OR starts_with(p, 'secrets/') THEN 'prefix'
      WHEN ends_with(p, '.pdf') OR ends_with(p, '.env') OR ends_with(p, '.sqlite') THEN 'suffix' ELSE '' END AS reason FROM (SELECT lower(replace(coalesce(x, ''), '\\', '/')) AS p FROM (SELECT source_path AS x FROM books UNION ALL SELECT source_filename FROM documents))) GROUP BY 1""",
    "stage_overrides": f"""WITH b AS {sql_once('pages', 'page_id', 'text')}, s AS (SELECT page_id, text AS t FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM pages WHERE page_id IS NOT NULL) WHERE n > 1 AND rn = 1)
      SELECT layout, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT CASE WHEN s.page_id IS NULL THEN 'none' WHEN coalesce(t, '') = coalesce(text, '') THEN 'current' ELSE 'stale' END AS layout, CASE WHEN s.page_id IS NOT NULL AND coalesce(t, '') = coalesce(text, '') THEN t || '*' ELSE text END AS text FROM b LEFT JOIN s USING (page_id)) GROUP BY 1""",
    "stage_inside": f"""WITH k AS (SELECT DISTINCT lower(trim(node_id)) AS id FROM graph_nodes WHERE entity_type IN ('Herb', 'FormulaVariant', 'FormulaConcept')) SELECT predicate, count(*) AS n
      FROM (SELECT predicate, lower(trim(subject_id)) AS a, lower(trim(object_id)) AS b FROM {_EDGES}) WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k) AND a <> b GROUP BY 1""",
    "qual_completeness": f"SELECT source, count(*) AS n, round(avg((NOT {_BLANK.format('title')} AND NOT {_BLANK.format('year')} AND NOT {_BLANK.format('sha256')} AND page_count IS NOT NULL)::INT::DOUBLE), 6) AS complete_share FROM documents GROUP BY source",
    "qual_key_sets": "SELECT present, count(*) AS n_keys FROM (SELECT k, string_agg(DISTINCT t, '+' ORDER BY t) AS present FROM (SELECT doc_id AS k, 'documents' AS t FROM documents UNION ALL SELECT doc_id, 'chunks' FROM chunks UNION ALL SELECT doc_id, 'titled' FROM documents WHERE title IS NOT NULL) WHERE k IS NOT NULL GROUP BY k) GROUP BY 1",
    "qual_conserved": f"SELECT *, candidates = kept + dropped AS conserved FROM (SELECT predicate, count(*) AS candidates, count(*) FILTER (confidence >= 0.7) AS kept, count(*) FILTER (confidence < 0.7) AS dropped FROM {_CONF} GROUP BY 1)",
    "dict_collisions": "SELECT form, len(t)::INT AS n_terms, array_to_string(t, ',') AS terms FROM (SELECT lower(trim(f)) AS form, list_sort(list(DISTINCT node_id)) AS t FROM (SELECT node_id, unnest(list_append(coalesce(aliases, []), canonical_name)) AS f FROM graph_nodes) WHERE f IS NOT NULL AND trim(f) <> '' GROUP BY 1) WHERE len(t) > 1",
    "stat_tiers": f"""SELECT CASE WHEN r = 'rejected' OR trim(coalesce(quote, '')) = '' THEN 'eliminated' WHEN r IS NULL OR r <> 'approved' THEN 'provisional' WHEN s >= 0.75 THEN 'high' WHEN s >= 0.6 THEN 'middle' ELSE 'low' END AS tier, count(*) AS n
      FROM (SELECT *, json_extract_string(try_cast(review AS JSON), '$.status') AS r, CASE evidence_grade WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.8 WHEN 'E3' THEN 0.6 WHEN 'E4' THEN 0.4 ELSE 0 END AS s FROM {sql_once('graph_evidence', 'evidence_id', 'evidence_grade', 'review', 'quote')}) GROUP BY 1""",
    "eval_by_category": retrieval.sql_eval(CATEGORIES),
    "eval_question_issues": f"""WITH q AS (SELECT doc_id::VARCHAR AS id, language AS c, section_hint AS h FROM {sql_once('(SELECT * FROM chunks WHERE chunk_index = 0)', 'chunk_id', 'doc_id', 'section_hint', 'language')})
      SELECT id AS record_id, 'error' AS severity, 'question_empty' AS code FROM q WHERE {_BLANK.format('h')} UNION ALL SELECT id, 'error', 'category_missing' FROM q WHERE {_BLANK.format('c')}
      UNION ALL SELECT id, 'error', 'question_id_repeated' FROM q WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""",
    "txt_quotes": f"""SELECT CASE WHEN trim(coalesce(normalized_text, '')) = '' THEN 'no_quote' WHEN contains(lower(coalesce(text, '')), normalized_text) THEN 'exact' WHEN contains({_SQUEEZED.format('lower(text)')}, {_SQUEEZED.format('normalized_text')}) THEN 'normalized_whitespace' ELSE 'missing' END AS status, count(*) AS n
      FROM {sql_once('chunks', 'chunk_id', 'text', 'normalized_text')} GROUP BY 1""",
    "txt_titles": f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(source_filename, ''), '\\.[A-Za-z0-9]{{1,5}}$', ''), '^[0-9]+[\\s._-]*', ''), '\\s*[(\\[_（［【].*$', '')) AS work, {_KEY} AS title_key,
      array_to_string(list_filter([trim(coalesce(lang, '')), trim(coalesce(language, '')), trim(coalesce(source, ''))], lambda x: x <> ''), ';') AS labels FROM documents""",
}

"""Queries of retrieval: keyword, vector, hybrid, two corpora, and their quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import evaluation, fusion, lexical, retrieve, vectors
from scholium.operators.questions import compile_question, plain
from scholium.plans.common import once, sql_grams, sql_in, sql_list, sql_once, sql_search_form, sql_tokens
from scholium.session import read_table

# Questions, with their terms and concept aliases.
QUESTIONS = {
    "q1": ("silver dressing for scald burns", ["silver", "dressing", "scald", "burns"], ["silver dressing"]),
    "q2": ("pain at dressing change", ["pain", "dressing", "change"], ["pain at dressing change"]),
    "q3": ("创面愈合时间", ["创面", "面愈", "愈合", "合时", "时间"], ["愈合时间"]),
    "q4": ("vegf angiogenesis phosphorylation", ["vegf", "angiogenesis", "phosphorylation"], ["vegf"]),
    "q5": ("zebra quantum lattice", ["zebra", "quantum", "lattice"], []),
}
TOP = 10


def _units(spark: SparkSession, d: str) -> DataFrame:
    chunks = once(read_table(spark, d, "chunks"), "chunk_id", "doc_id", "text", "topic_tags", "relevance_score")
    titles = read_table(spark, d, "documents").select("doc_id", "title")
    return chunks.join(titles, "doc_id", "left")


def _sql_units() -> str:
    return f"SELECT c.*, d.title FROM {sql_once('chunks', 'chunk_id', 'doc_id', 'text', 'topic_tags', 'relevance_score')} c LEFT JOIN documents d USING (doc_id)"


def _scores(units: DataFrame) -> DataFrame:
    """Scores from the index of the units, which is made once for their files."""
    fields = lexical.index_fields(F.col("title"), F.col("text"), F.col("topic_tags"))
    index = lexical.kept_index("chunks", [units], lambda: lexical.build_index(units, "chunk_id", fields))
    return lexical.search_index(index, {q: spec[1] for q, spec in QUESTIONS.items()})


def ret_unkept_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of each question by BM25 without an index: one pass that keeps the asked terms only."""
    fields = lexical.index_fields(F.col("title"), F.col("text"), F.col("topic_tags"))
    return lexical.ranked(lexical.bm25(_units(spark, d), "chunk_id", fields, {q: spec[1] for q, spec in QUESTIONS.items()}), "chunk_id", TOP, group=["question_id"])


def ret_keyword_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of each question by BM25."""
    return lexical.ranked(_scores(_units(spark, d)), "chunk_id", TOP, group=["question_id"])


def _sql_bm25(q: str, terms: list[str]) -> str:
    inside = sql_in(terms)
    fields = {"title": (4.0, sql_tokens("title")), "text": (1.0, sql_tokens("text")), "grams": (1.8, sql_grams("concat_ws(chr(10), title, text)")), "tags": (1.5, sql_tokens("topic_tags"))}
    hits = " UNION ALL ".join(f"SELECT chunk_id, unnest({n}_) AS token, {w}::DOUBLE AS w FROM toks" for n, (w, _) in fields.items())
    return f"""
    SELECT '{q}' AS question_id, chunk_id, round(sum(greatest(ln((n_units - df + 0.5) / (df + 0.5)), 1e-6) * (f * 2.2e0) / (f + 1.2e0 * (0.25e0 + 0.75e0 * len / mean_len))), 6) AS score
    FROM (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM (
            SELECT h.chunk_id, token, sum(w) AS f, any_value(len) AS len
            FROM ({hits}) h JOIN lens USING (chunk_id) WHERE token IN {inside} GROUP BY h.chunk_id, token)), total
    GROUP BY chunk_id"""


def _sql_scored() -> str:
    toks = f"toks AS (SELECT chunk_id, {sql_tokens('title')} AS title_, {sql_tokens('text')} AS text_, {sql_grams('concat_ws(chr(10), title, text)')} AS grams_, {sql_tokens('topic_tags')} AS tags_ FROM units)"
    lens = "lens AS (SELECT chunk_id, len(title_) + len(text_) + len(grams_) + len(tags_) AS len FROM toks)"
    total = "total AS (SELECT count(*) AS n_units, avg(len) AS mean_len FROM lens)"
    every = " UNION ALL ".join(_sql_bm25(q, spec[1]) for q, spec in QUESTIONS.items())
    return f"units AS MATERIALIZED ({_sql_units()}), {toks}, {lens}, {total}, scored AS ({every})"


_RANKED = "SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10"


def ret_bm25_rescored(spark: SparkSession, d: str) -> DataFrame:
    """BM25 candidates rescored by whole question, aliases and relevance."""
    units = _units(spark, d)
    hits = lexical.ranked(_scores(units), "chunk_id", max(8 * TOP, 50), group=["question_id"]).drop("rank").join(units, "chunk_id")
    asked = {q: (text, aliases) for q, (text, _, aliases) in QUESTIONS.items()}
    best = lexical.rescored(hits, F.col("title"), F.col("text"), F.col("relevance_score"), asked).select("question_id", "chunk_id", "relevance")
    return lexical.ranked(best, "chunk_id", TOP, "relevance", ["question_id"])


def _form(x: str) -> str:
    return sql_search_form(x)


def _sql_rescored() -> str:
    cases = []
    for q, (text, _, aliases) in QUESTIONS.items():
        t = " OR ".join(f"contains({_form('title')}, '{a}')" for a in aliases) or "false"
        x = " OR ".join(f"contains({_form('text')}, '{a}')" for a in aliases) or "false"
        cases.append(
            f"SELECT question_id, chunk_id, round(score + 5e0 * contains({_form('title')} || ' ' || {_form('text')}, '{text}')::INT + 20e0 * ({t})::INT + 5e0 * ({x})::INT + coalesce(relevance_score, 0) / 1000e0, 6) AS relevance "
            f"FROM (SELECT * FROM scored WHERE question_id = '{q}' ORDER BY score DESC, chunk_id LIMIT 80) JOIN units USING (chunk_id)"
        )
    return f"WITH {_sql_scored()}, again AS ({' UNION ALL '.join(cases)}) SELECT question_id, chunk_id, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, chunk_id) AS rank FROM again) WHERE rank <= 10"


GROUPS = [["silver", "hydrogel"], ["scald", "chemical"], ["dressing"]]


def ret_boolean_groups(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that have a word of every group."""
    return _units(spark, d).where(lexical.matches_groups(T.tokens(F.concat_ws("\n", "title", "text")), GROUPS)).select("chunk_id")


def ret_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the words of a phrase next to each other."""
    toks = T.tokens("text")
    phrases = ["capillary refill", "silver dressing of the donor site", "pin prick sensation"]
    units = _units(spark, d).select("chunk_id", toks.alias("t"))
    return units.select("chunk_id", F.explode(F.array_compact(F.array(*[F.when(lexical.has_phrase(F.col("t"), p), F.lit(p)) for p in phrases]))).alias("phrase"))


def ret_counted_terms(spark: SparkSession, d: str) -> DataFrame:
    """Pages by counted terms, the best of each question."""
    pages = once(read_table(spark, d, "pages"), "page_id", "book_id", "text")
    books = read_table(spark, d, "books").groupBy("book_id").agg(F.min("title").alias("title"))
    units = pages.join(F.broadcast(books), "book_id", "left")
    asked = {"a1": ("熱毒", ["熱毒", "痛"], ["傷科"]), "a2": ("burns", ["burn", "scald"], ["burns"])}
    out = []
    for q, (text, terms, aliases) in asked.items():
        hits = lexical.counted_terms(units, "page_id", F.col("title"), F.col("text"), terms, text, aliases)
        out.append(lexical.ranked(hits, "page_id", TOP).withColumn("question_id", F.lit(q)))
    return out[0].unionByName(out[1])


def _sql_counted() -> str:
    occ = lambda x, t: f"((length({x}) - length(replace({x}, '{t}', ''))) // {len(t)})"
    parts = []
    for q, (text, terms, alias) in {"a1": ("熱毒", ["熱毒", "痛"], "傷科"), "a2": ("burns", ["burn", "scald"], "burns")}.items():
        score = " + ".join(occ("both_", t) for t in terms)
        parts.append(f"SELECT '{q}' AS question_id, page_id, {score} + 4 * contains(both_, '{text}')::INT + 15 * contains(t_, '{alias}')::INT + 4 * contains(x_, '{alias}')::INT AS score FROM u")
    return f"""WITH u AS (SELECT page_id, lower(coalesce(title, '')) AS t_, lower(coalesce(text, '')) AS x_, lower(coalesce(title, '')) || chr(10) || lower(coalesce(text, '')) AS both_
      FROM {sql_once('pages', 'page_id', 'book_id', 'text')} p LEFT JOIN (SELECT book_id, min(title) AS title FROM books GROUP BY 1) b USING (book_id)),
    s AS ({' UNION ALL '.join(parts)})
    SELECT * FROM (SELECT question_id, page_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, page_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def _vector_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    return vectors.top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", k)


def ret_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every fiftieth one."""
    return _vector_hits(spark, d, TOP)


_SQL_UNIT = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)"


def _sql_vector(k: int) -> str:
    return f"""SELECT * FROM (SELECT q.vec_id AS query_id, x.vec_id AS match_id, round(list_dot_product(q.v, x.v), 6) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, x.v), 6) DESC, x.vec_id) AS rank
      FROM {_SQL_UNIT} q JOIN {_SQL_UNIT} x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id) WHERE rank <= {k}"""


def ret_vector_problems(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that cannot be searched."""
    return vectors.broken_vectors(read_table(spark, d, "embeddings"), "vec_id", "embedding", 64)


def _question_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each question's vector: one of the table, as there is no encoder that the vectors were made with."""
    of = spark.createDataFrame([(q, 50 * i) for i, q in enumerate(QUESTIONS)], "unit_id string, vec_id long")
    return read_table(spark, d, "embeddings").join(F.broadcast(of), "vec_id").select("unit_id", "embedding")


def _with_vectors(spark: SparkSession, d: str, units: DataFrame, unit: str, number: str) -> DataFrame:
    """Units with the vector whose place their document's number falls on."""
    rows = read_table(spark, d, "embeddings")
    n = rows.count()
    return units.select(F.col(unit).alias("unit_id"), F.pmod(F.col(number).cast("long"), F.lit(n)).alias("vec_id")).join(rows.select("vec_id", "embedding"), "vec_id")


def _vector_channel(spark: SparkSession, d: str, units: DataFrame, unit: str, number: str, k: int = 100) -> DataFrame:
    found = vectors.top_k(_question_vectors(spark, d), _with_vectors(spark, d, units, unit, number), "unit_id", "embedding", k)
    return found.select(F.col("query_id").alias("question_id"), F.col("match_id").alias("unit_id"), "score", "rank")


def _keyword_channel(units: DataFrame, k: int = 100) -> DataFrame:
    return lexical.ranked(_scores(units), "chunk_id", k, group=["question_id"]).withColumnRenamed("chunk_id", "unit_id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    pages = once(read_table(spark, d, "pages"), "page_id", "book_id", "physical_page", "text")
    books = read_table(spark, d, "books").groupBy("book_id").agg(F.min("title").alias("title"))
    return pages.join(books, "book_id", "left").withColumnRenamed("page_id", "unit_id")


# Questions on the old books; the second names a book and a focus, the last one is not answered.
PAGE_QUESTIONS = ["熱毒 治痛", "《濟囊瘡科集成》中的“熱毒”", "burn plaster with water", "股票 熱毒"]
OUT_OF_SCOPE = ("股票", "天气")


def _asked() -> list[tuple[str, object]]:
    return [(f"q{i}", compile_question(q, out_of_scope=OUT_OF_SCOPE)) for i, q in enumerate(PAGE_QUESTIONS, 1)]


def _page_keyword(pages: DataFrame, k: int = 100) -> DataFrame:
    """Pages of each question: by its locator if it names one, by counted terms otherwise, none if it is out of scope."""
    title, text = T.search_form("title"), T.search_form("text")
    scored = []
    for q, asked in _asked():
        if not asked.in_scope:
            continue
        if asked.title and asked.focus:
            scored.append(retrieve.located(pages, q, title, text, plain(asked.title), [plain(asked.focus)]))
            continue
        hits = lexical.counted_terms(pages, "unit_id", F.col("title"), F.col("text"), asked.terms, asked.text, asked.aliases)
        scored.append(hits.select(F.lit(q).alias("question_id"), "unit_id", F.col("score").cast("double").alias("score")))
    return retrieve.best(reduce(DataFrame.unionByName, scored), k, F.desc("score"), "unit_id")


def ret_pages(spark: SparkSession, d: str) -> DataFrame:
    """The best pages of questions on old books: counted terms, a locator, and a refusal."""
    return _page_keyword(_pages(spark, d), 20)


def ret_rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector channel of the chunks fused by reciprocal ranks, per question."""
    units = _units(spark, d)
    fused = retrieve.fuse(_keyword_channel(units), _vector_channel(spark, d, units, "chunk_id", "doc_id"), 100)
    return fused.select("question_id", F.col("unit_id").alias("chunk_id"), F.round("fusion_score", 8).alias("fusion_score"), "keyword_rank", "vector_rank", F.col("rank").alias("fusion_rank"))


def _groups(units: DataFrame, unit: str, group: str) -> DataFrame:
    return units.select(F.col(unit).alias("unit_id"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group_id"))


def ret_diversified(spark: SparkSession, d: str) -> DataFrame:
    """The fused ranking with at most three chunks of a document."""
    units = _units(spark, d)
    return retrieve.search("hybrid", 20, _groups(units, "chunk_id", "doc_id"), _keyword_channel(units), {"first": _vector_channel(spark, d, units, "chunk_id", "doc_id")})


def _overlaps(units: DataFrame, unit: str, chosen: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """The stand-in for a cross-encoder: the share of the question's terms that a unit has."""
    both = F.concat(T.tokens(F.concat_ws("\n", "title", "text")), T.char_ngrams(F.concat_ws("\n", "title", "text")))
    texts = units.select(F.col(unit).alias("unit_id"), "title", "text").join(chosen.select("unit_id").distinct(), "unit_id", "left_semi").select("unit_id", both.alias("both"))
    share = F.lit(0.0)
    for q, t in terms.items():
        if t:
            share = F.when(F.col("question_id") == q, fusion.overlap_score(t, F.col("both"))).otherwise(share)
    return chosen.select("question_id", "unit_id").join(texts, "unit_id").select("question_id", "unit_id", F.round(share, 6).alias("rerank"))


def ret_reranked_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fused, spread over documents, reranked by shared terms, spread again."""
    units = _units(spark, d)
    keyword, vector = _keyword_channel(units), _vector_channel(spark, d, units, "chunk_id", "doc_id")
    scores = _overlaps(units, "chunk_id", retrieve.fuse(keyword, vector, 100), {q: spec[1] for q, spec in QUESTIONS.items()})
    return retrieve.search("reranked_hybrid", TOP, _groups(units, "chunk_id", "doc_id"), keyword, {"second": vector}, scores)


def _page_channels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pages = _pages(spark, d)
    keyword = _page_keyword(pages)
    vector = _vector_channel(spark, d, pages, "unit_id", "physical_page")
    # A question that names a page, or is out of scope, has no neighbours but these.
    direct = [q for q, asked in _asked() if not asked.in_scope or (asked.title and asked.focus)]
    answered = [q for q, asked in _asked() if asked.in_scope]
    vector = vector.where(F.col("question_id").isin(answered) & ~F.col("question_id").isin(direct))
    named = keyword.where(F.col("question_id").isin(direct)).select("question_id", "unit_id", "score", "rank")
    return pages, keyword, vector.unionByName(named), _groups(pages, "unit_id", "book_id")


def ret_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Pages fused, reranked and guarded: the keyword channel's best ten are kept in front."""
    pages, keyword, vector, group = _page_channels(spark, d)
    every = keyword.select("question_id", "unit_id").unionByName(vector.select("question_id", "unit_id")).distinct()
    scores = _overlaps(pages, "unit_id", every, {q: asked.terms for q, asked in _asked()})
    return retrieve.search_pages("third_reranked_hybrid", TOP, group, keyword, vector, scores)


def ret_two_corpora(spark: SparkSession, d: str) -> DataFrame:
    """Keyword results of chunks and pages as one list, with at least one of the pages."""
    units, pages = _units(spark, d), _pages(spark, d)
    n = retrieve.candidates(TOP)
    modern = retrieve.search("keyword", n, _groups(units, "chunk_id", "doc_id"), _keyword_channel(units), {})
    group = _groups(units, "chunk_id", "doc_id").unionByName(_groups(pages, "unit_id", "book_id"))
    return retrieve.both_corpora(modern, _page_keyword(pages, n), group, TOP)


_SQL_UNIT_VECTORS = "qv AS (SELECT 'q' || (vec_id // 50 + 1) AS question_id, v FROM {u} WHERE vec_id IN (0, 50, 100, 150, 200)), nv AS (SELECT count(*) AS n FROM embeddings)"


def _sql_vector_channel(table: str, unit: str, number: str) -> str:
    return f"""SELECT * FROM (SELECT question_id, {unit} AS unit_id, round(list_dot_product(qv.v, x.v), 6) AS score,
      row_number() OVER (PARTITION BY question_id ORDER BY round(list_dot_product(qv.v, x.v), 6) DESC, {unit}) AS rank
      FROM {table} t, nv, {_SQL_UNIT} x, qv WHERE x.vec_id = t.{number} % nv.n) WHERE rank <= 100"""


def _sql_channels() -> str:
    return f"""{_sql_scored()}, {_SQL_UNIT_VECTORS.format(u=_SQL_UNIT)},
      kw AS (SELECT * FROM (SELECT question_id, chunk_id AS unit_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 100),
      ve AS ({_sql_vector_channel('units', 'chunk_id', 'doc_id')})"""


def _sql_fuse(kw: str, ve: str, k: int, w: float = 1.5) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fusion_score DESC, least(keyword_rank, vector_rank), unit_id) AS rank
      FROM (SELECT question_id, unit_id, round(sum(s), 10) AS fusion_score, min(kr) AS keyword_rank, min(vr) AS vector_rank FROM (
        SELECT question_id, unit_id, {w}::DOUBLE / (60 + rank) AS s, rank AS kr, NULL AS vr FROM {kw} UNION ALL SELECT question_id, unit_id, 1e0 / (60 + rank), NULL, rank FROM {ve}) GROUP BY 1, 2)) WHERE rank <= {k}"""


def _sql_spread(table: str, k: int, groups: str = "group_id", cap: int = 3) -> str:
    return f"""SELECT * EXCLUDE (rank, n_), row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY question_id, {groups} ORDER BY rank) AS n_ FROM {table}) WHERE n_ <= {cap} QUALIFY rank <= {k}""".replace("QUALIFY rank", "QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank)")


_SQL_OF_UNIT = "(SELECT chunk_id AS unit_id, coalesce(doc_id::VARCHAR, '') AS group_id, title, text FROM units)"
_SQL_PAGES = f"pg AS MATERIALIZED (SELECT page_id AS unit_id, coalesce(book_id, '') AS group_id, physical_page, text, title FROM {sql_once('pages', 'page_id', 'book_id', 'physical_page', 'text')} LEFT JOIN (SELECT book_id, min(title) AS title FROM books GROUP BY 1) USING (book_id))"


def _sql_page_keyword(k: int) -> str:
    occ = lambda x, t: f"((length({x}) - length(replace({x}, '{t}', ''))) // {len(t)})"
    parts = []
    for q, asked in _asked():
        if not asked.in_scope:
            continue
        if asked.title and asked.focus:
            t, f = plain(asked.title), plain(asked.focus)
            parts.append(f"SELECT '{q}' AS question_id, unit_id, 100e0 + {occ('x_', f)} AS score FROM pf WHERE (contains(t_, '{t}') OR (t_ <> '' AND contains('{t}', t_))) AND contains(x_, '{f}')")
            continue
        score = " + ".join(occ("both_", t) for t in asked.terms)
        parts.append(f"SELECT '{q}' AS question_id, unit_id, ({score} + 4 * contains(both_, '{asked.text.lower()}')::INT)::DOUBLE AS score FROM pf WHERE {score} + 4 * contains(both_, '{asked.text.lower()}')::INT > 0")
    return f"""pf AS (SELECT unit_id, {sql_search_form('title')} AS t_, {sql_search_form('text')} AS x_, lower(coalesce(title, '')) || chr(10) || lower(coalesce(text, '')) AS both_ FROM pg),
      pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS rank FROM ({' UNION ALL '.join(parts)})) WHERE rank <= {k})"""


def _sql_overlap(table: str, texts: str, terms: dict[str, list[str]]) -> str:
    x = "concat_ws(chr(10), title, text)"
    cases = " ".join(f"WHEN question_id = '{q}' THEN len(list_intersect({sql_tokens(x)} || {sql_grams(x)}, {sql_list(dict.fromkeys(t))})) / {len(dict.fromkeys(t))}.0::DOUBLE" for q, t in terms.items() if t)
    return f"SELECT question_id, unit_id, round(CASE {cases} ELSE 0 END, 6) AS rerank FROM {table} JOIN {texts} USING (unit_id)"


def _sql_reranked_hybrid() -> str:
    return f"""WITH {_sql_channels()}, fu AS ({_sql_fuse('kw', 've', 100)}), fg AS (SELECT f.*, group_id FROM fu f JOIN {_SQL_OF_UNIT} USING (unit_id)),
      ch AS ({_sql_spread('fg', 100)}), sc AS ({_sql_overlap('fu', _SQL_OF_UNIT, {q: s[1] for q, s in QUESTIONS.items()})}),
      rr AS (SELECT question_id, unit_id, group_id, row_number() OVER (PARTITION BY question_id ORDER BY rerank DESC, fusion_score DESC, unit_id) AS rank FROM ch JOIN sc USING (question_id, unit_id))
      SELECT question_id, unit_id, rank FROM ({_sql_spread('rr', TOP)})"""


def _sql_guarded() -> str:
    direct = [q for q, asked in _asked() if not asked.in_scope or (asked.title and asked.focus)]
    answered = [q for q, asked in _asked() if asked.in_scope and not (asked.title and asked.focus)]
    return f"""WITH {_SQL_PAGES}, {_sql_page_keyword(100)}, {_SQL_UNIT_VECTORS.format(u=_SQL_UNIT)},
      pv AS (SELECT question_id, unit_id, rank FROM ({_sql_vector_channel('pg', 'unit_id', 'physical_page')}) WHERE question_id IN {sql_in(answered)} UNION ALL SELECT question_id, unit_id, rank FROM pk WHERE question_id IN {sql_in(direct)}),
      fu AS ({_sql_fuse('pk', 'pv', 100)}), fg AS (SELECT f.*, group_id FROM fu f JOIN pg USING (unit_id)), ch AS ({_sql_spread('fg', 100)}),
      al AS (SELECT question_id, unit_id, fusion_score FROM ch UNION ALL SELECT question_id, unit_id, NULL FROM pk WHERE rank <= {TOP} AND (question_id, unit_id) NOT IN (SELECT question_id, unit_id FROM ch)),
      sc AS ({_sql_overlap('al', 'pg', {q: asked.terms for q, asked in _asked()})}),
      rr AS (SELECT question_id, unit_id, row_number() OVER (PARTITION BY question_id ORDER BY rerank DESC, coalesce(fusion_score, 0) DESC, unit_id) AS r FROM al JOIN sc USING (question_id, unit_id)),
      gd AS (SELECT rr.*, pk.unit_id IS NOT NULL AS p FROM rr LEFT JOIN (SELECT * FROM pk WHERE rank <= {TOP}) pk USING (question_id, unit_id))
      SELECT question_id, unit_id, row_number() OVER (PARTITION BY question_id ORDER BY p DESC, r) AS rank FROM gd QUALIFY rank <= {TOP}"""


def _sql_two_corpora() -> str:
    n = retrieve.candidates(TOP)
    return f"""WITH {_sql_scored()}, {_SQL_PAGES}, {_sql_page_keyword(n)},
      kw AS (SELECT * FROM (SELECT question_id, chunk_id AS unit_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 100),
      kg AS (SELECT k.*, group_id FROM kw k JOIN {_SQL_OF_UNIT} USING (unit_id)), mo AS ({_sql_spread('kg', n)}),
      fu AS ({_sql_fuse('mo', 'pk', 2 * n, 1.0)}), gr AS (SELECT unit_id, group_id FROM {_SQL_OF_UNIT} UNION ALL SELECT unit_id, group_id FROM pg),
      fg AS (SELECT f.*, CASE WHEN vector_rank IS NULL THEN 'modern' ELSE 'ancient' END AS corpus, group_id FROM fu f JOIN gr USING (unit_id)),
      ch AS (SELECT question_id, unit_id, corpus, rank FROM ({_sql_spread('fg', TOP, 'corpus, group_id')})),
      lo AS (SELECT question_id, unit_id FROM pk WHERE rank = 1 AND question_id NOT IN (SELECT question_id FROM ch WHERE corpus = 'ancient')),
      la AS (SELECT lo.*, 'ancient' AS corpus, coalesce((SELECT least(count(*) + 1, {TOP}) FROM ch WHERE ch.question_id = lo.question_id), 1) AS rank FROM lo)
      SELECT ch.* FROM ch LEFT JOIN la ON la.question_id = ch.question_id WHERE la.rank IS NULL OR ch.rank < la.rank UNION ALL SELECT * FROM la"""


def ret_reranked(spark: SparkSession, d: str) -> DataFrame:
    """BM25 candidates ordered by the share of the question's words they have."""
    units = _units(spark, d)
    hits = lexical.ranked(_scores(units), "chunk_id", 100, group=["question_id"]).drop("rank").join(units.select("chunk_id", "title", "text"), "chunk_id")
    both = F.concat(T.tokens(F.concat_ws("\n", "title", "text")), T.char_ngrams(F.concat_ws("\n", "title", "text"), 2, 2))
    share = F.lit(0.0)
    for q, (_, terms, _) in QUESTIONS.items():
        share = F.when(F.col("question_id") == q, fusion.overlap_score(terms, F.col("both"))).otherwise(share)
    scored = hits.select("question_id", "chunk_id", "score", both.alias("both")).select("question_id", "chunk_id", "score", F.round(share, 6).alias("rerank"))
    return lexical.ranked(scored, "chunk_id", TOP, "rerank", ["question_id"], ["score"])


def _sql_reranked() -> str:
    text = "concat_ws(chr(10), title, text)"
    parts = [
        f"SELECT question_id, chunk_id, score, round(len(list_intersect({sql_tokens(text)} || {sql_grams(text, 2, 2)}, {sql_list(spec[1])})) / {len(spec[1])}.0::DOUBLE, 6) AS rerank FROM (SELECT * FROM scored WHERE question_id = '{q}' ORDER BY score DESC, chunk_id LIMIT 100) JOIN units USING (chunk_id)"
        for q, spec in QUESTIONS.items()
    ]
    return f"WITH {_sql_scored()}, again AS ({' UNION ALL '.join(parts)}) SELECT * FROM (SELECT question_id, chunk_id, score, rerank, row_number() OVER (PARTITION BY question_id ORDER BY rerank DESC, score DESC, chunk_id) AS rank FROM again) WHERE rank <= 10"


def ret_snippets(spark: SparkSession, d: str) -> DataFrame:
    """A snippet of every chunk around the first of some terms."""
    return _units(spark, d).where("text is not null").select("chunk_id", T.snippet("text", ["silver", "愈合"], 120).alias("snippet"))


_SQL_SNIPPET = f"""SELECT chunk_id, (CASE WHEN s > 0 THEN '…' ELSE '' END) || replace(substring(text, s + 1, 120), chr(10), ' ') || (CASE WHEN s + 120 < length(text) THEN '…' ELSE '' END) AS snippet
  FROM (SELECT chunk_id, text, greatest(0, coalesce(least(nullif(instr(lower(text), 'silver'), 0), nullif(instr(lower(text), '愈合'), 0)), 1) - 1 - 40) AS s
        FROM {sql_once('chunks', 'chunk_id', 'doc_id', 'text', 'topic_tags', 'relevance_score')} WHERE text IS NOT NULL)"""


def ret_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A page by its book and number; the filter reaches the scan."""
    pages = read_table(spark, d, "pages").where("physical_page = 7")
    return once(pages, "page_id", "book_id", "physical_page", "text").select("page_id", "book_id", "physical_page", F.length("text").alias("n_chars"))


def expected_units(spark: SparkSession, d: str) -> DataFrame:
    """``question_id, expected``: the chunks that hold a question's whole alias."""
    units = _units(spark, d).select("chunk_id", T.search_form("text").alias("t"))
    asked = []
    for q, (_, _, aliases) in QUESTIONS.items():
        test = reduce(lambda a, b: a | b, [F.col("t").contains(a) for a in aliases], F.lit(False))
        asked.append(units.where(test).agg(F.collect_set("chunk_id").alias("expected")).select(F.lit(q).alias("question_id"), "expected"))
    return reduce(DataFrame.unionByName, asked)


def eval_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and refusals of the keyword retrieval against the chunks that hold the whole alias."""
    ranked = ret_keyword_bm25(spark, d).select("question_id", F.col("chunk_id").alias("unit_id"), "rank")
    return evaluation.retrieval_quality(ranked, expected_units(spark, d))


def sql_eval(categories: dict[str, str] | None = None) -> str:
    want = " UNION ALL ".join(
        f"SELECT '{q}' AS question_id, chunk_id FROM units WHERE {' OR '.join(f'contains({_form('text')}, ' + chr(39) + a + chr(39) + ')' for a in spec[2]) or 'false'}" for q, spec in QUESTIONS.items()
    )
    kind = "CASE q.question_id " + " ".join(f"WHEN '{q}' THEN '{c}'" for q, c in categories.items()) + " END AS category, " if categories else ""
    return f"""WITH {_sql_scored()}, top AS ({_RANKED}), want AS ({want}), q AS (SELECT unnest({sql_list(QUESTIONS)}) AS question_id),
    f AS (SELECT {kind}q.question_id, (SELECT count(*) FROM want w WHERE w.question_id = q.question_id) > 0 AS a,
      (SELECT min(rank) FROM top t JOIN want w USING (question_id, chunk_id) WHERE t.question_id = q.question_id) AS r, (SELECT count(*) FROM top t WHERE t.question_id = q.question_id) AS n FROM q)
    SELECT {'category, ' if categories else ''}count(*) AS n_questions, round(avg(CASE WHEN a THEN coalesce((r <= 5)::INT, 0)::DOUBLE END), 6) AS recall_5, round(avg(CASE WHEN a THEN coalesce((r <= 10)::INT, 0)::DOUBLE END), 6) AS recall_10,
      round(avg(CASE WHEN a THEN coalesce(CASE WHEN r <= 10 THEN 1e0 / r END, 0e0) END), 6) AS mrr_10, round(avg(CASE WHEN NOT a THEN (n = 0)::INT::DOUBLE END), 6) AS refusal_accuracy FROM f{' GROUP BY category' if categories else ''}"""


QUERIES = {
    f.__name__: f
    for f in (
        ret_keyword_bm25, ret_unkept_bm25, ret_bm25_rescored, ret_boolean_groups, ret_phrases, ret_counted_terms, ret_vector_topk, ret_vector_problems, ret_rrf_hybrid,
        ret_diversified, ret_guarded, ret_two_corpora, ret_reranked, ret_reranked_hybrid, ret_pages, ret_snippets, ret_point_lookup, eval_retrieval,
    )
}
_TOKENS = sql_tokens("concat_ws(chr(10), title, text)")
SQL = {
    "ret_keyword_bm25": f"WITH {_sql_scored()} {_RANKED}",
    "ret_bm25_rescored": _sql_rescored(),
    "ret_boolean_groups": f"SELECT chunk_id FROM ({_sql_units()}) WHERE " + " AND ".join(f"list_has_any({_TOKENS}, {sql_list(g)})" for g in GROUPS),
    "ret_phrases": " UNION ALL ".join(
        f"SELECT chunk_id, '{p}' AS phrase FROM ({_sql_units()}) WHERE contains(' ' || array_to_string({sql_tokens('text')}, ' ') || ' ', ' {p} ')"
        for p in ("capillary refill", "silver dressing of the donor site", "pin prick sensation")
    ),
    "ret_counted_terms": _sql_counted(),
    "ret_vector_topk": _sql_vector(TOP),
    "ret_vector_problems": """SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension'
      WHEN list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) THEN 'not_finite' ELSE 'zero' END AS problem
      FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64 OR list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
        OR sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) < 1e-8""",
    "ret_unkept_bm25": f"WITH {_sql_scored()} {_RANKED}",
    "ret_rrf_hybrid": f"WITH {_sql_channels()} SELECT question_id, unit_id AS chunk_id, round(fusion_score, 8) AS fusion_score, keyword_rank, vector_rank, rank AS fusion_rank FROM ({_sql_fuse('kw', 've', 100)})",
    "ret_diversified": f"WITH {_sql_channels()}, fu AS ({_sql_fuse('kw', 've', 100)}), fg AS (SELECT f.*, group_id FROM fu f JOIN {_SQL_OF_UNIT} USING (unit_id)) SELECT question_id, unit_id, rank FROM ({_sql_spread('fg', 20)})",
    "ret_guarded": _sql_guarded(),
    "ret_two_corpora": _sql_two_corpora(),
    "ret_reranked_hybrid": _sql_reranked_hybrid(),
    "ret_pages": f"WITH {_SQL_PAGES}, {_sql_page_keyword(20)} SELECT question_id, unit_id, score, rank FROM pk",
    "ret_reranked": _sql_reranked(),
    "ret_snippets": _SQL_SNIPPET,
    "ret_point_lookup": f"SELECT page_id, book_id, physical_page, length(text) AS n_chars FROM {sql_once('(SELECT * FROM pages WHERE physical_page = 7)', 'page_id', 'book_id', 'physical_page', 'text')}",
    "eval_retrieval": sql_eval(),
}

"""Queries over the evidence graph and the statistics on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import graph as G
from scholium.operators import sequences, stats
from scholium.operators.components import connected_components
from scholium.plans.common import sql_in
from scholium.session import durable, read_table

_SRC = "source_id, source_type, title, file_sha256"
# Columns of each table in the order in which the last row is chosen.
_COLS = {
    "sources": ("graph_sources", "source_id", ["source_type", "title", "file_sha256", "deleted_at"]),
    "nodes": ("graph_nodes", "node_id", ["entity_type", "canonical_name", "layer", "deleted_at"]),
    "evidence": ("graph_evidence", "evidence_id", ["source_id", "quote", "quote_sha256", "evidence_grade", "evidence_class", "review", "locator", "deleted_at"]),
    "edges": ("graph_edges", "edge_id", ["subject_id", "predicate", "object_id", "evidence_ids", "evidence_grade", "assertion_mode", "confidence", "review_status"]),
}


def _graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: G.current(read_table(spark, d, t).select(k, "loaded_at", *cols), k) for n, (t, k, cols) in _COLS.items()}


def _kept(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The same, each table written once: for queries that read one several times."""
    return {n: durable(df) for n, df in _graph(spark, d).items()}


def _sql_current(name: str) -> str:
    t, k, cols = _COLS[name]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("loaded_at", *cols))
    alive = " AND (deleted_at IS NULL OR deleted_at > loaded_at)" if "deleted_at" in cols else ""
    return f"(SELECT * FROM (SELECT {k}, loaded_at, {', '.join(cols)}, row_number() OVER (PARTITION BY {k} ORDER BY {order}) AS rn FROM {t} WHERE {k} IS NOT NULL) WHERE rn = 1{alive})"


_WITH = ", ".join(f"{n[0] if n != 'edges' else 'g'} AS MATERIALIZED {_sql_current(n)}" for n in _COLS)  # s, n, e, g


def graph_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every broken integrity rule of the graph as it stands."""
    return G.validate(**_kept(spark, d))


_GRADE = "list_position(['E1','E2','E3','E4','E5'], {})"
_STATUS = "json_extract_string(try_cast(review AS JSON), '$.status')"
_SQL_ISSUES = f"""WITH {_WITH},
  cited AS (SELECT edge_id, coalesce({_GRADE.format('evidence_grade')}, 0) AS eg, lower(trim(unnest(CASE WHEN len(evidence_ids) > 0 THEN evidence_ids ELSE [NULL] END))) AS id FROM g),
  found AS (SELECT c.edge_id, eg, count(*) FILTER (x.id IS NULL) AS n_absent, min(x.gr) AS best FROM cited c LEFT JOIN (SELECT lower(trim(evidence_id)) AS id, coalesce({_GRADE.format('evidence_grade')}, 0) AS gr FROM e) x USING (id) GROUP BY 1, 2)
  SELECT source_id AS record_id, 'error' AS severity, 'source_title_missing' AS code FROM s WHERE trim(coalesce(title, '')) = ''
  UNION ALL SELECT source_id, 'error', 'source_sha256_invalid' FROM s WHERE source_type LIKE '%pdf' AND NOT regexp_matches(coalesce(file_sha256, ''), '^[0-9a-f]{{64}}$')
  UNION ALL SELECT node_id, 'error', 'canonical_name_missing' FROM n WHERE trim(coalesce(canonical_name, '')) = ''
  UNION ALL SELECT evidence_id, 'error', 'evidence_grade_invalid' FROM e WHERE evidence_grade IS NULL OR evidence_grade NOT IN {sql_in(G.GRADES)}
  UNION ALL SELECT evidence_id, 'error', 'evidence_class_invalid' FROM e WHERE evidence_class IS NULL OR evidence_class NOT IN {sql_in(G.CLASSES)}
  UNION ALL SELECT evidence_id, 'error', 'evidence_review_status_invalid' FROM e WHERE {_STATUS} IS NULL OR {_STATUS} NOT IN {sql_in(G.REVIEW)}
  UNION ALL SELECT evidence_id, 'error', 'quote_sha256_mismatch' FROM e WHERE quote_sha256 IS NULL OR quote IS NULL OR quote_sha256 <> sha256(quote)
  UNION ALL SELECT evidence_id, 'error', 'e1_quote_missing' FROM e WHERE evidence_grade = 'E1' AND trim(coalesce(quote, '')) = ''
  UNION ALL SELECT evidence_id, 'warning', 'evidence_review_pending' FROM e WHERE coalesce({_STATUS}, 'pending') = 'pending'
  UNION ALL SELECT edge_id, 'error', 'edge_grade_invalid' FROM g WHERE evidence_grade IS NULL OR evidence_grade NOT IN {sql_in(G.GRADES)}
  UNION ALL SELECT edge_id, 'error', 'assertion_mode_invalid' FROM g WHERE assertion_mode IS NULL OR assertion_mode NOT IN {sql_in(G.MODES)}
  UNION ALL SELECT edge_id, 'error', 'edge_review_status_invalid' FROM g WHERE review_status IS NULL OR review_status NOT IN {sql_in(G.REVIEW)}
  UNION ALL SELECT edge_id, 'error', 'confidence_out_of_range' FROM g WHERE confidence IS NULL OR confidence < 0 OR confidence > 1
  UNION ALL SELECT edge_id, 'error', 'rejected_edge_present' FROM g WHERE review_status = 'rejected'
  UNION ALL SELECT edge_id, 'warning', 'edge_review_pending' FROM g WHERE coalesce(review_status, 'pending') = 'pending'
  UNION ALL SELECT edge_id, 'error', 'edge_evidence_missing' FROM found WHERE n_absent > 0
  UNION ALL SELECT edge_id, 'error', 'edge_grade_overstated' FROM found WHERE eg > 0 AND eg < best
  UNION ALL SELECT evidence_id, 'error', 'evidence_source_missing' FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE lower(trim(s.source_id)) = lower(trim(e.source_id)))
  UNION ALL SELECT edge_id, 'error', 'edge_subject_missing' FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE lower(trim(n.node_id)) = lower(trim(g.subject_id)))
  UNION ALL SELECT edge_id, 'error', 'edge_object_missing' FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE lower(trim(n.node_id)) = lower(trim(g.object_id)))"""


def graph_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each integrity rule is broken."""
    return G.validate(**_kept(spark, d)).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def graph_traceability(spark: SparkSession, d: str) -> DataFrame:
    """Share of edges of each predicate whose evidence and sources all exist."""
    g = _graph(spark, d)
    t = G.traceable(g["edges"], g["evidence"], g["sources"])
    return g["edges"].join(t, "edge_id").groupBy("predicate").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg(F.col("traceable").cast("double")), 6).alias("traceable_share"))


_SQL_TRACE = f"""WITH {_WITH}, ok AS (SELECT DISTINCT lower(trim(evidence_id)) AS id FROM e WHERE lower(trim(source_id)) IN (SELECT lower(trim(source_id)) FROM s)
    AND trim(coalesce(locator, '')) NOT IN ('', '{{}}', 'null') AND (coalesce(quote, '') = '' OR quote_sha256 = sha256(quote))),
  c AS (SELECT edge_id, predicate, lower(trim(unnest(CASE WHEN len(evidence_ids) > 0 THEN evidence_ids ELSE [NULL] END))) AS id FROM g),
  t AS (SELECT edge_id, predicate, bool_and(ok.id IS NOT NULL) AS t FROM c LEFT JOIN ok USING (id) GROUP BY 1, 2)
  SELECT predicate, count(*) AS n_edges, round(avg(t::INT::DOUBLE), 6) AS traceable_share FROM t GROUP BY predicate"""


def graph_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Size of the sub-graph of confident edges, part by part."""
    g = _graph(spark, d)
    parts = G.promote(g["edges"], g["evidence"], g["nodes"], g["sources"], 0.7)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_SQL_PROMOTED = f"""WITH {_WITH}, kept AS (SELECT * FROM e WHERE coalesce({_STATUS}, 'pending') <> 'rejected'), strong AS (SELECT * FROM g WHERE confidence BETWEEN 0.7 AND 1),
  held AS (SELECT DISTINCT edge_id, id FROM (SELECT edge_id, lower(trim(unnest(evidence_ids))) AS id FROM strong) WHERE id IN (SELECT lower(trim(evidence_id)) FROM kept)),
  pe AS (SELECT * FROM strong WHERE edge_id IN (SELECT edge_id FROM held)), pv AS (SELECT * FROM kept WHERE lower(trim(evidence_id)) IN (SELECT id FROM held))
  SELECT 'edges' AS part, count(*) AS n FROM pe UNION ALL SELECT 'evidence', count(*) FROM pv
  UNION ALL SELECT 'nodes', count(*) FROM n WHERE lower(trim(node_id)) IN (SELECT lower(trim(subject_id)) FROM pe WHERE subject_id IS NOT NULL UNION SELECT lower(trim(object_id)) FROM pe WHERE object_id IS NOT NULL)
  UNION ALL SELECT 'sources', count(*) FROM s WHERE lower(trim(source_id)) IN (SELECT lower(trim(source_id)) FROM pv WHERE source_id IS NOT NULL)"""


# The schema of the evidence graph.
SCHEMA = G.Schema(
    {"Passage": "L1", "Disease": "L2", "Syndrome": "L2", "BurnStage": "L2", "TreatmentMethod": "L3", "FormulaVariant": "L4", "FormulaConcept": "L4", "Herb": "L5", "Compound": "EXT", "Target": "EXT"},
    {
        "RECORDED_IN": ([], ["Passage"], [], ["explicit"], False),
        "HAS_TREATMENT_METHOD": (["Disease", "Syndrome", "BurnStage"], ["TreatmentMethod"], [], [], False),
        "REPRESENTATIVE_FORMULA": (["TreatmentMethod"], ["FormulaVariant", "FormulaConcept"], [], [], False),
        "HAS_INGREDIENT": (["FormulaVariant", "FormulaConcept"], ["Herb"], ["E1", "E2", "E3"], [], False),
        "VARIANT_OF": (["FormulaVariant"], ["FormulaConcept"], [], [], False),
        "MENTIONS": ([], [], [], [], False), "SAME_AS": ([], [], [], [], True), "BROADER_THAN": ([], [], [], ["explicit", "inferred"], True),
    },
)


def graph_schema_issues(spark: SparkSession, d: str) -> DataFrame:
    """What the schema does not allow in the graph as it stands, as a release."""
    g = _kept(spark, d)
    return G.schema_issues(SCHEMA, g["nodes"], g["evidence"], g["edges"], release=True)


def _sql_schema() -> str:
    kinds = f"CASE entity_type {' '.join(f'WHEN {chr(39)}{t}{chr(39)} THEN {chr(39)}{x}{chr(39)}' for t, x in SCHEMA.layers.items())} END"
    parts = [
        f"SELECT node_id AS record_id, 'unknown_entity_type' AS code FROM n WHERE {kinds} IS NULL",
        f"SELECT node_id, 'node_layer_mismatch' FROM n WHERE {kinds} IS NOT NULL AND layer IS DISTINCT FROM {kinds}",
        "SELECT evidence_id, 'e1_page_locator_missing' FROM e WHERE evidence_grade = 'E1' AND json_extract_string(try_cast(locator AS JSON), '$.pdf_page') IS NULL AND json_extract_string(try_cast(locator AS JSON), '$.page_id') IS NULL",
        f"SELECT evidence_id, 'direct_ancient_grade_invalid' FROM e WHERE evidence_class = 'direct_ancient' AND (evidence_grade IS NULL OR evidence_grade NOT IN {sql_in(SCHEMA.direct_grades)})",
        f"SELECT evidence_id, 'evidence_not_approved' FROM e WHERE coalesce({_STATUS}, '') <> 'approved'",
        f"SELECT edge_id, 'unknown_predicate' FROM t WHERE predicate IS NULL OR predicate NOT IN {sql_in(SCHEMA.predicates)}",
        "SELECT edge_id, 'edge_not_approved' FROM t WHERE review_status IS DISTINCT FROM 'approved'",
    ]
    codes = ("predicate_source_type_invalid", "predicate_target_type_invalid", "predicate_grade_invalid", "predicate_mode_invalid")
    for p, (*allowed, same) in SCHEMA.predicates.items():
        parts += [f"SELECT edge_id, '{code}' FROM t WHERE predicate = '{p}' AND {c} NOT IN {sql_in(a)}" for code, c, a in zip(codes, ("st", "ot", "evidence_grade", "assertion_mode"), allowed) if a]
        if same:
            parts.append(f"SELECT edge_id, 'predicate_same_type_required' FROM t WHERE predicate = '{p}' AND st <> ot")
    return f"""WITH {_WITH}, k AS (SELECT lower(trim(node_id)) AS id, min(entity_type) AS type FROM n GROUP BY 1),
      t AS (SELECT g.*, ks.type AS st, ko.type AS ot FROM g LEFT JOIN k ks ON ks.id = lower(trim(subject_id)) LEFT JOIN k ko ON ko.id = lower(trim(object_id)))
      SELECT record_id, 'error' AS severity, code FROM ({' UNION ALL '.join(parts)})"""


def graph_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the graph may be released: shares of traceable edges and of approved records against their least."""
    g = _graph(spark, d)
    t = G.traceable(g["edges"], g["evidence"], g["sources"])
    m = g["edges"].join(t, "edge_id").agg(F.avg(F.col("traceable").cast("double")).alias("traceable"), F.avg(F.coalesce(F.col("review_status") == "approved", F.lit(False)).cast("double")).alias("approved"))
    return G.release_gate(m, {"traceable": 1.0, "approved": 0.5})


def graph_rekeyed(spark: SparkSession, d: str) -> DataFrame:
    """Confident edges with the evidence that is not rejected, and the ids that follow from it."""
    g = _graph(spark, d)
    kept = g["evidence"].where(F.coalesce(F.get_json_object("review", "$.status"), F.lit("pending")) != "rejected")
    return G.rekeyed(g["edges"].where("confidence between 0.7 and 1"), kept).select("edge_id", "old_edge_id", F.array_join("evidence_ids", ",").alias("evidence"))


_SQL_REKEYED = f"""WITH {_WITH}, c AS (SELECT edge_id, list_sort(list(DISTINCT id)) AS ids FROM (SELECT edge_id, lower(trim(unnest(evidence_ids))) AS id FROM g WHERE confidence BETWEEN 0.7 AND 1)
    WHERE id IN (SELECT lower(trim(evidence_id)) FROM e WHERE coalesce({_STATUS}, 'pending') <> 'rejected') GROUP BY 1)
  SELECT 'kg:assertion:' || left(sha256('edge' || chr(10) || '{{"assertion_mode":' || coalesce(to_json(assertion_mode)::VARCHAR, 'null') || ',"evidence_ids":' || to_json(ids)::VARCHAR || ',"object_id":' || coalesce(to_json(lower(trim(object_id)))::VARCHAR, 'null') || ',"predicate":' || coalesce(to_json(predicate)::VARCHAR, 'null') || ',"subject_id":' || coalesce(to_json(lower(trim(subject_id)))::VARCHAR, 'null') || '}}'), 24) AS edge_id,
    edge_id AS old_edge_id, array_to_string(ids, ',') AS evidence FROM g JOIN c USING (edge_id)"""


def graph_collected(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that several variants belong to, with these."""
    g = _graph(spark, d)
    return G.collected(g["edges"], g["nodes"], "VARIANT_OF")


_SQL_NAMES = "nm AS (SELECT lower(trim(node_id)) AS id, min(canonical_name) AS name FROM n GROUP BY 1)"
_SQL_COLLECTED = f"""WITH {_WITH}, {_SQL_NAMES}, l AS (SELECT DISTINCT lower(trim(subject_id)) AS a, lower(trim(object_id)) AS b FROM g WHERE predicate = 'VARIANT_OF'),
  m AS (SELECT b, list_sort(list(DISTINCT a || '=' || coalesce(name, ''))) AS m FROM l JOIN nm ON nm.id = a GROUP BY b)
  SELECT b AS object_id, name, len(m)::INT AS n, array_to_string(m, ',') AS members FROM m JOIN nm ON nm.id = b WHERE len(m) >= 2"""


def graph_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Every edge's statement with its evidence and source."""
    g = _graph(spark, d)
    return G.assertions(g["edges"], g["nodes"], g["evidence"], g["sources"])


_SQL_ASSERTIONS = f"""WITH {_WITH}, {_SQL_NAMES}, c AS (SELECT DISTINCT edge_id, predicate, s, o, lower(trim(x)) AS ev FROM (SELECT edge_id, predicate, lower(trim(subject_id)) AS s, lower(trim(object_id)) AS o, unnest(evidence_ids) AS x FROM g))
  SELECT edge_id, predicate, a.name AS subject, b.name AS object, ev AS evidence_id, e.evidence_grade, e.locator, e.quote, s.title, s.file_sha256
  FROM c JOIN nm a ON a.id = c.s JOIN nm b ON b.id = c.o JOIN e ON lower(trim(e.evidence_id)) = ev JOIN s ON lower(trim(s.source_id)) = lower(trim(e.source_id))"""

TREATMENT = ["<RECORDED_IN", "HAS_TREATMENT_METHOD", "REPRESENTATIVE_FORMULA", "HAS_INGREDIENT"]


def graph_treatment_paths(spark: SparkSession, d: str) -> DataFrame:
    """Chains from a passage over what it records to methods, formulas and herbs, by the entity types they pass."""
    g = _graph(spark, d)
    return G.paths(g["edges"], g["nodes"], TREATMENT)


def _sql_paths(steps: list[str]) -> str:
    n = len(steps)
    ends = [("b", "a") if s.startswith("<") else ("a", "b") for s in steps]
    joins = "".join(f" JOIN p p{i} ON p{i}.{ends[i][0]} = p{i - 1}.{ends[i - 1][1]} AND p{i}.predicate = '{steps[i].lstrip('<')}'" for i in range(1, n))
    at = [f"p0.{ends[0][0]}", *[f"p{i}.{ends[i][1]}" for i in range(n)]]
    kinds = "".join(f" JOIN k k{i} ON k{i}.id = {x}" for i, x in enumerate(at))
    return f"""WITH {_WITH}, k AS (SELECT DISTINCT lower(trim(node_id)) AS id, entity_type AS t FROM n), p AS (SELECT predicate, lower(trim(subject_id)) AS a, lower(trim(object_id)) AS b FROM g)
      SELECT concat_ws('>', {', '.join(f'k{i}.t' for i in range(n + 1))}) AS types, count(*) AS n_paths FROM (SELECT * FROM p WHERE predicate = '{steps[0].lstrip('<')}') p0{joins}{kinds} GROUP BY 1"""


def graph_union(spark: SparkSession, d: str) -> DataFrame:
    """Edges of two loads (odd and even months) as one: keys whose content differs between rows are conflicts."""
    edges = read_table(spark, d, "graph_edges").where("edge_id is not null")
    odd = F.pmod(F.month("loaded_at"), F.lit(2)) == 1
    content = ["subject_id", "predicate", "object_id", "confidence"]
    return G.united(edges.where(odd), edges.where(~odd), "edge_id", content).groupBy("n_versions", "n_rows").agg(F.count(F.lit(1)).alias("n_edges"))


def graph_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same assertion made several times, as one with all its evidence."""
    out = G.merged_assertions(_graph(spark, d)["edges"]).where("subject_id <> '' and object_id <> ''")
    return out.select("subject_id", "predicate", "object_id", "confidence", F.array_join("evidence_ids", ",").alias("evidence"), "n_edges")


_SQL_MERGED = f"""WITH {_WITH} SELECT lower(trim(subject_id)) AS subject_id, predicate, lower(trim(object_id)) AS object_id, max(confidence) AS confidence,
  coalesce(array_to_string(list_sort(list(DISTINCT lower(trim(x))) FILTER (x IS NOT NULL)), ','), '') AS evidence, count(DISTINCT edge_id) AS n_edges
  FROM (SELECT *, unnest(CASE WHEN len(evidence_ids) > 0 THEN evidence_ids ELSE [NULL] END) AS x FROM g) WHERE trim(subject_id) <> '' AND trim(object_id) <> '' GROUP BY 1, 2, 3"""


def graph_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Edges' evidence and evidence's sources as rows, by kind and target."""
    g = _graph(spark, d)
    return G.provenance(g["edges"], g["evidence"]).groupBy("kind", "target_id").agg(F.count(F.lit(1)).alias("n"))


_SQL_PROVENANCE = f"""WITH {_WITH} SELECT kind, target_id, count(*) AS n FROM (SELECT DISTINCT 'SUPPORTED_BY' AS kind, edge_id AS r, lower(trim(x)) AS target_id FROM (SELECT edge_id, unnest(evidence_ids) AS x FROM g)
  UNION SELECT 'FROM_SOURCE', evidence_id, lower(trim(source_id)) FROM e) WHERE target_id <> '' GROUP BY 1, 2"""

STEPS = ["MENTIONS", "RECORDED_IN", "VARIANT_OF"]


def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Chains of three predicates by the entity types they pass."""
    g = _graph(spark, d)
    return G.paths(g["edges"], g["nodes"], STEPS)


_SQL_PATHS = f"""WITH {_WITH}, k AS (SELECT DISTINCT lower(trim(node_id)) AS id, entity_type AS t FROM n),
  p AS (SELECT predicate, lower(trim(subject_id)) AS a, lower(trim(object_id)) AS b FROM g)
  SELECT concat_ws('>', k0.t, k1.t, k2.t, k3.t) AS types, count(*) AS n_paths FROM p p1 JOIN p p2 ON p1.b = p2.a AND p1.predicate = '{STEPS[0]}' AND p2.predicate = '{STEPS[1]}' JOIN p p3 ON p2.b = p3.a AND p3.predicate = '{STEPS[2]}'
  JOIN k k0 ON k0.id = p1.a JOIN k k1 ON k1.id = p1.b JOIN k k2 ON k2.id = p2.b JOIN k k3 ON k3.id = p3.b GROUP BY 1"""


def graph_variants(spark: SparkSession, d: str) -> DataFrame:
    """Names that several nodes of a type share."""
    n = _graph(spark, d)["nodes"].where("canonical_name is not null")
    name = F.lower(F.trim("canonical_name"))
    return n.groupBy("entity_type", name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("node_ids")).where("n > 1")


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of at least five nodes linked by certain edges, by size."""
    e = _graph(spark, d)["edges"].where("confidence >= 0.97 and confidence <= 1").select(G.tidy(F.col("subject_id")).alias("a"), G.tidy(F.col("object_id")).alias("b")).where("a <> '' and b <> ''")
    sizes = connected_components(e, "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.where("n_nodes >= 5")


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(G.tidy(F.col("subject_id")).alias("a"), G.tidy(F.col("object_id")).alias("b")).where("a <> '' and b <> ''")


def graph_components_all(spark: SparkSession, d: str) -> DataFrame:
    """Each linked node's component over all current edges, however certain."""
    return connected_components(_links(_graph(spark, d)["edges"]), "a", "b")


def graph_modules(spark: SparkSession, d: str) -> DataFrame:
    """Each node's module: components of at least five nodes linked by approved edges of confidence 0.7 to 1."""
    used = _graph(spark, d)["edges"].where("review_status = 'approved' and confidence >= 0.7 and confidence <= 1")
    parts = connected_components(_links(used), "a", "b")
    large = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")).where("n_nodes >= 5")
    return parts.join(large, "component").select("node", "component", "n_nodes")


_SQL_COMPONENTS = f"""WITH RECURSIVE {_WITH}, l AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT lower(trim(subject_id)) AS a, lower(trim(object_id)) AS b FROM g WHERE confidence >= 0.97 AND confidence <= 1) WHERE a <> '' AND b <> '' AND a <> b),
  u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), r(x, m) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.x WHERE r.m < u.b)
  SELECT m AS component, count(*) AS n_nodes FROM (SELECT x, min(m) AS m FROM r GROUP BY x) GROUP BY m HAVING count(*) >= 5"""


def graph_verified(spark: SparkSession, d: str) -> DataFrame:
    """Whether each evidence's quote stands on the page it names, by status."""
    g = _graph(spark, d)
    v = G.verified_evidence(g["evidence"], g["sources"], read_table(spark, d, "pages"))
    return v.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_SQL_VERIFIED = f"""WITH {_WITH}, p AS (SELECT page_id, arg_min(text, loaded_at) AS t FROM (SELECT page_id, text, loaded_at FROM pages WHERE page_id IS NOT NULL ORDER BY page_id, loaded_at NULLS FIRST, text NULLS FIRST) GROUP BY page_id),
  j AS (SELECT e.*, json_extract_string(try_cast(locator AS JSON), '$.page_id') AS pid, lower(trim(source_id)) IN (SELECT lower(trim(source_id)) FROM s) AS hs, regexp_replace(coalesce(quote, ''), '\\s+', '', 'g') AS q FROM e)
  SELECT CASE WHEN hs IS NOT TRUE THEN 'source_unknown' WHEN pid IS NULL THEN 'no_locator' WHEN p.page_id IS NULL THEN 'page_unknown' WHEN q = '' THEN 'no_quote' WHEN contains(coalesce(t, ''), quote) THEN 'exact'
    WHEN contains(regexp_replace(coalesce(t, ''), '\\s+', '', 'g'), q) THEN 'normalized_whitespace' ELSE 'missing' END AS status, count(*) AS n FROM j LEFT JOIN p ON p.page_id = pid GROUP BY 1"""


def graph_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by type and layer, edges by predicate and grade."""
    g = _graph(spark, d)
    n = g["nodes"].groupBy(F.lit("node").alias("kind"), F.col("entity_type").alias("a"), F.col("layer").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    e = g["edges"].groupBy(F.lit("edge").alias("kind"), F.col("predicate").alias("a"), F.col("evidence_grade").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(e)


def graph_nearest_edge(spark: SparkSession, d: str) -> DataFrame:
    """The most certain edge of each subject and predicate, of ties the first loaded."""
    e = _graph(spark, d)["edges"].where("confidence between 0 and 1").withColumn("subject", G.tidy(F.col("subject_id"))).where("subject <> ''")
    top = sequences.first_per(e, ["subject", "predicate"], [F.desc("confidence"), "loaded_at", "edge_id"])
    return top.select("subject", "predicate", "edge_id", "confidence")


def stat_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Which entity types are over-represented among the objects of each predicate: tail, adjusted."""
    g = _graph(spark, d)
    kind = g["nodes"].select(G.tidy(F.col("node_id")).alias("id"), "entity_type").distinct()
    pairs = g["edges"].select("predicate", G.tidy(F.col("object_id")).alias("id")).where("predicate is not null").distinct().join(kind, "id")
    population = pairs.select("id", "entity_type").distinct()
    drawn = pairs.groupBy("predicate").agg(F.countDistinct("id").alias("n"))
    of_type = population.groupBy("entity_type").agg(F.count(F.lit(1)).alias("K_"))
    hits = pairs.groupBy("predicate", "entity_type").agg(F.countDistinct("id").alias("k"))
    total = population.agg(F.count(F.lit(1)).alias("N_"))
    tests = hits.join(drawn, "predicate").join(of_type, "entity_type").crossJoin(F.broadcast(total))
    tests = tests.withColumn("test", F.concat_ws("|", "predicate", "entity_type"))
    p = stats.hypergeometric_tail(tests, "test")
    q = stats.benjamini_hochberg(p.withColumn("p", F.round("p", 9)), "test", "p")
    return tests.select("test", "k").join(q, "test").select("test", "k", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


_SQL_ENRICH = f"""WITH {_WITH}, kd AS (SELECT DISTINCT lower(trim(node_id)) AS id, entity_type FROM n), pairs AS (SELECT DISTINCT predicate, id, entity_type FROM (SELECT predicate, lower(trim(object_id)) AS id FROM g WHERE predicate IS NOT NULL) JOIN kd USING (id)),
  pop AS (SELECT DISTINCT id, entity_type FROM pairs), tot AS (SELECT count(*) AS nn FROM pop), ty AS (SELECT entity_type, count(*) AS kk FROM pop GROUP BY 1), dr AS (SELECT predicate, count(DISTINCT id) AS n FROM pairs GROUP BY 1),
  h AS (SELECT predicate, entity_type, count(DISTINCT id) AS k FROM pairs GROUP BY 1, 2),
  t AS (SELECT predicate || '|' || entity_type AS test, k, n, kk, nn FROM h JOIN dr USING (predicate) JOIN ty USING (entity_type), tot),
  pv AS (SELECT test, k, round(least(1e0, list_sum(list_transform(range(greatest(k, n - (nn - kk)), least(kk, n) + 1), lambda i: exp(lgamma(kk + 1) - lgamma(i + 1) - lgamma(kk - i + 1) + lgamma(nn - kk + 1) - lgamma(n - i + 1) - lgamma(nn - kk - n + i + 1) - lgamma(nn + 1) + lgamma(n + 1) + lgamma(nn - n + 1))))), 9) AS p FROM t),
  rk AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS m FROM pv)
  SELECT test, k, round(p, 6) AS p, round(least(1e0, min(p * m / r) OVER (ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM rk"""


def stat_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """How far the subjects of two predicates are the same."""
    e = _graph(spark, d)["edges"].select("predicate", G.tidy(F.col("subject_id")).alias("subject")).where("subject <> ''")
    return stats.set_overlaps(e, "predicate", "subject")


_SQL_OVERLAPS = f"""WITH {_WITH}, p AS (SELECT DISTINCT predicate AS g_, lower(trim(subject_id)) AS i FROM g WHERE trim(subject_id) <> '' AND predicate IS NOT NULL), c AS (SELECT g_, count(*) AS n FROM p GROUP BY 1)
  SELECT x.g_ AS a, y.g_ AS b, count(*) AS common, round(count(*) / (any_value(cx.n) + any_value(cy.n) - count(*)), 6) AS jaccard FROM p x JOIN p y ON x.i = y.i AND x.g_ < y.g_ JOIN c cx ON cx.g_ = x.g_ JOIN c cy ON cy.g_ = y.g_ GROUP BY 1, 2"""


def stat_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of predicates by the evidence that they cite together."""
    e = _graph(spark, d)["edges"].select("predicate", F.explode("evidence_ids").alias("x")).select("predicate", G.tidy(F.col("x")).alias("ev")).where("ev <> ''")
    return stats.set_overlaps(e, "predicate", "ev", 2)


_WEIGHTS = {"n_edges": 0.4, "mean_confidence": 0.35, "n_predicates": 0.25}


def _features(spark: SparkSession, d: str) -> DataFrame:
    e = _graph(spark, d)["edges"].where("confidence between 0 and 1").withColumn("subject", G.tidy(F.col("subject_id"))).where("subject <> ''")
    g = e.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.countDistinct("predicate").alias("p"))
    return g.select("subject", F.round(F.least(F.lit(1.0), F.col("n") / 20), 6).alias("n_edges"), F.round("c", 9).alias("mean_confidence"), F.round(F.least(F.lit(1.0), F.col("p") / 8), 6).alias("n_predicates"))


_SQL_FEATURES = f"""f AS (SELECT subject, round(least(1e0, count(*) / 20), 6) AS n_edges, round(avg(confidence), 9) AS mean_confidence, round(least(1e0, count(DISTINCT predicate) / 8), 6) AS n_predicates
  FROM (SELECT *, lower(trim(subject_id)) AS subject FROM g WHERE confidence BETWEEN 0 AND 1) WHERE subject <> '' GROUP BY subject)"""


def stat_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score and tier of each subject."""
    from scholium.functions import numeric

    f = _features(spark, d)
    s = f.select("subject", F.round(numeric.weighted([F.col(c) for c in _WEIGHTS], list(_WEIGHTS.values())), 10).alias("score"))
    return s.withColumn("tier", F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.60, "middle").otherwise("low"))


def stat_stability(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the subjects under changed weights."""
    return stats.rank_stability(_features(spark, d), "subject", _WEIGHTS)


def _sql_stability() -> str:
    cases = " UNION ALL ".join(
        f"SELECT subject, '{n}' AS sc, round({' + '.join(f'{c} * {w!r}::DOUBLE' for c, w in ws.items())}, 8) AS score FROM f" for n, ws in stats.scenarios(_WEIGHTS)
    )
    return f"""WITH {_WITH}, {_SQL_FEATURES}, c AS ({cases}), r AS (SELECT *, row_number() OVER (PARTITION BY sc ORDER BY score DESC, subject) AS rank FROM c)
      SELECT subject, min(rank) AS rank_min, max(rank) AS rank_max, round(avg(rank), 4) AS rank_mean, min(score) AS score_min, max(score) AS score_max, round(avg((rank = 1)::INT::DOUBLE), 6) AS top_share FROM r GROUP BY subject"""


QUERIES = {k: f for k, f in list(globals().items()) if k.split("_")[0] in ("graph", "stat") and callable(f)}
SQL = {
    "graph_issues": _SQL_ISSUES,
    "graph_issue_counts": f"SELECT severity, code, count(*) AS n FROM ({_SQL_ISSUES}) GROUP BY 1, 2",
    "graph_traceability": _SQL_TRACE,
    "graph_promoted": _SQL_PROMOTED,
    "graph_union": "SELECT n_versions, n_rows, count(*) AS n_edges FROM (SELECT edge_id, count(DISTINCT (coalesce(subject_id, chr(0)), coalesce(predicate, chr(0)), coalesce(object_id, chr(0)), coalesce(confidence, -9))) AS n_versions, count(*) AS n_rows FROM graph_edges WHERE edge_id IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1) GROUP BY 1, 2",
    "graph_merged": _SQL_MERGED,
    "graph_provenance": _SQL_PROVENANCE,
    "graph_paths": _SQL_PATHS,
    "graph_variants": f"WITH {_WITH} SELECT entity_type, lower(trim(canonical_name)) AS name, count(*) AS n, string_agg(node_id, ',' ORDER BY node_id) AS node_ids FROM n WHERE canonical_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "graph_schema_issues": _sql_schema(),
    "graph_rekeyed": _SQL_REKEYED,
    "graph_collected": _SQL_COLLECTED,
    "graph_assertions": _SQL_ASSERTIONS,
    "graph_treatment_paths": _sql_paths(TREATMENT),
    "graph_gate": _SQL_TRACE.rsplit("SELECT predicate, count(*)", 1)[0].rstrip() + """, m AS (SELECT round(avg(t::INT::DOUBLE), 6) AS a FROM t), r AS (SELECT round(avg((coalesce(review_status, '') = 'approved')::INT::DOUBLE), 6) AS b FROM g)
      SELECT 'traceable' AS metric, a AS value, 1e0 AS least, coalesce(a >= 1, false) AS passed FROM m UNION ALL SELECT 'approved', b, 0.5e0, coalesce(b >= 0.5, false) FROM r""",
    "graph_components": _SQL_COMPONENTS,
    "graph_verified": _SQL_VERIFIED,
    "graph_histograms": f"WITH {_WITH} SELECT 'node' AS kind, entity_type AS a, layer AS b, count(*) AS n FROM n GROUP BY 2, 3 UNION ALL SELECT 'edge', predicate, evidence_grade, count(*) FROM g GROUP BY 2, 3",
    "graph_nearest_edge": f"WITH {_WITH} SELECT subject, predicate, edge_id, confidence FROM (SELECT *, lower(trim(subject_id)) AS subject FROM g WHERE confidence BETWEEN 0 AND 1) WHERE subject <> '' QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY confidence DESC, loaded_at, edge_id) = 1",
    "stat_enrichment": _SQL_ENRICH,
    "stat_overlaps": _SQL_OVERLAPS,
    "stat_cooccurrence": f"""WITH {_WITH}, p AS (SELECT DISTINCT predicate AS g_, ev AS i FROM (SELECT predicate, lower(trim(unnest(evidence_ids))) AS ev FROM g) WHERE ev <> '' AND predicate IS NOT NULL), c AS (SELECT g_, count(*) AS n FROM p GROUP BY 1)
      SELECT x.g_ AS a, y.g_ AS b, count(*) AS common, round(count(*) / (any_value(cx.n) + any_value(cy.n) - count(*)), 6) AS jaccard FROM p x JOIN p y ON x.i = y.i AND x.g_ < y.g_ JOIN c cx ON cx.g_ = x.g_ JOIN c cy ON cy.g_ = y.g_ GROUP BY 1, 2 HAVING count(*) >= 2""",
    "stat_weighted": f"WITH {_WITH}, {_SQL_FEATURES} SELECT subject, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.60 THEN 'middle' ELSE 'low' END AS tier FROM (SELECT subject, round(n_edges * 0.4e0 + mean_confidence * 0.35e0 + n_predicates * 0.25e0, 10) AS score FROM f)",
    "stat_stability": _sql_stability(),
}

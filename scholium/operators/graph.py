"""The evidence graph: current state, integrity rules, promotion, union, provenance, patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import ids
from scholium.operators import quality as Q

# Enumerations of the graph.
GRADES = ["E1", "E2", "E3", "E4", "E5"]
CLASSES = ["direct_ancient", "cross_source", "authoritative_curated", "modern_bridge", "predicted"]
REVIEW = ["pending", "approved", "rejected"]
MODES = ["explicit", "normalized", "inferred", "predicted"]


def current(df: DataFrame, key: str) -> DataFrame:
    """The last loaded row of each key, without those that are deleted by then; of ties the greatest."""
    rest = [c for c in df.columns if c not in (key, "loaded_at")]
    last = F.max(F.struct("loaded_at", *rest)).alias("r")
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "r.*")
    return out.where("deleted_at is null or deleted_at > loaded_at") if "deleted_at" in df.columns else out


def tidy(c: Column) -> Column:
    return F.lower(F.trim(c))


def validate(sources: DataFrame, nodes: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """``record_id, severity, code`` of every broken integrity rule of a graph (one row per id each)."""
    status = F.get_json_object("review", "$.status")
    rank = lambda c: F.array_position(F.array(*map(F.lit, GRADES)), c)
    source_rules = [
        ("error", "source_title_missing", F.coalesce(F.trim("title"), F.lit("")) == ""),
        ("error", "source_sha256_invalid", F.col("source_type").like("%pdf") & ~F.coalesce(F.col("file_sha256"), F.lit("")).rlike("^[0-9a-f]{64}$")),
    ]
    node_rules = [("error", "canonical_name_missing", F.coalesce(F.trim("canonical_name"), F.lit("")) == "")]
    evidence_rules = [
        ("error", "evidence_grade_invalid", ~F.coalesce(F.col("evidence_grade").isin(GRADES), F.lit(False))),
        ("error", "evidence_class_invalid", ~F.coalesce(F.col("evidence_class").isin(CLASSES), F.lit(False))),
        ("error", "evidence_review_status_invalid", ~F.coalesce(status.isin(REVIEW), F.lit(False))),
        ("error", "quote_sha256_mismatch", ~F.coalesce(F.col("quote_sha256") == F.sha2("quote", 256), F.lit(False))),
        ("error", "e1_quote_missing", (F.col("evidence_grade") == "E1") & (F.coalesce(F.trim("quote"), F.lit("")) == "")),
        ("warning", "evidence_review_pending", F.coalesce(status, F.lit("pending")) == "pending"),
    ]
    edge_rules = [
        ("error", "edge_grade_invalid", ~F.coalesce(F.col("evidence_grade").isin(GRADES), F.lit(False))),
        ("error", "assertion_mode_invalid", ~F.coalesce(F.col("assertion_mode").isin(MODES), F.lit(False))),
        ("error", "edge_review_status_invalid", ~F.coalesce(F.col("review_status").isin(REVIEW), F.lit(False))),
        ("error", "confidence_out_of_range", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        ("error", "rejected_edge_present", F.coalesce(F.col("review_status") == "rejected", F.lit(False))),
        ("warning", "edge_review_pending", F.coalesce(F.col("review_status"), F.lit("pending")) == "pending"),
    ]
    node_ids = nodes.select(tidy(F.col("node_id")).alias("id")).distinct()
    source_ids = sources.select(tidy(F.col("source_id")).alias("id")).distinct()
    grades = evidence.select(tidy(F.col("evidence_id")).alias("id"), rank(F.col("evidence_grade")).alias("g"))

    def absent(df: DataFrame, key: str, ref: str, ids: DataFrame, code: str) -> DataFrame:
        refs = df.select(F.col(key).alias("record_id"), tidy(F.col(ref)).alias("id"))
        return refs.join(ids, "id", "left_anti").select("record_id", F.lit("error").alias("severity"), F.lit(code).alias("code"))

    cited = edges.select("edge_id", rank(F.col("evidence_grade")).alias("edge_grade"), F.explode_outer("evidence_ids").alias("e")).withColumn("id", tidy(F.col("e")))
    found = cited.join(grades, "id", "left").groupBy("edge_id", "edge_grade").agg(F.count_if(F.col("g").isNull()).alias("n_absent"), F.min("g").alias("best"))
    cited_rules = [
        ("error", "edge_evidence_missing", F.col("n_absent") > 0),
        ("error", "edge_grade_overstated", (F.col("edge_grade") > 0) & (F.col("edge_grade") < F.col("best"))),
    ]
    return Q.union(
        [
            Q.issues(sources, F.col("source_id"), source_rules),
            Q.issues(nodes, F.col("node_id"), node_rules),
            Q.issues(evidence, F.col("evidence_id"), evidence_rules),
            Q.issues(edges, F.col("edge_id"), edge_rules),
            Q.issues(found, F.col("edge_id"), cited_rules),
            absent(evidence, "evidence_id", "source_id", source_ids, "evidence_source_missing"),
            absent(edges, "edge_id", "subject_id", node_ids, "edge_subject_missing"),
            absent(edges, "edge_id", "object_id", node_ids, "edge_object_missing"),
        ]
    )


def traceable(edges: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """``edge_id, traceable``: whether an edge has evidence and all of it exists, has an existing source, a locator, and, if it quotes, a quote of the stated hash."""
    located = F.coalesce(F.trim("locator"), F.lit("")).isin("", "{}", "null")
    sound = ~located & (F.coalesce("quote", F.lit("")) == "") | ~located & F.coalesce(F.col("quote_sha256") == F.sha2("quote", 256), F.lit(False))
    ok = evidence.where(sound).select(tidy(F.col("evidence_id")).alias("id"), tidy(F.col("source_id")).alias("s")).join(
        sources.select(tidy(F.col("source_id")).alias("s")).distinct(), "s", "left_semi"
    )
    cited = edges.select("edge_id", F.explode_outer("evidence_ids").alias("e")).select("edge_id", tidy(F.col("e")).alias("id")).distinct()
    hit = cited.join(ok.select("id").distinct().withColumn("ok", F.lit(True)), "id", "left")
    return hit.groupBy("edge_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("traceable"))


@dataclass(frozen=True)
class Schema:
    """What a graph may hold: the layer of each entity type, and what each predicate may link."""

    layers: dict[str, str]
    #: predicate: (types of subjects, types of objects, grades, modes, whether both ends must be of one type); an empty list allows all
    predicates: dict[str, tuple[list[str], list[str], list[str], list[str], bool]]
    direct_grades: list[str] = field(default_factory=lambda: ["E1", "E2"])


def schema_issues(schema: Schema, nodes: DataFrame, evidence: DataFrame, edges: DataFrame, release: bool = False) -> DataFrame:
    """``record_id, severity, code`` of what the schema does not allow; in a release, what is not approved is an error, too.

    The schema is a few dozen rows and stands in the expressions; each table is
    read once, edges are joined with the types of their ends.
    """
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    layer = F.try_element_at(pairs(schema.layers), F.col("entity_type"))
    node_rules = [
        ("error", "unknown_entity_type", layer.isNull()),
        ("error", "node_layer_mismatch", layer.isNotNull() & ~F.coalesce(layer == F.col("layer"), F.lit(False))),
    ]
    status = F.coalesce(F.get_json_object("review", "$.status"), F.lit(""))
    severity = "error" if release else "warning"
    evidence_rules = [
        ("error", "e1_page_locator_missing", (F.col("evidence_grade") == "E1") & F.coalesce(F.get_json_object("locator", "$.pdf_page"), F.get_json_object("locator", "$.page_id")).isNull()),
        ("error", "direct_ancient_grade_invalid", (F.col("evidence_class") == "direct_ancient") & ~F.coalesce(F.col("evidence_grade").isin(schema.direct_grades), F.lit(False))),
        (severity, "evidence_not_approved", status != "approved"),
    ]
    kind = nodes.select(tidy(F.col("node_id")).alias("id"), F.col("entity_type").alias("type")).groupBy("id").agg(F.min("type").alias("type"))
    typed = edges.select("edge_id", "predicate", "evidence_grade", "assertion_mode", "review_status", tidy(F.col("subject_id")).alias("s"), tidy(F.col("object_id")).alias("o"))
    typed = typed.join(kind.select(F.col("id").alias("s"), F.col("type").alias("st")), "s", "left").join(kind.select(F.col("id").alias("o"), F.col("type").alias("ot")), "o", "left")
    none = F.lit(False)
    outside = [none, none, none, none, none]
    for p, (subjects, objects, grades, modes, same) in schema.predicates.items():
        own = F.col("predicate") == p
        for i, (c, allowed) in enumerate((("st", subjects), ("ot", objects), ("evidence_grade", grades), ("assertion_mode", modes))):
            if allowed:
                outside[i] = outside[i] | own & F.col(c).isNotNull() & ~F.col(c).isin(allowed)
        if same:
            outside[4] = outside[4] | own & (F.col("st") != F.col("ot"))
    edge_rules = [("error", "unknown_predicate", ~F.coalesce(F.col("predicate").isin(list(schema.predicates)), none))]
    names = ("predicate_source_type_invalid", "predicate_target_type_invalid", "predicate_grade_invalid", "predicate_mode_invalid", "predicate_same_type_required")
    edge_rules += [("error", code, F.coalesce(test, none)) for code, test in zip(names, outside)]
    edge_rules.append((severity, "edge_not_approved", ~F.coalesce(F.col("review_status") == "approved", none)))
    return Q.union([Q.issues(nodes, F.col("node_id"), node_rules), Q.issues(evidence, F.col("evidence_id"), evidence_rules), Q.issues(typed, F.col("edge_id"), edge_rules)])


def release_gate(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """``metric, value, least, passed`` of a one-row table of shares; a share that is missing fails."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 6).alias("value"), F.lit(t).alias("least")) for m, t in least.items()])
    return metrics.select(F.explode(rows).alias("x")).select("x.*").withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


def promote(edges: DataFrame, evidence: DataFrame, nodes: DataFrame, sources: DataFrame, least: float) -> dict[str, DataFrame]:
    """The sub-graph of confident edges: their kept evidence, then only the nodes and sources these reach."""
    kept = evidence.where(F.coalesce(F.get_json_object("review", "$.status"), F.lit("pending")) != "rejected")
    ids = kept.select(tidy(F.col("evidence_id")).alias("id")).distinct()
    confident = edges.where(F.col("confidence").between(least, 1))
    cited = confident.select("edge_id", F.explode("evidence_ids").alias("e")).select("edge_id", tidy(F.col("e")).alias("id")).distinct()
    held = cited.join(ids, "id", "left_semi")
    strong = confident.join(held.select("edge_id").distinct(), "edge_id", "left_semi")
    used = kept.withColumn("id", tidy(F.col("evidence_id"))).join(held.select("id").distinct(), "id", "left_semi").drop("id")
    ends = strong.select(F.explode(F.array(tidy(F.col("subject_id")), tidy(F.col("object_id")))).alias("id")).distinct()
    reached = nodes.withColumn("id", tidy(F.col("node_id"))).join(ends, "id", "left_semi").drop("id")
    from_ = used.select(tidy(F.col("source_id")).alias("id")).distinct()
    origin = sources.withColumn("id", tidy(F.col("source_id"))).join(from_, "id", "left_semi").drop("id")
    return {"edges": strong, "evidence": used, "nodes": reached, "sources": origin}


def rekeyed(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """``edge_id, old_edge_id, evidence_ids``: edges with the evidence that exists (tidied, in order, each once) and the id that follows from it.

    Edges that no evidence is left for are dropped.
    """
    known = evidence.select(tidy(F.col("evidence_id")).alias("id")).distinct()
    cited = edges.select("edge_id", F.explode("evidence_ids").alias("e")).select("edge_id", tidy(F.col("e")).alias("id")).distinct().join(known, "id", "left_semi")
    kept = cited.groupBy("edge_id").agg(F.array_sort(F.collect_set("id")).alias("kept"))
    own = edges.select("edge_id", tidy(F.col("subject_id")).alias("s"), "predicate", tidy(F.col("object_id")).alias("o"), "assertion_mode").join(kept, "edge_id")
    new = ids.edge_id("s", "predicate", "o", "kept", "assertion_mode")
    return own.select(new.alias("edge_id"), F.col("edge_id").alias("old_edge_id"), F.col("kept").alias("evidence_ids"))


def collected(edges: DataFrame, nodes: DataFrame, predicate: str, least: int = 2) -> DataFrame:
    """``object_id, name, n, members``: objects that at least ``least`` subjects are linked to, with these (id and name, in order)."""
    names = nodes.select(tidy(F.col("node_id")).alias("id"), "canonical_name").groupBy("id").agg(F.min("canonical_name").alias("name"))
    links = edges.where(F.col("predicate") == predicate).select(tidy(F.col("subject_id")).alias("s"), tidy(F.col("object_id")).alias("o")).distinct()
    of = links.join(names.select(F.col("id").alias("s"), F.col("name").alias("sn")), "s")
    held = of.groupBy("o").agg(F.array_sort(F.collect_set(F.concat_ws("=", "s", F.coalesce("sn", F.lit(""))))).alias("m")).where(F.size("m") >= least)
    return held.join(names.withColumnRenamed("id", "o"), "o").select(F.col("o").alias("object_id"), "name", F.size("m").alias("n"), F.array_join("m", ",").alias("members"))


def assertions(edges: DataFrame, nodes: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """An edge's statement with each of its evidence and its source: names of both ends, grade, locator, quote, title and file hash."""
    names = nodes.select(tidy(F.col("node_id")).alias("id"), "canonical_name").groupBy("id").agg(F.min("canonical_name").alias("name"))
    cited = edges.select("edge_id", "predicate", tidy(F.col("subject_id")).alias("s"), tidy(F.col("object_id")).alias("o"), F.explode("evidence_ids").alias("e"))
    cited = cited.select("edge_id", "predicate", "s", "o", tidy(F.col("e")).alias("e")).distinct()
    proof = evidence.select(tidy(F.col("evidence_id")).alias("e"), "evidence_grade", "locator", "quote", tidy(F.col("source_id")).alias("src"))
    origin = sources.select(tidy(F.col("source_id")).alias("src"), "title", "file_sha256")
    ends = cited.join(names.select(F.col("id").alias("s"), F.col("name").alias("subject")), "s").join(names.select(F.col("id").alias("o"), F.col("name").alias("object")), "o")
    full = ends.join(proof, "e").join(origin, "src")
    return full.select("edge_id", "predicate", "subject", "object", F.col("e").alias("evidence_id"), "evidence_grade", "locator", "quote", "title", "file_sha256")


def united(a: DataFrame, b: DataFrame, key: str, content: list[str]) -> DataFrame:
    """``key, n_versions, n_rows`` over two graphs' records: more than one version is a conflict."""
    both = a.select(key, *content).unionByName(b.select(key, *content))
    version = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    return both.groupBy(key).agg(F.countDistinct(version).alias("n_versions"), F.count(F.lit(1)).alias("n_rows"))


def merged_assertions(edges: DataFrame) -> DataFrame:
    """``subject_id, predicate, object_id, confidence, evidence_ids, n_edges``: the same assertion made several times, as one."""
    rows = edges.select(
        tidy(F.col("subject_id")).alias("subject_id"), "predicate", tidy(F.col("object_id")).alias("object_id"), "confidence",
        F.explode_outer("evidence_ids").alias("e"), "edge_id",
    )
    return rows.groupBy("subject_id", "predicate", "object_id").agg(
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set(tidy(F.col("e")))).alias("evidence_ids"),
        F.countDistinct("edge_id").alias("n_edges"),
    )


def provenance(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """``kind, record_id, target_id``: an edge's evidence and an evidence's source as rows."""
    cited = edges.select(F.lit("SUPPORTED_BY").alias("kind"), F.col("edge_id").alias("record_id"), F.explode("evidence_ids").alias("x"))
    drawn = evidence.select(F.lit("FROM_SOURCE").alias("kind"), F.col("evidence_id").alias("record_id"), F.col("source_id").alias("x"))
    return cited.unionByName(drawn).select("kind", "record_id", tidy(F.col("x")).alias("target_id")).where("target_id is not null and target_id <> ''").distinct()


def paths(edges: DataFrame, nodes: DataFrame, steps: list[str]) -> DataFrame:
    """``types, n_paths`` of chains of edges with the given predicates, by the entity types they pass; ``<`` before one goes against it.

    Parallel edges are counted, not listed: each step joins distinct pairs with
    their number, and numbers are multiplied and summed along the way.
    """
    kind = nodes.select(tidy(F.col("node_id")).alias("id"), "entity_type").distinct()
    at = None
    for predicate in steps:
        a, b = ("object_id", "subject_id") if predicate.startswith("<") else ("subject_id", "object_id")
        pairs = edges.where(F.col("predicate") == predicate.lstrip("<")).select(tidy(F.col(a)).alias("a"), tidy(F.col(b)).alias("b")).where("a is not null and b is not null")
        pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        typed = pairs.join(kind.select(F.col("id").alias("b"), F.col("entity_type").alias("type_b")), "b")
        if at is None:
            first = typed.join(kind.select(F.col("id").alias("a"), F.col("entity_type").alias("type_a")), "a")
            at = first.groupBy("b", F.concat_ws(">", "type_a", "type_b").alias("types")).agg(F.sum("n").alias("n"))
        else:
            step = at.withColumnRenamed("b", "a").withColumnRenamed("n", "m").join(typed, "a")
            at = step.groupBy("b", F.concat_ws(">", "types", "type_b").alias("types")).agg(F.sum(F.col("m") * F.col("n")).alias("n"))
    return at.groupBy("types").agg(F.sum("n").alias("n_paths"))


def verified_evidence(evidence: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """``evidence_id, status``: whether a quote stands on the page its locator names.

    ``exact``, ``normalized_whitespace``, ``missing`` (the page lacks it),
    ``no_quote``, ``page_unknown``, ``no_locator`` or ``source_unknown``.
    """
    e = evidence.select("evidence_id", tidy(F.col("source_id")).alias("sid"), "quote", F.get_json_object("locator", "$.page_id").alias("page_id"))
    known = sources.select(tidy(F.col("source_id")).alias("sid")).distinct().withColumn("has_source", F.lit(True))
    text = pages.where("page_id is not null").groupBy("page_id").agg(F.min_by("text", F.struct("loaded_at", "text")).alias("page_text"), F.lit(True).alias("has_page"))
    j = e.join(known, "sid", "left").join(text, "page_id", "left")
    squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    bare = squeeze(F.col("quote"))
    status = (
        F.when(F.col("has_source").isNull(), "source_unknown")
        .when(F.col("page_id").isNull(), "no_locator")
        .when(F.col("has_page").isNull(), "page_unknown")
        .when(bare == "", "no_quote")
        .when(F.coalesce("page_text", F.lit("")).contains(F.col("quote")), "exact")
        .when(squeeze(F.col("page_text")).contains(bare), "normalized_whitespace")
        .otherwise("missing")
    )
    return j.select("evidence_id", status.alias("status"))

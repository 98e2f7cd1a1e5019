"""Writing results: records, tables with nested columns, graphs with a manifest, staged directories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators.quality import corpus_digest


def records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, nulls kept; the directory appears only when all of it is written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def flat_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nested columns are JSON texts."""
    nested = ("array", "map", "struct", "variant")
    cols = [F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).option("escape", '"').csv(path, header=True)


def without(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the removed ones."""
    return df.join(removed.select(key).distinct(), key, "left_anti")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """A finished staging directory takes the target's place by renaming."""
    fs, a = _fs(spark, staged)
    _, b = _fs(spark, target)
    _, old = _fs(spark, target + ".old")
    fs.delete(old, True)
    if fs.exists(b) and not fs.rename(b, old):
        raise OSError(f"cannot move {target} away")
    if not fs.rename(a, b):
        fs.rename(old, b)
        raise OSError(f"cannot publish {target}")
    fs.delete(old, True)


def graph(parts: dict[str, DataFrame], path: str, metadata: dict) -> dict:
    """Writes each part as records and a manifest with counts and digests; refuses to overwrite.

    Returns the manifest.
    """
    spark = next(iter(parts.values())).sparkSession
    manifest = {"metadata": metadata, "parts": {}}
    for name, df in parts.items():
        df.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{name}")
        manifest["parts"][name] = part_digest(spark.read.schema(df.schema).json(f"{path}/{name}"))
    fs, p = _fs(spark, f"{path}/manifest.json")
    out = fs.create(p)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return manifest


def part_digest(df: DataFrame) -> dict:
    """Row count and digest of a table, whatever the order of its rows."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    got = corpus_digest(df.withColumn("_all", F.lit(0)), ["_all"], row).first()
    return {"rows": got.n_rows, "digest": got.digest} if got else {"rows": 0, "digest": ""}


def load_graph(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The parts of a written graph after their digests have been compared with the manifest."""
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    parts = {n: spark.read.schema(s).json(f"{path}/{n}") for n, s in schemas.items()}
    for n, df in parts.items():
        if part_digest(df) != manifest["parts"].get(n):
            raise ValueError(f"{n} differs from its manifest")
    return parts


def property_graph(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, path: str) -> None:
    """CSV tables for a property-graph store: nodes with labels, relations, assertions and their provenance."""
    flat_csv(nodes.select(F.col("node_id").alias("id"), F.concat_ws(";", F.array_compact(F.array(F.lit("Entity"), "entity_type"))).alias("labels"), "canonical_name", "layer"), f"{path}/nodes")
    flat_csv(edges.select("subject_id", F.col("predicate").alias("type"), "object_id", "edge_id", "confidence", "evidence_grade"), f"{path}/relations")
    flat_csv(edges.select(F.col("edge_id").alias("id"), F.lit("Assertion").alias("labels"), "predicate", "review_status"), f"{path}/assertions")
    flat_csv(edges.select(F.col("edge_id").alias("start"), F.explode("evidence_ids").alias("end"), F.lit("SUPPORTED_BY").alias("type")), f"{path}/provenance")
    flat_csv(evidence.select(F.col("evidence_id").alias("id"), "source_id", "evidence_grade", "quote"), f"{path}/evidence")


def linked_data(parts: dict[str, tuple[DataFrame, str]], path: str) -> None:
    """JSON-LD, one object per line with ``@id`` and ``@type``; ``parts`` gives each table and its key."""
    frames = [df.select(F.to_json(F.struct(F.col(key).alias("@id"), F.lit(kind).alias("@type"), *[c for c in df.columns if c != key])).alias("value")) for kind, (df, key) in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    out.write.mode("overwrite").text(path)

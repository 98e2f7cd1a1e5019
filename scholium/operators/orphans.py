"""References to records that do not exist: orphans per table, field and period.

A reference is judged by the state of its target at the time ``t`` at which the
referring record was first loaded:

* ``missing`` - no row of the target table ever has the id;
* ``late`` - rows have it, but all were loaded after ``t``;
* ``deleted`` - the last row loaded by ``t`` has a ``deleted_at`` by ``t``.

Method.  References are pre-aggregated per key and period, target rows per key
and period as well; a running window over the periods of a key (at most a row
per period, however hot the key) gives each (key, period) the target's state at
its start and the few changes inside it.  Keys are then split by weight.  A key
is heavy from a fixed share of all references on, so there are never more than
``1 / HEAVY_SHARE`` of them, however many references; these few ids are
broadcast and mark each reference in one pass.  The verdicts of heavy keys are
broadcast too, after their number has been checked (each is spread over salts
otherwise), so that the references of a hot key stay where they are; all other
references are shuffled by key.  Both outcomes are united.

Counts need no rows: where a key did not change within a period, all its
references of that period have one reason, and the pre-aggregated numbers are
added up; only the others are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.session import durable

#: A key is heavy from this share of all references on, if that is at least so many.
HEAVY_SHARE, HEAVY_KEY_ROWS = 1 / 2_000, 2_000
#: Verdict rows that may be broadcast; beyond it the heavy keys are shuffled with a salt.
BROADCAST_ROWS = 200_000
#: Salts over which a heavy key's references are spread if its verdicts are not broadcast.
SALTS = 32


@dataclass(frozen=True)
class Reference:
    """``table.field`` (text or array of texts) names rows of ``target``."""

    table: str
    key: str
    field: str
    target: str


def clean_id(c: Column) -> Column:
    """An id without surrounding white space, in lower case; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare != "", bare)


def first_rows(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The row with the earliest ``loaded_at`` of every key, of ties the least by its fields.

    Rows without key or without ``loaded_at`` name no record at a known time and are left out.
    """
    known = df.where(F.col(key).isNotNull() & F.col("loaded_at").isNotNull())
    row = F.min_by(F.struct("loaded_at", *fields), F.struct("loaded_at", *fields)).alias("r")
    return known.groupBy(F.col(key).cast("string").alias("rec_id")).agg(row).select("rec_id", "r.*")


def _naming(r: Reference):
    return lambda x: F.struct(F.lit(r.field).alias("field_name"), F.lit(r.target).alias("target"), clean_id(x).alias("ref_id"))


def references(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """``rec_table, rec_id, field_name, target, ref_id, t, period`` of each distinct reference."""
    out = None
    for table in dict.fromkeys(r.table for r in refs):
        own = [r for r in refs if r.table == table]
        rows = first_rows(tables[table], own[0].key, [r.field for r in own])
        cols = []
        for r in own:
            many = dict(rows.dtypes)[r.field].startswith("array")
            ids = F.col(r.field) if many else F.array(r.field)
            cols.append(F.transform(F.coalesce(ids, F.array().cast("array<string>")), _naming(r)))
        named = rows.select("rec_id", F.col("loaded_at").alias("t"), F.explode(F.array_distinct(F.flatten(F.array(*cols)))).alias("x"))
        part = named.where("x.ref_id is not null").select(F.lit(table).alias("rec_table"), "rec_id", "x.*", "t")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("period", F.date_format("t", "yyyy-MM"))


def histories(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """``target, ref_id, period, versions``: the distinct rows of each id in each period, in time."""
    out = None
    for table, key in keys.items():
        df = tables[table]
        part = df.select(F.lit(table).alias("target"), clean_id(F.col(key)).alias("ref_id"), "loaded_at", "deleted_at").where(
            "ref_id is not null and loaded_at is not null"
        )
        out = part if out is None else out.unionByName(part)
    return out.groupBy("target", "ref_id", F.date_format("loaded_at", "yyyy-MM").alias("period")).agg(
        F.sort_array(F.collect_set(F.struct("loaded_at", "deleted_at"))).alias("versions")
    )


def verdicts(counts: DataFrame, history: DataFrame) -> DataFrame:
    """State of every referenced (key, period): ``known``, the version ``before`` it and those ``inside``."""
    both = counts.select("target", "ref_id", "period", "n", F.lit(None).cast(history.schema["versions"].dataType).alias("versions")).unionByName(
        history.select("target", "ref_id", "period", F.lit(0).cast("long").alias("n"), "versions")
    )
    per = both.groupBy("target", "ref_id", "period").agg(F.sum("n").alias("n"), F.first("versions", ignorenulls=True).alias("inside"))
    key = Window.partitionBy("target", "ref_id")
    past = key.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("known", F.max(F.col("inside").isNotNull()).over(key))
        .withColumn("before", F.last(F.try_element_at("inside", F.lit(-1)), ignorenulls=True).over(past))
        .where("n > 0")
        .select("target", "ref_id", "period", "n", "known", "before", "inside")
    )


def _reason() -> Column:
    seen = F.filter(F.coalesce("inside", F.array().cast("array<struct<loaded_at:timestamp_ntz,deleted_at:timestamp_ntz>>")), lambda v: v.loaded_at <= F.col("t"))
    last = F.coalesce(F.try_element_at(seen, F.lit(-1)), F.col("before"))
    return (
        F.when(~F.coalesce("known", F.lit(False)), "missing")
        .when(last.isNull(), "late")
        .when(last.deleted_at <= F.col("t"), "deleted")
    )


_KEY = ["target", "ref_id"]


def _judged(rows: DataFrame, state: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` with their verdict's columns; references of a heavy key are not shuffled by it."""
    on = [*_KEY, "period"]
    # At most 1 / HEAVY_SHARE keys.
    marked = rows.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), _KEY, "left")
    heavy_state = durable(state.join(F.broadcast(heavy), _KEY, "left_semi"))
    hot = marked.where("heavy")
    if _small(heavy_state):
        hot = hot.join(F.broadcast(heavy_state), on)
    else:  # keys with very many periods: spread the references of each over salts instead
        salted = heavy_state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot = hot.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")
    rest = marked.where("heavy is null").join(state, on)
    return hot.unionByName(rest).drop("heavy")


def _prepared(tables: dict[str, DataFrame], keys: dict[str, str], refs: list[Reference]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """References, their numbers per record table, field, key and period, the keys' states, and the heavy keys."""
    tables = {t: _as_ntz(df) for t, df in tables.items()}
    rows = durable(references(tables, refs))
    counts = durable(rows.groupBy("rec_table", "field_name", "target", "ref_id", "period").agg(F.count(F.lit(1)).alias("n")))
    state = durable(verdicts(counts, histories(tables, keys)))
    least = max(HEAVY_KEY_ROWS, int((counts.agg(F.sum("n")).first()[0] or 0) * HEAVY_SHARE))
    heavy = durable(state.groupBy(*_KEY).agg(F.sum("n").alias("total")).where(F.col("total") >= least).drop("total"))
    return rows, counts, state, heavy


def orphans(tables: dict[str, DataFrame], keys: dict[str, str], refs: list[Reference]) -> DataFrame:
    """``rec_table, rec_id, field_name, ref_id, reason, period``, all strings, every row distinct.

    Null, empty and blank ids are no references; ids are compared trimmed and in
    lower case; a record delivered more than once counts by its earliest row;
    empty tables give no rows (as referring side) or make every reference
    ``missing`` (as target).  Only the named columns are read, so extra columns
    with clashing names do no harm.
    """
    rows, _, state, heavy = _prepared(tables, keys, refs)
    out = ["rec_table", "rec_id", "field_name", "ref_id", "reason", "period"]
    return _judged(rows, state, heavy).withColumn("reason", _reason()).where("reason is not null").select(*out)


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _as_ntz(df: DataFrame) -> DataFrame:
    for c in ("loaded_at", "deleted_at"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def orphan_counts(tables: dict[str, DataFrame], keys: dict[str, str], refs: list[Reference]) -> DataFrame:
    """``rec_table, field_name, period, reason, n_refs, n_ids``: orphans per referring table, field, month and reason.

    The same references as ``orphans``; null ids, empty tables and repeated
    deliveries as there.
    """
    rows, counts, state, heavy = _prepared(tables, keys, refs)
    on, kept = [*_KEY, "period"], ["rec_table", "field_name", "ref_id", "period", "reason", "n"]
    gone = F.date_format("before.deleted_at", "yyyy-MM")
    # Neither a version nor a deletion within the period: one reason for all its references.
    still = F.col("inside").isNull() & ~F.coalesce(gone == F.col("period"), F.lit(False))
    reason = F.when(~F.coalesce("known", F.lit(False)), "missing").when(F.col("before").isNull(), "late").when(gone < F.col("period"), "deleted")
    fixed = state.where(still).select(*on, reason.alias("reason")).where("reason is not null")
    whole = counts.join(fixed, on).select(*kept)
    changing = durable(state.where(~still))
    single = _judged(rows, changing, heavy).withColumn("reason", _reason()).where("reason is not null").withColumn("n", F.lit(1).cast("long")).select(*kept)
    per_id = whole.unionByName(single).groupBy("rec_table", "field_name", "period", "reason", "ref_id").agg(F.sum("n").alias("n"))
    return per_id.groupBy("rec_table", "field_name", "period", "reason").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_ids"))


# The references of the evidence graph.
GRAPH_REFERENCES = [
    Reference("graph_edges", "edge_id", "subject_id", "graph_nodes"),
    Reference("graph_edges", "edge_id", "object_id", "graph_nodes"),
    Reference("graph_edges", "edge_id", "evidence_ids", "graph_evidence"),
    Reference("graph_evidence", "evidence_id", "source_id", "graph_sources"),
]
GRAPH_KEYS = {"graph_nodes": "node_id", "graph_evidence": "evidence_id", "graph_sources": "source_id"}

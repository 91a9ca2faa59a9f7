"""References to records that are missing, deleted or loaded later.

Every foreign key column becomes ``(table_name, record_id, field_name, ref_id,
created_at)``.  The distinct non-null keys, each with the earliest ``created_at``
that uses it, are anti-joined against the parents; only keys that are a problem
for at least one reference go back to the referring rows.  A key used by a third
of all rows is therefore one row in the parent join, and the join back moves it
only if it is broken (adaptive skew splitting applies, as the key side is unique).

Defined cases: a null or 0 reference is no reference; a null parent key matches
nothing; a reference with null ``created_at`` is never late; parents that are
live but carry no ``loaded_at`` are present; equal references are reported once;
empty tables give no rows (references) or only ``missing`` (parents); columns
beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(df: DataFrame, table_name: str, record: str, fields: Sequence[str], created: str) -> DataFrame:
    """Unpivot foreign-key columns; null and 0 slots vanish in the same pass."""
    slots = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("long").alias("ref_id")) for f in fields])
    return (
        df.select(F.col(record).cast("long").alias("record_id"), F.col(created).alias("created_at"), F.explode(slots).alias("s"))
        .select(F.lit(table_name).alias("table_name"), "record_id", F.col("s.field_name").alias("field_name"), F.col("s.ref_id").alias("ref_id"), "created_at")
        .where("ref_id is not null and ref_id <> 0")
    )


def parent_states(df: DataFrame, key: str, loaded: str, deleted: str) -> DataFrame:
    """One row per parent key: is any row live, and since when."""
    live = F.col(deleted).isNull()
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("ref_id"))
        .agg(F.max(live).alias("is_live"), F.min(F.when(live, F.col(loaded))).alias("live_since"))
    )


def broken_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Referring rows with ``kind`` in missing / deleted / late, one per row of ``refs``."""
    keys = refs.groupBy("ref_id").agg(F.min("created_at").alias("first_use"))
    # the anti-join as an outer join: one pass over the parents tells absent keys and the state of the others
    doubtful = keys.join(parents, "ref_id", "left").where("is_live is null or not is_live or live_since > first_use")
    doubtful = doubtful.select("ref_id", "is_live", F.col("live_since").cast("timestamp_ntz").alias("live_since"))
    kind = F.when(F.col("is_live").isNull(), "missing").when(~F.col("is_live"), "deleted").when(F.col("live_since") > F.col("created_at").cast("timestamp_ntz"), "late")
    return refs.join(doubtful, "ref_id").withColumn("kind", kind).where("kind is not null").select("table_name", "record_id", "field_name", "ref_id", "kind", "created_at")


def orphan_report(groups: Sequence[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """All broken references of several (references, parents) pairs."""
    out = None
    for refs, parents in groups:
        part = broken_references(refs, parents)
        out = part if out is None else out.unionByName(part)
    return out


def orphan_counts(groups: Sequence[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """References, broken ones by kind, and the broken share per table, field and month.

    A reference without ``created_at`` is counted under a null month.
    """
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    by = ["table_name", "field_name", "month"]
    total = None
    for refs, _ in groups:
        part = refs.groupBy("table_name", "field_name", month).agg(F.count("*").alias("n_refs"))
        total = part if total is None else total.unionByName(part)
    kinds: Mapping[str, str] = {"n_missing": "missing", "n_deleted": "deleted", "n_late": "late"}
    bad = orphan_report(groups).groupBy("table_name", "field_name", month).agg(*[F.count_if(F.col("kind") == v).alias(k) for k, v in kinds.items()])
    t, b = total.alias("t"), bad.alias("b")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    n = {k: F.coalesce(F.col(k), F.lit(0)) for k in kinds}
    return t.join(b, same, "left").select(*[f"t.{c}" for c in by], "n_refs", *[v.alias(k) for k, v in n.items()], F.round(sum(n.values(), F.lit(0)) / F.col("n_refs"), 6).alias("broken_share"))

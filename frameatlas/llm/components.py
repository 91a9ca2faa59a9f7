"""Group identifiers for records linked directly or over others.

Randomised contraction: in every round each vertex hooks to the member of its
closed neighbourhood that comes first in a fresh hash order, edges are relabelled
by that choice, loops and repeats are dropped, and the round ends when no edge is
left.  A constant share of the vertices disappears per round, whatever the shape
of the links (chains included), so the number of rounds grows with the logarithm
of the vertices.  The per-round mappings are then expanded from the last to the
first; their sizes fall geometrically.

Distribution: a round is one partially aggregated ``min`` per vertex and two
joins against a side that is unique per vertex; a hub with a third of all links
is pre-reduced by the map-side aggregate and its join partition is split by
adaptive skew handling.  Each round is written to the shared folder, so lineage
stays one round long and a lost executor costs at most one round.

Defined cases: null endpoints and self links are ignored; repeated links count
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameatlas.runtime import Written, materialize

MAX_ROUNDS = 200


def _order(col: str, seed: int):
    return F.struct(F.xxhash64(F.lit(seed), F.col(col)).alias("h"), F.col(col).alias("v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", seed: int = 7) -> DataFrame:
    """``(vertex, label)`` for every vertex with a link; equal labels mean one group."""
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current: Written = materialize(e, "cc-edges")
    maps: list[Written] = []
    while current.rows():
        if len(maps) >= MAX_ROUNDS:
            raise RuntimeError("contraction did not end; the hash order is broken")
        k = len(maps)
        both = current.df.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hook = both.groupBy("a").agg(F.min(_order("b", seed + k)).alias("n"))
        hook = hook.select(F.col("a").alias("vertex"), F.least(F.col("n"), _order("a", seed + k))["v"].alias("label"))
        m = materialize(hook, "cc-map")
        maps.append(m)
        left = current.df.join(m.df.select(F.col("vertex").alias("a"), F.col("label").alias("la")), "a")
        both_ends = left.join(m.df.select(F.col("vertex").alias("b"), F.col("label").alias("lb")), "b")
        nxt = both_ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        following = materialize(nxt, "cc-edges")
        current.drop()
        current = following
    current.drop()
    if not maps:
        return e.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
    done = maps[-1]
    for m in reversed(maps[:-1]):
        deeper = done.df.select(F.col("vertex").alias("label"), F.col("label").alias("final"))
        expanded = materialize(m.df.join(deeper, "label", "left").select("vertex", F.coalesce("final", "label").alias("label")), "cc-map")
        m.drop()
        done.drop()
        done = expanded
    return done.df


def link_groups(rows: DataFrame, record: str, points_to: str) -> DataFrame:
    """``(record, group_id)`` for records that share a group with another record.

    ``points_to`` may name records without a row: they connect those that name
    them but are not output.  0 means "unknown" and links nothing.  ``group_id``
    is the smallest record of the group that has a row.
    """
    pairs = rows.select(F.col(record).cast("long").alias("a"), F.col(points_to).cast("long").alias("b"))
    labels = connected_components(pairs.where("a <> 0 and b <> 0"))
    present = pairs.select(F.col("a").alias("vertex")).where("vertex is not null").distinct()
    member = labels.join(present, "vertex")
    groups = member.groupBy("label").agg(F.min("vertex").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return member.join(groups, "label").select(F.col("vertex").alias(record), "group_id", F.col("n").alias("group_size"))

"""Slot signatures: tokens, hashes, and collapsing the rare ones.

The dictionary of signatures is what is iterated, never the pictures: one count per
signature, then a bounded number of rounds in which signatures below the support
lose their weakest slot and are counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LABELS = [("left_hand", "LH"), ("right_hand", "RH"), ("top_face", "TF"), ("left_eye", "LE"), ("right_eye", "RE"), ("mouth", "MO"), ("shoulder", "SH"), ("waist", "WA"), ("feet", "FT")]  # fixed values


def parts(suffix: str = "_class") -> Column:
    """``LABEL:class`` of every set slot, in slot order."""
    return F.filter(F.array(*[F.when(F.col(f"{s}{suffix}").isNotNull(), F.concat(F.lit(f"{tag}:"), F.col(f"{s}{suffix}").cast("string"))) for s, tag in LABELS]), lambda x: x.isNotNull())


def token(p: Column) -> Column:
    return F.array_join(p, "|")


def collapse(rows: DataFrame, item: str, parts_col: str, support: int, rounds: int = 5, most_slots: int = 4) -> DataFrame:
    """``item, token``: signatures with at least ``support`` items, others shortened until they have it.

    Round r keeps at most ``most_slots - r`` slots of a rare signature: those whose
    (slot, class) is most common overall, ties in slot order; after the last round what
    is still rare gets the empty signature.
    """
    p = rows.select(item, F.col(parts_col).alias("p"))
    sig = p.groupBy("p").agg(F.count("*").alias("n"))
    common = sig.select(F.explode("p").alias("part"), "n").groupBy("part").agg(F.sum("n").alias("weight"))
    ranked = sig.select("p", F.explode("p").alias("part")).join(common, "part")
    order = ranked.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "part"))), lambda s: s["part"]).alias("best"))
    state = sig.join(order, "p", "left").select("p", "n", F.col("p").alias("now"), F.coalesce("best", F.array().cast("array<string>")).alias("best"))
    for r in range(rounds):
        size = max(0, most_slots - r)
        n_now = F.sum("n").over(W.partitionBy("now"))
        short = F.filter("p", lambda x: F.array_contains(F.slice("best", 1, size) if size else F.array().cast("array<string>"), x))
        state = state.withColumn("c", n_now).select("p", "n", "best", F.when(F.col("c") >= support, F.col("now")).otherwise(short).alias("now"))
    return p.join(state.select("p", token(F.col("now")).alias("token")), "p").select(item, "token")


def topic_collapse_map(rows: DataFrame, topic: str, item: str, parts_col: str, support: int) -> DataFrame:
    """``topic, token, n, state, target`` of every signature of a topic: 'retained', 'remapped' or 'discarded'.

    A signature with fewer than ``support`` different items in the topic loses its parts rarest first (by items of the
    topic that carry the part, ties in the order of the parts' text), until the rest is a signature with the support; the
    empty signature is no target, and without any the signature is discarded.  Supports are those before any remapping.
    """
    sig = rows.select(F.col(topic).alias("topic"), F.col(item).alias("item"), F.col(parts_col).alias("p")).distinct().groupBy("topic", "p").agg(F.count("*").alias("n"))
    weight = sig.select("topic", F.explode("p").alias("part"), "n").groupBy("topic", "part").agg(F.sum("n").alias("weight"))
    large = sig.where((F.col("n") >= support) & (F.size("p") > 0)).select("topic", token(F.col("p")).alias("target"))
    rare = sig.where(F.col("n") < support).select("topic", "p")
    drop = rare.select("topic", "p", F.explode("p").alias("part")).join(weight, ["topic", "part"]).groupBy("topic", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("weight", "part"))), lambda s: s["part"]).alias("drop"))
    left = drop.where(F.size("p") > 1).select("topic", "p", "drop", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    left = left.select("topic", "p", "k", token(F.filter("p", lambda x: ~F.array_contains(F.slice("drop", F.lit(1), F.col("k")), x))).alias("target"))
    best = left.join(large, ["topic", "target"]).groupBy("topic", "p").agg(F.min_by("target", "k").alias("target"))
    j = sig.join(best, ["topic", "p"], "left")
    keeps = F.col("n") >= support
    state = F.when(keeps, "retained").when(F.col("target").isNotNull(), "remapped").otherwise("discarded")
    return j.select("topic", token(F.col("p")).alias("token"), "n", state.alias("state"), F.when(keeps, token(F.col("p"))).otherwise(F.col("target")).alias("target"))


def apply_collapse(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """Rows (topic, token, ...) with their ``target``: discarded signatures vanish, others take the map's target or stay."""
    kept = rows.join(mapped.where("state = 'discarded'"), ["topic", "token"], "left_anti")
    to = mapped.where("state = 'remapped'").select("topic", "token", F.col("target").alias("_to"))
    return kept.join(to, ["topic", "token"], "left").withColumn("target", F.coalesce("_to", "token")).drop("_to")

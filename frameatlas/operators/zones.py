"""Where a box lies on a person, whether a mask is worn or held, and what a class may stand for.

Boxes are in face heights from the nose, y downwards.  Everything is a column
expression; a null coordinate gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameatlas.functions import columns as C

# fixed values: rectangles that a box must touch (x from, x to, top, bottom)
TOUCHED = {
    "left_eye": (-0.9, -0.05, -0.65, 0.15),
    "right_eye": (0.05, 0.9, -0.65, 0.15),
    "under_eye": (-0.9, 0.9, -0.45, 0.45),
    "eye_cover": (-0.9, 0.9, -0.80, 0.30),
    "forehead": (-1.00, 1.00, -1.10, -0.10),
    "waist": (-1.40, 1.40, 2.5, 4.5),
    "feet": (-2.00, 2.00, 4.75, 10.20),
}
# fixed values: limits of the face rules
WIDEST, OTHER_HALF = 2.0, 0.75
MASK_TOP, MASK_BOTTOM = (-0.4, 0.5), (0.3, 0.8)
FULL_X, FULL_TOP, FULL_BOTTOM = 0.15, -0.15, 0.15
TIE = {"off_centre": 0.35, "width": 1.25, "top": 1.25, "bottom": (0.35, 3.40), "height": 0.45, "aspect": 1.10}
BAND, STRAP, STRAP_CLASSES = 1.0, 1.5, (24, 26, 83, 90)
TOUCH = 0.5
WORN, HELD, MARGIN = 0.60, 0.60, 0.12
WEIGHT = {"mouth": 0.40, "face": 0.25, "line": 0.15, "hand": 0.20, "both": 0.10, "off": 0.25}
BIAS = {0: -9999.0, 1: -0.12, 2: 0.06}
MATRIX_SLOTS = ("hand", "left_eye", "right_eye", "top_face", "mouth", "shoulder", "waist", "feet")


def zones(b: Column) -> dict[str, Column]:
    """The thirteen predicates that ask for the box alone."""
    left, top, right, bottom = (b[x] for x in ("left", "top", "right", "bottom"))
    width, height = right - left, bottom - top
    astride = (left < 0) & (right > 0)
    on_face = astride & (width <= WIDEST)
    out = {k: (right >= x0) & (left <= x1) & (bottom >= y0) & (top <= y1) for k, (x0, x1, y0, y1) in TOUCHED.items()}
    out["top_face"] = on_face & (top < 0) & (bottom <= OTHER_HALF)
    out["bottom_face"] = on_face & (bottom > 0) & (top >= -OTHER_HALF)
    out["mouth"] = on_face & (bottom > 0) & (top >= 0)
    out["covid_mask"] = on_face & top.between(*MASK_TOP) & bottom.between(*MASK_BOTTOM)
    out["full_face"] = (left < -FULL_X) & (right > FULL_X) & (width <= WIDEST) & (top <= FULL_TOP) & (bottom >= FULL_BOTTOM)
    tall = (height >= TIE["height"]) & (height >= TIE["aspect"] * width) & (width > 0)
    out["tie_neck"] = astride & tall & (F.abs(left + right) / 2 <= TIE["off_centre"]) & (width <= TIE["width"]) & (top <= TIE["top"]) & bottom.between(*TIE["bottom"])
    return out


def on_shoulder(b: Column, cls: Column, one: tuple[Column, Column], two: tuple[Column, Column]) -> Column:
    """The box meets the band below the line between the shoulders; straps hang lower."""
    (x1, y1), (x2, y2) = one, two
    lo, hi = F.greatest(b["left"], F.least(x1, x2)), F.least(b["right"], F.greatest(x1, x2))
    steep = F.abs(x2 - x1) < 1e-9
    at = lambda x: y1 + (x - x1) / F.nullif(x2 - x1, F.lit(0.0)) * (y2 - y1)
    top = F.when(steep, F.least(y1, y2)).otherwise(F.least(at(lo), at(hi)))
    low = F.when(steep, F.greatest(y1, y2)).otherwise(F.greatest(at(lo), at(hi)))
    return (lo <= hi) & (b["bottom"] >= top) & (b["top"] <= low + BAND + F.when(cls.isin(*STRAP_CLASSES), STRAP).otherwise(0.0))


def hand_gap(b: Column, x: Column, y: Column) -> Column:
    """Distance of a hand to the box; null without a hand, which (0, 8) stands for too."""
    return F.when((x != 0) | (y != 8), C.point_to_box(x, y, b))


def mask_intent(b: Column, hands: Sequence[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """``(worn, held, intent)``: two scores and worn, held or ambiguous."""
    cx, cy = C.centre(b)
    fits = sum((F.when(c, 0.25).otherwise(0.0) for c in (b["top"] >= MASK_TOP[0], b["top"] <= MASK_TOP[1], b["bottom"] >= MASK_BOTTOM[0], b["bottom"] <= MASK_BOTTOM[1])), F.lit(0.0))
    near = lambda v, scale: F.greatest(F.lit(0.0), 1 - v / scale)
    line = near(F.abs(cx), 0.35)
    face = line * near(F.abs(cy - 0.2), 0.9)
    gaps = [hand_gap(b, *h) for h in hands]
    nearest = gaps[0] if len(gaps) == 1 else F.least(*gaps)
    hand = F.coalesce(near(nearest, 2 * TOUCH), F.lit(0.0))
    both = F.lit(True) if len(gaps) == 2 else F.lit(False)
    for g in gaps:
        both = both & (g <= TOUCH)
    both = F.when(both, 1.0).otherwise(0.0)
    off = F.when((fits < 0.5) & ((cy < MASK_TOP[0]) | (cy > MASK_BOTTOM[1])), 1.0).otherwise(0.0)
    w = WEIGHT
    worn = w["mouth"] * fits + w["face"] * face + w["line"] * line - w["hand"] * hand
    held = w["hand"] * hand + w["both"] * both + w["off"] * off - w["mouth"] * fits
    intent = F.when((worn >= WORN) & (worn >= held + MARGIN), "worn").when((held >= HELD) & (held >= worn + MARGIN), "held").otherwise("ambiguous")
    return worn, held, intent


def checked_matrix(levels: DataFrame, classes: int) -> DataFrame:
    """A matrix ``class_id`` x slots of levels 0, 1, 2 in long form (``class_id, slot, level``), or an error naming what is wrong."""
    got = levels.select("class_id", F.posexplode(F.array(*[F.col(s).cast("int") for s in MATRIX_SLOTS])).alias("at", "level")).withColumn("slot", F.element_at(F.array(*[F.lit(s) for s in MATRIX_SLOTS]), F.col("at") + 1)).drop("at")
    one = got.agg(F.count_distinct("class_id").alias("classes"), F.count("*").alias("cells"), F.count_if(~F.coalesce(F.col("level").isin(0, 1, 2), F.lit(False))).alias("bad")).first()
    if one["classes"] != classes or one["cells"] != classes * len(MATRIX_SLOTS) or one["bad"]:
        raise ValueError(f"{one['classes']} classes for {classes}, {one['cells']} cells, {one['bad']} levels that aren't 0, 1 or 2")
    return got


def biased_scores(boxes: DataFrame, matrix: DataFrame, score: Column) -> DataFrame:
    """Every box with every slot it may stand in: level, and score with the level's bias; a class without a row may stand anywhere (2), level 0 nowhere."""
    slots = F.explode(F.array(*[F.lit(s) for s in MATRIX_SLOTS])).alias("slot")
    known = boxes.select("*", slots).join(matrix, ["class_id", "slot"], "left").withColumn("level", F.coalesce("level", F.lit(2)))
    bias = F.when(F.col("level") == 1, BIAS[1]).when(F.col("level") == 2, BIAS[2])
    return known.where("level > 0").withColumn("score", score + bias)

"""Scalar functions over vectors, boxes, landmarks, colours, JSON and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


BOX = "left double, top double, right double, bottom double"


# ---- vectors
def l2(a, b) -> Column:
    """Euclidean distance of two arrays of equal length, in double; null if a length differs."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(d))


def mad(a, b) -> Column:
    """Mean absolute difference of two arrays; NaN components make it infinite."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)
    m = s / F.nullif(F.size(a), F.lit(0))
    return F.when(F.isnan(m), float("inf")).otherwise(m)


def projected(v, kept: list[int]) -> Column:
    """The components of ``v`` at the given places (0-based); places beyond the end are null."""
    return F.array(*[F.get(v, F.lit(i)) for i in kept])


def weighted(v, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.zip_with(v, w, lambda a, b: a.cast("double") * b)


# ---- boxes
def box(json_col) -> Column:
    """A box struct from JSON text, also if the text was encoded twice; null for 'null' and broken text."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    inner = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    parsed = F.from_json(F.when(F.substring(F.trim(c), 1, 1) == '"', inner).otherwise(c), BOX)
    return F.when(parsed["left"].isNotNull() & parsed["right"].isNotNull() & parsed["top"].isNotNull() & parsed["bottom"].isNotNull(), parsed)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["right"] - b["left"]) * F.greatest(F.lit(0.0), b["bottom"] - b["top"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both areas are 0."""
    o = overlap(a, b)
    return F.coalesce(o / F.nullif(area(a) + area(b) - o, F.lit(0.0)), F.lit(0.0))


def point_to_box(x: Column, y: Column, b: Column) -> Column:
    """Distance of a point to the nearest point of a box (0 inside)."""
    dx = F.greatest(b["left"] - x, F.lit(0.0), x - b["right"])
    dy = F.greatest(b["top"] - y, F.lit(0.0), y - b["bottom"])
    return F.sqrt(dx * dx + dy * dy)


def centre(b: Column) -> tuple[Column, Column]:
    return (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2


# ---- landmarks (flat arrays of points with ``dims`` numbers each)
def point(v, i: int, dims: int = 4) -> Column:
    names = ("x", "y", "z", "visibility")[:dims]
    return F.struct(*[F.get(v, F.lit(i * dims + j)).cast("double").alias(n) for j, n in enumerate(names)])


def visibilities(v, first: int, last: int) -> Column:
    return F.array(*[F.get(v, F.lit(i * 4 + 3)).cast("double") for i in range(first, last + 1)])


def subset(v, first: int, last: int, dims: int = 4) -> Column:
    return F.slice(v, first * dims + 1, (last - first + 1) * dims)


def count_above(arr: Column, bar: float) -> Column:
    return F.size(F.filter(arr, lambda x: x > bar))


# ---- colour and angle
def hue_distance(a: Column, b: Column) -> Column:
    """Distance on the circle of hues in 0..1: at most 0.5."""
    d = F.abs(a - b)
    return F.least(d, 1 - d)


def hand_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.degrees(F.atan2(y1 - y0, x1 - x0))


# ---- text
def replaced_in_order(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements one after the other: later ones see the results of earlier ones."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def hashed_folders(name: Column) -> Column:
    """A/AB/name, from the MD5 of the name."""
    m = F.upper(F.md5(name))
    return F.concat_ws("/", F.substring(m, 1, 1), F.substring(m, 1, 2), name)


def tokens(c: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Lower-case alphabetic words within the length limits."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)
    return F.filter(words, lambda w: (F.length(w) >= shortest) & (F.length(w) <= longest))


# ---- curves
def rescaled(x: Column, lo: float, hi: float, curve: float = 1.0) -> Column:
    """x in 0..1 to lo..hi, linearly or along a power curve."""
    return F.lit(lo) + F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(curve)) * (hi - lo)


def normalised(b: Column, nose_x: Column, nose_y: Column, face_height: Column) -> Column:
    """A pixel box in face heights from the nose: left and up are negative."""
    h = F.nullif(face_height, F.lit(0.0))
    return F.struct(((b["left"] - nose_x) / h).alias("left"), ((b["top"] - nose_y) / h).alias("top"), ((b["right"] - nose_x) / h).alias("right"), ((b["bottom"] - nose_y) / h).alias("bottom"))


def projected_back(b: Column, nose_x: Column, nose_y: Column, face_height: Column) -> Column:
    return F.struct((b["left"] * face_height + nose_x).alias("left"), (b["top"] * face_height + nose_y).alias("top"), (b["right"] * face_height + nose_x).alias("right"), (b["bottom"] * face_height + nose_y).alias("bottom"))


EULER_TURN = 360.0


def euler_normalised(a: Column) -> Column:
    """An angle in (-180, 180]."""
    r = F.pmod(a, F.lit(EULER_TURN))
    return F.when(r > 180, r - EULER_TURN).otherwise(r)



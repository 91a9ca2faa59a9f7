"""Distribution statistics, outlier flags and adaptive filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameatlas.operators.slices import exact_quantiles


def ratio(a: Column | str, b: Column | str, digits: int = 4) -> Column:
    """a / b rounded; null where b is 0."""
    b = F.col(b) if isinstance(b, str) else b
    a = F.col(a) if isinstance(a, str) else a
    return F.round(a / F.nullif(b, F.lit(0)), digits)


def iqr_bounds(df: DataFrame, axes: list[str], scale: float = 1.0) -> dict[str, tuple[float, float, float]]:
    """Median, interquartile range (linear interpolation) and ``scale`` of every axis."""
    out = {}
    for a in axes:
        row = exact_quantiles(df, None, a, {"lo": 0.25, "mid": 0.5, "hi": 0.75}).first()
        if row is not None:
            out[a] = (row["mid"], row["hi"] - row["lo"], scale)
    return out


def adaptive_iqr(df: DataFrame, axes: list[str], target: int, most: float = 3.0, steps: int = 12) -> tuple[DataFrame, float]:
    """Rows within median +- scale x IQR on all axes, with the scale that keeps about ``target`` rows.

    The joint scale of a row is the largest |x - median| / IQR over the axes, so one
    column decides for every scale; the bisection counts it in one aggregate per step
    over a column the engine keeps pruned.  Null axes never pass; an empty table keeps
    nothing; the scale is capped at ``most``.
    """
    b = iqr_bounds(df, axes)
    if len(b) < len(axes):
        return df.where("false"), most
    need = F.greatest(*[F.abs(F.col(a).cast("double") - m) / (iqr if iqr else 1e-12) for a, (m, iqr, _) in b.items()])
    whole = F.lit(True)
    for a in axes:
        whole &= F.col(a).isNotNull()
    needs = df.where(whole).select(need.alias("need"))
    grid = [most * (i + 1) / 2**steps for i in range(2**steps)]
    lo, hi = 0, len(grid) - 1
    for _ in range(steps):
        mid = (lo + hi) // 2
        if needs.where(F.col("need") <= grid[mid]).count() >= target:
            hi = mid
        else:
            lo = mid + 1
        if lo >= hi:
            break
    return df.where(whole & (need <= grid[hi])), grid[hi]


def outlier_reasons(x: str, med: str, q1: str, q3: str, mad: str, fixed: float, z: float = 3.5) -> Column:
    """Fixed limit, 1.5 IQR fence and MAD-z flags as one text, empty if none applies."""
    c = F.col
    return F.concat_ws(
        ";",
        F.when(c(x) > fixed, "fixed"),
        F.when((c(x) > c(q3) + 1.5 * (c(q3) - c(q1))) | (c(x) < c(q1) - 1.5 * (c(q3) - c(q1))), "iqr"),
        F.when(F.abs(0.6745 * (c(x) - c(med)) / F.nullif(c(mad), F.lit(0.0))) > z, "mad"),
    )


def low_is_good(x: str, lo: str, hi: str) -> Column:
    """Min-max scale to 1 (lowest) .. 0 (highest); 1 for all where all are equal."""
    return F.when(F.col(hi) == F.col(lo), F.lit(1.0)).otherwise((F.col(hi) - F.col(x)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)))

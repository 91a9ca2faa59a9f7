"""Pairs within a bounded window of an ordered list, and the near-duplicate cascade over them.

The naive range condition plans a nested loop.  Here a row is keyed by its bucket
``position div reach`` and meets the rows of its own and the next bucket by equality,
so the join is a hash or sort-merge join whose candidates are at most twice the
pairs asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameatlas.runtime import materialize


def window_pairs(df: DataFrame, position: str, reach: int, cols: list[str], part: str | None = None) -> DataFrame:
    """Pairs with 0 < position_b - position_a <= reach (inside a part): columns suffixed _a and _b."""
    keys = [part] if part else []
    b_of = F.floor(F.col(position) / reach).cast("long")
    a = df.select(*keys, F.col(position).alias("pos_a"), *[F.col(c).alias(f"{c}_a") for c in cols], F.explode(F.array(b_of, b_of + 1)).alias("_bk"))
    b = df.select(*keys, F.col(position).alias("pos_b"), *[F.col(c).alias(f"{c}_b") for c in cols], b_of.alias("_bk"))
    return a.join(b, [*keys, "_bk"]).where(F.col("pos_b").between(F.col("pos_a") + 1, F.col("pos_a") + reach)).drop("_bk")


def early_window_pairs(df: DataFrame, position: str, reach: int, early_reach: int, early: int, cols: list[str]) -> DataFrame:
    """As ``window_pairs``, but with ``early_reach`` from rows at the first ``early`` positions (1..early)."""
    later = window_pairs(df, position, reach, cols).where(F.col("pos_a") > early)
    return window_pairs(df.where(F.col(position) <= early + early_reach), position, early_reach, cols).where(F.col("pos_a") <= early).unionByName(later)


def cascade(pairs: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Pairs with the first stage that rejects them, or 'kept': cheap conditions come first.

    A stage's condition that is null (a value is missing) does not reject.
    """
    verdict = F.lit("kept")
    for name, keep in reversed(stages):
        verdict = F.when(~F.coalesce(keep, F.lit(True)), name).otherwise(verdict)
    return pairs.withColumn("verdict", verdict)


# ---------------------------------------------------------------- near duplicates
LIMBS, HANDS = [15, 16, 27, 28], list(range(17, 23))  # fixed values: wrists and ankles; fingers and thumbs
LIMIT = {"limbs": 0.8, "head": 15.0, "box": 80.0, "face": 0.5, "body": 1.0, "hands": 1.0}  # fixed values: a distance is divided by its limit
MOST_SUM, AUTO, SITE_SCALE = 2.0, 0.2, 100_000.0
TERMS = [*LIMIT, "description", "site"]
NEAR_SCHEMA = "encoding_id_a long, encoding_id_b long, image_id_a long, image_id_b long, " + ", ".join(f"{t} double" for t in TERMS) + ", verdict string"
VERDICTS = ["kept", "distance", "same image", "known not dupe", "face", "not comparable"]


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Lists of exactly ``width`` finite numbers, not all zero, as rows; every other list as a row of NaN."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.full((len(sizes), width), np.nan)
    own = np.flatnonzero(sizes == width)
    out[own] = flat[(np.cumsum(sizes)[own] - width)[:, None] + np.arange(width)]
    out[~np.isfinite(out).all(1) | (out == 0).all(1)] = np.nan
    return out


def _posture(col: pa.Array) -> np.ndarray:
    """x and y of 33 points from the nose, in distances from the nose to the middle of the shoulders."""
    four, three = _matrix(col, 132).reshape(-1, 33, 4)[..., :2], _matrix(col, 99).reshape(-1, 33, 3)[..., :2]
    p = np.where(np.isnan(four), three, four)
    p = p - p[:, :1]
    unit = np.linalg.norm(p[:, 11:13].mean(1), axis=1)
    return p / np.where(unit > 0, unit, np.nan)[:, None, None]


def near_duplicates(rows: DataFrame, reach: int, not_dupes: DataFrame | None = None, rows_per_block: int = 1000) -> DataFrame:
    """All pairs at most ``reach`` positions apart with their terms and the stage that rejects them, or 'kept'.

    ``rows``: pos (1..n without gaps), encoding_id, image_id, head, box, face, body (arrays or null), description, site,
    site_number.  ``not_dupes``: image ids i, j of pairs known not to be duplicates, in either order.

    1 'distance': the terms limbs, head and box sum up to more than 2 and none is below 0.2; 2 'same image', 'known not
    dupe' (by image ids); 3 'face': the face term isn't below 1; 4 body, hands, description and site terms, which reject
    nothing.  A term that lacks a usable value on either side is null: it is left out of the sum and of 'none below' and
    rejects nothing; a pair that has no term of stages 1 and 3 is 'not comparable'.  Terms of stages not reached are null.

    Rows are cut into blocks of positions; a block also gets the ``reach`` rows after it, so every pair is in the
    block of its first row and no vector travels more than a few times.
    """
    place = F.col("pos") - 1
    size = max(rows_per_block, reach)
    own = F.floor(place / size).cast("long")
    spread = rows.withColumn("_block", F.explode(F.when((place % size < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n, block = len(t), t["_block"][0].as_py()
        col = lambda c: t[c].to_numpy()
        first = int(np.searchsorted(col("pos"), (block + 1) * size, side="right"))  # rows of the block itself
        body = _posture(t["body"])
        vec = {"limbs": body[:, LIMBS].reshape(n, -1), "head": _matrix(t["head"], 3), "box": _matrix(t["box"], 4), "face": _matrix(t["face"], 128), "body": body.reshape(n, -1), "hands": body[:, HANDS].reshape(n, -1)}
        text = pc.dictionary_encode(t["description"].combine_chunks()).indices.fill_null(-1).to_numpy()
        number, site, enc, img = t["site_number"].to_pandas().to_numpy(float), t["site"].to_pandas().to_numpy(float), col("encoding_id"), col("image_id")
        parts = []
        for k in range(1, reach + 1):
            i = np.arange(min(first, n - k))
            if not len(i):
                break
            j = i + k
            far = lambda v: np.linalg.norm(vec[v][i] - vec[v][j], axis=1) / LIMIT[v]  # noqa: B023, E731
            x = {v: far(v) for v in LIMIT}
            one = np.stack([x["limbs"], x["head"], x["box"]])
            with np.errstate(invalid="ignore"):
                code = np.zeros(len(i), int)
                none = np.isnan(one).all(0) & np.isnan(x["face"])
                code[none] = 5
                code[x["face"] >= 1] = 4
                code[img[i] == img[j]] = 2
                code[(np.nansum(one, 0) > MOST_SUM) & ~(one < AUTO).any(0)] = 1
                apart = np.abs(number[i] - number[j])
                together = np.where(np.isnan(apart), 0.5, apart)
                same = site[i] == site[j]
                x["site"] = np.where(same & (together > 0), SITE_SCALE / np.where(together > 0, together, 1), 0.0)
            x["description"] = np.where(text[i] == text[j], np.where(text[i] < 0, 0.5, 0.0), 1.0)
            for v in ("body", "hands", "description", "site"):
                x[v] = np.where(code == 0, x[v], np.nan)
            x["face"] = np.where((code == 0) | (code == 4), x["face"], np.nan)
            parts.append({"encoding_id_a": enc[i], "encoding_id_b": enc[j], "image_id_a": img[i], "image_id_b": img[j], **{v: x[v] for v in TERMS}, "verdict": code})
        fields = ["encoding_id_a", "encoding_id_b", "image_id_a", "image_id_b", *TERMS, "verdict"]
        out = {f: np.concatenate([p[f] for p in parts]) if parts else np.array([]) for f in fields}
        ids = {f: pa.array(out[f].astype("int64")) for f in fields[:4]}
        return pa.table(ids | {v: pa.array(np.round(out[v].astype(float), 4), from_pandas=True) for v in TERMS} | {"verdict": pa.array(VERDICTS).take(pa.array(out["verdict"].astype("int64")))})

    pairs = spread.groupBy("_block").applyInArrow(run, NEAR_SCHEMA)
    if not_dupes is None:
        return pairs
    known = not_dupes.select(F.least("i", "j").alias("_lo"), F.greatest("i", "j").alias("_hi")).distinct().withColumn("_known", F.lit(True))
    j = pairs.withColumns({"_lo": F.least("image_id_a", "image_id_b"), "_hi": F.greatest("image_id_a", "image_id_b")}).join(known, ["_lo", "_hi"], "left")
    hit = F.col("_known").isNotNull() & ~F.col("verdict").isin("distance", "same image")
    later = ("face", "body", "hands", "description", "site")
    return j.select(*[F.when(~hit, F.col(c)).alias(c) if c in later else c for c in pairs.columns if c != "verdict"], F.when(hit, "known not dupe").otherwise(F.col("verdict")).alias("verdict"))


def keeper_chain(pairs: DataFrame) -> DataFrame:
    """``id, keeper``: the rows dropped when pairs (a before b, by id) are taken in order: b is a dupe of a unless a is one itself.

    A dupe is never a keeper, so its own partners may stay.  In a round, rows with no open pair before them are
    kept, their partners are dupes, and all pairs of both are settled; the first row of every connected component
    is settled at least, so the rounds end.  The keeper is the first kept partner.
    """
    edges = materialize(pairs.where("a < b").distinct(), "edges").df
    first = edges
    dupes = None
    while not edges.isEmpty():
        roots = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")), "id", "left_anti")
        now = materialize(edges.join(roots.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dupes").df
        dupes = now if dupes is None else dupes.unionByName(now)
        gone = roots.unionByName(now)
        edges = materialize(edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(now.withColumnRenamed("id", "b"), "b", "left_anti"), "edges").df
    if dupes is None:
        return first.select(F.col("a").alias("id"), F.col("b").alias("keeper"))
    by = first.join(dupes.withColumnRenamed("id", "b"), "b").join(dupes.withColumnRenamed("id", "a"), "a", "left_anti")
    return by.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("keeper"))

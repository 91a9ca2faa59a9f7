"""Groups of mutually similar records by grid density clustering.

1. A posture is reduced to what is left without position and size: visible points
   minus their centre, divided by their root mean square radius, then written in
   ``CHECK_DIMS`` principal directions.  Points of low visibility are left out of
   the fit, not guessed (least squares over the visible points).  The directions
   come from a sample of at most ``sample_rows`` rows; every row is projected.
2. The first ``GRID_DIMS`` scores are quantised; cells are counted (map-side
   combined, so a cell with a third of all rows costs one row per task).
3. Cells of at least ``dense`` members are dense.  Dense cells that touch (every
   coordinate differs by at most one) and whose mean postures are closer than
   ``link`` are joined; a sparse cell joins the dense ones it touches as their border
   and carries no label on.  Neighbours are found by an equality join on the first
   coordinates, in which only dense cells are copied to their surroundings; a key
   that many cells share is split by adaptive skew handling.
4. Minimum labels spread over the joined dense cells, with pointer jumping, until
   nothing changes; every round is written to the shared folder.  Rows whose cells
   stay sparse and alone are quantised once more on a grid moved by half a cell, so
   that a small group cut up by cell borders is found there.
5. An exact check keeps members within ``link`` of their group's mean posture; groups
   need ``least`` members.  A group is described by its size, by the members of
   its densest cell nearest to the mean, and by the name most members carry.

Defined cases: null, short, non-finite and all-zero vectors and vectors with fewer
than 8 visible points are left out; of several usable rows of an item the smallest
row id counts; ties between names go to the smaller one; a group none of whose
members has a name gets a null one; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.llm.topn import latest_per_item, top_n
from frameatlas.runtime import hash_sample, materialize, single_blas_thread

POINTS, GRID_DIMS, CHECK_DIMS, NEAR_DIMS = 33, 8, 16, 4
MIN_VISIBLE, GUESS_BELOW = 8, 0.1


def postures(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised points (n, 33, 3) and their visibility mask; rows must have 132 or 99 finite numbers."""
    sizes = np.asarray(col.value_lengths())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    pts, seen = np.zeros((len(sizes), POINTS, 3)), np.ones((len(sizes), POINTS), bool)
    for width in (3, 4):
        own = np.flatnonzero(sizes == POINTS * width)
        if len(own):
            at = (ends[own] - sizes[own])[:, None] + np.arange(POINTS * width)
            v = flat[at].reshape(-1, POINTS, width)
            pts[own] = v[:, :, :3]
            if width == 4:
                seen[own] = v[:, :, 3] >= GUESS_BELOW
    w = seen[:, :, None]
    n = np.maximum(seen.sum(1), 1)[:, None, None]
    pts = (pts - (pts * w).sum(1, keepdims=True) / n) * w
    radius = np.sqrt((pts**2).sum((1, 2)) / n[:, 0, 0])
    return pts / np.maximum(radius, 1e-12)[:, None, None], seen


class Basis:
    """Principal directions of normalised postures.

    Fitted on the rows with all points visible; if they are too few, on all rows with
    missing points at the mean.
    """

    def __init__(self, pts: np.ndarray, seen: np.ndarray, dims: int = CHECK_DIMS):
        whole = seen.all(1)
        if whole.sum() >= max(32, 0.05 * len(seen)):
            pts, seen = pts[whole], seen[whole]
        w = seen[:, :, None]
        self.mean = pts.sum(0) / np.maximum(w.sum(0), 1)
        y = ((pts - self.mean) * w).reshape(len(pts), -1)
        _, u = np.linalg.eigh(y.T @ y / max(1, len(pts)))
        self.dirs = u[:, ::-1][:, :dims]
        for j in range(dims):  # the sign of a direction is free: fix it
            self.dirs[:, j] *= np.sign(self.dirs[np.argmax(np.abs(self.dirs[:, j])), j]) or 1.0
        per_point = self.dirs.reshape(POINTS, 3, dims)
        self.gram = np.einsum("jda,jdb->jab", per_point, per_point).reshape(POINTS, -1)

    def scores(self, pts: np.ndarray, seen: np.ndarray) -> np.ndarray:
        k = self.dirs.shape[1]
        y = ((pts - self.mean) * seen[:, :, None]).reshape(len(pts), -1)
        a = (seen @ self.gram).reshape(-1, k, k) + 0.05 * np.eye(k)
        return np.linalg.solve(a, (y @ self.dirs)[:, :, None])[:, :, 0]


def _usable(v: str):
    c = F.col(v)
    return F.size(c).isin(POINTS * 4, POINTS * 3) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(c, lambda x: x != 0)


def _features(src: DataFrame, rows: int, sample_rows: int) -> DataFrame | None:
    """``item, z array<float>``: one row per item; ``rows`` is the size of the table, usable or not."""
    picked = hash_sample(src, "row", sample_rows, rows).select("row", "vec").toArrow().sort_by("row")
    if not picked.num_rows:
        return None
    basis = Basis(*postures(picked["vec"].combine_chunks()))

    def project(batches):
        single_blas_thread()
        for b in batches:
            pts, seen = postures(b.column("vec"))
            z = basis.scores(pts, seen).astype(np.float32)
            ok = pa.array(seen.sum(1) >= MIN_VISIBLE)
            arr = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("row"), arr(z)], names=["item", "row", "z"]).filter(ok)

    projected = src.mapInArrow(project, "item long, row long, z array<float>")
    return projected.groupBy("item").agg(F.min(F.struct("row", "z")).alias("m")).select("item", "m.z")


def _gap(a, b):
    """Distance of two score arrays as root mean square per point."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, x: s + x) / POINTS)


def _mean(z: str = "z"):
    return F.array(*[F.avg(F.col(z)[i]) for i in range(CHECK_DIMS)])


def cell_labels(cells: DataFrame, link: float, dense: int) -> DataFrame:
    """``id, label`` of dense cells and of the sparse ones at their border, for cells (id, cell, n, mean)."""
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    thick = F.col("n") >= dense
    near = cells.where(thick).select("id", "cell", "mean")
    for i in range(NEAR_DIMS):
        near = near.withColumn(f"s{i}", F.explode(steps))
    key = F.struct(*[(F.col("cell")[i] + F.col(f"s{i}")).alias(f"k{i}") for i in range(NEAR_DIMS)])
    left = near.select(F.col("id").alias("a"), F.col("cell").alias("ca"), F.col("mean").alias("ma"), key.alias("k"))
    right = cells.select(F.col("id").alias("b"), F.col("cell").alias("cb"), F.col("mean").alias("mb"), thick.alias("dense_b"), F.struct(*[F.col("cell")[i].alias(f"k{i}") for i in range(NEAR_DIMS)]).alias("k"))
    touch = F.forall(F.zip_with("ca", "cb", lambda x, y: F.abs(x - y)), lambda d: d <= 1)
    touching = materialize(left.join(right, "k").where((F.col("a") != F.col("b")) & touch).where(_gap(F.col("ma"), F.col("mb")) <= link).select("a", "b", "dense_b"), "grid-edges")
    edges = touching.df.where("dense_b").select("a", "b")
    state = materialize(cells.where(thick).select("id", F.col("id").alias("label")), "grid-labels")
    while True:
        around = edges.join(state.df.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("l2"))
        spread = state.df.join(around, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "l2").alias("label"))
        jump = state.df.select(F.col("id").alias("label"), F.col("label").alias("root"))
        nxt = materialize(spread.join(jump, "label", "left").select("id", "old", F.least("label", "root").alias("label")), "grid-labels")
        changed = nxt.df.where("label <> old").limit(1).count()
        state.drop()
        state = nxt
        if not changed:
            break
    border = touching.df.where("not dense_b").join(state.df.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("label"))
    labels = materialize(state.df.select("id", "label").unionByName(border), "grid-labels")
    touching.drop()
    state.drop()
    return labels.df


def density_groups(df: DataFrame, item: str, row: str, vector: str, least: int = 5, width: float = 0.6, link: float = 0.2, dense: int = 2, sample_rows: int = 4_096) -> DataFrame | None:
    """``item, group, cell_n, gap``: members of groups with at least ``least`` items; None for no usable row."""
    src = df.select(F.col(item).cast("long").alias("item"), F.col(row).cast("long").alias("row"), F.col(vector).alias("vec")).where(F.col("item").isNotNull() & _usable("vec"))
    feats = _features(src, df.count(), sample_rows)
    if feats is None:
        return None
    rows, found = materialize(feats, "grid-rows"), []
    for offset in (0.0, 0.5):
        cell = F.transform(F.slice("z", 1, GRID_DIMS), lambda x: F.floor(x / width + offset).cast("int"))
        placed = rows.df.withColumn("cell", cell).withColumn("id", F.xxhash64(F.lit(offset), "cell"))
        cells = materialize(placed.groupBy("id").agg(F.first("cell").alias("cell"), F.count("*").alias("n"), _mean().alias("mean")), "grid-cells")
        labels = cell_labels(cells.df, link, dense)
        known = cells.df.join(labels, "id")
        # the mean of a group from its cells' means and counts
        group_mean = known.groupBy("label").agg(F.sum("n").alias("size"), F.array(*[F.sum(F.col("mean")[i] * F.col("n")) / F.sum("n") for i in range(CHECK_DIMS)]).alias("gm")).where(F.col("size") >= least)
        cell_info = known.join(group_mean, "label").select("id", "label", F.col("n").alias("cell_n"), "gm")
        member = placed.join(cell_info, "id").select("item", F.col("label").alias("group"), "cell_n", _gap(F.col("z"), F.col("gm")).alias("gap"))
        found.append(materialize(member.where(F.col("gap") <= link), "grid-members").df)
        if not offset:
            alone = materialize(placed.join(labels, "id", "left_anti").select("item", "z"), "grid-rows")
            rows.drop()
            rows = alone
        cells.drop()
    rows.drop()
    member = found[0].unionByName(found[1])
    enough = member.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return member.join(enough, "group")


def name_groups(members: DataFrame, names: DataFrame, name_item: str, name: str, at: str) -> DataFrame:
    """``group, name``: the name most members carry (latest row of each item), ties to the smaller name."""
    current = latest_per_item(names, name_item, at, [name]).where(F.col(name).isNotNull()).select(F.col(name_item).alias("item"), F.col(name).alias("name"))
    votes = members.select("item", "group").join(current, "item").groupBy("group", "name").agg(F.count("*").alias("votes"))
    return votes.groupBy("group").agg(F.min_by("name", F.struct(-F.col("votes"), F.col("name"))).alias("name"))


def describe_groups(members: DataFrame, names: DataFrame, typical: int = 3) -> DataFrame:
    """``group, name, size, typical_items``: typical items lie in the densest cell, nearest to the mean first."""
    order = -F.col("cell_n").cast("double") * 10 + F.col("gap")
    best = top_n(members.withColumn("_o", order), "group", "_o", "item", typical)
    listed = best.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda s: s["item"]).alias("typical_items"))
    return members.groupBy("group").agg(F.max("size").alias("size")).join(names, "group", "left").join(listed, "group").select("group", "name", "size", "typical_items")

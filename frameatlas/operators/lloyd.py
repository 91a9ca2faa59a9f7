"""Several seeded k-means fits at once, and geometric medians: every pass over the data serves all of them.

Seeds come from k-means++ on a bounded sample (``sample_rows``); the passes run over
all rows.  A task gives one row of sums per fit and cluster; those are added up in a
second stage, so the driver gets fits x k rows a pass, however many tasks there are.
Fits that have settled (centres move less than ``tolerance`` of the mean variance)
drop out.  Empty clusters keep their centre; null vectors and
vectors with a null or NaN take no part; fewer rows than k give as many clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameatlas.runtime import hash_sample, materialize, single_blas_thread

_SUMS = "fit int, cluster int, n long, cost double, total array<double>"


def _rows(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of ``x``, each drawn with odds of its squared distance to those before."""
    at = [int(rng.integers(len(x)))]
    d = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < min(k, len(x)):
        total = d.sum()
        at.append(int(rng.choice(len(x), p=d / total)) if total > 0 else int(rng.integers(len(x))))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def kmeans(df: DataFrame, vector: str, k: int, fits: int = 10, most_passes: int = 300, tolerance: float = 1e-4, seed: int = 42, sample_rows: int = 10_000) -> tuple[np.ndarray, float]:
    """``(centres, cost)`` of the cheapest of ``fits`` fits."""
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    data = materialize(df.where(sound).select(F.transform(vector, lambda x: x.cast("double")).alias("v")), "kmeans").df
    few = hash_sample(data, "v", sample_rows).toArrow()
    if not few.num_rows:
        return np.zeros((0, 0)), 0.0
    x = _rows(few["v"].combine_chunks())
    x = x[np.lexsort(x.T[::-1])]
    settled = tolerance * float(x.var(0).mean())  # of the squared moves of all centres together
    centres = {f: plus_plus(x, k, np.random.default_rng(seed + f)) for f in range(fits)}
    costs: dict[int, float] = {}
    moving = set(centres)

    def sums(batches):
        single_blas_thread()
        todo = {f: centres[f] for f in sorted(moving)}
        acc = {f: [np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(c.shape)] for f, c in todo.items()}
        for b in batches:
            v = _rows(b.column("v"))
            for f, c in todo.items():
                d = (c * c).sum(1)[None, :] - 2 * v @ c.T
                own = d.argmin(1)
                gap = np.maximum(d[np.arange(len(v)), own] + (v * v).sum(1), 0.0)
                acc[f][0] += np.bincount(own, minlength=len(c))
                acc[f][1] += np.bincount(own, gap, len(c))
                pick = np.zeros((len(c), len(v)))
                pick[own, np.arange(len(v))] = 1.0
                acc[f][2] += pick @ v
        rows = [(f, j, int(a[0][j]), float(a[1][j]), a[2][j].tolist()) for f, a in acc.items() for j in range(len(a[0]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], names=["fit", "cluster", "n", "cost", "total"])

    def added(t: pa.Table) -> pa.Table:
        return pa.table({"fit": t["fit"][:1], "cluster": t["cluster"][:1], "n": [int(t["n"].to_numpy().sum())], "cost": [float(t["cost"].to_numpy().sum())], "total": [_rows(t["total"].combine_chunks()).sum(0).tolist()]})

    for _ in range(most_passes):
        parts = data.mapInArrow(sums, _SUMS)
        whole = parts if data.rdd.getNumPartitions() == 1 else parts.groupBy("fit", "cluster").applyInArrow(added, _SUMS)
        got = whole.toArrow()
        total, n = _rows(got["total"].combine_chunks()), got["n"].to_numpy()
        fit, cluster, cost = got["fit"].to_numpy(), got["cluster"].to_numpy(), got["cost"].to_numpy()
        for f in list(moving):
            own = fit == f
            new = centres[f].copy()
            use = own & (n > 0)
            new[cluster[use]] = total[use] / n[use][:, None]
            costs[f] = float(cost[own].sum())
            if ((new - centres[f]) ** 2).sum() <= settled:
                moving.discard(f)
            centres[f] = new
        if not moving:
            break
    best = min(costs, key=lambda f: (costs[f], f))
    return centres[best], costs[best]


def geometric_medians(df: DataFrame, group: str, vector: str, most_passes: int = 40, tolerance: float = 1e-5) -> DataFrame:
    """``group, n, median, median_cost, mean_cost``: per group the point with the least sum of distances, and that sum and the mean's.

    Every pass adds, per task and group, the vectors and ones over their distances to
    the current point; the sums of all tasks move the point (Weiszfeld).  Groups are a
    table, joined by key, so their number isn't bounded by the driver; a group's rows are
    never together.  Components below 1e-6 become 0.  Null groups and vectors take no part.
    """
    spark = df.sparkSession
    rows = materialize(df.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).cast("long").alias("group"), F.transform(vector, lambda x: x.cast("double")).alias("v")), "medians").df
    sums = "group long, n long, weight double, cost double, total array<double>"
    point = "group long, n long, moved double, cost double, at array<double>"

    def near(batches):
        acc: dict[int, list] = {}
        for b in batches:
            v, at, g = _rows(b.column("v")), _rows(b.column("at")), b.column("group").to_numpy(zero_copy_only=False)
            d = np.sqrt(((v - at) ** 2).sum(1))
            w = 1 / np.maximum(d, 1e-12)
            one, which = np.unique(g, return_inverse=True)
            total = np.zeros((len(one), v.shape[1]))
            np.add.at(total, which, v * w[:, None])
            for j, k in enumerate(one.tolist()):
                own = which == j
                a = acc.setdefault(k, [0, 0.0, 0.0, np.zeros(v.shape[1])])
                acc[k] = [a[0] + int(own.sum()), a[1] + w[own].sum(), a[2] + d[own].sum(), a[3] + total[j]]
        cols = [list(acc), *([a[i] for a in acc.values()] for i in range(3)), [a[3].tolist() for a in acc.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())))], names=["group", "n", "weight", "cost", "total"])

    def moved(t: pa.Table) -> pa.Table:
        old, total = _rows(t["old"].combine_chunks())[0], _rows(t["total"].combine_chunks()).sum(0)
        new = total / t["weight"].to_numpy().sum()
        return pa.table({"group": t["group"][:1], "n": [int(t["n"].to_numpy().sum())], "moved": [float(np.linalg.norm(new - old))], "cost": [float(t["cost"].to_numpy().sum())], "at": [new.tolist()]})

    dims = rows.select(F.max(F.size("v"))).first()[0] or 0
    start = rows.groupBy("group").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(dims)]).alias("at")) if dims else None
    if start is None:
        return spark.createDataFrame([], "group long, n long, median array<double>, median_cost double, mean_cost double")
    state, first = materialize(start, "median"), None
    for n in range(most_passes + 1):
        parts = rows.join(state.df.select("group", "at"), "group").mapInArrow(near, sums)
        old = state.df.select("group", F.col("at").alias("old"))
        now = materialize(parts.join(old, "group").groupBy("group").applyInArrow(moved, point), "median")
        first = first or now  # costs at the means
        far = now.df.where(F.col("moved") >= tolerance).limit(1).count()
        if not far or n == most_passes:
            break
        if state is not first:
            state.drop()
        state = now
    small = F.transform("at", lambda x: F.when(F.abs(x) < 1e-6, 0.0).otherwise(x))
    return now.df.select("group", "n", small.alias("median"), F.col("cost").alias("median_cost")).join(first.df.select("group", F.col("cost").alias("mean_cost")), "group")

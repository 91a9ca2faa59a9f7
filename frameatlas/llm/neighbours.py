"""The k most similar vectors for every vector of a collection.

Shards are the leaves of a vantage-point tree built from a bounded sample
(``sample_rows``); every vector of the collection is indexed in its own shard,
where a second tree is searched.  Queries go to their own shard and to the shards
that the triangle inequality, relaxed by ``relax``, does not rule out: a shard is
skipped where its lower bound exceeds ``relax`` times the distance of the query's
k-th neighbour.  Their number grows with the square root of the rows (a query's
copies with a small power of that) until a shard would pass ``most_per_shard``, and
the sample grows with the shards (``per_shard`` vectors each).  ``relax=1`` restores
exact search, on the vectors as they are; ``None`` picks the smallest factor that
keeps ``target_recall`` on probes whose true neighbours were found by one exact pass
over all rows, and vectors then travel as 16-bit steps of their largest component.

Two passes: the first uses a distance bound that covers the probes; queries whose
k-th neighbour turns out farther than that take a second pass over the shards they
still owe.

Skew: equal vectors form one class that is searched once; a class offers its k + 1
smallest ids (no more can ever be needed) and its result is joined back to all
members, so a third of all rows with one vector are one point in one shard.

Defined cases: null, short, non-finite and all-zero vectors are left out; of
several usable vectors of one item the one with the smallest row id counts; ties in
distance (below factor 1 vectors are held to 1/32767 of their largest component) go to the smaller item; with at most k other items all of them come out;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.llm.vptree import Tree, distances, nearest
from frameatlas.runtime import hash_sample, materialize, single_blas_thread

_ROUTED = "leaf int, h1 long, h2 long, ids array<long>, vec binary, slack float, ask boolean"
LAST: dict[str, float] = {}  # what the latest call chose, for reports
_FOUND = "h1 long, h2 long, near array<struct<dist: double, id: long>>"


def pack(x: np.ndarray, whole: bool = False) -> list[bytes]:
    """Vectors as they are (float32), or as a scale and int16 steps: half the bytes, exact to 1/32767 of the largest component."""
    if whole:
        return [r.tobytes() + b"\0" for r in x.astype("<f4")]  # an odd length tells the two forms apart
    scale = (np.abs(x).max(1, initial=0.0) / 32767.0).astype(np.float32)
    steps = np.rint(x / np.maximum(scale, 1e-30)[:, None]).astype("<i2")
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, steps)]


def unpack(col, size: int) -> np.ndarray:
    rows = col.to_pylist()
    if rows and len(rows[0]) % 2:
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 4 * size + 1)[:, :-1].copy().view("<f4").astype(np.float64)
    flat = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 4 + 2 * size)
    scale = flat[:, :4].copy().view(np.float32)
    return flat[:, 4:].copy().view("<i2").astype(np.float32) * scale


def packed(df: DataFrame, item: str, row: str, vector: str, size: int, whole: bool = False) -> DataFrame:
    """``item, row, vec``: the usable vectors, packed."""

    def run(batches):
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            at = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("item").filter(at), b.column("row").filter(at), pa.array(pack(x[ok], whole), pa.binary())], names=["item", "row", "vec"])

    src = df.select(F.col(item).cast("long").alias("item"), F.col(row).cast("long").alias("row"), F.col(vector).alias("vec"))
    return src.where(F.col("item").isNotNull() & (F.size("vec") == size)).mapInArrow(run, "item long, row long, vec binary")


def _probe(base: DataFrame, q: np.ndarray, own: np.ndarray, k: int, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Exact k nearest others of the probe vectors (``own``: their first hashes): one pass, k rows per probe and task."""

    def scan(batches):
        single_blas_thread()
        best: list[list[tuple[float, bytes]]] = [[] for _ in range(len(q))]
        for b in batches:
            x = unpack(b.column("vec"), size)
            if not len(x):
                continue
            d = distances(q, x)
            d[own[:, None] == b.column("h1").to_numpy()[None, :]] = np.inf  # the probe itself
            m = min(k, len(x))
            sel = np.argpartition(d, m - 1, axis=1)[:, :m]
            for i in range(len(q)):
                best[i] = sorted(best[i] + [(float(d[i, j]), x[j].astype(np.float32).tobytes()) for j in sel[i] if np.isfinite(d[i, j])])[:k]
        flat = [(i, d, v) for i, r in enumerate(best) for d, v in r]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.float64()), pa.array([f[2] for f in flat], pa.binary())], names=["q", "dist", "vec"])

    rows = base.select("h1", "vec").mapInArrow(scan, "q int, dist double, vec binary")
    w = W.partitionBy("q").orderBy("dist")
    got = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toArrow()
    qi, di, vi = got["q"].to_numpy(), got["dist"].to_numpy(), got["vec"].to_pylist()
    kth, vecs = np.full(len(q), np.nan), []
    for i in range(len(q)):
        own = np.flatnonzero(qi == i)
        kth[i] = di[own].max() if len(own) else np.nan
        vecs.append(np.frombuffer(b"".join(vi[j] for j in own), np.float32).reshape(-1, size))
    return kth, vecs


def _pick_relax(sample: np.ndarray, q: np.ndarray, kth: np.ndarray, near: list[np.ndarray], rows: int, leaf: int, target: float, hint: float) -> float:
    """Smallest factor that keeps the target recall over a tree as deep as the whole index."""
    depth = max(1, min(9, int(np.log2(max(2, len(sample) / 16)))))
    tree = Tree(sample, depth, least=4, seed=1)
    whole = max(1.0, np.log2(max(2.0, rows / leaf)))
    ok = np.flatnonzero(np.isfinite(kth))
    homes = {}
    for i in ok:
        h = np.empty(len(near[i]), int)
        for lf, r, home in tree.visits(near[i], np.zeros(len(near[i]))):
            h[r[home]] = lf
        homes[i] = h
    for relax in (0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7):
        seen: dict[int, set[int]] = {int(i): set() for i in ok}
        for lf, r, _ in tree.visits(q[ok], np.full(len(ok), relax * hint)):
            for j in r:
                seen[int(ok[j])].add(lf)
        hit = np.mean([np.isin(homes[i], list(seen[int(i)])).mean() for i in ok]) if len(ok) else 1.0
        if hit ** (whole / max(1, depth)) >= target:
            return relax
    return 1.0


def most_similar(
    df: DataFrame, item: str, row: str, vector: str, k: int = 5, size: int = 128, relax: float | None = None, target_recall: float = 0.97,
    shards: int | None = None, leaf_rows: int = 512, sample_rows: int = 8_192, probes: int = 192, per_shard: int = 16, most_per_shard: int = 100_000, asked: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(item, neighbour_id, distance)``: k rows per item with a usable vector.

    ``asked`` says of an item whether it is a query; all items are searched in any case.
    """
    wanted_item = asked or (lambda _: F.lit(True))
    single_blas_thread()  # many small products: threads of their own only wait for each other
    spark = df.sparkSession
    src = materialize(packed(df, item, row, vector, size, relax == 1.0).select("item", "row", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "vec"), "knn-packed")
    firsts = materialize(src.df.groupBy("item").agg(F.min(F.struct("row", "h1", "h2")).alias("m")).select("item", "m.*"), "knn-items")
    smallest = firsts.df.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("item"))).where(F.col("r") <= k + 1)
    classes = smallest.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("item")).alias("ids"), F.min_by("row", "item").alias("row"))
    if asked:  # a class asks if any of its items does
        asking = firsts.df.where(wanted_item(F.col("item"))).select("h1", "h2").distinct().withColumn("ask", F.lit(True))
        classes = classes.join(asking, ["h1", "h2"], "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    else:
        classes = classes.withColumn("ask", F.lit(True))
    base = materialize(src.df.select("row", "vec").join(classes, "row").select("h1", "h2", "ids", "vec", "ask"), "knn-base")
    src.drop()
    n = base.rows()
    if n == 0:
        return firsts.df.select(F.col("item").alias(item), F.col("item").alias("neighbour_id"), F.lit(0.0).alias("distance")).limit(0)
    wanted = shards or max(n**0.5 / 60, n / most_per_shard)
    picked = hash_sample(base.df, "h1", max(sample_rows, int(per_shard * wanted)), n).select("h1", "vec").toArrow().sort_by("h1")
    sample = unpack(picked["vec"], size)
    q, own = sample[: min(probes, len(sample))], picked["h1"].to_numpy()[: min(probes, len(sample))]
    kth, near = _probe(base.df, q, own, k, size)
    hint = 1.25 * float(np.nanmax(kth)) if np.isfinite(kth).any() else 1.0
    factor = relax if relax is not None else _pick_relax(sample, q, kth, near, n, leaf_rows, target_recall, hint)
    top = Tree(sample, int(np.ceil(np.log2(max(1, wanted)))), least=1, seed=2)
    LAST.update(relax=factor, hint=hint, shards=len(top.leaves), rows=n)
    shared = spark.sparkContext.broadcast(top)  # at most 2 x sample_rows vectors

    def routed(h1, h2, idlists, vec, slack_rows, done_slack, ask=None):
        """Rows for the shards to visit; ``done_slack`` rules out what an earlier pass visited."""
        tree, x = shared.value, unpack(vec, size)
        earlier = {}
        if done_slack is not None:
            for lf, r, _ in tree.visits(x, done_slack):
                earlier[lf] = r
        for lf, r, home in tree.visits(x, slack_rows):
            first = done_slack is None
            keep = r if first else np.setdiff1d(r, earlier.get(lf, r[:0]))
            if not len(keep):
                continue
            is_home = home if first else np.zeros(len(keep), bool)
            at = pa.array(keep)
            lists = idlists.take(at) if first else pa.nulls(len(keep), pa.list_(pa.int64()))
            if first:
                lists = pa.array([v if h else None for v, h in zip(lists.to_pylist(), is_home)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), lf, np.int32)), h1.take(at), h2.take(at), lists, vec.take(at), pa.array(slack_rows[keep].astype(np.float32)), ask.take(at) if ask is not None else pa.array(np.ones(len(keep), bool))], names=["leaf", "h1", "h2", "ids", "vec", "slack", "ask"])

    def first_pass(batches):
        single_blas_thread()
        for b in batches:
            ask = b.column("ask")  # what doesn't ask only goes home
            yield from routed(b.column("h1"), b.column("h2"), b.column("ids"), b.column("vec"), np.where(ask.to_numpy(zero_copy_only=False), factor * hint, -1.0), None, ask)

    def second_pass(batches):
        single_blas_thread()
        for b in batches:
            d = b.column("kth").to_numpy(zero_copy_only=False)
            slack = np.where(np.isfinite(d), factor * d, np.inf)
            yield from routed(b.column("h1"), b.column("h2"), None, b.column("vec"), slack, np.full(b.num_rows, factor * hint))

    def search(leaf: pa.Table) -> pa.Table:
        single_blas_thread()
        x_all = unpack(leaf["vec"], size)
        lists = leaf["ids"].to_pylist()
        data = np.array([i for i, v in enumerate(lists) if v is not None], int)
        queries = np.flatnonzero(leaf["ask"].to_numpy())
        if _only_new:
            queries = queries[[lists[i] is None for i in queries]]
        if not len(data) or not len(queries):
            return pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("dist", pa.float64()), ("id", pa.int64())])))})
        best, dist = nearest(x_all[data], x_all[queries], k + 1, factor, hint, leaf_rows)
        out_d, out_i, offsets = [], [], [0]
        simple = [lists[i] for i in data]
        for b, d in zip(best, dist):
            pairs = sorted((dd, e) for j, dd in zip(b.tolist(), d.tolist()) if j >= 0 for e in simple[j])[: k + 1]
            out_d.extend(p[0] for p in pairs)
            out_i.extend(p[1] for p in pairs)
            offsets.append(len(out_d))
        st = pa.StructArray.from_arrays([pa.array(out_d, pa.float64()), pa.array(out_i, pa.int64())], names=["dist", "id"])
        at = pa.array(queries)
        return pa.table({"h1": leaf["h1"].combine_chunks().take(at), "h2": leaf["h2"].combine_chunks().take(at), "near": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), st)})

    def merged(parts: DataFrame) -> DataFrame:
        lists = F.array_sort(F.flatten(F.collect_list("near")))
        return parts.groupBy("h1", "h2").agg(F.slice(lists, 1, k + 1).alias("near"))

    _only_new = False
    home = base.df.mapInArrow(first_pass, _ROUTED)
    found = materialize(merged(home.repartition(len(top.leaves), "leaf").groupBy("leaf").applyInArrow(search, _FOUND)), "knn-found")
    if len(top.leaves) > 1:
        far = F.when(F.size("near") > k, F.get("near", F.lit(k))["dist"])
        late = found.df.select("h1", "h2", F.coalesce(far, F.lit(float("inf"))).alias("kth")).where(F.col("kth") > hint)
        owed = materialize(base.df.join(late, ["h1", "h2"]).select("h1", "h2", "vec", "kth").mapInArrow(second_pass, _ROUTED), "knn-owed")
        if owed.rows():
            _only_new = True
            need = owed.df.select("leaf").distinct()
            own = base.df.mapInArrow(lambda bs: (r.filter(pa.array([v is not None for v in r.column("ids").to_pylist()], pa.bool_())) for b in bs for r in routed(b.column("h1"), b.column("h2"), b.column("ids"), b.column("vec"), np.zeros(b.num_rows), None)), _ROUTED)
            more = own.join(F.broadcast(need), "leaf", "left_semi").unionByName(owed.df).groupBy("leaf").applyInArrow(search, _FOUND)
            found = materialize(merged(found.df.unionByName(more)), "knn-found")
    joined = firsts.df.where(wanted_item(F.col("item"))).select("item", "h1", "h2").join(found.df, ["h1", "h2"])
    others = F.slice(F.filter("near", lambda p: p["id"] != F.col("item")), 1, k)
    apart = joined.withColumn("_others", others).select("item", F.explode("_others").alias("p"))
    return apart.select(F.col("item").alias(item), F.col("p.id").alias("neighbour_id"), F.col("p.dist").alias("distance"))

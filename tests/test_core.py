"""Core operators: fixtures by hand, brute force and round trips."""

import datetime as dt
import glob
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameatlas import catalog
from frameatlas.functions import columns as C
from frameatlas.functions.stem import lookup_keys, stem
from frameatlas.operators import grouped as G
from frameatlas.operators import lloyd
from frameatlas.operators import zones as Z
from frameatlas.operators import matrices as M
from frameatlas.operators import orphans as O
from frameatlas.operators import pairs as P
from frameatlas.operators import relational as R
from frameatlas.operators import signatures as SG
from frameatlas.operators import stats as ST
from frameatlas.operators.nearest import assign_nearest
from frameatlas.sources import artifacts as A
from frameatlas.sources import files as S

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def test_orphans_defined_cases(spark):
    refs = spark.createDataFrame(
        [(1, 10, None, "x"), (2, 11, day(5), "x"), (3, 12, day(5), "x"), (4, 13, day(5), "x"), (5, 0, day(5), "x"), (6, None, day(5), "x"), (7, 12, day(20), "x"), (8, 14, None, "x"), (2, 11, day(5), "x")],
        "id long, fk long, created_at timestamp_ntz, kind string",
    )
    parents = spark.createDataFrame(
        [(11, day(1), day(2)), (12, day(10), None), (12, day(1), day(3)), (13, day(1), None), (14, day(9), None), (None, day(1), None)], "k long, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
    )
    r = O.references(refs, "t", "id", ["fk"], "created_at")
    p = O.parent_states(parents, "k", "loaded_at", "deleted_at")
    got = {(x.record_id, x.ref_id, x.kind) for x in O.orphan_report([(r, p)]).collect()}
    assert got == {(1, 10, "missing"), (2, 11, "deleted"), (3, 12, "late")}
    counts = {x.month: (x.n_refs, x.n_missing, x.n_deleted, x.n_late) for x in O.orphan_counts([(r, p)]).collect()}
    assert counts == {None: (2, 1, 0, 0), "2024-01": (5, 0, 2, 1)}
    assert O.orphan_report([(r, p.limit(0))]).where("kind <> 'missing'").count() == 0
    assert O.orphan_report([(r.limit(0), p)]).count() == 0


def test_orphan_hot_key(spark):
    refs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("fk"), F.lit(day(1)).cast("timestamp_ntz").alias("created_at"))
    parents = refs.where("fk <> 7").select(F.col("fk").alias("k"), F.lit(day(0)).cast("timestamp_ntz").alias("loaded_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    out = O.orphan_report([(O.references(refs, "t", "id", ["fk"], "created_at"), O.parent_states(parents, "k", "loaded_at", "deleted_at"))])
    assert out.count() == 1000 and out.select("ref_id").distinct().count() == 1


def test_window_pairs_equal_brute_force(spark):
    df = spark.range(57).select(F.col("id").alias("pos"), (F.col("id") % 5).alias("v"))
    got = {(r.pos_a, r.pos_b) for r in P.window_pairs(df, "pos", 7, ["v"]).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(57), 2) if b - a <= 7}
    plan = P.window_pairs(df, "pos", 7, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ordered_positions(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    got = R.ordered_positions(df, ["h", "id"], "p", rows_per_slice=300).orderBy("p").collect()
    assert [r.p for r in got] == list(range(1, 5001)) and [r.h for r in got] == sorted(r.h for r in got)


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "key long, value string, seq long")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "key long, value string, seq long")
    once = R.upsert(old, new, ["key"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, R.upsert(once, new, ["key"], "seq").collect())) == [(1, "a", 1), (2, "c", 2), (3, "e", 3)]


def test_adaptive_iqr_keeps_about_the_target(spark):
    df = spark.range(2000).select(F.randn(1).alias("x"), F.randn(2).alias("y"))
    kept, scale = ST.adaptive_iqr(df, ["x", "y"], 1000)
    assert 1000 <= kept.count() <= 1010 and 0 < scale < 3
    assert ST.adaptive_iqr(df.limit(0), ["x", "y"], 5)[0].count() == 0


def test_assign_nearest_blocks_agree(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)] + [(900, None), (901, [1.0])], "id long, v array<double>")
    c = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)], "cluster int, centre array<double>")
    one = {r.id: r.cluster for r in assign_nearest(df, "id", "v", c).collect()}
    many = {r.id: r.cluster for r in assign_nearest(df, "id", "v", c, most_bytes=600).collect()}
    assert one == many and len(one) == 200
    assert assign_nearest(df, "id", "v", c.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [('{"left":1,"top":2,"right":3,"bottom":4}', (1, 2, 3, 4)), ('"{\\"left\\":1,\\"top\\":2,\\"right\\":3,\\"bottom\\":4}"', (1, 2, 3, 4)), ("null", None), ("broken", None), (None, None)])
def test_box_json(spark, text, want):
    b = spark.createDataFrame([(text,)], "j string").select(C.box("j").alias("b")).first().b
    assert (tuple(b) if b else None) == want


def test_geometry(spark):
    row = spark.range(1).select(
        C.iou(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(b, ("left", "top", "right", "bottom"))]) for b in ((0, 0, 2, 2), (1, 0, 3, 2))]).alias("i"),
        C.hue_distance(F.lit(0.95), F.lit(0.05)).alias("h"), C.euler_normalised(F.lit(190.0)).alias("e"),
    ).first()
    assert row.i == pytest.approx(1 / 3) and row.h == pytest.approx(0.1) and row.e == -170
    assert G.iou((0, 0, 0, 0), (0, 0, 0, 0)) == 0


def test_vectors_with_gaps(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(C.l2(F.col("a"), F.col("b"))).collect()] == [2.0, None, None]


def box(i, cls, conf, l, t, r, b):
    return {"image_id": 1, "detection_id": i, "obj_no": 0, "class_id": cls, "conf": conf, "left": l, "top": t, "right": r, "bottom": b}


def test_overlaps_are_resolved():
    first, wide, other, far = box(1, 5, 0.5, 0, 0, 10, 10), box(2, 5, 0.9, 0, 0, 10, 11), box(3, 6, 0.4, 0, 0, 10, 10), box(4, 7, 0.3, 50, 50, 60, 60)
    assert [r["detection_id"] for r in G.resolve_overlaps([first, wide, other, far])] == [1, 4]  # the last pair is first against other
    out = G.resolve_overlaps([first, wide, far])
    assert [r["detection_id"] for r in out] == [2, 4] and out[0]["bottom"] == 11
    # neither sure nor clear, different classes: both stay
    assert len(G.resolve_overlaps([box(1, 5, 0.5, 0, 0, 10, 10), box(2, 6, 0.5, 0, 2, 10, 12)])) == 2
    # the bonus of a preferred class decides
    assert [r["detection_id"] for r in G.resolve_overlaps([box(1, 67, 0.65, 0, 0, 10, 10), box(2, 137, 0.55, 0, 0, 10, 10)])] == [2]


def test_suppression_rules_and_events():
    left, events = G.suppress([box(1, 67, 0.5, 0, 0, 9, 9), box(2, 137, 0.4, 0, 0, 9, 9), box(3, 127, 0.1, 0, 0, 9, 9), box(4, 137, 0.9, 50, 50, 60, 60)])
    assert {r["detection_id"] for r in left} == {2, 4}
    assert [(e["rule"], e["decision"], e["winner"], e["loser"]) for e in events] == [("pair_67_137", "suppress", 2, 1), ("family_127_calculator", "suppress", 2, 3)]
    tie = G.suppress([box(1, 67, 0.5, 0, 0, 9, 9), box(2, 137, 0.3, 0, 0, 9, 9)])
    assert [r["detection_id"] for r in tie[0]] == [2] and tie[1][0]["by_tie"]


def test_a_batch_without_events(spark):
    rows = spark.createDataFrame([(i, i) for i in range(6)], "image_id long, n long")
    schema = "image_id long, rule string, winner long, by_tie boolean, conf double"
    assert G.per_small_group(rows, "image_id", lambda p: [], schema).collect() == []
    some = lambda p: [{"image_id": r["image_id"], "rule": "x", "winner": None, "by_tie": True, "conf": None} for r in p if r["n"] == 0]
    out = G.per_small_group(rows, "image_id", some, schema, 1).collect()  # most batches have no event
    assert [tuple(r) for r in out] == [(0, "x", None, True, None)]


def test_group_rules():
    merged = G.merge_adjacent([box(1, 5, 0.5, 0, 0, 10, 10), box(2, 5, 0.6, 25, 0, 30, 10), box(3, 5, 0.7, 300, 0, 310, 10)])
    assert sorted(r["n_merged"] for r in merged) == [1, 2]
    hands = {"left_pointer_x": 0.0, "left_pointer_y": 3.0, "right_pointer_x": 0.0, "right_pointer_y": 8.0}
    nowhere = {f"in_{z}": False for z in (*G.SLOT_ZONES, "tie")}
    rows = [box(1, 5, 0.9, -0.2, 2.9, 0.2, 3.1) | hands | nowhere, box(2, 6, 0.8, -0.2, 0.2, 0.2, 0.4) | hands | nowhere | {"in_mouth": True}, box(3, 7, 0.7, -0.2, 0.2, 0.2, 0.4) | hands | nowhere | {"in_mouth": True}]
    out = G.assign_slots(rows)[0]
    assert out["left_hand"] == 1 and out["mouth"] == 2 and out["right_hand"] is None
    assert G.assign_slots(rows, {(6, "mouth"): 0})[0]["mouth"] == 3 and G.assign_slots(rows, {(6, "mouth"): 1})[0]["mouth"] == 3


def test_matrix_is_checked(spark):
    rows = [(c, *[k % 3 for k in range(8)]) for c in range(3)]
    assert Z.checked_matrix(spark.createDataFrame(rows, ["class_id", *Z.MATRIX_SLOTS]), 3).count() == 24
    for bad in (rows[:2], [*rows[:2], (2, 7, *[0] * 7)]):
        with pytest.raises(ValueError):
            Z.checked_matrix(spark.createDataFrame(bad, ["class_id", *Z.MATRIX_SLOTS]), 3)


def test_orderings_visit_everything_once():
    x = np.random.default_rng(1).normal(size=(60, 3))
    walk = G.greedy_walk(x)
    tour = G.two_opt(x, walk)
    length = lambda p: np.linalg.norm(np.diff(x[p], axis=0), axis=1).sum()
    assert sorted(walk) == sorted(tour) == list(range(60)) and length(tour) <= length(walk)
    assert (tour[0], tour[-1]) == (walk[0], walk[-1])


def test_geometric_medians(spark):
    rng = np.random.default_rng(2)
    x = {g: np.vstack([rng.normal(size=(50, 2)) + g, [[100.0, 100.0]]]) for g in (1, 2)}
    df = spark.createDataFrame([(g, r.tolist()) for g, v in x.items() for r in v] + [(None, [1.0, 1.0]), (1, None)], "g long, v array<double>").repartition(3)
    for r in lloyd.geometric_medians(df, "g", "v", tolerance=1e-4).collect():
        cost = lambda c: np.linalg.norm(x[r["group"]] - c, axis=1).sum()  # noqa: B023, E731
        m = np.array(r["median"])
        assert r["n"] == 51 and r["median_cost"] == pytest.approx(cost(m)) and r["mean_cost"] == pytest.approx(cost(x[r["group"]].mean(0)))
        assert all(cost(m) <= cost(m + d) + 1e-6 for d in ([1e-2, 0], [-1e-2, 0], [0, 1e-2], [0, -1e-2]))
    assert lloyd.geometric_medians(df.limit(0), "g", "v").count() == 0


def test_signature_collapse_keeps_rows(spark):
    rows = spark.createDataFrame([(i, ["LH:1", "RH:2"]) for i in range(50)] + [(100, ["LH:1", "MO:9"]), (101, [])], "id long, p array<string>")
    out = {r.token: r.n for r in SG.collapse(rows, "id", "p", 10).groupBy("token").agg(F.count("*").alias("n")).collect()}
    assert sum(out.values()) == 52 and out["LH:1|RH:2"] == 50


def test_subsplit(spark):
    df = spark.createDataFrame([("a", 1)] * 8 + [("a", 2)] * 2 + [("b", 1)] * 3 + [("c", None)] * 20, "p string, s int")
    assert sorted(map(tuple, M.subsplit(df, "p", "s", 9, 5).collect())) == [("a", "1", 8), ("b", "whole", 3), ("c", "whole", 20)]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, ""), (3, None)], "id long, t string")
    S.write_csv(df, str(tmp_path / "c"))
    assert sorted((r.id, r.t) for r in S.read_csv(spark, str(tmp_path / "c"), "id long, t string").collect()) == [(1, 'a "q", b'), (2, None), (3, None)]
    A.write_artifact(df, f"file://{tmp_path}/a", "k")
    assert A.read_artifact(spark, f"file://{tmp_path}/a", "k").count() == 3
    with pytest.raises(ValueError):
        A.read_artifact(spark, f"file://{tmp_path}/a", "other")
    with pytest.raises(ValueError):
        A.add_to_manifest(A.matrix_manifest("x", {}), A.matrix_manifest("y", {}))
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "17.txt").write_text("3 0.5 0.5 0.2 0.1\nbroken line\n\n4 x 0 0 0\n")
    assert [(r.file_name, r.class_id) for r in S.read_labels(spark, str(tmp_path / "l")).collect()] == [("17.txt", 3)]
    assert S.folder_ids(spark, str(tmp_path / "l" / "*.txt")).first().file_id == 17


def test_stems(spark):
    assert [stem(w) for w in ("running", "cities", "glass", "cats", "sad")] == ["run", "city", "glass", "cat", "sad"]
    keys = {r["w"]: r["k"] for r in spark.createDataFrame([("cities",), ("run",), ("making",)], "w string").select("w", lookup_keys(F.col("w")).alias("k")).collect()}
    assert "city" in keys["cities"] and {"run", "runs", "runing"} <= set(keys["run"]) and "make" in keys["making"]


def test_every_query_runs_and_equals_its_sql(spark, sf):
    """A random dozen of the SQL-backed queries; the whole catalogue is compared by the driver."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name in random.Random(7).sample(sorted(catalog.SQL), 12):
        df = catalog.QUERIES[name](spark, sf)
        cur = con.execute(catalog.SQL[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns), name
        want = cur.fetchall()
        show = lambda v: f"{v:.10g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        assert sorted(tuple(map(show, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(show, r)) for r in want), name


def test_inventory_is_covered():
    """Every entry of the operator inventory has a query, but for those without a result to state."""
    have = {x for ids in catalog.COVERS.values() for x in ids}
    want = {f"{k}{i}" for k, n in (("S", 19), ("F", 20), ("J", 20), ("A", 37), ("W", 10), ("T", 18), ("U", 8), ("X", 37), ("C", 31), ("M", 10), ("B", 10), ("R", 24)) for i in range(1, n + 1)}
    assert want - have <= {"C27"}, sorted(want - have)

"""Queries that do the whole of the inventory entries they claim: small cases by hand and brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from frameatlas import catalog
from frameatlas.operators import pairs as P
from frameatlas.operators import signatures as SG


def _people(n=30, seed=3):
    """Rows with gaps: near copies, missing heads, boxes, faces and bodies."""
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rows[i - 3] if i % 3 == 0 and i >= 3 else None
        near = lambda v, s: [float(x) for x in np.array(v) + g.normal(0, s, len(v))]  # noqa: B023, E731
        head, box, face, body = (near(base[k], 0.01) if base and base[k] else near(np.zeros(m), s) for k, m, s in ((2, 3, 15), (3, 4, 90), (4, 128, 0.2), (5, 132, 1)))
        gap = g.random(4) < 0.25
        rows.append((i + 1, 100 + i - 3 * (i in (12, 18, 24)), *[None if x else v for x, v in zip(gap, (head, box, face, body))], ["a text", None, "other"][i % 3], i % 2, float(i * 7) if i % 5 else None))
    return rows


def _brute(rows, reach, known):
    """The rules of the reference pair by pair, null terms left out."""
    d = lambda a, b, limit: None if a is None or b is None else float(np.linalg.norm(np.array(a) - np.array(b))) / limit

    def pose(v, points):
        if v is None:
            return None
        p = np.array(v).reshape(33, 4)[:, :2]
        p = p - p[0]
        return (p / np.linalg.norm((p[11] + p[12]) / 2))[points].ravel()

    out = {}
    for a, b in itertools.combinations(rows, 2):
        if b[0] - a[0] > reach:
            continue
        one = [x for x in (d(pose(a[5], [15, 16, 27, 28]), pose(b[5], [15, 16, 27, 28]), 0.8), d(a[2], b[2], 15), d(a[3], b[3], 80)) if x is not None]
        face = d(a[4], b[4], 0.5)
        if not (sum(one) <= 2 or any(x < 0.2 for x in one)):
            v = "distance"
        elif a[1] == b[1]:
            v = "same image"
        elif {a[1], b[1]} in known:
            v = "known not dupe"
        elif face is not None and face >= 1:
            v = "face"
        else:
            v = "kept" if one or face is not None else "not comparable"
        out[a[0], b[0]] = v
    return out


def test_near_duplicates_equal_brute_force_over_block_borders(spark):
    rows, known = _people(), [{103, 106}, {109, 112}, {115, 121}]
    df = spark.createDataFrame([(r[0], *r) for r in rows], "pos long, encoding_id long, image_id long, head array<double>, box array<double>, face array<double>, body array<double>, description string, site int, site_number double")
    want = _brute(rows, 7, known)
    no = spark.createDataFrame([(max(k), min(k)) for k in known], "i long, j long")
    got = P.near_duplicates(df, 7, no, rows_per_block=8).collect()
    assert {(r.encoding_id_a, r.encoding_id_b): r.verdict for r in got} == want and len(got) == len(want)
    assert {"kept", "distance", "same image", "known not dupe", "face"} <= set(want.values())
    assert all((r.body is None and r.description is None and r.site is None) for r in got if r.verdict in ("distance", "face", "known not dupe"))


def test_near_duplicates_metadata_terms(spark):
    row = lambda pos, text, site, number: (pos, pos, pos, [0.0, 1.0, 0.0], None, None, None, text, site, number)
    df = spark.createDataFrame([row(1, "t", 1, 10.0), row(2, "t", 1, 30.0), row(3, None, 1, None), row(4, None, 2, 5.0)], "pos long, encoding_id long, image_id long, head array<double>, box array<double>, face array<double>, body array<double>, description string, site int, site_number double")
    got = {(r.encoding_id_a, r.encoding_id_b): (r.description, r.site, r.verdict) for r in P.near_duplicates(df, 3).collect()}
    assert got == {(1, 2): (0.0, 5000.0, "kept"), (1, 3): (1.0, 200_000.0, "kept"), (1, 4): (1.0, 0.0, "kept"), (2, 3): (1.0, 200_000.0, "kept"), (2, 4): (1.0, 0.0, "kept"), (3, 4): (0.5, 0.0, "kept")}


def test_near_duplicate_cascade_has_every_pair_of_the_window(spark, sf):
    got = catalog.QUERIES["near_duplicate_cascade"](spark, sf)
    n = spark.read.parquet(f"{sf}/encodings_migration.parquet").count()
    assert got.count() == sum(min(100, n - i) for i in range(1, n + 1))
    assert got.select(F.count_if(F.col("verdict") == "kept")).first()[0] > 0


def test_dense_matrix_holds_every_class_and_cluster(spark, sf, tmp_path):
    rows = [(0, 3), (35, 140), (35, 140), (35, 7), (None, 5), (2, 0)]  # a cluster above 29, classes beside 0, 27, 67
    spark.createDataFrame(rows, "meta_cluster_id int, class_id int").write.parquet(f"{tmp_path}/detections.parquet")
    got = catalog.QUERIES["dense_matrix_all_classes"](spark, str(tmp_path))
    assert got.columns == ["bin", *[f"c_{i}" for i in range(141)], "total"]
    m = {r["bin"]: r.asDict() for r in got.collect()}
    assert sorted(m) == list(range(36)) and m[35]["c_140"] == 2 and m[35]["c_7"] == 1 and m[35]["total"] == 3 and m[1]["total"] == 0
    assert sum(r["total"] for r in m.values()) == 5 and all(v is not None for r in m.values() for v in r.values())
    x = spark.read.parquet(f"{sf}/detections.parquet").where("meta_cluster_id is not null")
    assert catalog.QUERIES["dense_matrix_all_classes"](spark, sf).agg(F.sum("total")).first()[0] == x.count()


def test_keeper_chain_equals_the_ordered_loop(spark):
    g = np.random.default_rng(5)
    pairs = sorted({tuple(sorted(map(int, g.choice(60, 2, replace=False)))) for _ in range(70)} | {(100, 101), (101, 102), (102, 103)})
    want: dict[int, int] = {}
    for a, b in pairs:
        if a not in want:
            want.setdefault(b, a)
    got = {r.id: r.keeper for r in P.keeper_chain(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want and got[101] == 100 and 102 not in got and got[103] == 102
    assert P.keeper_chain(spark.createDataFrame([], "a long, b long")).count() == 0


def test_duplicate_chain_finds_near_twins(spark, tmp_path):
    g = np.random.default_rng(1)
    face = [float(x) for x in g.normal(0, 0.2, 128)]
    step = lambda k: [x + 0.03 * k for x in face]  # noqa: E731  faces k and k + 1 are 0.34 apart, k and k + 2 0.68
    rows = [(1, 10, 1.0, None, step(0), None), (2, 20, 1.2, None, step(1), None), (3, 30, 1.4, None, step(2), None), (4, 40, 1.1, None, None, None), (5, 1050, 1.0, None, step(0), None)]
    df = spark.createDataFrame(rows, "encoding_id long, image_id long, face_x double, bbox string, face_encodings68 array<double>, body_landmarks array<double>")
    df.withColumns({"face_y": F.lit(0.5), "face_z": F.lit(0.5)}).write.parquet(f"{tmp_path}/encodings_migration.parquet")
    spark.createDataFrame([(r[1], f"text {r[0]}", 1, str(r[0])) for r in rows], "image_id long, description string, site_name_id int, site_image_id string").write.parquet(f"{tmp_path}/images.parquet")
    got = {r.encoding_id: (r.is_dupe, r.keeper_id, r.review) for r in catalog.QUERIES["duplicate_chain"](spark, str(tmp_path)).collect()}
    assert got == {1: (False, None, False), 2: (True, 1, False), 3: (False, None, False), 4: (False, None, True), 5: (True, 1, False)}


def _collapse_by_hand(rows, support):
    """Per topic the cascade of the reference over (topic, item, parts)."""
    out = {}
    for topic in {r[0] for r in rows}:
        n, weight = {}, {}
        for _, _, p in {(t, i, tuple(p)) for t, i, p in rows if t == topic}:
            n[p] = n.get(p, 0) + 1
            for x in p:
                weight[x] = weight.get(x, 0) + 1
        for p in n:
            if n[p] >= support:
                out[topic, "|".join(p)] = ("retained", "|".join(p))
                continue
            now, to = list(p), None
            for x in sorted(p, key=lambda x: (weight[x], x)):
                now.remove(x)
                if now and n.get(tuple(now), 0) >= support:
                    to = "|".join(now)
                    break
            out[topic, "|".join(p)] = ("remapped", to) if to else ("discarded", None)
    return out


def test_topic_collapse_drops_the_rarest_part_step_by_step(spark):
    rows = [(1, i, ["LH:1", "RH:2"]) for i in range(3)] + [(1, 10, ["LH:1", "RH:2", "MO:9"]), (1, 11, ["LH:7"]), (1, 11, ["LH:7"])] + [(2, i, ["LH:1", "RH:2"]) for i in range(2)] + [(2, 20, ["LH:1", "RH:2", "MO:9"])]
    df = spark.createDataFrame(rows, "topic int, item int, p array<string>")
    m = SG.topic_collapse_map(df, "topic", "item", "p", 3)
    got = {(r.topic, r.token): (r.state, r.target) for r in m.collect()}
    assert got[1, "LH:1|RH:2|MO:9"] == ("remapped", "LH:1|RH:2")  # one part is dropped, not two
    assert got[1, "LH:7"] == ("discarded", None) and got[2, "LH:1|RH:2"] == ("discarded", None) == got[2, "LH:1|RH:2|MO:9"]  # no support in this topic
    out = SG.apply_collapse(df.select("topic", "item", SG.token(F.col("p")).alias("token")), m)
    assert {(r.topic, r.target): r.n for r in out.groupBy("topic", "target").agg(F.count_distinct("item").alias("n")).collect()} == {(1, "LH:1|RH:2"): 4}
    g = np.random.default_rng(2)
    rows = [(int(t), i, [f"{s}:{c}" for s, c in zip(("LH", "RH", "TF", "MO"), g.integers(0, 3, 4)) if c]) for i in range(400) for t in g.integers(1, 4, 1)]
    got = {(r.topic, r.token): (r.state, r.target) for r in SG.topic_collapse_map(spark.createDataFrame(rows, "topic int, item int, p array<string>"), "topic", "item", "p", 5).collect()}
    assert got == _collapse_by_hand(rows, 5) and {s for s, _ in got.values()} == {"retained", "remapped", "discarded"}


def test_topic_collapse_queries_leave_no_target_below_the_support(spark, sf):
    m = catalog.QUERIES["topic_collapse_map"](spark, sf)
    assert m.groupBy("topic_id", "token").count().where("count > 1").count() == 0
    n = {(r.topic_id, r.target): r.n for r in catalog.QUERIES["topic_collapse_apply"](spark, sf).collect()}
    assert set(n) == {(r.topic_id, r.target) for r in m.where("target is not null").collect()} and min(n.values(), default=20) >= 20


def test_label_refinement_keeps_one_winner_of_a_component(spark, sf, tmp_path):
    box = lambda left, top=0: f'{{"left": {left}, "top": {top}, "right": {left + 100}, "bottom": {top + 100}}}'
    rows = [(1, 1, 0, box(0)), (2, 1, 5, box(10)), (3, 1, 5, box(300)), (4, 1, 132, box(330)), (5, 1, 133, box(360)), (6, 1, 8, box(700)), (7, 1, 9, box(705)), (8, 2, 8, box(300))]
    df = spark.createDataFrame(rows, "detection_id long, image_id long, class_id int, bbox string").withColumns({"obj_no": F.lit(1), "conf": F.lit(0.5)})
    df.unionByName(df).write.parquet(f"{tmp_path}/detections.parquet")  # copies of rows count once
    got = {(r.image_id, r.detection_id): r.n_members for r in catalog.QUERIES["label_refinement"](spark, str(tmp_path)).collect()}
    assert got == {(1, 4): 3, (1, 6): 2, (2, 8): 1}  # 3 and 5 meet over 4, which has the highest priority; 2 repeats 1
    out = catalog.QUERIES["label_refinement"](spark, sf)
    merged = catalog.QUERIES["prediction_merge"](spark, sf)
    assert out.agg(F.sum("n_members")).first()[0] == merged.agg(F.sum("n_kept")).first()[0] and out.where("n_members > 1").count() > 0


def test_early_rows_reach_twice_as_far(spark, sf):
    df = spark.range(1, 61).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("v"))
    got = [(r.pos_a, r.pos_b) for r in P.early_window_pairs(df, "pos", 5, 10, 20, ["v"]).collect()]
    want = {(a, b) for a, b in itertools.combinations(range(1, 61), 2) if b - a <= (10 if a <= 20 else 5)}
    assert set(got) == want and len(got) == len(want)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert catalog.QUERIES["windowed_pair_distance_early"](spark, sf).count() == sum(min(100 if i <= 1000 else 50, n - i) for i in range(1, n + 1))


def test_registry_keeps_the_first_value(spark, tmp_path):
    rows = [(1, 5, "a", 0.5, 30), (1, 4, "b", 0.7, 10), (1, 3, "c", 0.9, 10), (2, 9, "a", 1.0, 1), (None, 8, "a", 1.0, 1)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double, ts long").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.event_id, r.value) for r in catalog.QUERIES["registry_first_wins"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3, 0.9), (2, 9, 1.0)}

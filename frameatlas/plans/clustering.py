"""Clustering, similarity, near duplicates, slots, signatures and orderings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.functions import columns as C
from frameatlas.operators import grouped as G
from frameatlas.operators import pairs as P
from frameatlas.operators import signatures as SG
from frameatlas.operators import slices as SL
from frameatlas.operators import zones as Z
from frameatlas.operators.lloyd import geometric_medians, kmeans
from frameatlas.operators.nearest import assign_nearest
from frameatlas.operators.relational import ordered_positions
from frameatlas.plans.cohorts import SLOTS, detection_dim, slots_long
from frameatlas.plans.registry import query
from frameatlas.plans.scalars import BOXES, boxes
from frameatlas.runtime import materialize
from frameatlas.runtime import table as T


def fit_kmeans(df, vec: str, k: int, inits: int = 10, seed: int = 42):
    """Centres of the cheapest of ten seeded fits, all made in the same passes over the data."""
    return kmeans(df, vec, k, fits=inits, seed=seed)[0]


def model_centres(spark, centres):
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>")


@query("C1 C5 C6")
def kmeans_assign(spark, d):
    """Build clusters, then assign every vector to its nearest stored centre."""
    e = T(spark, d, "embeddings").select("vec_id", "embedding")
    return assign_nearest(e, "vec_id", "embedding", model_centres(spark, fit_kmeans(e, "embedding", 10))).select("vec_id", "cluster", F.round("dist", 4).alias("dist"))


@query("C2")
def silhouette_by_k(spark, d):
    e = T(spark, d, "embeddings").select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")).persist()
    rows = [(k, float(ClusteringEvaluator(metricName="silhouette").evaluate(KMeans(k=k, seed=42, maxIter=40).fit(e).transform(e)))) for k in (6, 10, 14)]
    e.unpersist()
    best = max(rows, key=lambda r: r[1])[0]
    return spark.createDataFrame([(k, s, k == best) for k, s in rows], "k int, silhouette double, is_best boolean")


@query("C8")
def oversized_split(spark, d):
    """Segments above a size are split into max(1, ceil(n / 100) - 2) parts by k-means; smaller ones stay whole."""
    e = T(spark, d, "embeddings").select("vec_id", "label", "embedding").withColumn("seg", F.col("label") % 2)
    sizes = e.groupBy("seg").agg(F.count("*").alias("n")).collect()  # one row per segment
    out = None
    for r in sorted(sizes, key=lambda r: r["seg"]):
        part, k = e.where(F.col("seg") == r["seg"]), max(1, -(-r["n"] // 100) - 2)
        if k == 1:
            done = part.select("vec_id", "seg", F.lit(0).alias("part"))
        else:
            done = assign_nearest(part, "vec_id", "embedding", model_centres(spark, fit_kmeans(part, "embedding", k, inits=1))).select("vec_id", F.lit(r["seg"]).alias("seg"), F.col("cluster").alias("part"))
        out = done if out is None else out.unionByName(done)
    return out


@query("C6 C7", """WITH a AS (SELECT image_id, max(cluster_id) AS cluster_id FROM imagesarmsposes3d WHERE cluster_id IS NOT NULL GROUP BY 1), b AS (SELECT image_id, max(cluster_id) AS cluster_id FROM imagesbodyposes3d WHERE cluster_id IS NOT NULL GROUP BY 1)
  SELECT b.image_id, coalesce(a.cluster_id, b.cluster_id) AS cluster_id, CASE WHEN a.image_id IS NULL THEN 'new' ELSE 'kept' END AS state FROM b LEFT JOIN a ON a.image_id = b.image_id""")
def assign_unassigned_only(spark, d):
    one = lambda t: T(spark, d, t).where("cluster_id is not null").groupBy("image_id").agg(F.max("cluster_id").alias("cluster_id"))
    a = one("imagesarmsposes3d").withColumnRenamed("cluster_id", "have")
    return one("imagesbodyposes3d").join(a, "image_id", "left").select("image_id", F.coalesce("have", "cluster_id").alias("cluster_id"), F.when(F.col("have").isNull(), "new").otherwise("kept").alias("state"))


@query("C4", """WITH s AS (SELECT avg(h) AS mh, coalesce(nullif(stddev_pop(h), 0), 1) AS sh, avg(w) AS mw, coalesce(nullif(stddev_pop(w), 0), 1) AS sw FROM images)
  SELECT image_id, round((h - mh) / sh * 4.0, 6) AS h_scaled, round((w - mw) / sw * 2.0, 6) AS w_scaled FROM images, s WHERE h IS NOT NULL AND w IS NOT NULL""")
def feature_scale_weight(spark, d):
    """Population z-scores (a constant column keeps scale 1), then group weights."""
    i = T(spark, d, "images")
    sd = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    s = i.agg(F.avg("h").alias("mh"), sd("h").alias("sh"), F.avg("w").alias("mw"), sd("w").alias("sw"))
    z = lambda c, m, x, k: F.round((F.col(c) - F.col(m)) / F.col(x) * k, 6)
    return i.where("h is not null and w is not null").join(F.broadcast(s)).select("image_id", z("h", "mh", "sh", 4.0).alias("h_scaled"), z("w", "mw", "sw", 2.0).alias("w_scaled"))


def hydrated(spark, d):
    h = slots_long(spark, d).join(detection_dim(spark, d), "detection_id")
    return h.groupBy("id").agg(*[x for s in SLOTS for x in (F.max(F.when(F.col("slot") == s, F.col("class_id"))).alias(f"{s}_class"), F.max(F.when(F.col("slot") == s, F.col("conf"))).alias(f"{s}_conf"))])


_HYD = f"""WITH sl AS ({" UNION ALL ".join(f"SELECT id, '{s}' AS slot, {s}_object_id AS detection_id FROM imagesdetections WHERE {s}_object_id <> 0" for s in SLOTS)}), det AS (SELECT detection_id, max(class_id) AS class_id, max(conf) AS conf FROM detections GROUP BY 1),
  h AS (SELECT sl.id, {", ".join(f"max(class_id) FILTER (WHERE slot = '{s}') AS {s}_class, max(conf) FILTER (WHERE slot = '{s}') AS {s}_conf" for s in SLOTS)} FROM sl JOIN det ON det.detection_id = sl.detection_id GROUP BY sl.id)"""


@query("C3", _HYD + " SELECT id, [" + ", ".join(f"CASE WHEN {s}_class IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE, coalesce({s}_class, -1)::DOUBLE, coalesce({s}_conf, 0)::DOUBLE" for s in SLOTS) + "] AS features FROM h")
def slot_features(spark, d):
    cols = [x for s in SLOTS for x in (F.when(F.col(f"{s}_class").isNull(), 0.0).otherwise(1.0), F.coalesce(F.col(f"{s}_class").cast("double"), F.lit(-1.0)), F.coalesce(f"{s}_conf", F.lit(0.0)))]
    return hydrated(spark, d).select("id", F.array(*cols).alias("features"))


_TOK = "concat_ws('|', " + ", ".join(f"CASE WHEN {s}_class IS NOT NULL THEN '{t}:' || {s}_class END" for s, t in SG.LABELS) + ")"


@query("C16 X25", _HYD + f" SELECT token, sha1(token) AS hash, count(*) AS n, max(n_objects) AS n_objects FROM (SELECT {_TOK} AS token, {' + '.join(f'CASE WHEN {s}_class IS NOT NULL THEN 1 ELSE 0 END' for s in SLOTS)} AS n_objects FROM h) AS x GROUP BY 1, 2")
def signature_token(spark, d):
    s = hydrated(spark, d).select(SG.parts().alias("p"))
    return s.groupBy("p").agg(F.count("*").alias("n")).select(SG.token(F.col("p")).alias("token"), F.sha1(SG.token(F.col("p"))).alias("hash"), "n", F.size("p").alias("n_objects"))


@query("C17")
def signature_collapse(spark, d):
    rows = hydrated(spark, d).select("id", SG.parts().alias("p"))
    return SG.collapse(rows, "id", "p", 30).groupBy("token").agg(F.count("*").alias("n"))


@query("", _HYD + f""", t AS (SELECT id, {_TOK} AS token FROM h), n AS (SELECT token, count(*) AS n FROM t GROUP BY 1), m AS (SELECT token, CASE WHEN n >= 20 THEN token ELSE string_split(token, '|')[1] END AS target FROM n)
  SELECT m.target, count(*) AS n FROM t JOIN m ON m.token = t.token GROUP BY 1""")
def collapse_map_apply(spark, d):
    """A map from rare signatures to their first slot's, applied to all rows by one join."""
    t = hydrated(spark, d).select("id", SG.token(SG.parts()).alias("token"))
    m = t.groupBy("token").agg(F.count("*").alias("n")).select("token", F.when(F.col("n") >= 20, F.col("token")).otherwise(F.get(F.split("token", "[|]"), F.lit(0))).alias("target"))
    return t.join(m, "token").groupBy("target").agg(F.count("*").alias("n"))


def topic_signatures(spark, d):
    """``topic, item, p``: signature parts of every picture in each of its topics; 0 and null are no topic."""
    t = T(spark, d, "imagestopics").where("topic_id is not null and topic_id <> 0").select(F.col("topic_id").alias("topic"), "image_id").distinct()
    i = T(spark, d, "imagesdetections").select("id", "image_id")
    return hydrated(spark, d).select("id", SG.parts().alias("p")).join(i, "id").select("image_id", "p").distinct().join(t, "image_id").select("topic", F.col("image_id").alias("item"), "p")


@query("C18")
def topic_collapse_map(spark, d):
    """Signatures below 20 pictures of a topic lose their rarest parts until one with that support is met, else they are discarded."""
    return SG.topic_collapse_map(topic_signatures(spark, d), "topic", "item", "p", 20).withColumnRenamed("topic", "topic_id")


@query("C28")
def topic_collapse_apply(spark, d):
    """Pictures per topic and signature once the map is applied."""
    rows = materialize(topic_signatures(spark, d), "signatures").df
    mapped = materialize(SG.topic_collapse_map(rows, "topic", "item", "p", 20), "map").df
    out = SG.apply_collapse(rows.select("topic", "item", SG.token(F.col("p")).alias("token")), mapped)
    return out.groupBy(F.col("topic").alias("topic_id"), "target").agg(F.count_distinct("item").alias("n"))


# boxes in face heights: the tables have no nose and face height in pixels, so a fixed place stands in for them
_NORM = f"""{BOXES}, z AS (SELECT detection_id, obj_no, image_id, class_id, (l - 600) / 120 AS l, (t - 300) / 120 AS t, (r - 600) / 120 AS r, (m - 300) / 120 AS m FROM bb)"""


def _normal_boxes(spark, d):
    n = C.normalised(F.col("b"), F.lit(600.0), F.lit(300.0), F.lit(120.0))
    return boxes(spark, d).select("detection_id", "obj_no", "image_id", "class_id", n.alias("n"))


@query("C12", f"""WITH {_NORM} SELECT detection_id, obj_no,
  NOT (r < -0.9 OR l > -0.05 OR m < -0.65 OR t > 0.15) AS left_eye, NOT (r < 0.05 OR l > 0.9 OR m < -0.65 OR t > 0.15) AS right_eye, NOT (r < -0.9 OR l > 0.9 OR m < -0.45 OR t > 0.45) AS under_eye,
  NOT (r < -0.9 OR l > 0.9 OR m < -0.8 OR t > 0.3) AS eye_cover, NOT (r < -1 OR l > 1 OR m < -1.1 OR t > -0.1) AS forehead, NOT (r < -1.4 OR l > 1.4 OR m < 2.5 OR t > 4.5) AS waist, NOT (r < -2 OR l > 2 OR m < 4.75 OR t > 10.2) AS feet,
  l < 0 AND r > 0 AND r - l <= 2 AND t < 0 AND greatest(0, m) <= 0.75 AS top_face, l < 0 AND r > 0 AND r - l <= 2 AND m > 0 AND greatest(0, -t) <= 0.75 AS bottom_face, l < 0 AND r > 0 AND r - l <= 2 AND m > 0 AND greatest(0, -t) <= 0 AS mouth,
  l < 0 AND r > 0 AND r - l <= 2 AND t BETWEEN -0.4 AND 0.5 AND m BETWEEN 0.3 AND 0.8 AS covid_mask, l < -0.15 AND r > 0.15 AND r - l <= 2 AND t <= -0.15 AND m >= 0.15 AS full_face,
  r > l AND m > t AND l < 0 AND r > 0 AND abs((l + r) / 2) <= 0.35 AND r - l <= 1.25 AND t <= 1.25 AND m BETWEEN 0.35 AND 3.4 AND m - t >= 0.45 AND m - t >= 1.1 * (r - l) AS tie_neck,
  l <= 1.0 AND r >= -1.0 AND m >= least(1.1 + (greatest(l, -1.0) + 1.0) * 0.1, 1.1 + (least(r, 1.0) + 1.0) * 0.1)
    AND t <= greatest(1.1 + (greatest(l, -1.0) + 1.0) * 0.1, 1.1 + (least(r, 1.0) + 1.0) * 0.1) + 1.0 + CASE WHEN class_id IN (24, 26, 83, 90) THEN 1.5 ELSE 0 END AS shoulder,
  sqrt(pow(greatest(l - 0.4, 0, 0.4 - r), 2) + pow(greatest(t - 2.0, 0, 2.0 - m), 2)) <= 0.5 AS touches_hand FROM z""")
def zone_predicates(spark, d):
    """All zone predicates; shoulders lie at (-1, 1.1) and (1, 1.3), the hand at (0.4, 2)."""
    n, f = F.col("n"), lambda x: F.lit(float(x))
    shoulder = Z.on_shoulder(n, F.col("class_id"), (f(-1), f(1.1)), (f(1), f(1.3)))
    return _normal_boxes(spark, d).select("detection_id", "obj_no", *[c.alias(k) for k, c in Z.zones(n).items()], shoulder.alias("shoulder"), (Z.hand_gap(n, f(0.4), f(2)) <= Z.TOUCH).alias("touches_hand"))


@query("C14", f"""WITH {_NORM}, i AS (SELECT id, image_id, left_pointer_x AS x1, left_pointer_y AS y1, right_pointer_x AS x2, right_pointer_y AS y2 FROM imagesdetections),
  g AS (SELECT id, detection_id, obj_no, (l + r) / 2 AS cx, (t + m) / 2 AS cy, ((t >= -0.4)::INT + (t <= 0.5)::INT + (m >= 0.3)::INT + (m <= 0.8)::INT) / 4.0::DOUBLE AS fits,
    CASE WHEN x1 <> 0 OR y1 <> 8 THEN sqrt(pow(greatest(l - x1, 0, x1 - r), 2) + pow(greatest(t - y1, 0, y1 - m), 2)) END AS d1, CASE WHEN x2 <> 0 OR y2 <> 8 THEN sqrt(pow(greatest(l - x2, 0, x2 - r), 2) + pow(greatest(t - y2, 0, y2 - m), 2)) END AS d2
    FROM z JOIN i ON i.image_id = z.image_id WHERE class_id = 110),
  h AS (SELECT *, greatest(0, 1 - abs(cx) / 0.35) AS line, coalesce(greatest(0, 1 - least(d1, d2)), 0) AS hand, CASE WHEN d1 <= 0.5 AND d2 <= 0.5 THEN 1.0 ELSE 0.0 END AS both_, CASE WHEN fits < 0.5 AND (cy < -0.4 OR cy > 0.8) THEN 1.0 ELSE 0.0 END AS off FROM g),
  s AS (SELECT id, detection_id, obj_no, 0.4 * fits + 0.25 * line * greatest(0, 1 - abs(cy - 0.2) / 0.9) + 0.15 * line - 0.2 * hand AS worn, 0.2 * hand + 0.1 * both_ + 0.25 * off - 0.4 * fits AS held FROM h)
  SELECT id, detection_id, obj_no, round(worn, 6) AS worn, round(held, 6) AS held, CASE WHEN worn >= 0.6 AND worn >= held + 0.12 THEN 'worn' WHEN held >= 0.6 AND held >= worn + 0.12 THEN 'held' ELSE 'ambiguous' END AS intent FROM s""")
def mask_intent(spark, d):
    """Masks (class 110) as worn on the face, held in a hand, or neither clearly, for every slot row of the picture."""
    i = T(spark, d, "imagesdetections").select("id", "image_id", *[F.col(f"{s}_pointer_{a}").alias(f"{s}_{a}") for s in ("left", "right") for a in "xy"])
    worn, held, intent = Z.mask_intent(F.col("n"), [(F.col("left_x"), F.col("left_y")), (F.col("right_x"), F.col("right_y"))])
    return _normal_boxes(spark, d).where("class_id = 110").join(i, "image_id").select("id", "detection_id", "obj_no", F.round(worn, 6).alias("worn"), F.round(held, 6).alias("held"), intent.alias("intent"))


@query("C13", f"""WITH {BOXES}, m AS (SELECT c AS class_id, k, ['hand', 'left_eye', 'right_eye', 'top_face', 'mouth', 'shoulder', 'waist', 'feet'][k + 1] AS slot, (c + k) % 3 AS level FROM range(141) AS r(c), range(8) AS s(k))
  SELECT detection_id, obj_no, slot, level::INT AS level, round(conf + CASE level WHEN 1 THEN -0.12 ELSE 0.06 END, 6) AS score FROM (
    SELECT b.detection_id, b.obj_no, b.conf, s.slot, coalesce(m.level, 2) AS level FROM bb AS b, (SELECT DISTINCT slot FROM m) AS s LEFT JOIN m ON m.class_id = b.class_id AND m.slot = s.slot WHERE b.conf IS NOT NULL) AS x WHERE level > 0""")
def compatibility_score(spark, d):
    """Confidence biased by a class x slot matrix (never 0, unusual 1, usual 2).

    The matrix is a parameter of the operator, checked for 141 classes and eight slots;
    here it is made by a rule.
    """
    rule = spark.createDataFrame([(c, *((c + k) % 3 for k in range(len(Z.MATRIX_SLOTS)))) for c in range(141)], ["class_id", *Z.MATRIX_SLOTS])
    b = boxes(spark, d).where("conf is not null").select("detection_id", "obj_no", "class_id", "conf")
    return Z.biased_scores(b, Z.checked_matrix(rule, 141), F.col("conf")).select("detection_id", "obj_no", "slot", "level", F.round("score", 6).alias("score"))


def _flat(spark, d):
    b = F.col("b")
    return boxes(spark, d).where("conf is not null").select("image_id", "detection_id", "obj_no", "class_id", "conf", *[b[x].alias(x) for x in ("left", "top", "right", "bottom")]).distinct()


_FLAT = "image_id long, detection_id long, obj_no int, class_id int, conf double, left double, top double, right double, bottom double"


def _resolved(spark, d):
    return materialize(G.per_small_group(_flat(spark, d), "image_id", G.resolve_overlaps, _FLAT), "resolved").df


@query("C9")
def overlap_resolution(spark, d):
    return G.per_small_group(_flat(spark, d), "image_id", G.resolve_overlaps, _FLAT).select("image_id", "detection_id", "class_id")


@query("C10")
def suppression_rules(spark, d):
    """Per rule: pairs looked at, both kept, one suppressed, and won by the bonus or by the tie rule."""
    events = G.per_small_group(_resolved(spark, d), "image_id", lambda p: G.suppress(p)[1], "image_id long, rule string, decision string, winner long, loser long, by_bonus boolean, by_tie boolean")
    cut = F.col("decision") == "suppress"
    return events.groupBy("rule").agg(F.count("*").alias("n_pairs"), F.count_if(~cut).alias("n_kept"), F.count_if(cut).alias("n_suppressed"), F.count_if("by_bonus").alias("n_by_bonus"), F.count_if("by_tie").alias("n_by_tie"))


@query("C31 R7")
def suppression_audit(spark, d):
    """The funnel of every class: rows seen, with a readable box, left by overlap resolution and by the rules, and what was lost where."""
    seen = T(spark, d, "detections")
    parsed = _flat(spark, d)
    resolved = _resolved(spark, d)
    after = G.per_small_group(resolved, "image_id", lambda p: G.suppress(p)[0], _FLAT)
    n = lambda x, c: x.groupBy("class_id").agg(F.count("*").alias(c))
    out = n(seen, "n_seen")
    for x, c in ((parsed, "n_parsed"), (resolved, "n_resolved"), (after, "n_after")):
        out = out.join(n(x, c), "class_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_parsed", "n_resolved", "n_after")}
    return out.select("class_id", "n_seen", *[v.alias(c) for c, v in zero.items()], (zero["n_parsed"] - zero["n_resolved"]).alias("lost_by_overlap"), (zero["n_resolved"] - zero["n_after"]).alias("lost_by_rule"))


@query("C19")
def adjacent_merge(spark, d):
    return G.per_small_group(_flat(spark, d).where("class_id <> 0"), "image_id", G.merge_adjacent, _FLAT + ", n_merged long").select("image_id", "class_id", "detection_id", "n_merged")


@query("C21", f"""WITH {BOXES}, u AS (SELECT DISTINCT * FROM bb), o AS (SELECT * FROM u WHERE class_id = 0), p AS (SELECT * FROM u WHERE class_id <> 0)
  SELECT p.class_id, count(*) AS n_kept FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.image_id = p.image_id AND greatest(0, least(o.r, p.r) - greatest(o.l, p.l)) * greatest(0, least(o.m, p.m) - greatest(o.t, p.t)) >= 0.5 * nullif(greatest(0, o.r - o.l) * greatest(0, o.m - o.t) + greatest(0, p.r - p.l) * greatest(0, p.m - p.t) - greatest(0, least(o.r, p.r) - greatest(o.l, p.l)) * greatest(0, least(o.m, p.m) - greatest(o.t, p.t)), 0)) GROUP BY 1""")
def prediction_merge(spark, d):
    """New boxes that don't repeat a protected one: an anti-join with an overlap residual."""
    x = boxes(spark, d).distinct()
    o, p = x.where("class_id = 0").alias("o"), x.where("class_id <> 0").alias("p")
    same = (F.col("o.image_id") == F.col("p.image_id")) & (C.iou(F.col("o.b"), F.col("p.b")) >= 0.5)
    return p.join(o, same, "left_anti").groupBy("class_id").agg(F.count("*").alias("n_kept"))


@query("C20")
def label_refinement(spark, d):
    """New boxes that repeat no existing one (class 0), then one winner by priority of each component of overlapping new boxes."""
    x = boxes(spark, d).distinct()
    o, p = x.where("class_id = 0").alias("o"), x.where("class_id <> 0").alias("p")
    same = (F.col("o.image_id") == F.col("p.image_id")) & (C.iou(F.col("o.b"), F.col("p.b")) >= 0.5)
    b = F.col("b")
    new = p.join(o, same, "left_anti").select("image_id", "detection_id", "obj_no", "class_id", "conf", *[b[s].alias(s) for s in ("left", "top", "right", "bottom")])
    new = materialize(new, "new_boxes").df  # counted and grouped: the boxes are parsed and joined once
    return G.per_small_group(new, "image_id", G.refine_new, _FLAT + ", n_members long").select("image_id", "detection_id", "obj_no", "class_id", "n_members")


@query("C11")
def slot_assignment(spark, d):
    """Detections of every picture assigned to nine slots by position rules."""
    n = C.box("bbox_norm")
    x = T(spark, d, "detections").where("deleted_at is null and conf > 0.4").select("image_id", "detection_id", "class_id", "conf", n.alias("n")).where("n is not null")
    x = x.select("image_id", "detection_id", "class_id", "conf", "n").distinct()
    f = lambda v: F.lit(float(v))
    zone = Z.zones(F.col("n")) | {"shoulder": Z.on_shoulder(F.col("n"), F.col("class_id"), (f(-1), f(1.2)), (f(1), f(1.2)))}  # shoulders where they mostly are
    x = x.select("image_id", "detection_id", "class_id", "conf", *[F.col("n")[c].alias(c) for c in ("left", "top", "right", "bottom")], *[zone[z].alias(f"in_{z}") for z in G.SLOT_ZONES], zone["tie_neck"].alias("in_tie"))
    ptr = T(spark, d, "imagesdetections").groupBy("image_id").agg(F.max_by(F.struct("left_pointer_x", "left_pointer_y", "right_pointer_x", "right_pointer_y"), "id").alias("p")).select("image_id", "p.*")
    cols = ", ".join(f"{s} long" for s in ("left_hand", "right_hand", *G.SLOT_ZONES))
    return G.per_small_group(x.join(ptr, "image_id"), "image_id", G.assign_slots, f"image_id long, {cols}")


@query("W9", """WITH e AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings)
  SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 5) AS dist FROM e AS a JOIN e AS b ON b.pos BETWEEN a.pos + 1 AND a.pos + 50""")
def windowed_pair_distance(spark, d):
    e = ordered_positions(T(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], "pos")
    return P.window_pairs(e, "pos", 50, ["vec_id", "embedding"]).select("vec_id_a", "vec_id_b", F.round(C.l2(F.col("embedding_a"), F.col("embedding_b")), 5).alias("dist"))


@query("J14", """WITH e AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings)
  SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 5) AS dist FROM e AS a JOIN e AS b ON b.pos BETWEEN a.pos + 1 AND a.pos + CASE WHEN a.pos <= 1000 THEN 100 ELSE 50 END""")
def windowed_pair_distance_early(spark, d):
    """Pairs up to 100 positions after the first 1,000 rows, up to 50 after later ones."""
    e = ordered_positions(T(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], "pos")
    return P.early_window_pairs(e, "pos", 50, 100, 1000, ["vec_id", "embedding"]).select("vec_id_a", "vec_id_b", F.round(C.l2(F.col("embedding_a"), F.col("embedding_b")), 5).alias("dist"))


_CAND = "SELECT encoding_id, image_id, CAST(face_x AS DOUBLE) AS x, CAST(face_y AS DOUBLE) AS y, CAST(face_z AS DOUBLE) AS z, CAST(mouth_gap AS DOUBLE) AS g, row_number() OVER (PARTITION BY (image_id // 1000) ORDER BY encoding_id) AS pos, image_id // 1000 AS part FROM encodings_migration"


@query("C26", f"""WITH e AS ({_CAND}), p AS (SELECT a.encoding_id AS encoding_id_a, b.encoding_id AS encoding_id_b, abs(a.x - b.x) / 15 + abs(a.y - b.y) / 15 + abs(a.z - b.z) / 15 AS head, abs(a.g - b.g) AS mouth, a.image_id = b.image_id AS same FROM e AS a JOIN e AS b ON a.part = b.part AND b.pos BETWEEN a.pos + 1 AND a.pos + 100)
  SELECT encoding_id_a, encoding_id_b, CASE WHEN NOT coalesce(head <= 0.4, true) THEN 'head' WHEN NOT coalesce(mouth <= 2, true) THEN 'mouth' WHEN same THEN 'same image' ELSE 'kept' END AS verdict FROM p WHERE head <= 0.8""")
def dupe_cascade(spark, d):
    c = lambda n: F.col(n).cast("double")
    part = F.floor(F.col("image_id") / 1000).alias("part")
    e = T(spark, d, "encodings_migration").select("encoding_id", "image_id", c("face_x").alias("x"), c("face_y").alias("y"), c("face_z").alias("z"), c("mouth_gap").alias("g"), part)
    e = e.withColumn("pos", F.row_number().over(W.partitionBy("part").orderBy("encoding_id")))
    p = P.window_pairs(e, "pos", 100, ["encoding_id", "image_id", "x", "y", "z", "g"], "part")
    head = sum((F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) / 15 for v in "xyz"), F.lit(0.0))
    p = p.withColumn("head", head).where("head <= 0.8")
    return P.cascade(p, [("head", F.col("head") <= 0.4), ("mouth", F.abs(F.col("g_a") - F.col("g_b")) <= 2), ("same image", F.col("image_id_a") != F.col("image_id_b"))]).select("encoding_id_a", "encoding_id_b", "verdict")


def encodings_in_order(spark, d):
    """Encodings with their picture's texts, placed by id over the whole table (no blocks of pictures)."""
    c = lambda n: F.col(n).cast("double")
    b = C.box("bbox")
    e = T(spark, d, "encodings_migration").select("encoding_id", "image_id", F.array(c("face_x"), c("face_y"), c("face_z")).alias("head"), F.array(*[b[s] for s in ("left", "top", "right", "bottom")]).alias("box"), F.col("face_encodings68").alias("face"), F.col("body_landmarks").alias("body"))
    i = T(spark, d, "images").select("image_id", "description", F.col("site_name_id").alias("site"), F.expr("try_cast(site_image_id AS double)").alias("site_number"))
    return ordered_positions(e.join(i, "image_id", "left"), ["encoding_id"], "pos")


@query("C22")
def near_duplicate_cascade(spark, d):
    """Every pair within 100 positions with its terms and the stage that rejects it; no table lists pairs known not to be duplicates."""
    return P.near_duplicates(encodings_in_order(spark, d), 100).drop("image_id_a", "image_id_b")


@query("C23")
def duplicate_chain(spark, d):
    """Every encoding with its keeper, if it is a near duplicate of an earlier kept one.

    A pair confirms when the cascade keeps it and its faces were compared: a missing face never makes two rows equal.
    Later rows of pairs kept without a face are marked for review and stay.
    """
    kept = materialize(P.near_duplicates(encodings_in_order(spark, d), 100).where("verdict = 'kept'").select("encoding_id_a", "encoding_id_b", "face"), "kept").df
    dupes = P.keeper_chain(kept.where("face is not null").select(F.col("encoding_id_a").alias("a"), F.col("encoding_id_b").alias("b")))
    look = kept.where("face is null").select(F.col("encoding_id_b").alias("encoding_id")).distinct().withColumn("review", F.lit(True))
    e = T(spark, d, "encodings_migration").select("encoding_id", "image_id")
    j = e.join(dupes.select(F.col("id").alias("encoding_id"), "keeper"), "encoding_id", "left").join(look, "encoding_id", "left")
    is_dupe = F.col("keeper").isNotNull()
    return j.select("encoding_id", "image_id", is_dupe.alias("is_dupe"), F.col("keeper").alias("keeper_id"), (F.col("review").isNotNull() & ~is_dupe).alias("review"))


@query("A30 D3")
def geometric_median(spark, d):
    """Per cluster the point with the least sum of distances, against the mean's sum."""
    e = T(spark, d, "embeddings").select("label", "embedding")
    return geometric_medians(e, "label", "embedding").select(F.col("group").alias("label"), "n", F.round("median_cost", 4).alias("median_cost"), F.round("mean_cost", 4).alias("mean_cost"))


def _ordered(spark, d, order):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable").reset_index(drop=True)
        path = order(np.stack(pdf["embedding"].to_numpy()).astype(float))
        return pd.DataFrame({"label": pdf["label"].iloc[0], "vec_id": pdf["vec_id"].iloc[path].to_numpy(), "position": np.arange(len(path))})

    return T(spark, d, "embeddings").select("label", "vec_id", "embedding").groupBy("label").applyInPandas(run, "label int, vec_id long, position long")


@query("T8 D4")
def greedy_order(spark, d):
    return _ordered(spark, d, G.greedy_walk)


@query("T9")
def tour_order(spark, d):
    return _ordered(spark, d, lambda x: G.skip_detours(x, G.two_opt(x, G.greedy_walk(x))))


@query("R22 X21", f"""WITH {BOXES}, u AS (SELECT class_id, (m - t) * (r - l) AS size FROM bb) SELECT class_id, count(*) AS n, round(quantile_cont(size, 0.25), 4) AS q1, round(quantile_cont(size, 0.5), 4) AS med, round(quantile_cont(size, 0.75), 4) AS q3 FROM u GROUP BY 1""")
def box_size_quartiles(spark, d):
    b = F.col("b")
    u = boxes(spark, d).select("class_id", ((b["bottom"] - b["top"]) * (b["right"] - b["left"])).alias("size"))
    p = lambda q: F.round(F.percentile("size", F.lit(q)), 4)
    return u.groupBy("class_id").agg(F.count("*").alias("n"), p(0.25).alias("q1"), p(0.5).alias("med"), p(0.75).alias("q3"))


@query("R19", """WITH v AS (SELECT d.id, i.left_pointer_x AS ax, i.left_pointer_y AS ay, i.right_pointer_x AS bx, i.right_pointer_y AS byy FROM imagesdetections AS i JOIN imagesdetections AS d ON d.id = i.id WHERE i.left_pointer_x IS NOT NULL AND i.right_pointer_x IS NOT NULL), x AS (SELECT sqrt((ax - bx) * (ax - bx) + (ay - byy) * (ay - byy)) AS dist, bx - ax AS dx FROM v)
  SELECT count(*) AS n, round(avg(dist), 6) AS mean_dist, round(quantile_cont(dist, 0.5), 6) AS median_dist, round(stddev_pop(dist), 6) AS sd_dist, round(quantile_cont(dist, 0.95), 6) AS p95_dist, CASE WHEN avg(dx) > 0 THEN 'right' ELSE 'left' END AS bias FROM x""")
def source_divergence(spark, d):
    x = T(spark, d, "imagesdetections").where("left_pointer_x is not null and right_pointer_x is not null")
    dx, dy = F.col("right_pointer_x") - F.col("left_pointer_x"), F.col("right_pointer_y") - F.col("left_pointer_y")
    x = x.select(F.sqrt(dx * dx + dy * dy).alias("dist"), dx.alias("dx"))
    r = lambda e: F.round(e, 6)
    q = SL.exact_quantiles(x, None, "dist", {"m": 0.5, "p": 0.95})
    s = x.agg(F.count("*").alias("n"), r(F.avg("dist")).alias("mean_dist"), r(F.stddev_pop("dist")).alias("sd_dist"), F.when(F.avg("dx") > 0, "right").otherwise("left").alias("bias"))
    return s.join(q).select("n", "mean_dist", r(F.col("m")).alias("median_dist"), "sd_dist", r(F.col("p")).alias("p95_dist"), "bias")  # one row each

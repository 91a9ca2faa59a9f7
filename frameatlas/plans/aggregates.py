"""Aggregates, pivots, matrices and distribution reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.operators import matrices as M
from frameatlas.operators import slices as SL
from frameatlas.operators import stats as ST
from frameatlas.operators.relational import ordered_positions
from frameatlas.plans.cohorts import KEYWORDS, SLOT_SQL, SLOTS, keywords, slots_long
from frameatlas.plans.registry import query
from frameatlas.runtime import table as T

DIST = "cluster_dist IS NOT NULL AND NOT isnan(cluster_dist) AND cluster_dist >= 0 AND cluster_id IS NOT NULL"


def _dist(spark, d, t="imagesbodyposes3d"):
    return T(spark, d, t).where("cluster_dist is not null and not isnan(cluster_dist) and cluster_dist >= 0 and cluster_id is not null")


@query("A1 A2 A3 A4 A5", """SELECT class_id, count(*) AS n_rows, count(conf) AS n_conf, count(DISTINCT image_id) AS n_images, count(DISTINCT CASE WHEN conf >= 0.8 THEN image_id END) AS n_sure_images,
  count(*) FILTER (WHERE deleted_at IS NOT NULL) AS n_deleted, round(count(*) FILTER (WHERE deleted_at IS NOT NULL) / nullif(count(*), 0), 4) AS deleted_rate FROM detections GROUP BY 1""")
def detection_counts(spark, d):
    gone = F.count_if(F.col("deleted_at").isNotNull())
    return T(spark, d, "detections").groupBy("class_id").agg(
        F.count("*").alias("n_rows"), F.count("conf").alias("n_conf"), F.count_distinct("image_id").alias("n_images"), F.count_distinct(F.when(F.col("conf") >= 0.8, F.col("image_id"))).alias("n_sure_images"),
        gone.alias("n_deleted"), ST.ratio(gone, F.count("*")).alias("deleted_rate"),
    )


@query("A6 A7 R20 W3", f"""SELECT cluster_id, count(*) AS n, round(avg(cluster_dist), 6) AS avg_dist, round(stddev_pop(cluster_dist), 6) AS sd_dist, min(cluster_dist) AS min_dist, max(cluster_dist) AS max_dist,
  round(sum(cluster_dist), 6) AS sum_dist, quantile_disc(cluster_dist, 0.9) AS p90 FROM imagesbodyposes3d WHERE {DIST} GROUP BY 1""")
def pose_cluster_cohesion(spark, d):
    x, rows = F.col("cluster_dist"), _dist(spark, d).select("cluster_id", "cluster_dist")
    stats = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("avg_dist"), F.round(F.stddev_pop(x), 6).alias("sd_dist"), F.min(x).alias("min_dist"), F.max(x).alias("max_dist"), F.round(F.sum(x), 6).alias("sum_dist"))
    return stats.join(SL.exact_quantiles(rows, "cluster_id", "cluster_dist", {"p90": 0.9}, nearest=True), "cluster_id")


@query("A8 J6", f"""WITH c AS (SELECT cluster_id, quantile_disc(cluster_dist, 0.9) AS p FROM imagesbodyposes3d WHERE {DIST} GROUP BY 1), t AS (SELECT quantile_disc(cluster_dist, 0.9) AS p FROM imagesbodyposes3d WHERE {DIST})
  SELECT count(*) AS n_clusters, count(*) FILTER (WHERE c.p > t.p) AS n_mixed, round(count(*) FILTER (WHERE c.p > t.p) / nullif(count(*), 0), 4) AS mixed_rate FROM c, t""")
def mixed_rate(spark, d):
    x = _dist(spark, d)
    c = SL.exact_quantiles(x, "cluster_id", "cluster_dist", {"p": 0.9}, nearest=True)
    t = SL.exact_quantiles(x, None, "cluster_dist", {"tp": 0.9}, nearest=True)
    mixed = F.count_if(F.col("p") > F.col("tp"))
    return c.join(F.broadcast(t)).agg(F.count("*").alias("n_clusters"), mixed.alias("n_mixed"), ST.ratio(mixed, F.count("*")).alias("mixed_rate"))


@query("A9", "WITH n AS (SELECT count(*) AS n FROM imagesbodyposes3d WHERE cluster_id IS NOT NULL GROUP BY cluster_id) SELECT count(*) AS n_clusters, max(n) AS largest, round(sum(n * n) / (sum(n) * sum(n)), 8) AS hhi FROM n")
def size_concentration(spark, d):
    n = T(spark, d, "imagesbodyposes3d").where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.count("*").alias("n_clusters"), F.max("n").cast("long").alias("largest"), F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 8).alias("hhi"))


@query("A10", f"SELECT count(*) AS n_rows, {', '.join(f'round(avg(CASE WHEN {s}_object_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS {s}_rate' for s in SLOTS)} FROM imagesdetections")
def slot_fill_rates(spark, d):
    rate = lambda s: F.round(F.avg(F.when(F.col(f"{s}_object_id").isNotNull(), 1.0).otherwise(0.0)), 6).alias(f"{s}_rate")
    return T(spark, d, "imagesdetections").agg(F.count("*").alias("n_rows"), *[rate(s) for s in SLOTS])


@query("A11 W5", """WITH n AS (SELECT b.cluster_id, x.class_id, count(*) AS n FROM (SELECT DISTINCT image_id, cluster_id FROM imagesbodyposes3d WHERE cluster_id IS NOT NULL) AS b JOIN (SELECT DISTINCT image_id, class_id FROM detections) AS x ON x.image_id = b.image_id GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, class_id) AS rk, sum(n) OVER (PARTITION BY cluster_id) AS total FROM n)
  SELECT cluster_id, max(class_id) FILTER (WHERE rk = 1) AS top_class, round(max(n) FILTER (WHERE rk = 1) / max(total), 4) AS top_share, round(sum(n) FILTER (WHERE rk <= 3) / max(total), 4) AS top3_share FROM r GROUP BY 1""")
def dominant_class_per_cluster(spark, d):
    b = T(spark, d, "imagesbodyposes3d").where("cluster_id is not null").select("image_id", "cluster_id").distinct()
    n = b.join(T(spark, d, "detections").select("image_id", "class_id").distinct(), "image_id").groupBy("cluster_id", "class_id").agg(F.count("*").alias("n"))
    w = W.partitionBy("cluster_id")
    r = n.withColumn("rk", F.row_number().over(w.orderBy(F.col("n").desc(), "class_id"))).withColumn("total", F.sum("n").over(w))
    top = F.col("rk") == 1
    return r.groupBy("cluster_id").agg(F.max(F.when(top, F.col("class_id"))).alias("top_class"), ST.ratio(F.max(F.when(top, F.col("n"))), F.max("total")).alias("top_share"), ST.ratio(F.sum(F.when(F.col("rk") <= 3, F.col("n"))), F.max("total")).alias("top3_share"))


@query("A12 A13 A18 A20", """SELECT i.site_name_id, count(*) AS n, count(*) FILTER (WHERE gender IN ('woman', 'older woman', 'young woman')) AS women, count(*) FILTER (WHERE gender IN ('man', 'older man', 'young man')) AS men,
  count(*) FILTER (WHERE gender IN ('girl', 'boy')) AS children, count(*) FILTER (WHERE gender IS NULL) AS missing FROM images AS i LEFT JOIN genders AS g ON g.gender_id = i.gender_id GROUP BY 1 HAVING count(*) >= 5""")
def demographic_pivot(spark, d):
    i = T(spark, d, "images").join(T(spark, d, "genders"), "gender_id", "left")
    g = F.col("gender")
    return i.groupBy("site_name_id").agg(
        F.count("*").alias("n"), F.count_if(g.isin("woman", "older woman", "young woman")).alias("women"), F.count_if(g.isin("man", "older man", "young man")).alias("men"), F.count_if(g.isin("girl", "boy")).alias("children"), F.count_if(g.isNull()).alias("missing"),
    ).where("n >= 5")


@query("A14 R24", "SELECT cluster_id, " + ", ".join(f"count(*) FILTER (WHERE orientation = {o}) AS o_{o}" for o in range(4)) + ", count(*) FILTER (WHERE orientation IS NULL) AS o_none FROM (SELECT meta_cluster_id AS cluster_id, orientation FROM detections WHERE meta_cluster_id IS NOT NULL) AS x GROUP BY 1")
def static_pivot(spark, d):
    x = T(spark, d, "detections").where("meta_cluster_id is not null").select(F.col("meta_cluster_id").alias("cluster_id"), "orientation")
    return M.wide_counts(x, "cluster_id", "orientation", list(range(4)), "o_").join(x.groupBy("cluster_id").agg(F.count_if(F.col("orientation").isNull()).alias("o_none")), "cluster_id")


@query("R13", f"WITH {SLOT_SQL}, det AS (SELECT detection_id, max(class_id) AS class_id FROM detections GROUP BY 1) SELECT class_id, {', '.join(f'count(*) FILTER (WHERE slot = {chr(39)}{s}{chr(39)}) AS {s}' for s in SLOTS)}, count(*) AS total FROM sl JOIN det ON det.detection_id = sl.detection_id GROUP BY 1")
def class_slot_matrix(spark, d):
    det = T(spark, d, "detections").groupBy("detection_id").agg(F.max("class_id").alias("class_id"))
    return M.with_total(M.wide_counts(slots_long(spark, d).join(det, "detection_id"), "class_id", "slot", SLOTS, ""), SLOTS)


@query("A17", "WITH n AS (SELECT meta_cluster_id AS bin, count(*) FILTER (WHERE class_id = 0) AS c_0, count(*) FILTER (WHERE class_id = 27) AS c_27, count(*) FILTER (WHERE class_id = 67) AS c_67 FROM detections WHERE meta_cluster_id IS NOT NULL GROUP BY 1)"
  " SELECT r.i AS bin, coalesce(c_0, 0) AS c_0, coalesce(c_27, 0) AS c_27, coalesce(c_67, 0) AS c_67, coalesce(c_0, 0) + coalesce(c_27, 0) + coalesce(c_67, 0) AS total, coalesce(c_27, 0) + coalesce(c_67, 0) AS sum_27_67 FROM (SELECT unnest(range(0, 30)) AS i) AS r LEFT JOIN n ON n.bin = r.i")
def dense_matrix_full_axes(spark, d):
    x = T(spark, d, "detections").where("meta_cluster_id is not null").select(F.col("meta_cluster_id").cast("long").alias("bin"), "class_id")
    cols = ["c_0", "c_27", "c_67"]
    m = M.full_axis(M.wide_counts(x, "bin", "class_id", [0, 27, 67]), "bin", 30, cols)
    return M.with_total(M.with_total(m, cols), ["c_27", "c_67"], "sum_27_67")


@query("A16 A17 A34 R12", "WITH n AS (SELECT meta_cluster_id AS bin, " + ", ".join(f"count(*) FILTER (WHERE class_id = {c}) AS c_{c}" for c in range(141)) + ", count(class_id) AS total FROM detections WHERE meta_cluster_id IS NOT NULL GROUP BY 1) SELECT r.i AS bin, "
  + ", ".join(f"coalesce(c_{c}, 0) AS c_{c}" for c in range(141)) + ", coalesce(total, 0) AS total FROM (SELECT unnest(range(0, (SELECT max(meta_cluster_id) + 1 FROM detections))) AS i) AS r LEFT JOIN n ON n.bin = r.i")
def dense_matrix_all_classes(spark, d):
    """Meta clusters by classes: both axes run from 0 to the largest id of the data, absent cells are 0, the total holds every class."""
    x = T(spark, d, "detections")
    size = lambda c: (F.coalesce(F.max(c), F.lit(0)) + 1).alias(c)
    n = x.agg(size("meta_cluster_id"), size("class_id")).first()  # one row
    return M.dense_counts(x.select(F.col("meta_cluster_id").cast("long").alias("bin"), "class_id"), "bin", "class_id", n["meta_cluster_id"], n["class_id"])


@query("A34", "SELECT 'images' AS name, coalesce(max(image_id), 0) + 1 AS next_id FROM images UNION ALL SELECT 'topics', coalesce(max(topic_id), 0) + 1 FROM topics")
def next_ids(spark, d):
    one = lambda t, c: T(spark, d, t).agg(F.lit(t).alias("name"), (F.coalesce(F.max(c), F.lit(0)) + 1).alias("next_id"))
    return one("images", "image_id").unionByName(one("topics", "topic_id"))


@query("A19", """SELECT t.topic_id, i.gender_id AS category, count(DISTINCT i.image_id) AS n FROM imagestopics AS t JOIN images AS i ON i.image_id = t.image_id WHERE t.topic_id IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT t.topic_id, 99, count(DISTINCT i.image_id) FROM imagestopics AS t JOIN images AS i ON i.image_id = t.image_id WHERE t.topic_id IS NOT NULL AND i.gender_id <> 2 GROUP BY 1""")
def synthetic_category_union(spark, d):
    j = T(spark, d, "imagestopics").where("topic_id is not null").select("topic_id", "image_id").join(T(spark, d, "images").select("image_id", "gender_id"), "image_id").distinct()
    each = j.groupBy("topic_id", F.col("gender_id").alias("category")).agg(F.count("*").alias("n"))
    return each.unionByName(j.where("gender_id <> 2").groupBy("topic_id").agg(F.count("*").alias("n")).select("topic_id", F.lit(99).cast("long").alias("category"), "n"))


BAND = "CASE WHEN conf < 0.5 THEN 'low' WHEN conf < 0.75 THEN 'mid' ELSE 'high' END"
PLACED = f"""pl AS (SELECT x.class_id, {BAND} AS band, count(DISTINCT x.detection_id) AS n_det, count(DISTINCT sl.detection_id) AS n_placed FROM detections AS x LEFT JOIN sl ON sl.detection_id = x.detection_id WHERE x.conf IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT x.class_id, 'all', count(DISTINCT x.detection_id), count(DISTINCT sl.detection_id) FROM detections AS x LEFT JOIN sl ON sl.detection_id = x.detection_id WHERE x.conf IS NOT NULL GROUP BY 1)"""


def placement(spark, d):
    """Detections and placed detections per class and confidence band, with an 'all' band counted afresh."""
    band = F.when(F.col("conf") < 0.5, "low").when(F.col("conf") < 0.75, "mid").otherwise("high")
    x = T(spark, d, "detections").where("conf is not null").select("detection_id", "class_id", F.explode(F.array(band, F.lit("all"))).alias("band")).distinct()
    placed = slots_long(spark, d).select("detection_id", F.col("detection_id").alias("placed_id")).distinct()
    return x.join(placed, "detection_id", "left").groupBy("class_id", "band").agg(F.count_distinct("detection_id").alias("n_det"), F.count_distinct("placed_id").alias("n_placed"))


@query("A21 R4", f"WITH {SLOT_SQL}, {PLACED} SELECT class_id, band, n_det, n_placed, round(n_placed / nullif(n_det, 0), 4) AS rate FROM pl")
def banded_rates(spark, d):
    return placement(spark, d).withColumn("rate", ST.ratio("n_placed", "n_det"))


@query("A22 A24", f"""WITH {SLOT_SQL}, det AS (SELECT detection_id, max(class_id) AS class_id FROM detections GROUP BY 1), n AS (SELECT class_id, slot, count(*) AS n FROM sl JOIN det ON det.detection_id = sl.detection_id GROUP BY 1, 2), t AS (SELECT slot, sum(n) AS g FROM n GROUP BY 1),
  r AS (SELECT *, n / sum(n) OVER (PARTITION BY class_id) AS share, row_number() OVER (PARTITION BY class_id ORDER BY n DESC, slot) AS rk FROM n)
  SELECT r.class_id, r.slot AS top_slot, round(r.share, 6) AS top_share, round(t.g / (SELECT sum(g) FROM t), 6) AS global_share FROM r JOIN t ON t.slot = r.slot WHERE rk = 1""")
def slot_shares(spark, d):
    det = T(spark, d, "detections").groupBy("detection_id").agg(F.max("class_id").alias("class_id"))
    n = slots_long(spark, d).join(det, "detection_id").groupBy("class_id", "slot").agg(F.count("*").alias("n"))
    w = W.partitionBy("class_id")
    r = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rk", F.row_number().over(w.orderBy(F.col("n").desc(), "slot"))).where("rk = 1")
    g = n.groupBy("slot").agg(F.sum("n").alias("g")).withColumn("global_share", F.round(F.col("g") / F.sum("g").over(W.partitionBy(F.lit(1))), 6))
    return r.join(g, "slot").select("class_id", F.col("slot").alias("top_slot"), F.round("share", 6).alias("top_share"), "global_share")


@query("A23 R4", f"""WITH {SLOT_SQL}, {PLACED}, r AS (SELECT class_id, band, n_placed / nullif(n_det, 0) AS x FROM pl), q AS (SELECT band, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM r GROUP BY 1),
  m AS (SELECT r.band, quantile_cont(abs(r.x - q.med), 0.5) AS mad FROM r JOIN q ON q.band = r.band GROUP BY 1)
  SELECT r.class_id, r.band, concat_ws(';', CASE WHEN r.x > 0.9 THEN 'fixed' END, CASE WHEN r.x > q3 + 1.5 * (q3 - q1) OR r.x < q1 - 1.5 * (q3 - q1) THEN 'iqr' END, CASE WHEN abs(0.6745 * (r.x - med) / nullif(mad, 0)) > 3.5 THEN 'mad' END) AS reasons
  FROM r JOIN q ON q.band = r.band JOIN m ON m.band = r.band""")
def rate_outliers(spark, d):
    r = placement(spark, d).select("class_id", "band", (F.col("n_placed") / F.nullif(F.col("n_det"), F.lit(0))).alias("x"))
    p = lambda q: F.percentile("x", F.lit(q))
    q = r.groupBy("band").agg(p(0.25).alias("q1"), p(0.5).alias("med"), p(0.75).alias("q3"))
    j = r.join(q, "band")
    m = j.groupBy("band").agg(F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5)).alias("mad"))
    return j.join(m, "band").select("class_id", "band", ST.outlier_reasons("x", "med", "q1", "q3", "mad", 0.9).alias("reasons"))


@query("A25 R3", """WITH c AS (SELECT l_suppkey AS candidate, avg(l_quantity) AS dist, avg(l_discount) AS mixed, max(l_extendedprice) AS largest FROM lineitem GROUP BY 1),
  s AS (SELECT *, (max(dist) OVER () - dist) / nullif(max(dist) OVER () - min(dist) OVER (), 0) AS a, (max(mixed) OVER () - mixed) / nullif(max(mixed) OVER () - min(mixed) OVER (), 0) AS b, (max(largest) OVER () - largest) / nullif(max(largest) OVER () - min(largest) OVER (), 0) AS c FROM c),
  z AS (SELECT candidate, round(0.5 * coalesce(a, 1) + 0.3 * coalesce(b, 1) + 0.2 * coalesce(c, 1), 6) AS score FROM s) SELECT candidate, score, row_number() OVER (ORDER BY score DESC, candidate) AS rank FROM z""")
def candidate_scorecard(spark, d):
    c = T(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("candidate")).agg(F.avg("l_quantity").alias("dist"), F.avg("l_discount").alias("mixed"), F.max("l_extendedprice").alias("largest"))
    parts = ("dist", "mixed", "largest")
    ends = c.agg(*[f(x).alias(f"{x}_{n}") for x in parts for f, n in ((F.min, "lo"), (F.max, "hi"))])  # one row
    score = sum((k * ST.low_is_good(x, f"{x}_lo", f"{x}_hi") for x, k in zip(parts, (0.5, 0.3, 0.2))), F.lit(0.0))
    s = c.join(F.broadcast(ends)).select("candidate", F.round(score, 6).alias("score"), (-F.round(score, 6)).alias("down"))
    return ordered_positions(s, ["down", "candidate"], "rank").drop("down")


@query("A26 R21", f"WITH {KEYWORDS} SELECT i.site_name_id, kw.keyword, count(*) AS n FROM kw JOIN ingest_items AS i ON i.item_id = kw.item_id GROUP BY 1, 2")
def keyword_frequency_by_site(spark, d):
    return keywords(spark, d).join(T(spark, d, "ingest_items").select("item_id", "site_name_id"), "item_id").groupBy("site_name_id", "keyword").agg(F.count("*").alias("n"))


@query("A28", "WITH u AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i AS pos, round(quantile_cont(x, 0.5), 6) AS med FROM u GROUP BY 1, 2")
def vector_median(spark, d):
    u = T(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return u.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.percentile(F.col("x").cast("double"), F.lit(0.5)), 6).alias("med"))


@query("A31", """SELECT least(greatest(floor(l_quantity / 5), 0), 9)::BIGINT AS qx, least(greatest(floor(l_discount * 100), 0), 10)::BIGINT AS dy, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def histogram_2d(spark, d):
    clip = lambda c, hi: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(hi)).cast("long")
    return T(spark, d, "lineitem").groupBy(clip(F.col("l_quantity") / 5, 9).alias("qx"), clip(F.col("l_discount") * 100, 10).alias("dy")).agg(F.count("*").alias("n"))


@query("A31", "WITH b AS (SELECT min(conf) AS lo, max(conf) AS hi FROM detections) SELECT least(floor((conf - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM detections, b WHERE conf IS NOT NULL GROUP BY 1")
def histogram_1d(spark, d):
    x = T(spark, d, "detections").where("conf is not null").select("conf")
    b = x.agg(F.min("conf").alias("lo"), F.max("conf").alias("hi"))
    bin_ = F.least(F.floor((F.col("conf") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20)), F.lit(19)).cast("long")
    return x.join(F.broadcast(b)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("A32 X26", "SELECT year(uploaddate) AS year, site_name_id, count(*) AS n FROM images WHERE uploaddate >= DATE '2015-01-01' AND uploaddate < DATE '2030-01-01' GROUP BY 1, 2")
def yearly_counts(spark, d):
    return T(spark, d, "images").where("uploaddate >= date '2015-01-01' and uploaddate < date '2030-01-01'").groupBy(F.year("uploaddate").cast("long").alias("year"), "site_name_id").agg(F.count("*").alias("n"))


@query("A33", """WITH c AS (SELECT t.topic_id, b.cluster_id AS r, x.class_id AS c, count(*) AS n FROM imagestopics AS t JOIN imagesarmsposes3d AS b ON b.image_id = t.image_id JOIN detections AS x ON x.image_id = t.image_id WHERE t.topic_id IS NOT NULL AND b.cluster_id IS NOT NULL GROUP BY 1, 2, 3)
  SELECT r, c, round(avg(least(n, 20)), 6) AS mean_capped, count(*) AS n_topics FROM c GROUP BY 1, 2""")
def cellwise_mean(spark, d):
    t = T(spark, d, "imagestopics").where("topic_id is not null").select("image_id", "topic_id")
    b = T(spark, d, "imagesarmsposes3d").where("cluster_id is not null").select("image_id", F.col("cluster_id").alias("r"))
    n = t.join(b, "image_id").join(T(spark, d, "detections").select("image_id", F.col("class_id").alias("c")), "image_id").groupBy("topic_id", "r", "c").agg(F.count("*").alias("n"))
    return n.groupBy("r", "c").agg(F.round(F.avg(F.least("n", F.lit(20))), 6).alias("mean_capped"), F.count("*").alias("n_topics"))


@query("A35 R9", """SELECT (SELECT count(*) FROM images) AS n_images, (SELECT count(DISTINCT image_id) FROM encodings_migration) AS n_encoded, (SELECT count(DISTINCT image_id) FROM detections) AS n_detected, (SELECT count(*) FROM detections WHERE bbox_norm IS NOT NULL) AS n_normalised""")
def coverage_row(spark, d):
    one = lambda t, c, n: T(spark, d, t).agg(c.alias(n))
    parts = [one("encodings_migration", F.count_distinct("image_id"), "n_encoded"), one("detections", F.count_distinct("image_id"), "n_detected"), one("detections", F.count("bbox_norm"), "n_normalised")]
    out = one("images", F.count("*"), "n_images")
    for p in parts:
        out = out.join(F.broadcast(p))
    return out


@query("A36 R9", """WITH e AS (SELECT image_id, max(CASE WHEN is_body THEN 1 ELSE 0 END) AS body, max(CASE WHEN is_face THEN 1 ELSE 0 END) AS face FROM encodings_migration GROUP BY 1)
  SELECT CASE WHEN e.image_id IS NULL THEN 'not encoded' WHEN body = 1 AND face = 1 THEN 'body and face' WHEN body = 1 THEN 'body' WHEN face = 1 THEN 'face' ELSE 'neither' END AS status, count(*) AS n FROM (SELECT DISTINCT image_id FROM images) AS i LEFT JOIN e ON e.image_id = i.image_id GROUP BY 1""")
def status_breakdown(spark, d):
    e = T(spark, d, "encodings_migration").groupBy("image_id").agg(F.max(F.when(F.col("is_body"), 1).otherwise(0)).alias("body"), F.max(F.when(F.col("is_face"), 1).otherwise(0)).alias("face"))
    b, f = F.col("body") == 1, F.col("face") == 1
    status = F.when(F.col("body").isNull(), "not encoded").when(b & f, "body and face").when(b, "body").when(f, "face").otherwise("neither")
    return T(spark, d, "images").select("image_id").distinct().join(e, "image_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("A37", """SELECT site_name_id, site_image_id, count(*) AS n_items, '[' || string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) || ']' AS items FROM ingest_items GROUP BY 1, 2""")
def grouped_json_list(spark, d):
    ids = F.array_sort(F.collect_list("item_id"))
    return T(spark, d, "ingest_items").groupBy("site_name_id", "site_image_id").agg(F.count("*").alias("n_items"), F.to_json(ids).alias("items"))


@query("F16", """WITH e AS (SELECT encoding_id, CAST(face_x AS DOUBLE) AS x, CAST(face_y AS DOUBLE) AS y, CAST(face_z AS DOUBLE) AS z FROM encodings_migration),
  s AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS ix, quantile_cont(y, 0.5) AS my, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iy, quantile_cont(z, 0.5) AS mz, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS iz, count(x) // 2 AS target FROM e),
  n AS (SELECT encoding_id, greatest(abs(x - mx) / ix, abs(y - my) / iy, abs(z - mz) / iz) AS need, target FROM e, s WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
  g AS (SELECT 3.0::DOUBLE * (i + 1) / 4096 AS scale FROM range(4096) AS r(i)), k AS (SELECT coalesce(min(g.scale), 3.0) AS scale FROM g WHERE (SELECT count(*) FROM n WHERE n.need <= g.scale) >= (SELECT max(target) FROM n))
  SELECT encoding_id, scale FROM n, k WHERE need <= scale""")
def adaptive_iqr(spark, d):
    """Head poses kept when half of all rows are wanted, with the scale found."""
    e = T(spark, d, "encodings_migration").select("encoding_id", "face_x", "face_y", "face_z")
    kept, scale = ST.adaptive_iqr(e, ["face_x", "face_y", "face_z"], target=e.where("face_x is not null").count() // 2)
    return kept.select("encoding_id", F.lit(scale).alias("scale"))


@query("F17", """WITH e AS (SELECT CAST(face_x AS DOUBLE) AS x, CAST(face_y AS DOUBLE) AS y FROM encodings_migration WHERE face_x IS NOT NULL AND face_y IS NOT NULL),
  s AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS ix, quantile_cont(y, 0.5) AS my, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iy, avg(x) AS ax, stddev_samp(x) AS sx, avg(y) AS ay, stddev_samp(y) AS sy FROM e)
  SELECT count(*) AS n, count(*) FILTER (WHERE abs(x) < 15 AND abs(y) < 15) AS n_fixed, count(*) FILTER (WHERE abs(x - mx) <= 1.5 * ix AND abs(y - my) <= 1.5 * iy) AS n_iqr, count(*) FILTER (WHERE abs(x - ax) <= 2 * sx AND abs(y - ay) <= 2 * sy) AS n_sigma FROM e, s""")
def filter_survival(spark, d):
    e = T(spark, d, "encodings_migration").select(F.col("face_x").cast("double").alias("x"), F.col("face_y").cast("double").alias("y")).where("x is not null and y is not null")
    q = [SL.exact_quantiles(e, None, c, {f"l{c}": 0.25, f"m{c}": 0.5, f"h{c}": 0.75}).select(f"m{c}", F.expr(f"h{c} - l{c}").alias(f"i{c}")) for c in "xy"]
    s = e.agg(*[f for c in "xy" for f in (F.avg(c).alias(f"a{c}"), F.stddev_samp(c).alias(f"s{c}"))]).join(q[0]).join(q[1])  # one row each
    near = lambda m, w, k: F.expr(" and ".join(f"abs({c} - {m}{c}) <= {k} * {w}{c}" for c in "xy"))
    return e.join(F.broadcast(s)).agg(F.count("*").alias("n"), F.count_if(F.expr("abs(x) < 15 and abs(y) < 15")).alias("n_fixed"), F.count_if(near("m", "i", 1.5)).alias("n_iqr"), F.count_if(near("a", "s", 2)).alias("n_sigma"))

"""Audits and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.operators.stats import ratio
from frameatlas.plans.cohorts import DET_SQL, SLOT_SQL, detection_dim, slots_long
from frameatlas.plans.registry import query
from frameatlas.runtime import table as T


@query("R1", f"""WITH {SLOT_SQL}, u AS (SELECT DISTINCT detection_id, class_id, image_id FROM detections WHERE conf >= 0.4), a AS (SELECT u.class_id, count(DISTINCT u.detection_id) AS n_raw, count(DISTINCT u.image_id) AS n_images, count(DISTINCT sl.detection_id) AS n_assigned FROM u LEFT JOIN sl ON sl.detection_id = u.detection_id GROUP BY 1),
  b AS (SELECT u.class_id, count(DISTINCT p.cluster_id) AS n_clusters FROM u JOIN imagesbodyposes3d AS p ON p.image_id = u.image_id GROUP BY 1)
  SELECT a.class_id, n_raw, n_images, n_assigned, coalesce(n_clusters, 0) AS n_clusters, round(n_assigned / nullif(n_raw, 0), 4) AS assigned_rate FROM a LEFT JOIN b ON b.class_id = a.class_id""")
def detection_funnel(spark, d):
    u = T(spark, d, "detections").where("conf >= 0.4").select("detection_id", "class_id", "image_id").distinct()
    placed = slots_long(spark, d).select("detection_id", F.col("detection_id").alias("placed_id")).distinct()
    a = u.join(placed, "detection_id", "left").groupBy("class_id").agg(F.count_distinct("detection_id").alias("n_raw"), F.count_distinct("image_id").alias("n_images"), F.count_distinct("placed_id").alias("n_assigned"))
    poses = T(spark, d, "imagesbodyposes3d").where("cluster_id is not null").select("image_id", "cluster_id").distinct()
    b = u.select("image_id", "class_id").distinct().join(poses, "image_id").select("class_id", "cluster_id").distinct().groupBy("class_id").agg(F.count("*").alias("n_clusters"))
    return a.join(b, "class_id", "left").select("class_id", "n_raw", "n_images", "n_assigned", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), ratio("n_assigned", "n_raw").alias("assigned_rate"))


@query("R6", f"WITH {SLOT_SQL} SELECT slot, id, detection_id FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY id, detection_id) AS r FROM sl) AS x WHERE r <= 8")
def spot_check_per_slot(spark, d):
    w = W.partitionBy("slot").orderBy("id", "detection_id")
    return slots_long(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 8").select("slot", "id", "detection_id")


@query("R10", """WITH a AS (SELECT site_name_id, count(*) AS n_in FROM ingest_items GROUP BY 1), b AS (SELECT site_name_id, count(*) AS n_out FROM images GROUP BY 1)
  SELECT coalesce(a.site_name_id, b.site_name_id) AS site_name_id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, round(n_out / nullif(n_in, 0), 4) AS retention, CASE WHEN n_in IS NULL THEN 'no input' WHEN n_out IS NULL THEN 'no output' WHEN n_out > n_in THEN 'grew' ELSE 'ok' END AS flag FROM a FULL JOIN b ON a.site_name_id = b.site_name_id""")
def throughput_retention(spark, d):
    a = T(spark, d, "ingest_items").groupBy("site_name_id").agg(F.count("*").alias("n_in"))
    b = T(spark, d, "images").groupBy("site_name_id").agg(F.count("*").alias("n_out"))
    flag = F.when(F.col("n_in").isNull(), "no input").when(F.col("n_out").isNull(), "no output").when(F.col("n_out") > F.col("n_in"), "grew").otherwise("ok")
    return a.join(b, "site_name_id", "full").select("site_name_id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"), ratio("n_out", "n_in").alias("retention"), flag.alias("flag"))


@query("R14", f"""WITH {SLOT_SQL} SELECT class_id, count(*) AS n, max(conf) AS max_conf FROM detections WHERE detection_id NOT IN (SELECT detection_id FROM sl) GROUP BY 1 ORDER BY n DESC, class_id LIMIT 200""")
def unassigned_detected(spark, d):
    x = T(spark, d, "detections").join(slots_long(spark, d).select("detection_id"), "detection_id", "left_anti")
    return x.groupBy("class_id").agg(F.count("*").alias("n"), F.max("conf").alias("max_conf")).orderBy(F.col("n").desc(), "class_id").limit(200)


@query("R15 R18", """SELECT count(*) FILTER (WHERE l IS NOT NULL AND r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL AND r IS NOT NULL) AS right_only, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS both_hands, count(*) FILTER (WHERE l = r) AS same_object, count(*) FILTER (WHERE left_source = 'default') AS left_default FROM (SELECT nullif(left_hand_object_id, 0) AS l, nullif(right_hand_object_id, 0) AS r, left_source FROM imagesdetections) AS x""")
def side_occupancy(spark, d):
    x = T(spark, d, "imagesdetections").select(F.nullif(F.col("left_hand_object_id"), F.lit(0)).alias("l"), F.nullif(F.col("right_hand_object_id"), F.lit(0)).alias("r"), "left_source")
    n = lambda c, a: F.count_if(F.expr(c)).alias(a)
    return x.agg(n("l is not null and r is null", "left_only"), n("l is null and r is not null", "right_only"), n("l is not null and r is not null", "both_hands"), n("l = r", "same_object"), n("left_source = 'default'", "left_default"))


@query("R16", f"""WITH {SLOT_SQL}, {DET_SQL}, n AS (SELECT class_id, count(*) FILTER (WHERE slot = 'left_hand') AS n_left, count(*) FILTER (WHERE slot = 'right_hand') AS n_right FROM sl JOIN det ON det.detection_id = sl.detection_id WHERE slot IN ('left_hand', 'right_hand') GROUP BY 1)
  SELECT class_id, n_left, n_right, round(least(n_left, n_right) / nullif(greatest(n_left, n_right), 0), 4) AS balance FROM n WHERE n_left + n_right >= 20 AND least(n_left, n_right) / nullif(greatest(n_left, n_right), 0) < 0.9""")
def side_imbalance(spark, d):
    j = slots_long(spark, d).where("slot in ('left_hand', 'right_hand')").join(detection_dim(spark, d), "detection_id")
    n = j.groupBy("class_id").agg(F.count_if(F.col("slot") == "left_hand").alias("n_left"), F.count_if(F.col("slot") == "right_hand").alias("n_right"))
    b = F.least("n_left", "n_right") / F.nullif(F.greatest("n_left", "n_right"), F.lit(0))
    return n.where((F.col("n_left") + F.col("n_right") >= 20) & (b < 0.9)).select("class_id", "n_left", "n_right", F.round(b, 4).alias("balance"))


@query("R17", f"""WITH {SLOT_SQL}, {DET_SQL} SELECT slot, count(*) AS n_refs, count(det.detection_id) AS n_resolved, min(sl.detection_id) AS min_id, max(sl.detection_id) AS max_id, count(*) - count(det.detection_id) AS n_broken FROM sl LEFT JOIN det ON det.detection_id = sl.detection_id GROUP BY 1""")
def slot_resolvability(spark, d):
    keys = detection_dim(spark, d).select("detection_id", F.col("detection_id").alias("hit"))
    j = slots_long(spark, d).join(keys, "detection_id", "left")
    return j.groupBy("slot").agg(F.count("*").alias("n_refs"), F.count("hit").alias("n_resolved"), F.min("detection_id").alias("min_id"), F.max("detection_id").alias("max_id"), (F.count("*") - F.count("hit")).alias("n_broken"))


@query("R23", """SELECT 'image' AS origin, image_id AS id, caption, CAST(NULL AS VARCHAR) AS country FROM images UNION ALL SELECT 'item', item_id, title, country FROM ingest_items""")
def merged_metas(spark, d):
    a = T(spark, d, "images").select(F.lit("image").alias("origin"), F.col("image_id").alias("id"), "caption")
    b = T(spark, d, "ingest_items").select(F.lit("item").alias("origin"), F.col("item_id").alias("id"), F.col("title").alias("caption"), "country")
    return a.unionByName(b, allowMissingColumns=True)


@query("R9 R11", """SELECT i.site_name_id, count(*) AS n_images, count(e.image_id) AS n_encoded, count(b.image_id) AS n_posed, round(count(e.image_id) / nullif(count(*), 0), 4) AS encoded_rate FROM images AS i LEFT JOIN (SELECT DISTINCT image_id FROM encodings_migration) AS e ON e.image_id = i.image_id LEFT JOIN (SELECT DISTINCT image_id FROM imagesbodyposes3d) AS b ON b.image_id = i.image_id GROUP BY 1""")
def completeness_by_site(spark, d):
    has = lambda t, n: T(spark, d, t).select("image_id", F.col("image_id").alias(n)).distinct()
    j = T(spark, d, "images").select("image_id", "site_name_id").join(has("encodings_migration", "e"), "image_id", "left").join(has("imagesbodyposes3d", "b"), "image_id", "left")
    return j.groupBy("site_name_id").agg(F.count("*").alias("n_images"), F.count("e").alias("n_encoded"), F.count("b").alias("n_posed"), ratio(F.count("e"), F.count("*")).alias("encoded_rate"))

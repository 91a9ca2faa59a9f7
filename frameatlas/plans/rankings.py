"""Windows, top-k selection and cell routing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.functions import columns as C
from frameatlas.operators import matrices as M
from frameatlas.operators import slices as SL
from frameatlas.operators.relational import ordered_positions
from frameatlas.plans.registry import query
from frameatlas.runtime import materialize
from frameatlas.runtime import table as T


@query("W1 W2 W6 T3", """WITH n AS (SELECT cluster_id, count(*) AS n FROM imagesbodyposes3d WHERE cluster_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, cluster_id) AS a, row_number() OVER (ORDER BY n DESC, cluster_id) AS z, count(*) OVER () AS k FROM n)
  SELECT 'smallest' AS bucket, cluster_id, n FROM r WHERE a <= 5 UNION ALL SELECT 'largest', cluster_id, n FROM r WHERE z <= 5 UNION ALL SELECT 'middle', cluster_id, n FROM r WHERE abs(a - ceil(k / 2.0)) <= 2""")
def reviewer_buckets(spark, d):
    n = T(spark, d, "imagesbodyposes3d").where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    n = materialize(n, "sizes").df
    placed = ordered_positions(n, ["n", "cluster_id"], "a")
    middle = F.abs(F.col("a") - F.ceil(F.lit(n.count()) / 2.0)) <= 2
    pick = lambda x, b: x.select(F.lit(b).alias("bucket"), "cluster_id", "n")
    return pick(n.orderBy("n", "cluster_id").limit(5), "smallest").unionByName(pick(n.orderBy(F.col("n").desc(), "cluster_id").limit(5), "largest")).unionByName(pick(placed.where(middle), "middle"))


@query("W4 R3", """WITH n AS (SELECT site_name_id, gender_id, count(*) AS n FROM images GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY site_name_id) AS total FROM n)
  SELECT site_name_id, max(total)::BIGINT AS total, count(*) AS n_groups, round(sum((n / total) * (n / total)), 8) AS hhi FROM s GROUP BY 1""")
def candidate_rollup(spark, d):
    n = T(spark, d, "images").groupBy("site_name_id", "gender_id").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy("site_name_id")))
    share = F.col("n") / F.col("total")
    return n.groupBy("site_name_id").agg(F.max("total").alias("total"), F.count("*").alias("n_groups"), F.round(F.sum(share * share), 8).alias("hhi"))


def _first_words(c):
    return F.array_join(F.slice(F.split(c, " "), 1, 3), " ")


@query("W7", """WITH w AS (SELECT site_name_id, image_id, array_to_string(string_split(description, ' ')[1:3], ' ') AS lead3 FROM images WHERE description IS NOT NULL)
  SELECT image_id, coalesce(lead3 = lag(lead3) OVER (PARTITION BY site_name_id ORDER BY image_id), false) AS repeats FROM w""")
def repeat_flag_lag(spark, d):
    w = T(spark, d, "images").where("description is not null").select("site_name_id", "image_id", _first_words(F.col("description")).alias("lead3"))
    return SL.previous(w, "site_name_id", ["image_id"], "lead3", "before").select("image_id", F.coalesce(F.col("lead3") == F.col("before"), F.lit(False)).alias("repeats"))


@query("W8", "SELECT image_id, last_value(location_id IGNORE NULLS) OVER (PARTITION BY site_name_id ORDER BY image_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_location FROM images")
def last_valid_value(spark, d):
    i = T(spark, d, "images").select("site_name_id", "image_id", "location_id")
    return SL.last_known(i, "site_name_id", ["image_id"], "location_id", "known_location").select("image_id", "known_location")


@query("W9", "SELECT event_id, count(*) OVER w AS n_near, round(avg(value) OVER w, 6) AS mean_near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 10 FOLLOWING)")
def sliding_neighbours(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-1, 10)
    return T(spark, d, "events").select("event_id", F.count("*").over(w).alias("n_near"), F.round(F.avg("value").over(w), 6).alias("mean_near"))


@query("W10", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) AS x WHERE r = 1")
def most_recent_per_key(spark, d):
    w = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return T(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_id", "event_type")


@query("T1 T2", "SELECT class_id, n, max_conf FROM (SELECT class_id, count(*) AS n, max(conf) AS max_conf FROM detections GROUP BY 1) AS x ORDER BY n DESC, max_conf DESC, class_id LIMIT 10")
def top_classes(spark, d):
    x = T(spark, d, "detections").groupBy("class_id").agg(F.count("*").alias("n"), F.max("conf").alias("max_conf"))
    return x.orderBy(F.col("n").desc(), F.col("max_conf").desc(), "class_id").limit(10)


@query("T5", "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END), 2) AS delta FROM lineitem GROUP BY 1 ORDER BY abs(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END)) DESC, l_suppkey LIMIT 20")
def largest_changes(spark, d):
    x = T(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity"))), 2).alias("delta"))
    return x.orderBy(F.abs("delta").desc(), "l_suppkey").limit(20)


@query("T6 M7", """WITH u AS (SELECT image_id, created_at, unnest([{'t': topic_id, 's': topic_score}, {'t': topic_id2, 's': topic_score2}, {'t': topic_id3, 's': topic_score3}]) AS p FROM imagestopics), r AS (SELECT image_id, created_at, p.t AS t, p.s AS s, row_number() OVER (PARTITION BY image_id ORDER BY p.s DESC, p.t) AS rk FROM u WHERE p.t IS NOT NULL AND p.s IS NOT NULL)
  SELECT image_id, max(t) FILTER (WHERE rk = 1) AS first_topic, max(t) FILTER (WHERE rk = 2) AS second_topic, max(t) FILTER (WHERE rk = 3) AS third_topic FROM r GROUP BY 1""")
def topk_scores(spark, d):
    pairs = F.array(*[F.struct((-F.col(f"topic_score{i}")).alias("s"), F.col(f"topic_id{i}").alias("t")) for i in ("", "2", "3")])
    ok = F.filter(pairs, lambda p: p["s"].isNotNull() & p["t"].isNotNull())
    x = T(spark, d, "imagestopics").groupBy("image_id").agg(F.array_sort(F.flatten(F.collect_list(ok))).alias("p")).where(F.size("p") > 0)
    return x.select("image_id", *[F.get("p", F.lit(i))["t"].alias(n) for i, n in enumerate(("first_topic", "second_topic", "third_topic"))])


@query("T7 J13", """WITH s AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), x AS (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS dist FROM embeddings, s)
  SELECT vec_id, round(dist, 6) AS dist, row_number() OVER (ORDER BY round(dist, 6), vec_id) AS place FROM x""")
def knn_order(spark, d):
    """The whole set ordered by distance to one seed (range-partitioned sort; places from one pass over sorted rows)."""
    e = T(spark, d, "embeddings")
    seed = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    x = e.join(F.broadcast(seed)).select("vec_id", F.round(C.l2(F.col("embedding"), F.col("q")), 6).alias("dist"))
    return ordered_positions(x, ["dist", "vec_id"], "place")


CELLS = "cells AS (SELECT a.cluster_id AS r, x.meta_cluster_id AS c, count(DISTINCT a.image_id) AS n FROM imagesarmsposes3d AS a JOIN detections AS x ON x.image_id = a.image_id WHERE a.cluster_id IS NOT NULL AND x.meta_cluster_id IS NOT NULL GROUP BY 1, 2)"


def cells(spark, d):
    a = T(spark, d, "imagesarmsposes3d").where("cluster_id is not null").select("image_id", F.col("cluster_id").alias("r"))
    x = T(spark, d, "detections").where("meta_cluster_id is not null").select("image_id", F.col("meta_cluster_id").alias("c"))
    return a.join(x, "image_id").groupBy("r", "c").agg(F.count_distinct("image_id").alias("n"))


@query("T10 T13", f"WITH {CELLS} SELECT r, c, n, row_number() OVER (PARTITION BY r ORDER BY n DESC, c) AS place FROM cells WHERE n > 1")
def matrix_cell_selection(spark, d):
    return M.selected_cells(cells(spark, d), 1)


@query("T11", f"WITH {CELLS} SELECT r, c // 4 AS grp, sum(n)::BIGINT AS n FROM cells GROUP BY 1, 2 HAVING sum(n) > 2")
def grouped_column_selection(spark, d):
    return cells(spark, d).groupBy("r", F.floor(F.col("c") / 4).cast("int").alias("grp")).agg(F.sum("n").alias("n")).where("n > 2")


@query("T12", f"WITH {CELLS}, t AS (SELECT c, sum(n)::BIGINT AS total FROM cells GROUP BY 1) SELECT c, total, CASE WHEN total <= 50 THEN 'side' ELSE 'main' END AS bucket FROM t")
def small_column_bucket(spark, d):
    return cells(spark, d).groupBy("c").agg(F.sum("n").alias("total")).withColumn("bucket", F.when(F.col("total") <= 50, "side").otherwise("main"))


@query("T15", f"WITH {CELLS}, t AS (SELECT *, sum(n) OVER (PARTITION BY c) AS total FROM cells) SELECT r, c, n, CASE WHEN total < 100 THEN 'small_column' WHEN c = 0 AND n >= 2 THEN 'no_colour' WHEN n >= 12 THEN 'colour' WHEN n >= 2 THEN 'plain' ELSE 'drop' END AS route FROM t")
def cell_route_policy(spark, d):
    return M.routed_cells(cells(spark, d), 2, 0, 12)


@query("T16", """SELECT cluster_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cluster_dist, image_id) AS r FROM (SELECT cluster_id, image_id, min(cluster_dist) AS cluster_dist FROM imagesarmsposes3d WHERE cluster_id IS NOT NULL AND cluster_dist >= 0 AND NOT isnan(cluster_dist) GROUP BY 1, 2) AS m) AS x WHERE r <= 25""")
def nearest_per_cluster(spark, d):
    m = T(spark, d, "imagesarmsposes3d").where("cluster_id is not null and cluster_dist >= 0 and not isnan(cluster_dist)").groupBy("cluster_id", "image_id").agg(F.min("cluster_dist").alias("x"))
    return m.withColumn("r", F.row_number().over(W.partitionBy("cluster_id").orderBy("x", "image_id"))).where("r <= 25").select("cluster_id", "image_id")


@query("T17", """WITH p AS (SELECT class_id, orientation, count(*) AS n FROM detections GROUP BY 1, 2), s AS (SELECT class_id, sum(n) AS total, count(*) FILTER (WHERE n >= 20 AND orientation IS NOT NULL) AS alive FROM p GROUP BY 1)
  SELECT p.class_id, CAST(p.orientation AS VARCHAR) AS part, p.n FROM p JOIN s ON s.class_id = p.class_id WHERE s.total >= 100 AND alive > 0 AND p.n >= 20 AND p.orientation IS NOT NULL
  UNION ALL SELECT class_id, 'whole', total::BIGINT FROM s WHERE NOT (total >= 100 AND alive > 0)""")
def subsplit_by_group(spark, d):
    return M.subsplit(T(spark, d, "detections").where("class_id is not null"), "class_id", "orientation", 100, 20)


@query("T18", "SELECT CASE WHEN meta_cluster_id IN (1, 2, 3) THEN CAST(meta_cluster_id AS VARCHAR) ELSE 'other' END AS bin, count(*) AS n FROM detections GROUP BY 1")
def remainder_bins(spark, d):
    b = F.when(F.col("meta_cluster_id").isin(1, 2, 3), F.col("meta_cluster_id").cast("string")).otherwise("other")
    return T(spark, d, "detections").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("T14", """WITH b AS (SELECT encoding_id, round(CAST(face_z AS DOUBLE) / 5)::BIGINT AS bin FROM encodings_migration WHERE face_z IS NOT NULL) SELECT encoding_id, bin, row_number() OVER (PARTITION BY bin ORDER BY encoding_id) AS turn FROM b""")
def angle_bin_cycle(spark, d):
    """Rows dealt in turns over the angle bins: first of every bin, then second of every bin, ..."""
    b = T(spark, d, "encodings_migration").where("face_z is not null").select("encoding_id", F.round(F.col("face_z").cast("double") / 5).cast("long").alias("bin"))
    return SL.grouped_positions(b, "bin", ["encoding_id"], "turn").drop("turn_of")


@query("T3 X37")
def seeded_sample(spark, d):
    """A hundred ids by hash order, always with the three smallest."""
    i = T(spark, d, "images").select("image_id").distinct()
    fixed = i.orderBy("image_id").limit(3)
    return i.orderBy(F.xxhash64("image_id", F.lit(42)), "image_id").limit(100).union(fixed).distinct()

"""Batches, retries, counters, lookups, run modes and names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.functions import columns as C
from frameatlas.operators import matrices as M
from frameatlas.operators.lloyd import kmeans
from frameatlas.operators.nearest import assign_nearest
from frameatlas.plans.registry import query
from frameatlas.runtime import materialize, retried, scratch
from frameatlas.runtime import table as T
from frameatlas.sources import artifacts as A


@query("A29", """WITH v AS (SELECT site_name_id, h, w, count(*) AS n FROM images WHERE h IS NOT NULL AND w IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT *, row_number() OVER (PARTITION BY site_name_id ORDER BY n DESC, h, w) AS r FROM v WHERE n > 1),
  d AS (SELECT site_name_id, trunc(quantile_cont(h, 0.5))::BIGINT AS h, trunc(quantile_cont(w, 0.5))::BIGINT AS w FROM images WHERE h IS NOT NULL AND w IS NOT NULL GROUP BY 1)
  SELECT d.site_name_id, coalesce(m.h, d.h)::BIGINT AS h, coalesce(m.w, d.w)::BIGINT AS w, m.h IS NOT NULL AS is_mode FROM d LEFT JOIN m ON m.r = 1 AND m.site_name_id IS NOT DISTINCT FROM d.site_name_id""")
def common_size(spark, d):
    """The most common size of a site's pictures as a row of two; without a repeated one the median of both, cut to integers."""
    i = T(spark, d, "images").where("h is not null and w is not null").groupBy("site_name_id", F.array(F.col("h").cast("long"), F.col("w").cast("long")).alias("v")).agg(F.count("*").alias("n"))
    mode = F.max_by("v", F.struct("n", F.transform("v", lambda x: -x)))
    # medians from the counted rows: a size that many pictures have is one row
    mid = lambda k: F.expr(f"percentile(v[{k}], 0.5, n)").cast("long")
    out = i.groupBy("site_name_id").agg((F.max("n") > 1).alias("is_mode"), mode.alias("m"), mid(0).alias("h"), mid(1).alias("w"))
    return out.select("site_name_id", F.when(F.col("is_mode"), F.col("m")[0]).otherwise(F.col("h")).alias("h"), F.when(F.col("is_mode"), F.col("m")[1]).otherwise(F.col("w")).alias("w"), "is_mode")


@query("A15", "SELECT meta_cluster_id AS cluster_id, " + ", ".join(f"count(*) FILTER (WHERE orientation = {o}) AS o_{o}" for o in range(4)) + " FROM detections WHERE meta_cluster_id IS NOT NULL AND orientation IS NOT NULL GROUP BY 1")
def discovered_pivot(spark, d):
    """A column for every orientation the data have; the values are found first (few, counted in one aggregate)."""
    x = T(spark, d, "detections").where("meta_cluster_id is not null and orientation is not null").select(F.col("meta_cluster_id").alias("cluster_id"), "orientation")
    found = sorted(r[0] for r in x.select("orientation").distinct().limit(1_001).collect())
    if len(found) > 1_000:
        raise ValueError("more than 1000 columns")
    return M.wide_counts(x, "cluster_id", "orientation", found, "o_")


@query("B1", "SELECT ((r - 1) // 50)::BIGINT AS page, image_id FROM (SELECT image_id, row_number() OVER (ORDER BY image_id) AS r FROM images) AS x WHERE r <= 150")
def keyset_pages(spark, d):
    """Three pages of 50 pictures: each starts after the last key of the one before."""
    i, last, out = T(spark, d, "images").select("image_id"), -1, None
    for page in range(3):
        rows = i.where(F.col("image_id") > last).orderBy("image_id").limit(50)
        last = rows.agg(F.max("image_id")).first()[0] or last
        got = rows.select(F.lit(page).cast("long").alias("page"), "image_id")
        out = got if out is None else out.unionByName(got)
    return out


@query("B2", "SELECT (image_id // 500)::BIGINT AS batch, count(*) AS n, min(image_id) AS first_id, max(image_id) AS last_id FROM images GROUP BY 1")
def id_range_batches(spark, d):
    """Ranges of 500 ids, each handled by one task on its own; ranges without rows don't appear."""
    i = T(spark, d, "images").select("image_id", F.floor(F.col("image_id") / 500).alias("batch"))
    return i.groupBy("batch").agg(F.count("*").alias("n"), F.min("image_id").alias("first_id"), F.max("image_id").alias("last_id"))


@query("B9", "SELECT count(*) AS n, 3 AS attempts FROM images")
def retried_read(spark, d):
    """A read that fails twice and is tried again."""
    tries = []

    def read():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("not there yet")
        return T(spark, d, "images")

    rows = retried(read, times=5, wait=0.0)
    return rows.agg(F.count("*").alias("n"), F.lit(len(tries)).alias("attempts"))


@query("B10", """SELECT 'read' AS stage, count(*) AS n_rows, count(DISTINCT image_id) AS n_images FROM imagesbodyposes3d UNION ALL SELECT 'usable', count(*), count(DISTINCT image_id) FROM imagesbodyposes3d WHERE cluster_id IS NOT NULL AND cluster_dist >= 0 AND NOT isnan(cluster_dist)
  UNION ALL SELECT 'near', count(*), count(DISTINCT image_id) FROM imagesbodyposes3d WHERE cluster_id IS NOT NULL AND cluster_dist >= 0 AND NOT isnan(cluster_dist) AND cluster_dist < 0.5""")
def stage_counters(spark, d):
    """Rows that pass every stage, counted by observations while one job runs."""
    seen = {s: Observation(s) for s in ("read", "usable", "near")}
    step = T(spark, d, "imagesbodyposes3d").select("image_id", "cluster_id", "cluster_dist").observe(seen["read"], F.count(F.lit(1)).alias("n"))
    step = step.where("cluster_id is not null and cluster_dist >= 0 and not isnan(cluster_dist)").observe(seen["usable"], F.count(F.lit(1)).alias("n"))
    step = step.where("cluster_dist < 0.5").observe(seen["near"], F.count(F.lit(1)).alias("n"))
    step.write.format("noop").mode("overwrite").save()
    rows = spark.createDataFrame([(s, o.get["n"]) for s, o in seen.items()], "stage string, n_rows long")
    p = T(spark, d, "imagesbodyposes3d")
    usable = F.col("cluster_id").isNotNull() & (F.col("cluster_dist") >= 0) & ~F.isnan("cluster_dist")
    one = p.agg(F.count_distinct("image_id").alias("read"), F.count_distinct(F.when(usable, F.col("image_id"))).alias("usable"), F.count_distinct(F.when(usable & (F.col("cluster_dist") < 0.5), F.col("image_id"))).alias("near"))
    return rows.join(one.unpivot([], ["read", "usable", "near"], "stage", "n_images"), "stage")


@query("S10", """SELECT i.image_id, e.encoding_id, e.bbox, b.cluster_id AS body_cluster, a.cluster_id AS arms_cluster, t.topic_id FROM (SELECT DISTINCT image_id FROM images) AS i
  LEFT JOIN (SELECT image_id, max(encoding_id) AS encoding_id, max_by(bbox, encoding_id) AS bbox FROM encodings_migration GROUP BY 1) AS e USING (image_id) LEFT JOIN (SELECT image_id, max(cluster_id) AS cluster_id FROM imagesbodyposes3d GROUP BY 1) AS b USING (image_id)
  LEFT JOIN (SELECT image_id, max(cluster_id) AS cluster_id FROM imagesarmsposes3d GROUP BY 1) AS a USING (image_id) LEFT JOIN (SELECT image_id, max(topic_id) AS topic_id FROM imagestopics GROUP BY 1) AS t USING (image_id)""")
def feature_lookup(spark, d):
    """What four tables know of every picture, null where one knows nothing."""
    one = lambda t, c, name: T(spark, d, t).groupBy("image_id").agg(F.max(c).alias(name))
    e = T(spark, d, "encodings_migration").groupBy("image_id").agg(F.max("encoding_id").alias("encoding_id"), F.max_by("bbox", F.when(F.col("bbox").isNotNull(), F.col("encoding_id"))).alias("bbox"))
    i = T(spark, d, "images").select("image_id").distinct()
    for x in (e, one("imagesbodyposes3d", "cluster_id", "body_cluster"), one("imagesarmsposes3d", "cluster_id", "arms_cluster"), one("imagestopics", "topic_id", "topic_id")):
        i = i.join(x, "image_id", "left")
    return i


@query("S7 S14", "SELECT 'topics' AS kind, count(*) AS n_rows, 2 AS n_files FROM imagestopics")
def manifest_round_trip(spark, d):
    """Rows of a manifest after an append, and the files of two matrix manifests put together."""
    p = scratch(spark, "artifact")
    t = T(spark, d, "imagestopics").select("image_id", "topic_id")
    A.write_artifact(t.where("image_id % 2 = 0"), p, "topics")
    m = A.append_artifact(t.where("image_id % 2 <> 0 or image_id is null"), p, "topics")
    if A.read_artifact(spark, p, "topics").count() != m["rows"]:
        raise ValueError("the manifest is not true")
    files = A.add_to_manifest(A.matrix_manifest("topics", {"a.csv": {"entity_type": "topic", "entity_id": 1}}), A.matrix_manifest("topics", {"b.csv": {"entity_type": "topic"}}))["files"]
    return spark.createDataFrame([(m["kind"], m["rows"], len(files))], "kind string, n_rows long, n_files int")


def label_medians(e):
    parts = e.where("label is not null").select("label", F.posexplode("embedding").alias("i", "x"))
    mid = parts.groupBy("label", "i").agg(F.percentile(F.col("x").cast("double"), F.lit(0.5)).alias("m"))
    return mid.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


@query("C6", """WITH part AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, i, quantile_cont(x, 0.5) AS m FROM part GROUP BY 1, 2)
  SELECT vec_id, label, round(sqrt(sum((x - m.m) * (x - m.m))), 5) AS dist FROM part JOIN m USING (label, i) GROUP BY 1, 2""")
def recompute_medians(spark, d):
    """Run mode 2: medians of the clusters as they are now, and every member's distance to its own."""
    e = T(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return e.join(label_medians(e), "label").select("vec_id", "label", F.round(C.l2(F.transform("embedding", lambda x: x.cast("double")), F.col("centre")), 5).alias("dist"))


@query("C6")
def meta_clusters(spark, d):
    """Run mode 3: clusters of the cluster medians, and the medians' distance to their meta-cluster."""
    m = materialize(label_medians(T(spark, d, "embeddings").select("vec_id", "label", "embedding")), "medians").df
    centres, _ = kmeans(m, "centre", 3)
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.asarray(centres))], "cluster int, centre array<double>")
    return assign_nearest(m.withColumnRenamed("centre", "vec"), "label", "vec", c).select("label", F.col("cluster").alias("meta_cluster"), F.round("dist", 5).alias("dist"))


_TOKENS = {"segment_count": "ct", "pose_no": "p", "topic_no": "t", "cluster_no": "c", "background_bin": "h", "object_bin": "sb", "object_match": "om"}


@query("X28", """WITH n AS (SELECT id, 'ct' || (id % 40) || '_p' || (id % 7) || '_t' || (image_id % 50) || '_c' || (image_id % 90) || '.0_oml3_hl2_h' || (id % 23) || '_sbnone_om' || (image_id % 9) AS name FROM imagesdetections)
  SELECT id, regexp_extract(name, 'ct([0-9]+)', 1)::BIGINT AS segment_count, regexp_extract(name, '_p([0-9]+)', 1)::BIGINT AS pose_no, regexp_extract(name, '_t([0-9]+)', 1)::BIGINT AS topic_no, regexp_extract(name, '_c([0-9]+)', 1)::BIGINT AS cluster_no, regexp_extract(name, '_h([0-9]+)', 1)::BIGINT AS background_bin, NULL::BIGINT AS object_bin, regexp_extract(name, '_om([0-9]+)', 1)::BIGINT AS object_match FROM n""")
def name_tokens(spark, d):
    """Numbers behind the prefixes of a file name; "none", "nan" and a missing token are null, oml and hl tokens are others."""
    x = lambda t, c, m: [F.lit(t), (F.col(c) % m).cast("string")]
    name = F.concat(*x("ct", "id", 40), *x("_p", "id", 7), *x("_t", "image_id", 50), *x("_c", "image_id", 90), F.lit(".0_oml3_hl2"), *x("_h", "id", 23), F.lit("_sbnone"), *x("_om", "image_id", 9))
    # a token is what stands between underscores; prefixes end where a digit or a word for nothing begins
    token = lambda p: F.floor(F.nullif(F.regexp_extract("name", rf"(?:^|_){p}([0-9]+(?:\.[0-9]+)?)(?=_|$)", 1), F.lit("")).cast("double")).cast("long")
    return T(spark, d, "imagesdetections").select("id", name.alias("name")).select("id", *[token(p).alias(k) for k, p in _TOKENS.items()])


@query("R21", "SELECT topic_id, k.keyword, count(DISTINCT i.image_id) AS n FROM (SELECT DISTINCT image_id, topic_id FROM imagestopics WHERE topic_id IS NOT NULL AND topic_id <> 0) AS i JOIN (SELECT DISTINCT image_id, keyword FROM (SELECT image_id, unnest(string_split(lower(description), ' ')) AS keyword FROM images) AS u WHERE keyword <> '') AS k ON k.image_id = i.image_id GROUP BY 1, 2 HAVING count(DISTINCT i.image_id) >= 5")
def topic_word_frequencies(spark, d):
    """Words of descriptions per topic, in at least five pictures; written in parts by topic where files are wanted."""
    t = T(spark, d, "imagestopics").where("topic_id is not null and topic_id <> 0").select("image_id", "topic_id").distinct()
    w = T(spark, d, "images").select("image_id", F.explode(F.array_distinct(F.split(F.lower("description"), " "))).alias("keyword")).where("keyword <> ''").distinct()
    return t.join(w, "image_id").groupBy("topic_id", "keyword").agg(F.count("*").alias("n")).where("n >= 5")


@query("R22", """WITH b AS (SELECT DISTINCT image_id, detection_id, class_id, l, t, r, m FROM (SELECT detection_id, obj_no, image_id, class_id, (b ->> '$.left')::DOUBLE AS l, (b ->> '$.top')::DOUBLE AS t, (b ->> '$.right')::DOUBLE AS r, (b ->> '$.bottom')::DOUBLE AS m FROM (
    SELECT *, CASE WHEN json_type(bbox::JSON) = 'VARCHAR' THEN (bbox::JSON ->> '$')::JSON ELSE bbox::JSON END AS b FROM detections WHERE bbox IS NOT NULL AND json_valid(bbox)) AS x) AS y WHERE l IS NOT NULL AND t IS NOT NULL AND r IS NOT NULL AND m IS NOT NULL),
  c AS (SELECT *, round(l) AS l2, round(t) AS t2, ceil(r) AS r2, ceil(m) AS m2 FROM b), o AS (SELECT *, greatest(0, least(r, r2) - greatest(l, l2)) * greatest(0, least(m, m2) - greatest(t, t2)) AS i, greatest(0, r - l) * greatest(0, m - t) AS s1, greatest(0, r2 - l2) * greatest(0, m2 - t2) AS s2 FROM c)
  SELECT class_id, count(*) AS n, round(avg(r2 - r), 5) AS mean_right, round(avg(m2 - m), 5) AS mean_bottom, round(avg(CASE WHEN s1 + s2 - i > 0 THEN i / (s1 + s2 - i) ELSE 0 END), 5) AS mean_iou FROM o GROUP BY 1""")
def boxes_before_after(spark, d):
    """Boxes before and after they are set to whole pixels: mean shifts and overlap per class."""
    from frameatlas.plans.scalars import boxes

    b = boxes(spark, d).select("image_id", "detection_id", "class_id", "b").distinct()
    after = F.struct(F.round("b.left").alias("left"), F.round("b.top").alias("top"), F.ceil("b.right").cast("double").alias("right"), F.ceil("b.bottom").cast("double").alias("bottom"))
    x = b.select("class_id", "b", after.alias("a"))
    return x.groupBy("class_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a.right") - F.col("b.right")), 5).alias("mean_right"), F.round(F.avg(F.col("a.bottom") - F.col("b.bottom")), 5).alias("mean_bottom"), F.round(F.avg(F.coalesce(C.iou(F.col("b"), F.col("a")), F.lit(0.0))), 5).alias("mean_iou"))

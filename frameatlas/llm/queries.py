"""The training-data queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameatlas.llm import canon, components, gridcluster, mixing, neighbours, packing, topn, toxicity, truncation
from frameatlas.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.link_groups(table(spark, sf_dir, "encodings_migration"), "image_id", "is_dupe_of").select("image_id", "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.most_similar(table(spark, sf_dir, "encodings_migration"), "image_id", "encoding_id", "face_encodings68").select("image_id", "neighbour_id")


def p3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images whose id is divisible by 100, against all, with factor 1, which restores exact search."""
    return neighbours.most_similar(table(spark, sf_dir, "encodings_migration"), "image_id", "encoding_id", "face_encodings68", relax=1.0, asked=lambda item: item % 100 == 0).select("image_id", "neighbour_id")


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those images the true neighbours, and whether nine in ten of them are found by the relaxed search."""
    found = p3_found(spark, sf_dir).where(F.col("image_id") % 100 == 0).withColumn("hit", F.lit(1))
    joined = p3_exact(spark, sf_dir).join(found, ["image_id", "neighbour_id"], "left")
    return joined.agg(F.count_distinct("image_id").alias("n_queries"), F.count("*").alias("n_true"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("recall_met"))


def p4_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 10 again with a bar of 200 rows for a heavy group, so that most rows take the salted range sort."""
    latest = topn.latest_per_item(table(spark, sf_dir, "imagesbodyposes3d"), "image_id", "assigned_at", ["cluster_id", "cluster_dist"])
    return topn.top_n(latest.where("cluster_dist >= 0"), "cluster_id", "cluster_dist", "image_id", 10, heavy_rows=200, slice_rows=2_000).select("cluster_id", "image_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = topn.latest_per_item(table(spark, sf_dir, "imagesbodyposes3d"), "image_id", "assigned_at", ["cluster_id", "cluster_dist"])
    return topn.top_n(latest.where("cluster_dist >= 0"), "cluster_id", "cluster_dist", "image_id", 10).select("cluster_id", "image_id")


def _posture_groups(spark: SparkSession, sf_dir: str):
    members = gridcluster.density_groups(table(spark, sf_dir, "encodings_migration"), "image_id", "encoding_id", "body_landmarks")
    if members is None:
        members = spark.createDataFrame([], "item long, group long, cell_n long, gap double, size long")
    return members, gridcluster.name_groups(members, table(spark, sf_dir, "imagesarmsposes3d"), "image_id", "cluster_id", "assigned_at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, names = _posture_groups(spark, sf_dir)
    return members.join(names, "group", "left").select(members["item"].alias("image_id"), names["name"].alias("cluster_id"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, name and typical images of every posture group."""
    return gridcluster.describe_groups(*_posture_groups(spark, sf_dir)).withColumnRenamed("group", "group_id").withColumnRenamed("name", "cluster_id")


_P1_SQL = """
WITH RECURSIVE l AS (SELECT DISTINCT image_id AS a, is_dupe_of AS b FROM encodings_migration WHERE is_dupe_of IS NOT NULL AND is_dupe_of <> 0 AND image_id IS NOT NULL AND image_id <> is_dupe_of),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS v, a AS r FROM e UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.r),
label AS (SELECT v, min(r) AS g FROM reach GROUP BY v),
member AS (SELECT v, g FROM label WHERE v IN (SELECT image_id FROM encodings_migration)),
grp AS (SELECT g, min(v) AS group_id FROM member GROUP BY g HAVING count(*) > 1)
SELECT m.v AS image_id, grp.group_id FROM member AS m JOIN grp ON m.g = grp.g"""

_P4_SQL = """
WITH latest AS (SELECT image_id, cluster_id, cluster_dist FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY assigned_at DESC NULLS LAST, cluster_id DESC NULLS LAST, cluster_dist DESC NULLS LAST) AS r FROM imagesbodyposes3d WHERE image_id IS NOT NULL) AS x WHERE r = 1),
usable AS (SELECT * FROM latest WHERE cluster_id IS NOT NULL AND cluster_dist IS NOT NULL AND NOT isnan(cluster_dist) AND cluster_dist >= 0)
SELECT cluster_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cluster_dist, image_id) AS r FROM usable) AS x WHERE r <= 10"""

_P3_TRUE = """
usable AS (SELECT image_id, min(encoding_id) AS encoding_id FROM encodings_migration WHERE image_id IS NOT NULL AND len(face_encodings68) = 128
  AND len(list_filter(face_encodings68, lambda x: x IS NOT NULL AND isfinite(x))) = 128 AND list_max(list_transform(face_encodings68, lambda x: abs(x))) > 0 GROUP BY 1),
vec AS (SELECT u.image_id, CAST(e.face_encodings68 AS FLOAT[128]) AS v FROM usable AS u JOIN encodings_migration AS e USING (encoding_id)),
pairs AS (SELECT a.image_id, b.image_id AS neighbour_id, row_number() OVER (PARTITION BY a.image_id ORDER BY list_distance(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), b.image_id) AS r FROM vec AS a JOIN vec AS b ON a.image_id <> b.image_id{where}),
near AS (SELECT image_id, neighbour_id FROM pairs WHERE r <= 5)"""
_P3_SQL = f"WITH {_P3_TRUE.format(where=' AND a.image_id % 100 = 0')} SELECT image_id, neighbour_id FROM near"
_P3_RECALL_SQL = f"WITH {_P3_TRUE.format(where=' AND a.image_id % 100 = 0')} SELECT count(DISTINCT image_id) AS n_queries, count(*) AS n_true, true AS recall_met FROM near"

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_exact": p3_exact, "p3_recall": p3_recall, "p4_found": p4_found, "p4_hot": p4_hot, "p7_found": p7_found, "p7_groups": p7_groups, **canon.QUERIES, **truncation.QUERIES, **packing.QUERIES, **mixing.QUERIES, **toxicity.QUERIES}
SQL = {"p1_found": _P1_SQL, "p3_exact": _P3_SQL, "p3_recall": _P3_RECALL_SQL, "p4_found": _P4_SQL, "p4_hot": _P4_SQL, **canon.SQL, **packing.SQL, **mixing.SQL, **truncation.SQL}

"""Queries p2_*: slot and topic references of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameatlas.operators import orphans
from frameatlas.runtime import table


def _groups(spark: SparkSession, sf_dir: str):
    slots = orphans.references(table(spark, sf_dir, "imagesdetections"), "imagesdetections", "id", ["left_hand_object_id", "right_hand_object_id"], "created_at")
    topics = orphans.references(table(spark, sf_dir, "imagestopics"), "imagestopics", "image_id", ["topic_id"], "created_at")
    return [
        (slots, orphans.parent_states(table(spark, sf_dir, "detections"), "detection_id", "loaded_at", "deleted_at")),
        (topics, orphans.parent_states(table(spark, sf_dir, "topics"), "topic_id", "loaded_at", "deleted_at")),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_groups(spark, sf_dir)).select("table_name", "record_id", "field_name", "ref_id", "kind").distinct()


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(_groups(spark, sf_dir))


_REFS = """
refs AS (
  SELECT 'imagesdetections' AS table_name, id AS record_id, 'left_hand_object_id' AS field_name, left_hand_object_id AS ref_id, created_at FROM imagesdetections
  UNION ALL SELECT 'imagesdetections', id, 'right_hand_object_id', right_hand_object_id, created_at FROM imagesdetections
  UNION ALL SELECT 'imagestopics', image_id, 'topic_id', topic_id, created_at FROM imagestopics),
parents AS (
  SELECT 'imagesdetections' AS t, detection_id AS k, bool_or(deleted_at IS NULL) AS live, min(loaded_at) FILTER (WHERE deleted_at IS NULL) AS since FROM detections GROUP BY detection_id
  UNION ALL SELECT 'imagestopics', topic_id, bool_or(deleted_at IS NULL), min(loaded_at) FILTER (WHERE deleted_at IS NULL) FROM topics GROUP BY topic_id),
judged AS (
  SELECT r.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN NOT p.live THEN 'deleted' WHEN p.since > r.created_at THEN 'late' END AS kind
  FROM refs r LEFT JOIN parents p ON p.t = r.table_name AND p.k = r.ref_id WHERE r.ref_id IS NOT NULL AND r.ref_id <> 0)
"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
SQL = {
    "p2_found": f"WITH {_REFS} SELECT DISTINCT table_name, record_id, field_name, ref_id, kind FROM judged WHERE kind IS NOT NULL",
    "p2_counts": f"""WITH {_REFS} SELECT table_name, field_name, strftime(created_at, '%Y-%m') AS month, count(*) AS n_refs,
      count(*) FILTER (WHERE kind = 'missing') AS n_missing, count(*) FILTER (WHERE kind = 'deleted') AS n_deleted, count(*) FILTER (WHERE kind = 'late') AS n_late,
      round(count(kind) / count(*), 6) AS broken_share FROM judged GROUP BY 1, 2, 3""",
}

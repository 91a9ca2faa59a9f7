"""Round trips through file formats, incremental runs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameatlas.plans.registry import query
from frameatlas.runtime import scratch
from frameatlas.runtime import table as T
from frameatlas.sources import artifacts as A
from frameatlas.sources import files as S
from frameatlas.streaming import events as E


@query("S4 S13 S6", "SELECT site_name_id, count(*) AS n, count(country) AS n_country FROM ingest_items WHERE item_id NOT IN (SELECT image_id FROM images) GROUP BY 1")
def jsonl_resume(spark, d):
    """Records written as JSON lines and read again with a schema, without those already taken in."""
    p = scratch(spark, "items-jsonl")
    S.write_jsonl(T(spark, d, "ingest_items").select("item_id", "site_name_id", "country"), p)
    rows = S.read_jsonl(spark, p, "item_id long, site_name_id int, country string", T(spark, d, "images").select(F.col("image_id").alias("item_id")), "item_id")
    return rows.groupBy("site_name_id").agg(F.count("*").alias("n"), F.count("country").alias("n_country"))


@query("S5 S9", "SELECT location_id, nullif(getty_name, '') AS getty_name, nullif(sovereignty, '') AS sovereignty FROM locations")
def csv_round_trip(spark, d):
    p = scratch(spark, "locations-csv")
    S.write_csv(T(spark, d, "locations").select("location_id", "getty_name", "sovereignty"), p)
    return S.read_csv(spark, p, "location_id long, getty_name string, sovereignty string")


@query("S6 S8", "SELECT topic_id, count(*) AS n, CAST(sum(CAST(topic_score AS DECIMAL(18, 6))) AS DOUBLE) AS sum_score FROM imagestopics GROUP BY 1")
def artifact_round_trip(spark, d):
    """A table with a manifest, appended in two halves, checked and read back."""
    p = scratch(spark, "artifact")
    t = T(spark, d, "imagestopics").select("image_id", "topic_id", "topic_score")
    A.write_artifact(t.where("image_id % 2 = 0"), p, "topics")
    A.append_artifact(t.where("image_id % 2 <> 0 or image_id is null"), p, "topics")
    return A.read_artifact(spark, p, "topics").groupBy("topic_id").agg(F.count("*").alias("n"), F.sum(F.col("topic_score").cast("decimal(18,6)")).cast("double").alias("sum_score"))


@query("B6 S8", "SELECT site_name_id, count(*) AS n, max(image_id) AS newest FROM images WHERE site_name_id IS NOT NULL GROUP BY 1")
def partition_overwrite(spark, d):
    """One partition is deleted and written again; the others are untouched."""
    p = scratch(spark, "images-parts")
    i = T(spark, d, "images").where("site_name_id is not null").select("image_id", "site_name_id")
    S.overwrite_parts(i, p, "site_name_id")
    S.overwrite_parts(i.where("site_name_id = 1"), p, "site_name_id")
    return spark.read.schema("image_id long, site_name_id int").parquet(p).groupBy("site_name_id").agg(F.count("*").alias("n"), F.max("image_id").alias("newest"))


@query("S15 X22", "SELECT l_linenumber AS class_id, count(*) AS n, round(avg(round(l_discount, 6) - round(l_tax, 6) / 2), 5) AS mean_left FROM lineitem GROUP BY 1")
def label_files(spark, d):
    """Boxes written as label lines and parsed again."""
    p = scratch(spark, "labels")
    rows = T(spark, d, "lineitem").select(F.col("l_linenumber").alias("class_id"), F.col("l_discount").alias("cx"), F.col("l_discount").alias("cy"), F.col("l_tax").alias("w"), F.col("l_tax").alias("h"))
    S.label_lines(rows).write.mode("overwrite").text(p)
    back = S.read_labels(spark, p)
    return back.select("class_id", *S.corners("cx", "cy", "w", "h")).groupBy("class_id").agg(F.count("*").alias("n"), F.round(F.avg("left"), 5).alias("mean_left"))


@query("S16 S17 B10", "SELECT event_type AS stage, count(*) AS n, round(sum(value), 3) AS seconds FROM events WHERE value IS NOT NULL GROUP BY 1")
def log_parse(spark, d):
    """Stage timings written as log lines and parsed by pattern."""
    p = scratch(spark, "log")
    T(spark, d, "events").where("value is not null").select(F.concat(F.lit("[stage] "), "event_type", F.lit(" took "), F.col("value").cast("string"), F.lit(" s")).alias("value")).write.mode("overwrite").text(p)
    rows = S.read_log(spark, p, r"^\[stage\] (\w+) took ([-+0-9.E]+) s$", ["stage", "seconds"])
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum(F.col("seconds").try_cast("double")), 3).alias("seconds"))


@query("S18", "SELECT i.item_id, m.value AS location_id FROM ingest_items AS i JOIN (SELECT lower(trim(nation_name)) AS key, min(location_id) AS value FROM locations WHERE nation_name IS NOT NULL GROUP BY 1) AS m ON m.key = lower(trim(i.country))")
def dictionary_lookup(spark, d):
    m = S.dictionary(T(spark, d, "locations"), "nation_name", "location_id")
    return T(spark, d, "ingest_items").select("item_id", F.lower(F.trim("country")).alias("key")).join(m, "key").select("item_id", F.col("value").alias("location_id"))


@query("S2 B4", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    return E.streamed_window_counts(spark, f"{d}/events.parquet")


@query("B4", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_distinct(spark, d):
    return E.streamed_distinct(spark, f"{d}/events.parquet", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("B5 B8", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) AS x WHERE r = 1")
def stream_last_per_user(spark, d):
    return E.streamed_last_per_key(spark, f"{d}/events.parquet", "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("W9", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    s = F.session_window("ts", "6 hours")
    return T(spark, d, "events").groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")

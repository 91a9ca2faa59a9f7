"""Scans, filters, joins, set operations and merges over the archive."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.operators import relational as R
from frameatlas.plans.registry import query
from frameatlas.runtime import table as T


def keywords(spark, d):
    """The item-keyword bridge: one row per item and word."""
    k = T(spark, d, "ingest_items").select("item_id", F.explode(F.split("keywords", "[|]")).alias("keyword"))
    return k.where("keyword <> ''").distinct()


KEYWORDS = "kw AS (SELECT DISTINCT item_id, keyword FROM (SELECT item_id, unnest(string_split(keywords, '|')) AS keyword FROM ingest_items WHERE keywords IS NOT NULL) AS u WHERE keyword <> '')"


@query("S1 F1 F2 F3", """SELECT image_id, encoding_id, CAST(face_x AS DOUBLE) AS face_x, CAST(face_y AS DOUBLE) AS face_y FROM encodings_migration
  WHERE face_x > -20 AND face_x < 20 AND face_y > -10 AND face_y < 10 AND face_z BETWEEN -5 AND 5 AND is_face IN (true)""")  # fmt: skip
def face_range_cohort(spark, d):
    e = R.in_open_ranges(T(spark, d, "encodings_migration"), {"face_x": (-20, 20), "face_y": (-10, 10)})
    return e.where(F.col("face_z").between(-5, 5) & F.col("is_face").isin(True)).select("image_id", "encoding_id", F.col("face_x").cast("double").alias("face_x"), F.col("face_y").cast("double").alias("face_y"))


@query("S2 S3 F20", "SELECT count(*) AS n_rows, count(caption) AS n_captions, count(*) FILTER (WHERE description <> '') AS n_described FROM images")
def image_scan_counts(spark, d):
    return spark.sql("SELECT count(*) AS n_rows, count(caption) AS n_captions, count_if(description <> '') AS n_described FROM {i}", i=T(spark, d, "images"))


@query("F4 J2 S11", "SELECT image_id, site_name_id FROM images WHERE image_id NOT IN (SELECT image_id FROM imagestopics WHERE image_id IS NOT NULL)")
def images_without_topic(spark, d):
    return T(spark, d, "images").join(T(spark, d, "imagestopics").select("image_id"), "image_id", "left_anti").select("image_id", "site_name_id")


@query("F5", "SELECT is_face, is_body, is_feet, count(*) AS n FROM encodings_migration GROUP BY ALL")
def tri_state_flags(spark, d):
    return T(spark, d, "encodings_migration").groupBy("is_face", "is_body", "is_feet").agg(F.count("*").alias("n"))


@query("F6 J4", "SELECT image_id, uploaddate FROM images AS i WHERE EXISTS (SELECT 1 FROM detections AS x WHERE x.image_id = i.image_id AND x.class_id = 27 AND x.conf >= 0.4 AND x.deleted_at IS NULL)")
def images_with_class(spark, d):
    hit = T(spark, d, "detections").where("class_id = 27 and conf >= 0.4 and deleted_at is null").select("image_id")
    return T(spark, d, "images").join(hit, "image_id", "left_semi").select("image_id", "uploaddate")


@query("F7 C25", """SELECT b.image_id, b.cluster_id FROM imagesbodyposes3d AS b WHERE b.cluster_id IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM imagesarmsposes3d AS a WHERE a.image_id = b.image_id AND (a.cluster_id = b.cluster_id OR a.cluster_id IS NULL))""")
def not_excluded_poses(spark, d):
    b = T(spark, d, "imagesbodyposes3d").where("cluster_id is not null").select("image_id", "cluster_id").alias("b")
    a = T(spark, d, "imagesarmsposes3d").select("image_id", "cluster_id").alias("a")
    return b.join(a, (F.col("a.image_id") == F.col("b.image_id")) & ((F.col("a.cluster_id") == F.col("b.cluster_id")) | F.col("a.cluster_id").isNull()), "left_anti")


@query("F8", "SELECT site_name_id, count(*) AS n_matches FROM images WHERE description ILIKE '%woman%' OR caption ILIKE 'elderly%' GROUP BY site_name_id")
def text_pattern_counts(spark, d):
    i = T(spark, d, "images").where(F.col("description").ilike("%woman%") | F.col("caption").ilike("elderly%"))
    return i.groupBy("site_name_id").agg(F.count("*").alias("n_matches"))


@query("F9", "SELECT image_id % 40 AS slice, count(*) AS n, count(*) FILTER (WHERE image_id % 2 = 0) AS n_even FROM images GROUP BY 1")
def modulo_slices(spark, d):
    return T(spark, d, "images").groupBy((F.col("image_id") % 40).alias("slice")).agg(F.count("*").alias("n"), F.count_if(F.col("image_id") % 2 == 0).alias("n_even"))


@query("F10 B1 B5", """WITH seen AS (SELECT i.site_name_id, max(i.image_id) AS high FROM images AS i WHERE i.image_id IN (SELECT image_id FROM imagestopics) GROUP BY 1)
  SELECT i.site_name_id, i.image_id FROM images AS i LEFT JOIN seen AS s ON s.site_name_id = i.site_name_id WHERE i.image_id > coalesce(s.high, 0)""")
def beyond_high_water_mark(spark, d):
    i = T(spark, d, "images").select("site_name_id", "image_id")
    high = i.join(T(spark, d, "imagestopics").select("image_id"), "image_id", "left_semi").groupBy("site_name_id").agg(F.max("image_id").alias("high"))
    return i.join(high, "site_name_id", "left").where(F.col("image_id") > F.coalesce("high", F.lit(0))).select("site_name_id", "image_id")


@query("F11", "SELECT event_type, count(*) AS n_high, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 GROUP BY 1")
def json_path_filter(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return T(spark, d, "events").where(k >= 50).groupBy("event_type").agg(F.count("*").alias("n_high"), F.max(k).alias("max_k"))


@query("F12", "SELECT 'any' AS wanted, count(*) AS n FROM imagesarmsposes3d WHERE cluster_id IS NOT NULL UNION ALL SELECT '2', count(*) FROM imagesarmsposes3d WHERE cluster_id = 2")
def sentinel_cluster_filter(spark, d):
    """-1 asks for any cluster, another number for that one."""
    a = T(spark, d, "imagesarmsposes3d")
    pick = lambda c: a.where(F.col("cluster_id").isNotNull() if c == -1 else F.col("cluster_id") == c)
    one = lambda c, n: pick(c).agg(F.lit(n).alias("wanted"), F.count("*").alias("n"))
    return one(-1, "any").unionByName(one(2, "2"))


@query("F13", f"""WITH {KEYWORDS} SELECT item_id FROM kw GROUP BY item_id HAVING bool_or(keyword IN ('protest', 'placard')) AND bool_or(keyword = 'walking') AND NOT bool_or(keyword = 'isolated')""")
def keyword_bool_filter(spark, d):
    return R.keyword_cohort(keywords(spark, d), "item_id", "keyword", any_of=["protest", "placard"], all_of=["walking"], none_of=["isolated"])


@query("F14", f"""WITH {KEYWORDS} SELECT a.keyword AS word_a, b.keyword AS word_b, count(*) AS n_items FROM kw AS a JOIN kw AS b ON a.item_id = b.item_id AND a.keyword < b.keyword GROUP BY 1, 2""")
def cooccurrence_selfjoin(spark, d):
    """Word pairs from each item's (short) word list; the same pairs as a self-join of the bridge, without its shuffle of pairs."""
    words = keywords(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list("keyword")).alias("w"))
    pairs = words.select(F.explode("w").alias("word_a"), "w").select("word_a", F.explode("w").alias("word_b")).where("word_a < word_b")
    return pairs.groupBy("word_a", "word_b").agg(F.count("*").alias("n_items"))


@query("F15", f"""WITH {KEYWORDS} SELECT item_id, count(DISTINCT keyword) AS n_words FROM kw WHERE keyword IN ('protest', 'placard', 'megaphone', 'walking', 'travel') GROUP BY item_id HAVING count(DISTINCT keyword) >= 3""")
def k_of_n_keywords(spark, d):
    return R.at_least_k_of(keywords(spark, d), "item_id", "keyword", ["protest", "placard", "megaphone", "walking", "travel"], 3)


@query("F18", "SELECT DISTINCT site_name_id, gender_id, age_id FROM images")
def distinct_projection(spark, d):
    return T(spark, d, "images").select("site_name_id", "gender_id", "age_id").distinct()


@query("F19 T4", "SELECT image_id, uploaddate FROM images ORDER BY uploaddate DESC NULLS LAST, image_id LIMIT 500")
def capped_first_n(spark, d):
    return T(spark, d, "images").select("image_id", "uploaddate").orderBy(F.col("uploaddate").desc_nulls_last(), "image_id").limit(500)


@query("F20", "SELECT encoding_id FROM encodings_migration WHERE len(face_encodings68) = 128 AND NOT list_bool_or(list_transform(face_encodings68, lambda x: x IS NULL OR isnan(x) OR isinf(x)))", name="finite_vectors")
def _finite(spark, d):
    e = T(spark, d, "encodings_migration")
    return e.where((F.size("face_encodings68") == 128) & ~F.exists("face_encodings68", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select("encoding_id")


@query("J1 S10", """SELECT i.image_id, t.topic_id, b.cluster_id AS body_cluster, a.cluster_id AS arms_cluster FROM images AS i JOIN imagestopics AS t ON t.image_id = i.image_id
  JOIN imagesbodyposes3d AS b ON b.image_id = i.image_id LEFT JOIN imagesarmsposes3d AS a ON a.image_id = i.image_id""")
def four_way_join(spark, d):
    i = T(spark, d, "images").select("image_id")
    t = T(spark, d, "imagestopics").select("image_id", "topic_id")
    b = T(spark, d, "imagesbodyposes3d").select("image_id", F.col("cluster_id").alias("body_cluster"))
    a = T(spark, d, "imagesarmsposes3d").select("image_id", F.col("cluster_id").alias("arms_cluster"))
    return i.join(t, "image_id").join(b, "image_id").join(a, "image_id", "left")


@query("J3 J5 J17", """SELECT l.location_id, count(i.image_id) AS n_images, coalesce(sum(CASE WHEN i.no_image THEN 1 ELSE 0 END), 0)::BIGINT AS n_missing FROM locations AS l LEFT JOIN images AS i ON i.location_id = l.location_id GROUP BY 1""")
def zero_filled_counts(spark, d):
    n = T(spark, d, "images").groupBy("location_id").agg(F.count("image_id").alias("n"), F.count_if("no_image").alias("m"))
    return T(spark, d, "locations").select("location_id").join(n, "location_id", "left").select("location_id", F.coalesce("n", F.lit(0)).alias("n_images"), F.coalesce("m", F.lit(0)).alias("n_missing"))


@query("J6 J7", """WITH n AS (SELECT cluster_id, count(*) AS n FROM imagesbodyposes3d WHERE cluster_id IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM n)
  SELECT n.cluster_id, n.n, round(n.n / t.total, 8) AS share, round(n.n * t.k / t.total, 6) AS vs_mean FROM n, t""")
def share_of_total(spark, d):
    n = T(spark, d, "imagesbodyposes3d").where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))  # one row
    return n.join(F.broadcast(total)).select("cluster_id", "n", F.round(F.col("n") / F.col("total"), 8).alias("share"), F.round(F.col("n") * F.col("k") / F.col("total"), 6).alias("vs_mean"))


@query("J8 J12", "SELECT r_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def crosswalk_two_hops(spark, d):
    n = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return T(spark, d, "customer").join(n, on=["c_nationkey"]).groupBy("r_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("J9 R8", """WITH x AS (SELECT DISTINCT image_id, class_id FROM detections WHERE class_id IN (24, 26, 27, 67) AND conf >= 0.4)
  SELECT a.class_id AS class_a, b.class_id AS class_b, count(DISTINCT a.image_id) AS n_images FROM x AS a JOIN x AS b ON a.image_id = b.image_id AND a.class_id < b.class_id GROUP BY 1, 2""")
def class_collisions(spark, d):
    x = T(spark, d, "detections").where(F.col("class_id").isin(24, 26, 27, 67) & (F.col("conf") >= 0.4)).select("image_id", "class_id").distinct()
    a, b = x.alias("a"), x.alias("b")
    j = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.class_id") < F.col("b.class_id")))
    return j.groupBy(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b")).agg(F.count_distinct("a.image_id").alias("n_images"))


SLOTS = ["left_hand", "right_hand", "top_face", "left_eye", "right_eye", "mouth", "shoulder", "waist", "feet"]


def slots_long(spark, d):
    """``id, image_id, slot, detection_id``: the nine slots as rows, unset ones dropped."""
    s = T(spark, d, "imagesdetections").select("id", "image_id", *[F.col(f"{x}_object_id").alias(x) for x in SLOTS])
    return s.unpivot(["id", "image_id"], SLOTS, "slot", "detection_id").where("detection_id is not null and detection_id <> 0")


SLOT_SQL = "sl AS (" + " UNION ALL ".join(f"SELECT id, image_id, '{s}' AS slot, {s}_object_id AS detection_id FROM imagesdetections WHERE {s}_object_id IS NOT NULL AND {s}_object_id <> 0" for s in SLOTS) + ")"
DET_SQL = "det AS (SELECT detection_id, max(class_id) AS class_id, max(conf) AS conf FROM detections GROUP BY detection_id)"


def detection_dim(spark, d):
    return T(spark, d, "detections").groupBy("detection_id").agg(F.max("class_id").alias("class_id"), F.max("conf").alias("conf"))


@query("J10 U3", f"""WITH {SLOT_SQL}, {DET_SQL} SELECT sl.id, {", ".join(f"max(det.class_id) FILTER (WHERE slot = '{s}') AS {s}_class" for s in SLOTS)} FROM sl LEFT JOIN det ON det.detection_id = sl.detection_id GROUP BY sl.id""")
def slot_hydration(spark, d):
    """Nine joins of one dimension as one: unpivot, join once, pivot back."""
    h = slots_long(spark, d).join(detection_dim(spark, d), "detection_id", "left")
    return h.groupBy("id").agg(*[F.max(F.when(F.col("slot") == s, F.col("class_id"))).alias(f"{s}_class") for s in SLOTS])


@query("J11 B5", """WITH m AS (SELECT image_id, max(loaded_at) AS newest FROM detections GROUP BY 1), p AS (SELECT image_id, max(created_at) AS processed FROM imagesdetections GROUP BY 1)
  SELECT m.image_id, m.newest FROM m JOIN p ON p.image_id = m.image_id WHERE m.newest > p.processed""")
def reprocess_if_newer(spark, d):
    m = T(spark, d, "detections").groupBy("image_id").agg(F.max("loaded_at").alias("newest"))
    p = T(spark, d, "imagesdetections").groupBy("image_id").agg(F.max("created_at").alias("processed"))
    return m.join(p, "image_id").where("newest > processed").select("image_id", "newest")


@query("J18 U4", "SELECT o_orderstatus, found, count(*) AS n FROM (SELECT o_orderstatus, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'in' ELSE 'out' END AS found FROM orders) AS x GROUP BY 1, 2")
def membership_split(spark, d):
    o, keys = T(spark, d, "orders"), T(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    a = o.join(keys, "o_orderkey", "left_semi").withColumn("found", F.lit("in"))
    b = o.join(keys, "o_orderkey", "left_anti").withColumn("found", F.lit("out"))
    return a.unionByName(b).groupBy("o_orderstatus", "found").agg(F.count("*").alias("n"))


@query("J19 B6", "SELECT image_id, topic_id, topic_score FROM imagestopics WHERE topic_id IS NULL OR topic_id NOT IN (SELECT topic_id FROM topics WHERE deleted_at IS NOT NULL AND topic_id IS NOT NULL)")
def delete_by_join(spark, d):
    gone = T(spark, d, "topics").where("deleted_at is not null").select("topic_id")
    return T(spark, d, "imagestopics").join(gone, "topic_id", "left_anti").select("image_id", "topic_id", "topic_score")


@query("J20 C30", """WITH f AS (SELECT site_name_id, min(h) AS h, min(w) AS w, min(location_id) AS location_id FROM images GROUP BY 1)
  SELECT i.image_id, coalesce(i.location_id, f.location_id) AS location_id, coalesce(i.h, f.h) AS h FROM images AS i LEFT JOIN f ON f.site_name_id = i.site_name_id""")
def coalesce_update_join(spark, d):
    i = T(spark, d, "images").select("image_id", "site_name_id", "location_id", "h")
    f = i.groupBy("site_name_id").agg(F.min("location_id").alias("location_id"), F.min("h").alias("h"))
    return R.fill_nulls_from(i, f, "site_name_id", ["location_id", "h"]).select("image_id", "location_id", "h")


@query("J16 R5", """WITH a AS (SELECT l_suppkey AS k, count(*) AS n, avg(l_discount) AS r FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n, avg(l_discount) AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS suppkey, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, round(b.r - a.r, 6) AS rate_change FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_diff(spark, d):
    l = T(spark, d, "lineitem")
    half = lambda c: l.where(c).groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("r"))
    a, b = half("l_shipdate < timestamp '1995-01-01'").alias("a"), half("l_shipdate >= timestamp '1995-01-01'").alias("b")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "suppkey", "full").select("suppkey", zero("a.n").alias("n_before"), zero("b.n").alias("n_after"), F.round(F.col("b.r") - F.col("a.r"), 6).alias("rate_change"))


@query("U1", "SELECT image_id FROM imagesbodyposes3d UNION SELECT image_id FROM imagesarmsposes3d UNION SELECT image_id FROM imagestopics")
def union_of_ids(spark, d):
    t = [T(spark, d, n).select("image_id") for n in ("imagesbodyposes3d", "imagesarmsposes3d", "imagestopics")]
    return t[0].union(t[1]).union(t[2]).distinct()


@query("U2", "SELECT 'body' AS kind, cluster_id, count(*) AS n FROM imagesbodyposes3d GROUP BY 2 UNION ALL SELECT 'arms', cluster_id, count(*) FROM imagesarmsposes3d GROUP BY 2")
def tagged_union(spark, d):
    one = lambda t, k: T(spark, d, t).groupBy("cluster_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "cluster_id", "n")
    return one("imagesbodyposes3d", "body").unionByName(one("imagesarmsposes3d", "arms"))


@query("U4 R11", """SELECT found_in, count(*) AS n FROM (SELECT CASE WHEN a.image_id IS NOT NULL AND b.image_id IS NOT NULL THEN 'both' WHEN a.image_id IS NOT NULL THEN 'left' ELSE 'right' END AS found_in
  FROM (SELECT DISTINCT image_id FROM encodings_migration WHERE image_id IS NOT NULL) AS a FULL JOIN (SELECT DISTINCT image_id FROM detections WHERE image_id IS NOT NULL) AS b ON a.image_id = b.image_id) AS x GROUP BY 1""")
def set_reconcile(spark, d):
    return R.reconcile(T(spark, d, "encodings_migration"), T(spark, d, "detections"), "image_id").groupBy("found_in").agg(F.count("*").alias("n"))


@query("U5 S12", "SELECT image_id, encoding_id, is_face FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY encoding_id DESC) AS r FROM encodings_migration) AS x WHERE r = 1")
def last_row_per_image(spark, d):
    return R.last_wins(T(spark, d, "encodings_migration").select("image_id", "encoding_id", "is_face"), "image_id", [F.col("encoding_id")])


@query("U6", "SELECT site_name_id, site_image_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY site_name_id, site_image_id ORDER BY received_at, item_id) AS r FROM ingest_items) AS x WHERE r = 1")
def first_wins_dedupe(spark, d):
    i = T(spark, d, "ingest_items").select("site_name_id", "site_image_id", "item_id", "received_at")
    return R.first_wins(i, ["site_name_id", "site_image_id"], [F.col("received_at"), F.col("item_id")]).drop("received_at")


@query("U7 C24", "SELECT DISTINCT least(image_id, is_dupe_of) AS lo, greatest(image_id, is_dupe_of) AS hi FROM encodings_migration WHERE is_dupe_of <> 0 AND image_id <> is_dupe_of")
def unordered_pair_dedupe(spark, d):
    return T(spark, d, "encodings_migration").where("is_dupe_of <> 0 and image_id <> is_dupe_of").select(*R.unordered_pair("image_id", "is_dupe_of")).distinct()


@query("U8", """SELECT site_name_id, site_image_id, list_sort(list_distinct(flatten(list(w)))) AS all_words FROM (SELECT site_name_id, site_image_id, list_filter(string_split(keywords, '|'), lambda x: x <> '') AS w FROM ingest_items WHERE keywords IS NOT NULL) AS x GROUP BY 1, 2""")
def keyword_set_union(spark, d):
    w = T(spark, d, "ingest_items").where("keywords is not null").select("site_name_id", "site_image_id", F.filter(F.split("keywords", "[|]"), lambda x: x != "").alias("w"))
    return w.groupBy("site_name_id", "site_image_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("all_words"))


@query("B3 C26", """SELECT i.image_id, bool_or(e.is_dupe_of IS NOT NULL) AS is_dupe FROM images AS i JOIN encodings_migration AS e ON e.image_id = i.image_id GROUP BY 1""")
def dupe_recheck(spark, d):
    e = T(spark, d, "encodings_migration").groupBy("image_id").agg(F.max(F.col("is_dupe_of").isNotNull()).alias("is_dupe"))
    return T(spark, d, "images").select("image_id").join(e, "image_id")


@query("B7 C7", """WITH cache AS (SELECT image_id, min(cluster_dist) AS v FROM imagesarmsposes3d WHERE cluster_dist IS NOT NULL AND NOT isnan(cluster_dist) GROUP BY 1), fresh AS (SELECT image_id, min(cluster_dist) AS v FROM imagesbodyposes3d WHERE cluster_dist IS NOT NULL AND NOT isnan(cluster_dist) GROUP BY 1)
  SELECT image_id, v, 'cached' AS origin FROM cache UNION ALL SELECT image_id, v, 'computed' FROM fresh WHERE image_id NOT IN (SELECT image_id FROM cache)""")
def cache_hydrate_union(spark, d):
    best = lambda t: T(spark, d, t).where("cluster_dist is not null and not isnan(cluster_dist)").groupBy("image_id").agg(F.min("cluster_dist").alias("v"))
    cache = best("imagesarmsposes3d").withColumn("origin", F.lit("cached"))
    return R.merge_insert_absent(cache, best("imagesbodyposes3d").withColumn("origin", F.lit("computed")), ["image_id"])


@query("B8", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) AS x WHERE r = 1")
def upsert_last_wins(spark, d):
    e = T(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("seq"))
    old, new = e.where("event_type in ('view', 'click')"), e.where("event_type not in ('view', 'click') or event_type is null")
    return R.upsert(R.upsert(old, new, ["user_id"], "seq"), new, ["user_id"], "seq").drop("seq")


@query("C29", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL) AS x WHERE r = 1")
def registry_first_wins(spark, d):
    """A write-once registry: the first value of a key stays, whatever is computed for it later; replays change nothing."""
    e = T(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts").where("user_id is not null")
    return R.first_wins(e, "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")

"""Scalar families over the archive: text, JSON, vectors, landmarks, boxes, colours."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.functions import columns as C
from frameatlas.plans.registry import query
from frameatlas.runtime import table as T


@query("X1 X2 X35", """SELECT item_id, lower(trim(country, ' .;!')) AS country_plain, CASE WHEN keywords IS NULL THEN NULL ELSE to_json(list_sort(list_distinct(list_filter(string_split(keywords, '|'), lambda x: x <> '')))) END AS words_json, replace(upper(gender), ' ', '_') AS gender_tag FROM ingest_items""")
def text_cleanup(spark, d):
    words = F.array_sort(F.array_distinct(F.filter(F.split("keywords", "[|]"), lambda x: x != "")))
    return T(spark, d, "ingest_items").select("item_id", F.lower(F.btrim("country", F.lit(" .;!"))).alias("country_plain"), F.to_json(words).alias("words_json"), F.replace(F.upper("gender"), F.lit(" "), F.lit("_")).alias("gender_tag"))


@query("X3", "SELECT site_name_id, string_agg(DISTINCT number_of_people, ',' ORDER BY number_of_people) AS people FROM ingest_items WHERE number_of_people IS NOT NULL GROUP BY 1")
def ordered_listagg(spark, d):
    return T(spark, d, "ingest_items").where("number_of_people is not null").groupBy("site_name_id").agg(F.array_join(F.array_sort(F.collect_set("number_of_people")), ",").alias("people"))


# fixed values: phrases kept together before splitting, applied in this order
PHRASES = [("black and white", "monochrome"), ("copy space", "copyspace"), ("looking away", "averted gaze"), ("averted gaze from", "turned from")]


@query("X4 M10", "SELECT image_id, CASE WHEN lower(description) LIKE '%black%' OR lower(description) LIKE '%space%' OR lower(description) LIKE '%looking%' THEN replace(replace(replace(replace(lower(description), 'black and white', 'monochrome'), 'copy space', 'copyspace'), 'looking away', 'averted gaze'), 'averted gaze from', 'turned from') ELSE lower(description) END AS clarified FROM images WHERE description IS NOT NULL")
def phrase_clarify(spark, d):
    low = F.lower("description")
    guard = low.contains("black") | low.contains("space") | low.contains("looking")
    return T(spark, d, "images").where("description is not null").select("image_id", F.when(guard, C.replaced_in_order(low, PHRASES)).otherwise(low).alias("clarified"))


@query("X5", "SELECT image_id, lower(regexp_extract(description, '(?i)\\b(woman|man|girl|boy|couple|group)\\b', 1)) AS who FROM images WHERE description IS NOT NULL")
def whole_word_lookup(spark, d):
    return T(spark, d, "images").where("description is not null").select("image_id", F.lower(F.regexp_extract("description", r"(?i)\b(woman|man|girl|boy|couple|group)\b", 1)).alias("who"))


@query("X6 A26", "WITH w AS (SELECT site_name_id, unnest(regexp_extract_all(lower(description), '[a-z]+')) AS word FROM images WHERE description IS NOT NULL) SELECT site_name_id, word, count(*) AS n FROM w WHERE length(word) BETWEEN 4 AND 15 GROUP BY 1, 2")
def token_counts(spark, d):
    w = T(spark, d, "images").where("description is not null").select("site_name_id", F.explode(C.tokens(F.col("description"), 4)).alias("word"))
    return w.groupBy("site_name_id", "word").agg(F.count("*").alias("n"))


@query("X8", """WITH m(raw, canonical) AS (VALUES ('woman', 'woman'), ('female', 'woman'), ('women', 'woman'), ('man', 'man'), ('male', 'man'), ('men', 'man')), h AS (SELECT i.site_name_id, i.site_image_id, m.canonical FROM ingest_items AS i JOIN m ON lower(trim(i.gender)) = m.raw)
  SELECT site_name_id, site_image_id, CASE WHEN count(DISTINCT canonical) = 1 THEN max(canonical) END AS agreed FROM h GROUP BY 1, 2""")
def synonym_agreement(spark, d):
    m = spark.createDataFrame([("woman", "woman"), ("female", "woman"), ("women", "woman"), ("man", "man"), ("male", "man"), ("men", "man")], "raw string, canonical string")
    h = T(spark, d, "ingest_items").withColumn("raw", F.lower(F.trim("gender"))).join(F.broadcast(m), "raw")
    return h.groupBy("site_name_id", "site_image_id").agg(F.collect_set("canonical").alias("s")).select("site_name_id", "site_image_id", F.when(F.size("s") == 1, F.get("s", F.lit(0))).alias("agreed"))


@query("X9", "WITH w AS (SELECT DISTINCT image_id, unnest(string_split(regexp_replace(lower(description), '(,|''s|[.])', '', 'g'), ' ')) AS word FROM images WHERE description IS NOT NULL), t AS (SELECT DISTINCT topic_id, unnest(string_split(topic, ' ')) AS word FROM topics WHERE topic IS NOT NULL) SELECT w.image_id, t.topic_id, count(*) AS n_words FROM w JOIN t ON t.word = w.word WHERE length(w.word) > 2 GROUP BY 1, 2")
def description_to_topics(spark, d):
    w = T(spark, d, "images").where("description is not null").select("image_id", F.explode(F.split(F.regexp_replace(F.lower("description"), "(,|'s|[.])", ""), " ")).alias("word")).where("length(word) > 2").distinct()
    t = T(spark, d, "topics").where("topic is not null").select("topic_id", F.explode(F.split("topic", " ")).alias("word")).distinct()
    return w.join(t, "word").groupBy("image_id", "topic_id").agg(F.count("*").alias("n_words"))


@query("X10", """SELECT item_id, CASE WHEN lower(gender) LIKE '%group%' OR lower(gender) LIKE '% and %' THEN 'mixed' WHEN regexp_matches(lower(gender), '(woman|women|female|lady|girl)') THEN 'female' WHEN regexp_matches(lower(gender), '(man|men|male|boy)') THEN 'male' WHEN gender IS NULL OR trim(gender) = '' THEN 'missing' ELSE 'unknown' END AS sex,
  TRY_CAST(regexp_extract(age, '([0-9]+)', 1) AS INTEGER) AS age_from FROM ingest_items""")
def gender_age_rows(spark, d):
    g = F.lower("gender")
    sex = F.when(g.contains("group") | g.contains(" and "), "mixed").when(g.rlike("(woman|women|female|lady|girl)"), "female").when(g.rlike("(man|men|male|boy)"), "male").when(F.col("gender").isNull() | (F.trim("gender") == ""), "missing").otherwise("unknown")
    return T(spark, d, "ingest_items").select("item_id", sex.alias("sex"), F.regexp_extract("age", "([0-9]+)", 1).try_cast("int").alias("age_from"))


@query("X11", """WITH p AS (SELECT item_id, lower(trim(list_extract(string_split(country, ','), -1))) AS k FROM ingest_items WHERE country IS NOT NULL) SELECT p.item_id, coalesce(a.location_id, b.location_id) AS location_id FROM p
  LEFT JOIN (SELECT lower(code_alpha2) AS k, min(location_id) AS location_id FROM locations WHERE code_alpha2 IS NOT NULL GROUP BY 1) AS a ON length(p.k) = 2 AND a.k = p.k LEFT JOIN (SELECT lower(nation_name) AS k, min(location_id) AS location_id FROM locations WHERE nation_name IS NOT NULL GROUP BY 1) AS b ON b.k = p.k""")
def location_resolution(spark, d):
    p = T(spark, d, "ingest_items").where("country is not null").select("item_id", F.lower(F.trim(F.element_at(F.split("country", ","), -1))).alias("k"))
    loc = T(spark, d, "locations")
    by = lambda c, n: loc.where(f"{c} is not null").groupBy(F.lower(c).alias("k")).agg(F.min("location_id").alias(n))
    j = p.join(by("code_alpha2", "a"), "k", "left").join(by("nation_name", "b"), "k", "left")
    return j.select("item_id", F.coalesce(F.when(F.length("k") == 2, F.col("a")), "b").alias("location_id"))


BOXES = """bx AS (SELECT detection_id, obj_no, image_id, class_id, conf, CASE WHEN json_type(bbox::JSON) = 'VARCHAR' THEN (bbox::JSON ->> '$')::JSON ELSE bbox::JSON END AS b FROM detections WHERE bbox IS NOT NULL AND json_valid(bbox)),
  bb AS (SELECT detection_id, obj_no, image_id, class_id, conf, (b ->> '$.left')::DOUBLE AS l, (b ->> '$.top')::DOUBLE AS t, (b ->> '$.right')::DOUBLE AS r, (b ->> '$.bottom')::DOUBLE AS m FROM bx WHERE (b ->> '$.left') IS NOT NULL AND (b ->> '$.top') IS NOT NULL AND (b ->> '$.right') IS NOT NULL AND (b ->> '$.bottom') IS NOT NULL)"""


def boxes(spark, d):
    x = T(spark, d, "detections").select("detection_id", "obj_no", "image_id", "class_id", "conf", C.box("bbox").alias("b"))
    return x.where("b is not null")


@query("X13 F11", f"WITH {BOXES} SELECT class_id, count(*) AS n, round(avg(r - l), 6) AS mean_w, round(avg(m - t), 6) AS mean_h FROM bb WHERE l >= 100 GROUP BY 1")
def json_boxes(spark, d):
    x = boxes(spark, d).where("b.left >= 100")
    return x.groupBy("class_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b.right") - F.col("b.left")), 6).alias("mean_w"), F.round(F.avg(F.col("b.bottom") - F.col("b.top")), 6).alias("mean_h"))


@query("X14 X15 X30", "SELECT encoding_id, round(coalesce(abs(CAST(face_x AS DOUBLE)), 0) + pow(least(1.0, greatest(0.0, CAST(mouth_gap AS DOUBLE) / 10)), 2) * 0.75 + 0.25, 6) AS level, ceil(CAST(face_y AS DOUBLE))::BIGINT AS up, floor(CAST(face_y AS DOUBLE))::BIGINT AS down, encoding_id % 7 AS rest, CASE WHEN is_face THEN 'face' WHEN is_body THEN 'body' ELSE 'other' END AS kind FROM encodings_migration WHERE mouth_gap IS NOT NULL")
def numeric_functions(spark, d):
    e = T(spark, d, "encodings_migration").where("mouth_gap is not null")
    x, y, g = (F.col(c).cast("double") for c in ("face_x", "face_y", "mouth_gap"))
    level = F.coalesce(F.abs(x), F.lit(0.0)) + C.rescaled(g / 10, 0.25, 1.0, 2.0)
    return e.select("encoding_id", F.round(level, 6).alias("level"), F.ceil(y).alias("up"), F.floor(y).alias("down"), (F.col("encoding_id") % 7).alias("rest"), F.when(F.col("is_face"), "face").when(F.col("is_body"), "body").otherwise("other").alias("kind"))


@query("X16 C5", """WITH c AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2), u AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), dd AS (SELECT u.vec_id, m.label, sqrt(sum((u.x - m.m) * (u.x - m.m))) AS dist, sum(abs(u.x - m.m)) / 64 AS mad FROM u JOIN m ON m.i = u.i GROUP BY 1, 2)
  SELECT vec_id, label AS nearest, round(dist, 6) AS dist, round(mad, 6) AS mad FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS r FROM dd) AS x WHERE r = 1""")
def nearest_centroid(spark, d):
    from frameatlas.operators.nearest import assign_nearest, centroids

    e = T(spark, d, "embeddings")
    return assign_nearest(e, "vec_id", "embedding", centroids(e, "label", "embedding")).select("vec_id", F.col("cluster").alias("nearest"), F.round("dist", 6).alias("dist"), F.round("mad", 6).alias("mad"))


@query("X17 X32 X33 C15", """WITH v AS (SELECT encoding_id, body_landmarks AS b FROM encodings_migration WHERE len(body_landmarks) = 132)
  SELECT encoding_id, len(list_filter(range(27, 33), lambda i: b[i * 4 + 4] > 0.85)) >= 3 AS is_feet, len(list_filter(range(15, 23), lambda i: b[i * 4 + 4] > 0.5)) > 0 AS hand_visible, b[61]::DOUBLE AS left_wrist_x, b[66]::DOUBLE AS right_wrist_y, round(list_sum(list_transform(range(23, 29), lambda i: b[i * 4 + 4]::DOUBLE)) / 6, 6) AS lower_body FROM v""")
def landmark_flags(spark, d):
    v = T(spark, d, "encodings_migration").where("size(body_landmarks) = 132")
    b = F.col("body_landmarks")
    low = F.aggregate(C.visibilities(b, 23, 28), F.lit(0.0), lambda s, x: s + x) / 6
    return v.select("encoding_id", (C.count_above(C.visibilities(b, 27, 32), 0.85) >= 3).alias("is_feet"), (C.count_above(C.visibilities(b, 15, 22), 0.5) > 0).alias("hand_visible"), C.point(b, 15)["x"].alias("left_wrist_x"), C.point(b, 16)["y"].alias("right_wrist_y"), F.round(low, 6).alias("lower_body"))


@query("X18 X19", "SELECT vec_id, [round(embedding[1]::DOUBLE * 1.0, 6), round(embedding[5]::DOUBLE * 2.0, 6), round(embedding[33]::DOUBLE * 0.5, 6)] AS v FROM embeddings")
def projected_weighted_vector(spark, d):
    v = C.weighted(C.projected(F.col("embedding"), [0, 4, 32]), [1.0, 2.0, 0.5])
    return T(spark, d, "embeddings").select("vec_id", F.transform(v, lambda x: F.round(x, 6)).alias("v"))


@query("X20 X22", f"WITH {BOXES} SELECT detection_id, obj_no, l, round((l - 500) / 200, 6) AS norm_left, round((m - 300) / 200, 6) AS norm_bottom, round((l + r) / 2, 6) AS cx, round(r - l, 6) AS w FROM bb")
def normalised_boxes(spark, d):
    b = F.col("b")
    n = C.normalised(b, F.lit(500.0), F.lit(300.0), F.lit(200.0))
    return boxes(spark, d).select("detection_id", "obj_no", b["left"].alias("l"), F.round(n["left"], 6).alias("norm_left"), F.round(n["bottom"], 6).alias("norm_bottom"), F.round(C.centre(b)[0], 6).alias("cx"), F.round(b["right"] - b["left"], 6).alias("w"))


@query("X21 J15", f"""WITH {BOXES}, p AS (SELECT a.image_id, a.detection_id AS det_a, b.detection_id AS det_b, greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.m, b.m) - greatest(a.t, b.t)) AS o, greatest(0, a.r - a.l) * greatest(0, a.m - a.t) AS sa, greatest(0, b.r - b.l) * greatest(0, b.m - b.t) AS sb FROM bb AS a JOIN bb AS b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.detection_id < b.detection_id)
  SELECT image_id, det_a, det_b, round(max(coalesce(o / nullif(sa + sb - o, 0), 0)), 6) AS iou FROM p WHERE o > 0 GROUP BY 1, 2, 3""")
def box_overlaps(spark, d):
    x = boxes(spark, d)
    a, b = x.alias("a"), x.alias("b")
    j = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.detection_id") < F.col("b.detection_id"))).where(C.overlap(F.col("a.b"), F.col("b.b")) > 0)
    return j.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.detection_id").alias("det_a"), F.col("b.detection_id").alias("det_b")).agg(F.round(F.max(C.iou(F.col("a.b"), F.col("b.b"))), 6).alias("iou"))


@query("X21 C12", f"WITH {BOXES} SELECT detection_id, obj_no, round(sqrt(pow(greatest(l - 600, 0, 600 - r), 2) + pow(greatest(t - 400, 0, 400 - m), 2)), 6) AS dist, sqrt(pow(greatest(l - 600, 0, 600 - r), 2) + pow(greatest(t - 400, 0, 400 - m), 2)) <= 50 AS touches FROM bb")
def point_box_distance(spark, d):
    p = C.point_to_box(F.lit(600.0), F.lit(400.0), F.col("b"))
    return boxes(spark, d).select("detection_id", "obj_no", F.round(p, 6).alias("dist"), (p <= 50).alias("touches"))


@query("X23 X24", "SELECT id, round(least(abs(h1 - h2), 1 - abs(h1 - h2)), 6) AS hue_gap, round(degrees(atan2(right_pointer_y - left_pointer_y, right_pointer_x - left_pointer_x)), 6) AS angle FROM (SELECT *, (id % 360) / 360.0::DOUBLE AS h1, (image_id % 360) / 360.0::DOUBLE AS h2 FROM imagesdetections) AS x WHERE left_pointer_x IS NOT NULL AND right_pointer_x IS NOT NULL")
def hue_and_angle(spark, d):
    x = T(spark, d, "imagesdetections").where("left_pointer_x is not null and right_pointer_x is not null")
    h = lambda c: (F.col(c) % 360) / F.lit(360.0)
    return x.select("id", F.round(C.hue_distance(h("id"), h("image_id")), 6).alias("hue_gap"), F.round(C.hand_angle(*[F.col(c) for c in ("left_pointer_x", "left_pointer_y", "right_pointer_x", "right_pointer_y")]), 6).alias("angle"))


@query("X25 S19", "SELECT image_id, upper(md5(imagename))[1:1] || '/' || upper(md5(imagename))[1:2] || '/' || imagename AS path, sha1(concat_ws('|', site_name_id, site_image_id)) AS token FROM images WHERE imagename IS NOT NULL")
def hash_paths(spark, d):
    return T(spark, d, "images").where("imagename is not null").select("image_id", C.hashed_folders(F.col("imagename")).alias("path"), F.sha1(F.concat_ws("|", F.col("site_name_id").cast("string"), F.col("site_image_id"))).alias("token"))


@query("X27", "SELECT item_id, CAST(json_extract_string('[' || item_id || ',' || length(coalesce(title, '')) || ']', '$[1]') AS BIGINT) AS second FROM ingest_items")
def array_literal_parse(spark, d):
    text = F.concat(F.lit("["), F.col("item_id"), F.lit(","), F.length(F.coalesce("title", F.lit(""))), F.lit("]"))
    return T(spark, d, "ingest_items").select("item_id", F.get(F.from_json(text, "array<bigint>"), F.lit(1)).alias("second"))


@query("X28 X34 S16", "SELECT image_id, regexp_extract(contenturl, '([0-9]{10})', 1) AS url_id, regexp_extract(imagename, '^([A-Z])/', 1) AS folder, regexp_extract(imagename, '[.]([a-z]+)$', 1) AS ext FROM images WHERE contenturl IS NOT NULL AND imagename IS NOT NULL")
def ids_from_names(spark, d):
    return T(spark, d, "images").where("contenturl is not null and imagename is not null").select("image_id", F.regexp_extract("contenturl", "([0-9]{10})", 1).alias("url_id"), F.regexp_extract("imagename", "^([A-Z])/", 1).alias("folder"), F.regexp_extract("imagename", "[.]([a-z]+)$", 1).alias("ext"))


@query("X29", "SELECT item_id, least(len(list_filter(string_split(keywords, '|'), lambda k: contains(k, 'w'))) / 4.0, 0.9)::DOUBLE AS score FROM ingest_items WHERE keywords IS NOT NULL")
def substring_keyword_score(spark, d):
    return T(spark, d, "ingest_items").where("keywords is not null").select("item_id", F.least(F.size(F.filter(F.split("keywords", "[|]"), lambda k: k.contains("w"))) / 4.0, F.lit(0.9)).alias("score"))


@query("X31", "WITH s AS (SELECT image_id, w / nullif(h, 0)::DOUBLE AS ratio FROM images WHERE w IS NOT NULL AND h IS NOT NULL AND h <> 0), c(name, v) AS (VALUES ('1:1', 1.0::DOUBLE), ('4:3', 4.0::DOUBLE / 3), ('3:2', 1.5::DOUBLE), ('16:9', 16.0::DOUBLE / 9), ('2:3', 2.0::DOUBLE / 3), ('3:4', 0.75::DOUBLE)) SELECT image_id, name AS snapped FROM (SELECT image_id, name, row_number() OVER (PARTITION BY image_id ORDER BY abs(ratio - v), name) AS r FROM s, c) AS x WHERE r = 1")
def canonical_ratio(spark, d):
    """The nearest of a few fixed aspect ratios, chosen inside the row."""
    fixed = [("1:1", 1.0), ("4:3", 4.0 / 3), ("3:2", 1.5), ("16:9", 16.0 / 9), ("2:3", 2.0 / 3), ("3:4", 0.75)]
    near = F.array_sort(F.array(*[F.struct(F.abs(F.col("w") / F.col("h") - v).alias("d"), F.lit(n).alias("n")) for n, v in fixed]))
    return T(spark, d, "images").where("w is not null and h is not null and h <> 0").select("image_id", F.get(near, F.lit(0))["n"].alias("snapped"))


@query("X36", "SELECT event_id, (r - 1) * 10.0 AS start_s, max(value) OVER (PARTITION BY user_id ORDER BY r) AS longest_so_far FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) AS x")
def timeline_offsets(spark, d):
    w = W.partitionBy("user_id")
    x = T(spark, d, "events").withColumn("r", F.row_number().over(w.orderBy("ts", "event_id")))
    return x.select("event_id", ((F.col("r") - 1) * 10.0).alias("start_s"), F.max("value").over(w.orderBy("r").rowsBetween(W.unboundedPreceding, 0)).alias("longest_so_far"))

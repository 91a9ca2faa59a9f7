"""Vocabularies, TF-IDF, topic models and keyword translation."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.functions import columns as C
from frameatlas.functions.stem import lookup_keys, stems
from frameatlas.plans.cohorts import KEYWORDS, keywords
from frameatlas.plans.registry import query
from frameatlas.runtime import table as T


def bags(spark, d):
    """``item_id, keyword`` bags of words: the intake records are the documents."""
    return keywords(spark, d)


@query("A27 M1", f"""WITH {KEYWORDS}, n AS (SELECT count(DISTINCT item_id) AS k FROM kw) SELECT keyword, count(*) AS df FROM kw, n GROUP BY keyword, n.k HAVING count(*) >= 5 AND count(*) <= 0.5 * n.k""")
def doc_frequency_vocab(spark, d):
    b = bags(spark, d)
    n = b.agg(F.count_distinct("item_id").alias("k"))
    return b.groupBy("keyword").agg(F.count("*").alias("df")).join(F.broadcast(n)).where("df >= 5 and df <= 0.5 * k").select("keyword", "df")


DESC = "w AS (SELECT image_id, unnest(regexp_extract_all(lower(description), '[a-z]+')) AS word FROM images WHERE description IS NOT NULL), tf AS (SELECT image_id, word, count(*) AS tf FROM w WHERE length(word) BETWEEN 4 AND 15 GROUP BY 1, 2)"


def term_counts(spark, d):
    w = T(spark, d, "images").where("description is not null").select("image_id", F.explode(C.tokens(F.col("description"), 4)).alias("word"))
    return w.groupBy("image_id", "word").agg(F.count("*").alias("tf"))


@query("M2", f"WITH {DESC} SELECT image_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens FROM tf GROUP BY 1")
def bag_of_words(spark, d):
    return term_counts(spark, d).groupBy("image_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query("M3", f"""WITH {DESC}, n AS (SELECT count(DISTINCT image_id) AS k FROM tf), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), v AS (SELECT tf.image_id, tf.word, tf.tf * log2(n.k / df.df) AS x FROM tf JOIN df ON df.word = tf.word, n), z AS (SELECT image_id, word, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY image_id)), 0) AS weight FROM v)
  SELECT image_id, word, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(weight, 9) DESC, word) AS r FROM z) AS q WHERE r <= 3""")
def tfidf_top_terms(spark, d):
    tf = term_counts(spark, d)
    n = tf.agg(F.count_distinct("image_id").alias("k"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    x = tf.join(df, "word").join(F.broadcast(n)).withColumn("x", F.col("tf") * F.log2(F.col("k") / F.col("df")))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("image_id")))
    z = x.select("image_id", "word", (F.col("x") / F.nullif(norm, F.lit(0.0))).alias("weight"))
    r = F.row_number().over(W.partitionBy("image_id").orderBy(F.round("weight", 9).desc_nulls_last(), "word"))
    return z.withColumn("r", r).where("r <= 3").select("image_id", "word", F.round("weight", 6).alias("weight"))


@query("M5", f"""WITH {KEYWORDS}, df AS (SELECT keyword, count(*) AS df FROM kw GROUP BY 1), top AS (SELECT keyword, df FROM df ORDER BY df DESC, keyword LIMIT 12),
  p AS (SELECT a.keyword AS wa, b.keyword AS wb, count(*) AS co FROM kw AS a JOIN kw AS b ON a.item_id = b.item_id JOIN top AS ta ON ta.keyword = a.keyword JOIN top AS tb ON tb.keyword = b.keyword WHERE a.keyword < b.keyword GROUP BY 1, 2)
  SELECT count(*) AS n_pairs, round(sum(ln((co + 1.0) / df)), 6) AS u_mass FROM p JOIN df ON df.keyword = p.wa""")
def umass_coherence(spark, d):
    """Co-document counts of the twelve most common words, from each record's own (short) word list."""
    b = bags(spark, d)
    df = b.groupBy("keyword").agg(F.count("*").alias("df"))
    top = df.orderBy(F.col("df").desc(), "keyword").limit(12)
    own = b.join(F.broadcast(top.select("keyword")), "keyword", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list("keyword")).alias("w"))
    p = own.select(F.explode("w").alias("wa"), "w").select("wa", F.explode("w").alias("wb")).where("wa < wb").groupBy("wa", "wb").agg(F.count("*").alias("co"))
    return p.join(F.broadcast(top.withColumnRenamed("keyword", "wa")), "wa").agg(F.count("*").alias("n_pairs"), F.round(F.sum(F.log((F.col("co") + 1.0) / F.col("df"))), 6).alias("u_mass"))


def _fit_lda(spark, d, k=5):
    docs = T(spark, d, "images").where("description is not null").select("image_id", C.tokens(F.col("description"), 4).alias("words")).where(F.size("words") > 2)
    cv = CountVectorizer(inputCol="words", outputCol="features", vocabSize=5_000, minDF=5.0, maxDF=0.5).fit(docs)
    bow = cv.transform(docs).select("image_id", "features").persist()
    return cv, bow, LDA(k=k, maxIter=4, optimizer="online", seed=42).fit(bow)


@query("M4 M8 M7")
def lda_topics(spark, d):
    """The main topic of every described picture."""
    from pyspark.ml.functions import vector_to_array

    _, bow, model = _fit_lda(spark, d)
    p = model.transform(bow).select("image_id", vector_to_array("topicDistribution").alias("p"))
    best = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("s"), i.alias("t"))))
    return p.select("image_id", F.get(best, F.lit(0))["t"].alias("topic"), F.get(best, F.lit(1))["t"].alias("second_topic"))


@query("M6")
def lda_topic_words(spark, d):
    cv, _, model = _fit_lda(spark, d)
    return spark.createDataFrame([(r["topic"], " ".join(cv.vocabulary[i] for i in r["termIndices"])) for r in model.describeTopics(6).collect()], "topic int, words string")


@query("M9", f"""WITH {KEYWORDS}, dict(raw, put, kind) AS (VALUES ('placard', 'sign', 'word'), ('megaphone', 'speaker', 'word'), ('isolated', 'plain background', 'word'), ('outdoor', 'outside', 'place')) SELECT coalesce(dict.kind, 'word') AS kind, coalesce(dict.put, kw.keyword) AS keyword, count(*) AS n FROM kw LEFT JOIN dict ON dict.raw = kw.keyword GROUP BY 1, 2""")
def keyword_translation(spark, d):
    m = spark.createDataFrame([("placard", "sign", "word"), ("megaphone", "speaker", "word"), ("isolated", "plain background", "word"), ("outdoor", "outside", "place")], "keyword string, put string, kind string")
    j = bags(spark, d).join(F.broadcast(m), "keyword", "left")
    return j.groupBy(F.coalesce("kind", F.lit("word")).alias("kind"), F.coalesce("put", "keyword").alias("keyword")).agg(F.count("*").alias("n"))


@query("X6 M10 D1")
def stemmed_counts(spark, d):
    w = T(spark, d, "images").where("description is not null").select(F.explode(stems(C.tokens(F.col("description"), 4))).alias("stem"))
    return w.groupBy("stem").agg(F.count("*").alias("n"))


@query("X7", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(description), '[a-z]+')) AS word FROM images), u AS (SELECT word FROM w WHERE length(word) BETWEEN 4 AND 15),
  k AS (SELECT word, unnest([word, CASE WHEN suffix(word, 'ies') THEN word[:-4] || 'y' END, CASE WHEN suffix(word, 'es') THEN word[:-3] END, CASE WHEN suffix(word, 's') THEN word[:-2] ELSE word || 's' END, CASE WHEN NOT suffix(word, 's') THEN word || 'es' END, CASE WHEN suffix(word, 'y') THEN word[:-2] || 'ies' END,
    CASE WHEN suffix(word, 'ing') THEN word[:-4] ELSE word || 'ing' END, CASE WHEN suffix(word, 'ing') THEN word[:-4] || 'e' ELSE rtrim(word, 'e') || 'ing' END]) AS key FROM u),
  v AS (SELECT DISTINCT unnest(string_split(topic, ' ')) AS key FROM topics WHERE topic IS NOT NULL)
  SELECT word, min(key) AS key FROM k JOIN v USING (key) GROUP BY 1""")
def plural_key_lookup(spark, d):
    """Words of descriptions found in the topic dictionary under any of their number or verb forms."""
    vocab = T(spark, d, "topics").where("topic is not null").select(F.explode(F.split("topic", " ")).alias("key")).distinct()
    words = T(spark, d, "images").where("description is not null").select(F.explode(C.tokens(F.col("description"), 4)).alias("word")).distinct()
    return words.select("word", F.explode(lookup_keys(F.col("word"))).alias("key")).join(vocab, "key").groupBy("word").agg(F.min("key").alias("key"))


@query("X12", """SELECT item_id, site_name_id, site_image_id, nullif(trim(CASE WHEN site_name_id BETWEEN 1 AND 12 AND site_name_id % 3 = 0 THEN replace(keywords, '|', ', ') ELSE title END), '') AS caption, strftime(received_at, '%Y-%m-%d') AS uploaddate FROM ingest_items""")
def site_mapped_items(spark, d):
    """Intake records in the shape of pictures: one projection, the per-site rules in a table."""
    rules = spark.createDataFrame([(s, "title" if s % 3 else "keywords", s % 2 == 0) for s in range(1, 13)], "site_name_id int, text_from string, upper boolean")
    j = T(spark, d, "ingest_items").join(F.broadcast(rules), "site_name_id", "left")
    text = F.when(F.col("text_from") == "keywords", F.replace("keywords", F.lit("|"), F.lit(", "))).otherwise(F.col("title"))
    return j.select("item_id", "site_name_id", "site_image_id", F.nullif(F.trim(text), F.lit("")).alias("caption"), F.date_format("received_at", "yyyy-MM-dd").alias("uploaddate"))


@query("W7 A26 R21", "SELECT site_name_id, description, count(*) AS n FROM images WHERE description IS NOT NULL AND description <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_descriptions(spark, d):
    return T(spark, d, "images").where("description is not null and description <> ''").groupBy("site_name_id", "description").agg(F.count("*").alias("n")).where("n > 1")

"""Cohesion of vector clusters: size, mean, deviation and nearest-rank p90 of the distance to the centre."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameatlas.operators.slices import exact_quantiles
from frameatlas.runtime import materialize, table


def member_distances(vectors: DataFrame, item: str, cluster: str, vec: str) -> DataFrame:
    """``(item, cluster, dist)``: Euclidean distance to the element-wise mean of the cluster.

    The mean is one aggregate over (cluster, position); centres are one short row
    per cluster and join by key.
    """
    v = vectors.select(F.col(item).alias("item"), F.col(cluster).alias("cluster"), F.posexplode(vec).alias("i", "x"))
    centre = v.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    own = vectors.select(F.col(item).alias("item"), F.col(cluster).alias("cluster"), F.col(vec).alias("v"))
    gap = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return own.join(centre, "cluster").select("item", "cluster", F.sqrt(gap).alias("dist"))


def cohesion_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = materialize(member_distances(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"), "distances").df
    stats = d.groupBy(F.col("cluster").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("avg_dist"), F.round(F.stddev_pop("dist"), 6).alias("std_dist"))
    p90 = exact_quantiles(d, "cluster", "dist", {"p90_dist": 0.9}, nearest=True).select(F.col("cluster").alias("label"), F.round("p90_dist", 6).alias("p90_dist"))
    return stats.join(p90, "label")


DISTANCES_SQL = """
centre AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) AS u GROUP BY label, i),
part AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
dist AS (SELECT p.vec_id, p.label, sqrt(sum((p.x - c.m) * (p.x - c.m))) AS dist FROM part AS p JOIN centre AS c ON p.label = c.label AND p.i = c.i GROUP BY p.vec_id, p.label)"""

QUERIES = {"cohesion_by_cluster": cohesion_by_cluster}
SQL = {
    "cohesion_by_cluster": f"""WITH {DISTANCES_SQL}
      SELECT label, count(*) AS n, round(avg(dist), 6) AS avg_dist, round(stddev_pop(dist), 6) AS std_dist, round(quantile_disc(dist, 0.9), 6) AS p90_dist FROM dist GROUP BY label"""
}

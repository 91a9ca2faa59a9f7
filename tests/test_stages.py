"""Restarted streams, retries, manifests, many fits at once, names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameatlas.operators import lloyd
from frameatlas.runtime import retried
from frameatlas.sources import artifacts as A
from frameatlas.streaming import events as E


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    src, one, two, three = (str(tmp_path / x) for x in ("src", "w", "l", "d"))
    _events(spark, [(1, "2024-01-01 00:10:00", 1, "view", 1.0), (2, "2024-01-01 00:20:00", 2, "view", 2.0)]).write.parquet(src)
    first = E.streamed_window_counts(spark, src, home=one).collect()
    E.streamed_last_per_key(spark, src, "user_id", ["ts", "event_id"], home=two)
    E.streamed_distinct(spark, src, "event_id", home=three)
    assert [(r["n"], r["total"]) for r in first] == [(2, 3.0)]
    _events(spark, [(3, "2024-01-01 00:30:00", 1, "view", 4.0), (1, "2024-01-01 00:10:00", 1, "view", 1.0)]).write.mode("append").parquet(src)
    again = E.streamed_window_counts(spark, src, home=one).collect()
    assert [(r["n"], r["total"]) for r in again] == [(4, 8.0)]
    last = {r["user_id"]: r["event_id"] for r in E.streamed_last_per_key(spark, src, "user_id", ["ts", "event_id"], home=two).collect()}
    assert last == {1: 3, 2: 2}
    assert sorted(r["event_id"] for r in E.streamed_distinct(spark, src, "event_id", home=three).collect()) == [1, 2, 3]


def test_retries():
    tries = []

    def fail(n, error):
        tries.append(1)
        if len(tries) < n:
            raise error
        return "ok"

    assert retried(lambda: fail(3, OSError()), wait=0) == "ok" and len(tries) == 3
    with pytest.raises(OSError):
        retried(lambda: fail(99, OSError()), times=4, wait=0)
    with pytest.raises(ValueError):
        retried(lambda: fail(999, ValueError()), wait=0)
    assert len(tries) == 3 + 4 + 1


def test_manifest_stays_true(spark, tmp_path):
    p, t = str(tmp_path / "a"), spark.range(5).withColumnRenamed("id", "x")
    A.write_artifact(t, p, "k")
    assert A.append_artifact(t, p, "k")["rows"] == 10 and A.read_artifact(spark, p, "k").count() == 10
    with pytest.raises(ValueError):
        A.append_artifact(t.withColumn("y", F.lit(1)), p, "k")
    t.write.mode("append").parquet(f"{p}/data")
    with pytest.raises(ValueError):
        A.read_artifact(spark, p, "k")


def test_many_fits_find_the_clusters(spark):
    rng = np.random.default_rng(3)
    truth = rng.normal(scale=10, size=(4, 5))
    x = np.concatenate([t + rng.normal(scale=0.1, size=(50, 5)) for t in truth])
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([float("nan")] * 5,)], "v array<double>").repartition(3)
    centres, cost = lloyd.kmeans(df, "v", 4, fits=6)
    assert max(np.linalg.norm(truth - c, axis=1).min() for c in centres) < 0.1 and cost < 200 * 5 * 0.02
    same, _ = lloyd.kmeans(df.repartition(2), "v", 4, fits=6)
    assert np.allclose(np.sort(centres, 0), np.sort(same, 0), atol=1e-6)
    assert lloyd.kmeans(df.limit(0), "v", 4)[0].size == 0 and len(lloyd.kmeans(df.limit(1).where("v is not null"), "v", 4)[0]) <= 1

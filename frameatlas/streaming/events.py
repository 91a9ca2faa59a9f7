"""Event-time windows, deduplication and last-write-wins state over a stream of files.

Every stream runs to the end of what is there (``availableNow``).  Checkpoint and
output lie below ``home``: a run with the same ``home`` goes on where the last one
stopped and reads only new files.  Without one a fresh folder is used and removed at
exit.  State tables are versions by batch id, each made from the newest version below
it, so a batch that runs twice after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameatlas.runtime import filesystem, scratch


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A folder of Parquet files (or one file) as a stream; zone-less times become instants of the session zone."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    s = reader.parquet(path)
    return s.withColumns({c: F.col(c).cast("timestamp") for c, t in s.dtypes if t == "timestamp_ntz"})


def run_to_end(stream: DataFrame, mode: str, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
    q.awaitTermination()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below a folder."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(filesystem(spark, f"{path}/{n}/_SUCCESS")[1]))


def merged_state(stream: DataFrame, mode: str, key: list[str], order: list[str], home: str) -> DataFrame:
    """The last row per key by ``order`` of everything streamed so far; one table per batch, older versions are dropped."""
    spark, state = stream.sparkSession, f"{home}/state"

    def merge(df: DataFrame, i: int) -> None:
        before = [v for v in _versions(spark, state) if v < i]
        now = df.unionByName(spark.read.parquet(f"{state}/v{before[-1]}")) if before else df
        best = F.max_by(F.struct(*df.columns), F.struct(*order))
        now.groupBy(*key).agg(best.alias("_r")).select("_r.*").write.mode("overwrite").parquet(f"{state}/v{i}")
        for v in before[:-1]:
            fs, p = filesystem(spark, f"{state}/v{v}")
            fs.delete(p, True)

    run_to_end(stream, mode, merge, f"{home}/checkpoint")
    return spark.read.parquet(f"{state}/v{_versions(spark, state)[-1]}")


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts and value sums per event type and tumbling window."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def streamed_window_counts(spark: SparkSession, path: str, width: str = "1 hour", home: str | None = None) -> DataFrame:
    """Counts by window: a batch gives the windows it changed, the state table keeps their last counts; the stream's own state is bounded by the watermark."""
    changed = window_counts(read_stream(spark, path), width)
    return merged_state(changed, "update", ["window_start", "event_type"], ["n"], home or scratch(spark, "stream-windows"))


def streamed_distinct(spark: SparkSession, path: str, key: str, late: str = "7 days", home: str | None = None) -> DataFrame:
    """Rows of a stream, each key once within the watermark."""
    home = home or scratch(spark, "stream-distinct")
    s = read_stream(spark, path).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    run_to_end(s, "append", lambda df, i: df.write.mode("overwrite").parquet(f"{home}/rows/batch={i}"), f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/rows")


def streamed_last_per_key(spark: SparkSession, path: str, key: str, order: list[str], home: str | None = None) -> DataFrame:
    """The latest row per key."""
    return merged_state(read_stream(spark, path), "append", [key], order, home or scratch(spark, "stream-state"))

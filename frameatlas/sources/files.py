"""JSONL, CSV, Parquet and label files, logs and folders as tables.

Every reader takes an explicit schema: nothing is inferred from data, so a scan reads
its input once and columns have the same types on every day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "class_id int, cx double, cy double, w double, h double"


def read_jsonl(spark: SparkSession, path: str, schema: str, done: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """One record per line; broken lines give nulls. ``done`` resumes: keys it holds are left out."""
    rows = spark.read.schema(schema).json(path)
    return rows.join(done.select(key), key, "left_anti") if done is not None and key else rows


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",", empty_is_null: bool = True) -> DataFrame:
    """Delimited text; empty cells of string columns are null unless told otherwise. A leading BOM is ignored."""
    df = spark.read.schema(schema).option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    strings = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.nullif(F.regexp_replace(c, "^\\ufeff", ""), F.lit("")) for c in strings}) if empty_is_null and strings else df


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("quote", '"').option("escape", '"').csv(path)


def dictionary(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` with lower-cased keys; of equal keys the smallest value counts."""
    return df.where(F.col(key).isNotNull()).groupBy(F.lower(F.trim(key)).alias("key")).agg(F.min(value).alias("value"))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_parts(df: DataFrame, path: str, part: str) -> None:
    """Replace exactly the partitions that ``df`` holds (delete-then-insert of a subset)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, class_id, cx, cy, w, h`` of label files ('class cx cy w h' per line); broken lines are dropped."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file_name"), p.alias("p"))
    cast = [F.get("p", F.lit(i)).try_cast("int" if i == 0 else "double").alias(n) for i, n in enumerate(("class_id", "cx", "cy", "w", "h"))]
    return rows.where(F.size("p") == 5).select("file_name", *cast).where("class_id is not null and cx is not null and cy is not null and w is not null and h is not null")


def label_lines(df: DataFrame) -> DataFrame:
    """Label lines from columns class_id, cx, cy, w, h."""
    return df.select(F.concat_ws(" ", F.col("class_id").cast("string"), *[F.format_string("%.6f", F.col(c).cast("double")) for c in ("cx", "cy", "w", "h")]).alias("value"))


def corners(cx, cy, w, h) -> list:
    """Corner columns of a centre-size box."""
    c = F.col
    return [(c(cx) - c(w) / 2).alias("left"), (c(cy) - c(h) / 2).alias("top"), (c(cx) + c(w) / 2).alias("right"), (c(cy) + c(h) / 2).alias("bottom")]


def folder_ids(spark: SparkSession, glob: str, pattern: str = r"([0-9]+)[^/]*$") -> DataFrame:
    """``path, folder, file_id`` of files, from their names alone (contents are not read)."""
    p = F.col("_metadata.file_path")
    return spark.read.format("binaryFile").load(glob).select(p.alias("path"), F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(p, pattern, 1).try_cast("bigint").alias("file_id"))


def read_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Lines that match a pattern, its groups as string columns."""
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])

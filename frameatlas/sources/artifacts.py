"""Tables written with a manifest, and manifests checked before use."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

CONTRACT = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def write_artifact(df: DataFrame, path: str, kind: str) -> dict:
    """Parquet below ``path``/data and a manifest with contract version, kind, columns and rows."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    rows = df.sparkSession.read.parquet(f"{path}/data").count()
    m = {"contract_version": CONTRACT, "kind": kind, "rows": rows, "columns": [[c, t] for c, t in df.dtypes]}
    write_text(df.sparkSession, f"{path}/manifest.json", json.dumps(m, sort_keys=True))
    return m


def append_artifact(df: DataFrame, path: str, kind: str) -> dict:
    """Rows added to an artifact of the same kind and columns; its manifest counts them."""
    spark = df.sparkSession
    old = spark.read.parquet(f"{path}/data")
    if [[c, t] for c, t in df.dtypes] != json.loads(read_text(spark, f"{path}/manifest.json") or "{}").get("columns"):
        raise ValueError("columns differ from the manifest's")
    read_artifact(spark, path, kind)
    df.select(*old.columns).write.mode("append").parquet(f"{path}/data")
    m = {"contract_version": CONTRACT, "kind": kind, "rows": spark.read.parquet(f"{path}/data").count(), "columns": [[c, t] for c, t in df.dtypes]}
    write_text(spark, f"{path}/manifest.json", json.dumps(m, sort_keys=True))
    return m


def read_artifact(spark: SparkSession, path: str, kind: str | None = None, csv_schema: str | None = None) -> DataFrame:
    """The Parquet data, or CSV at ``path`` where there is none; a manifest of another contract, kind or number of rows is refused."""
    text = read_text(spark, f"{path}/manifest.json")
    rows = None
    if text is not None:
        m = json.loads(text)
        rows = m.get("rows")
        if m.get("contract_version") != CONTRACT:
            raise ValueError(f"contract_version {m.get('contract_version')}, expected {CONTRACT}")
        if kind and m.get("kind") != kind:
            raise ValueError(f"kind {m.get('kind')}, expected {kind}")
    fs, p = _fs(spark, f"{path}/data")
    if fs.exists(p):
        data = spark.read.parquet(f"{path}/data")
        if rows is not None and data.count() != rows:  # from the footers
            raise ValueError(f"{rows} rows in the manifest of {path}, other data")
        return data
    if csv_schema is None:
        raise FileNotFoundError(path)
    return spark.read.schema(csv_schema).option("header", True).csv(path)


def matrix_manifest(mode: str, files: dict[str, dict]) -> dict:
    """The manifest of a set of matrix files, each with its entity and schema version."""
    return {"contract_version": CONTRACT, "mode": mode, "files": {k: {"entity_type": v.get("entity_type"), "entity_id": v.get("entity_id"), "csv_schema_version": v.get("csv_schema_version", 1)} for k, v in sorted(files.items())}}


def add_to_manifest(old: dict, new: dict) -> dict:
    """Files of both; manifests of different contract or mode don't mix."""
    for k in ("contract_version", "mode"):
        if old.get(k) != new.get(k):
            raise ValueError(f"{k} differs: {old.get(k)} and {new.get(k)}")
    return old | {"files": old["files"] | new["files"]}

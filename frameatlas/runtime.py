"""Session, table access and lineage cuts shared by every operator.

Results that are read more than once are written as Parquet below the shared
folder named in ``spark.checkpoint.dir``.  All executors see that folder, so a
lost executor costs a re-read and never a recomputation of the whole lineage,
and Parquet keeps column pruning and size statistics (which let Spark decide by
size whether a join side may be broadcast).
"""

from __future__ import annotations

import atexit
import ctypes
import glob
import os
import tempfile
import time
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: dict[str, SparkSession] = {}


def session(app: str = "frameatlas", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; a file and a folder of files read alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master a temporary one where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    have = jsc.getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="frameatlas-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def filesystem(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def _cleanup() -> None:
    for path, spark in list(_OWNED.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already
            pass


atexit.register(_cleanup)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that is removed at exit."""
    path = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    _OWNED[path] = spark
    return path


class Written:
    """A materialised table: ``df`` reads it, ``drop()`` frees the space."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def rows(self) -> int:
        return self.df.count()  # answered from the Parquet footers

    def drop(self) -> None:
        _OWNED.pop(self.path, None)
        _delete(self.spark, self.path)


def materialize(df: DataFrame, name: str = "t") -> Written:
    """Write ``df`` once to the shared folder and read it back (a lineage cut)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return Written(spark, path)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    """Partition count that follows the data instead of a fixed setting."""
    return max(least, -(-rows // per_partition))


def hash_sample(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows: all whose hash of ``key`` lies below a threshold sized from the row count.

    The filter runs where the rows lie, so a task sends only its share of the sample.
    """
    n = df.count() if total is None else total
    steps = 1 << 40
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(77), F.col(key)), F.lit(steps)) < F.lit(int(steps * (rows / n))))


def retried(fn, times: int = 5, wait: float = 1.0, on: tuple[type[BaseException], ...] = (OSError,)):
    """The result of ``fn``, tried up to ``times`` times; the wait doubles from try to try, other errors pass through."""
    for n in range(times):
        try:
            return fn()
        except on:
            if n + 1 == times:
                raise
            time.sleep(wait * 2**n)


@lru_cache(maxsize=1)
def single_blas_thread() -> bool:
    """Call inside Arrow functions: tasks already use every core, so matrix products must not start threads of their own."""
    import numpy

    found = False
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(numpy.__file__)), "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                found = True
                break
    return found

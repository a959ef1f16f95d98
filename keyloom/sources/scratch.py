"""Written intermediates: tables below the cluster's shared checkpoint folder. They cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidOptions

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, deleted at exit.

    Where that is unset, a local master takes a temporary folder, and any other is an error: executors wouldn't see the driver's files.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise InvalidOptions("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        _roots[sc.applicationId] = f"{base.rstrip('/')}/keyloom-{uuid.uuid4().hex}"
        atexit.register(discard, spark, _roots[sc.applicationId])
    return _roots[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_path = path
    return out


def discard(spark: SparkSession, *where) -> None:
    """Delete materialised frames (or paths) that nothing reads any more."""
    for w in where:
        path = getattr(w, "_keyloom_path", w)
        if isinstance(path, str):
            with contextlib.suppress(Exception):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

"""Settings that a session needs to run this library."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this library where it is run from a checkout: they take PYTHONPATH from the context."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


_made: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Deletes the tables that stored() has made so far. Call it in a long session once results built on them are written; it is called when the process ends."""
    while _made:
        spark, path = _made.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(release)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet to the folder that all executors share (spark.checkpoint.dir; in local mode one of our own where that is unset) and read again.

    by: a column of few values; a filter on it reads the files of these values alone.
    The table stays until release(), for what is built on it may be read at any time."""
    spark = df.sparkSession
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
        where = spark.sparkContext.getCheckpointDir()
    path = f"{where}/tickloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)

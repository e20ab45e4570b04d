"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def session(name: str = "stratalake", master: str | None = None, **config: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings hold otherwise."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in config.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset (tests, single machine). On a cluster it must be set, as
    executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset; set it to a folder that the driver and all executors share")

        where = "file://" + tempfile.mkdtemp(prefix="stratalake-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with Spark's own file system client."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/stratalake/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already, others may not have
            continue


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stratalake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_stratalake_path", None)
        if path:
            remove(df.sparkSession, path)

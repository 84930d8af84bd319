"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local
    sessions (tests) get a temporary folder, and clusters one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if (spark.sparkContext.master or "").startswith("local") and "cluster" not in spark.sparkContext.master:
            folder = tempfile.mkdtemp(prefix="skylattice-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and survives
    the loss of executors. The files go when the driver ends, or by drop_stage()."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/skylattice-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished phases that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None:
            continue
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may already be gone at exit
            return

"""Session helpers: tables, the shared folder for staged results, and the size check before a broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_process(master: str) -> bool:
    """Whether ``master`` runs driver and executors as one process."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process.

    On a cluster a folder of one machine would be a different one for every executor, so an unset folder raises ValueError there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not one_process(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-trackloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors. The files are removed when the driver's process ends. Values are written without
    a dictionary, so that the files' size, by which Spark decides on broadcasts, stays near the size in memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    except Exception:  # the session has already ended
        pass


def in_force(df: DataFrame, keys: list[str], columns: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per key: the one with the latest ``order``.

    Equal rows sent twice give one row. A NULL ``order`` counts as the oldest; rows that differ but share the latest
    ``order`` are ranked by ``columns``, so the choice does not depend on the input's order. The aggregate combines on
    the map side, so that a key repeated in very many rows is reduced before the shuffle.
    """
    rest = [c for c in columns if c not in keys and c != order]
    last = F.max(F.struct(F.col(f"`{order}`"), *(F.col(f"`{c}`") for c in rest))).alias("_last")
    kept = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(last)
    return kept.select(*(F.col(f"`{k}`") for k in keys), *(F.col("_last").getField(c).alias(c) for c in [order, *rest]))

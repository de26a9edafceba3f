"""The folder that driver and executors share, and cutting of long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a local master, as in tests, a folder of our own where it is unset."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not held:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as a table in the shared folder and read from there.

    Unlike a checkpoint, a table isn't computed twice, and the planner knows its size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/strandlake/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read any more: what was made from them has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

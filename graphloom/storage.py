"""Tables that later steps of a job read again, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset and all runs in one process (as in tests), under /tmp."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file:///tmp/checkpoints/graphloom"
    return f"{at.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, in subfolders by the columns named: cuts lineage between rounds and survives lost executors."""
    path = shared_folder(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Deletes what written() wrote for the tables, or a subfolder of it, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{df._written_at}/{part}" if part else df._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled.  Rounds would else send their tables through the driver as broadcasts again and again, and each grows with the input."""
    return df.hint("merge")

"""Intermediate tables in the folder that driver and executors share; they go when the application ends, or before by `clean`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "spanloom-"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where none is set and all runs in one process, a folder of our own; on a cluster a
    folder of one machine would lose rows, so that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix=PREFIX)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows and read them back: lineage ends here, and a lost executor costs only a new read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{PREFIX}{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        folders = {name.rpartition("/")[0] for name in table.inputFiles()}
        for folder in folders:
            if not folder.rpartition("/")[2].startswith(PREFIX):
                raise ValueError(f"{folder} is no scratch table")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> int:
    """Delete the tables of this application that are still in the shared folder, once nothing reads them any more; gives their number."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{PREFIX}{spark.sparkContext.applicationId}-*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [s.getPath() for s in files.globStatus(pattern) or []]
    for path in left:
        files.delete(path, True)
    return len(left)

"""Where intermediate results are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared folder, or in the warehouse where none is set.

    Spark removes it with all that is in it when the application ends. A warehouse on one machine's disk
    will do in local mode only: executors elsewhere would not see it.
    """
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    base = (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = f"{base}/kept-{spark.sparkContext.applicationId}"
    files = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not configured and files.getUri().getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {_SETTING} to a folder that all executors share; {base} is on one machine's disk")
    if not files.exists(hadoop(folder)):
        files.mkdirs(hadoop(folder))
        files.deleteOnExit(hadoop(folder))
    # Named in full, for readers that are not Spark's.
    return str(files.makeQualified(hadoop(folder)).toString()).replace("file:/", "file:///", 1).replace("file:////", "file:///", 1)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    It is computed once, its lineage ends there, and it is safe when executors are lost.
    """
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

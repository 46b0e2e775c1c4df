"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on
    a cluster that would lose data, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="recdata-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _until_exit(spark: SparkSession, path: str) -> object:
    """The path as Hadoop has it; its files, which must exist, go when the application ends."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return hadoop_path


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    folder = f"{shared_dir(spark)}/recdata-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop_path)
    _until_exit(spark, folder)
    return f"{folder}/files"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs no more than its running tasks, and
    columns are pruned on every later read. The files go with `release`, or when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recdata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = _until_exit(spark, path)
    stored = spark.read.schema(df.schema).parquet(path)
    _paths[stored] = hadoop_path
    return stored


#: The folder of each stored table that may still be released; tables that nothing refers to any more drop out.
_paths: WeakKeyDictionary[DataFrame, object] = WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that `materialize` gave; nothing may read them any more. Other tables are left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

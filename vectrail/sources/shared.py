"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one in
    local mode; on a cluster an error, as its machines share no such folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is unset, and {master} has no folder that all its machines share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="vectrail-"))
        root = _own_folder[0]
    return root.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/vectrail-{tag}-{uuid.uuid4().hex}"


class Stored:
    """A table written to the shared folder. Reading it back cuts the lineage
    and leaves no partitioning behind, so that later joins can split skew."""

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        self.path = fresh_path(spark, tag)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    return Stored(df, tag).df

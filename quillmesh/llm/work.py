"""Shared working folder for tables that cut lineage between steps.

The folder is the cluster's ``spark.checkpoint.dir``.  Where that setting is absent, a folder under ``/tmp/checkpoints``
serves in local mode, whose one process sees it whole; on a cluster it is an error, as executors share no such folder.
"""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


class Work:
    """A folder of intermediate tables; ``drop`` removes tables no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_base(spark)}/quillmesh/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Have the files of finished shuffles deleted, which stay until the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables; a name may end in ``*``."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            files = path.getFileSystem(conf)
            for found in files.globStatus(path) or []:
                files.delete(found.getPath(), True)

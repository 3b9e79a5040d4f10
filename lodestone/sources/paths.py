"""Look at a path through the file system Spark itself would use for it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(sc._jsc.hadoopConfiguration())
    return bool(files.globStatus(where))

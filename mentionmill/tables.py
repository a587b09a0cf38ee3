"""Intermediate tables in the folder that the cluster's machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


class Table:
    """A written DataFrame: its lineage ends here, lost executors read it again, and it can be dropped.

    ``files`` bounds the number of its files, for small tables: on a local disk Hadoop starts processes for every file
    that an executor writes, to set its rights. It should follow from a count of rows, so that it grows with them.
    """

    def __init__(self, df: DataFrame, files: int | None = None) -> None:
        if files:
            df = df.coalesce(files)
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark).rstrip('/')}/{uuid.uuid4().hex}"
        self.schema = df.schema
        # The job's shuffle files are of no use once the rows are written, and go with it.
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; only when everything that reads them has been written elsewhere."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

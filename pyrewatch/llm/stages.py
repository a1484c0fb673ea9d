"""Stages: tables written once to the shared folder, so that lost executors repeat nothing before them."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pyrewatch.session import shared_folder


class Stages:
    """Writes intermediate tables of one run and removes those no longer needed.

    Tables that the returned, lazy result still reads stay until the driver ends; its file system then deletes them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/run-{uuid4().hex}"
        self._count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the stored table."""
        self._count += 1
        path = f"{self.folder}/{self._count}"
        df.write.option("compression", "zstd").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored._stage_path = path
        return stored

    def drop(self, *stored: DataFrame) -> None:
        """Remove tables of ``keep`` whose readers have all been written."""
        for df in stored:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_rows(df: DataFrame, column: str, keep: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of ``df`` for which ``keep``, given a batch of ``column``, says so; whole, whatever columns are called."""
    at, names = df.columns.index(column), df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in batches:
            yield batch.filter(keep(batch.column(at)))
    return plain.mapInArrow(run, plain.schema).toDF(*names)

"""Reading tables and cutting lineage through files that every executor can reach."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only on a local master one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lodestrata-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


class Workspace:
    """Written intermediate tables of one run of an iterative operator.

    A table that has been written survives the loss of any executor and is never recomputed.
    `drop` removes one as soon as nothing reads it any more, so disk stays at a few live tables.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def cut(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_workspace_path"] = path
        return out

    def cut_by(self, df: DataFrame, name: str, kind: str, kinds: list[str]) -> list[DataFrame]:
        """Adds the rows to the tables of `name`, one for each value of the column `kind`; each can be dropped by itself."""
        path = f"{self.root}/{name}"
        df.write.mode("append").partitionBy(kind).parquet(path)
        return [self._read(f"{path}/{kind}={k}", df.drop(kind)) for k in kinds]

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """Adds the rows to the table `name`, which the query may read; all rows so far."""
        df.write.mode("append").parquet(f"{self.root}/{name}")
        return self._read(f"{self.root}/{name}", df)

    def _read(self, path: str, like: DataFrame) -> DataFrame:
        self._fs(path).mkdirs(self._path(path))  # a table without rows may have no folder
        out = self.spark.read.schema(like.schema).parquet(path)
        out.__dict__["_workspace_path"] = path
        return out

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, df: DataFrame) -> None:
        path = df.__dict__.get("_workspace_path")
        if path:
            self._fs(path).delete(self._path(path), True)


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Before work that is heavy per row: rows of a scan of fewer partitions than `tasks` are spread by key.

    Without `tasks` it is the cores of the session. A table of as many partitions is left as it is. Pass 0 to leave any.
    """
    n = df.sparkSession.sparkContext.defaultParallelism if tasks is None else tasks
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *keys)

"""Shared folder and scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one file of a table that is known to be small.
FILE_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or that of setCheckpointDir.

    Where neither is set, local mode (one machine, as in tests) gets a temporary folder; a cluster
    has no folder that could stand in, which is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="lexaudit-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor costs a reread, not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def keep(self, df: DataFrame, label: str, rows: int | None = None, a_file: int = FILE_ROWS) -> DataFrame:
        """The table read back. rows: a bound on its rows, and on those of all it is made from; a small table then takes few tasks and files."""
        files = df if rows is None else df.coalesce(max(1, -(-rows // a_file)))
        files.write.mode("overwrite").parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def drop(self, *labels: str) -> None:
        """Delete tables that no later plan reads."""
        for label in labels:
            fs, p = self._fs(self.path(label))
            fs.delete(p, True)

    def labels(self) -> list[str]:
        """The tables that are there."""
        fs, p = self._fs(self.root)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

"""Tables between the steps of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where the session names none (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage.

    ``drop`` removes them, as does the end of a ``with`` block; what is left goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/gleaner-{uuid.uuid4().hex}"
        self.tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it back."""
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.option("compression", "zstd").parquet(path)
        if self.tables == 1:
            folder, files = self._folder()
            files.deleteOnExit(folder)
        return self.spark.read.schema(df.schema).parquet(path)

    def _folder(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self) -> None:
        folder, files = self._folder()
        files.delete(folder, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

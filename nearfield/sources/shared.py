"""Tables and folders in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Written without checksum files under a local file system: Hadoop starts a process for the permissions of every file, and for a moment it counts as a second JVM.
RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the session sets it. Where it is unset and everything runs
    in one process on one machine, a folder of this application under the temp folder serves; on a
    cluster that is an error, since executors don't see each other's temp folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/nearfield-{spark.sparkContext.applicationId}"
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


class Scratch:
    """Tables and folders in the shared folder, which outlive a lost executor and cut lineage.

    They are deleted when the driver's JVM ends, or earlier by :meth:`drop`.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/nearfield-{uuid.uuid4().hex[:16]}"

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, name: str) -> str:
        """Make an empty folder and return its URI."""
        path, fs = self._path(name)
        fs.mkdirs(path)
        fs.deleteOnExit(path.getParent())
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path, fs = self._path(name)
        fs.deleteOnExit(path.getParent())
        df.write.mode("overwrite").options(**RAW).parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without names all of them."""
        for name in names or ("",):
            path, fs = self._path(name)
            fs.delete(path, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished queries, which it does once their plans are garbage on the driver."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

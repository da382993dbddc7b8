"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on local[...] alone an own one."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_root is None:
        keep = tempfile.TemporaryDirectory(prefix="quillon-", ignore_cleanup_errors=True)
        atexit.register(keep.cleanup)
        _own_root = f"file://{keep.name}"
    return _own_root


class Scratch:
    """Tables written to the shared folder to cut lineage: they survive lost executors.

    ``save`` writes a DataFrame as Parquet and reads it back; ``drop`` deletes a table that no later
    plan reads. What a returned DataFrame still reads stays until the session's folder is cleaned.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/quillon/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")  # this write's shuffle files go when it is done: nothing reads them again
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def rename(self, old: str, new: str) -> None:
        """Let ``drop(new)`` delete what was saved as ``old``."""
        self.paths[new] = self.paths.pop(old)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)

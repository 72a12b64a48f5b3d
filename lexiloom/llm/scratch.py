"""Intermediate tables in the folder that the whole cluster shares.

A table written here replaces a long lineage: it survives lost executors, and a later
read does not compute its parents again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="lexiloom-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, like those given."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """A folder for one run of one operator. ``save`` writes and rereads, ``drop`` frees the space."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lexiloom_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that no later plan reads."""
        for df in tables:
            path = getattr(df, "_lexiloom_path", None)
            if path:
                jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)

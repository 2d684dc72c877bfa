"""Working tables: results that are read several times are written once to a folder that all executors share.

A written table cuts the lineage, survives the loss of executors and can be deleted as soon as nothing reads it.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without that setting a local session gets a folder of its own; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append((spark, root))
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            else:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


class Workspace:
    """Named working tables of one query below the shared folder.

    As results are read from them later, they stay until :meth:`close` or the end of a ``with`` block; what is left is deleted when
    the process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.root))

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete all tables; results that read them must have been written or collected."""
        _delete(self.spark, self.root)
        if (self.spark, self.root) in _made:
            _made.remove((self.spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` as table ``name`` and return the DataFrame that reads it."""
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for n in names:
            _delete(self.spark, self.path(n))

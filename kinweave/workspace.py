"""Intermediate tables in the folder that all executors share.

The cluster names that folder in ``spark.checkpoint.dir``. A folder of our own is
used only where the setting is absent, which is the case in local tests.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_scopes: list[list[Workspace]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="kinweave-")
    return _own_root


@contextlib.contextmanager
def scope():
    """Drop at the end all workspaces that were opened inside, whose results must be written by then."""
    opened: list[Workspace] = []
    _scopes.append(opened)
    try:
        yield
    finally:
        _scopes.remove(opened)
        for work in opened:
            work.drop()


class Workspace:
    """A folder of intermediate tables for one call of an operator.

    Tables are plain Parquet, so a lost executor costs the tasks it ran and not the
    lineage before the table. The folder goes when the session's process ends, with
    :meth:`drop`, which may be called once the operator's result has been written, or at the
    end of the :func:`scope` it was opened in.

    A plan takes the size of a table's files for its size in memory, and ids in order may be
    a hundred times as large there. With ``shuffled``, for tables that grow with the input,
    a join does not broadcast one of them unasked; ``F.broadcast`` of the other side still counts.
    """

    def __init__(self, spark: SparkSession, label: str, shuffled: bool = False) -> None:
        self.spark, self.shuffled = spark, shuffled
        self.path = f"{shared_root(spark)}/kinweave/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)
        if _scopes:
            _scopes[-1].append(self)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.folder(name))
        rows = self.spark.read.schema(df.schema).parquet(self.folder(name))
        return rows.hint("merge") if self.shuffled else rows

    def remove(self, name: str) -> None:
        """Delete one table that nothing reads any more."""
        self._delete(self.folder(name))

    def drop(self) -> None:
        atexit.unregister(self.drop)
        self._delete(self.path)

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        try:
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone when the interpreter ends
            return

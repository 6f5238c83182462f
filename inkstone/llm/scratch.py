"""Intermediate tables in the folder that all machines of a cluster share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading
it again, so a lost executor costs at most one stage and no machine-local file
is ever needed by another machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder; a
    cluster gets an error, since its machines don't share one.
    """
    folder = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {_SETTING} to a folder that all machines share")
    folder = "file://" + tempfile.mkdtemp(prefix="inkstone-")
    spark.conf.set(_SETTING, folder)
    return folder


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_BYTES at once, however long the rows are
    (or one row). Only ever lowers the session's setting."""
    set_now = spark.conf.get(_BATCH, "1g").lower().rstrip("b")
    if not set_now.isdigit() or int(set_now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Scratch:
    """Tables of one query run; each can be dropped once it has been used."""

    def __init__(self, spark: SparkSession, name: str, compression: str = "none"):
        """Codecs hold buffers outside the heap until a collection frees them; of
        many small files these add up, so only tables of texts are compressed."""
        bounded_batches(spark)
        self.spark, self.compression = spark, compression
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet in the shared folder, and read again."""
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.option("compression", self.compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes the files of a table made by ``keep``."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_GROUP_BYTES = 16 << 20
_DROP_SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own;
    on a cluster a missing setting is an error, because executors share no local disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Cut ``df``'s lineage by a compressed table in the shared folder, then delete what only ``df`` still needed.

    ``spent`` are earlier results of this function that no later step reads;
    other tables among them stay. The shuffle files of the write go with it: a
    lost executor costs nothing once the table is there.
    """
    spark = df.sparkSession
    folder = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLE_FILES, "false")
    spark.conf.set(_DROP_SHUFFLE_FILES, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", _ROW_GROUP_BYTES).parquet(folder)
    finally:
        spark.conf.set(_DROP_SHUFFLE_FILES, before)
    for table in spent:
        if old := _FOLDERS.pop(table, None):
            path = spark._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    found = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[found] = folder
    return found


def text_column(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole text (null: empty); other columns are left behind, so none can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

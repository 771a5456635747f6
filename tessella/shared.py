"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application: on one machine only.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder of its context.

    Where neither is set, a temporary folder on a single machine (``local``
    masters, as in tests); on a cluster, whose executors could not read it, an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(sc.applicationId, _OWN.get(sc.applicationId) or tempfile.mkdtemp(prefix="tessella-"))
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:
        pass  # the session may be gone already; the folder's own retention applies


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tessella-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:
        pass  # the session may be gone already


def cut_by(df: DataFrame, column: str, parts: int) -> DataFrame:
    """The same as a table bucketed by a column: grouping by it later moves nothing."""
    spark = df.sparkSession
    name = f"tessella_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, column).saveAsTable(name, format="parquet")
    atexit.register(_delete, spark, path)
    atexit.register(_drop, spark, name)
    return spark.table(name)

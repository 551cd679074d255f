"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where that is unset in a session of one
    process (tests, a laptop) a temporary folder is made and set; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='partlab-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that is not in use; what is written there goes at exit."""
    path = f"{folder(spark)}/partlab/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: its owner clears the shared folder
        pass


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage: ``df`` as a table in the shared folder, so that what follows neither
    recomputes it nor depends on the executors that made it, and is planned by its real size."""
    spark = df.sparkSession
    path = new_path(spark, "round")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._partlab_path = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a written table, else :func:`checkpoint` of it."""
    return df if hasattr(df, "_partlab_path") else checkpoint(df)


def release(*tables: DataFrame) -> None:
    """Deletes tables of earlier rounds that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_partlab_path", None)
        if path:
            remove(df.sparkSession, path)

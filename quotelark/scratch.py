"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of this process for a local master, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quotelark-"))
    return _OWN[0]


def new_path(spark: SparkSession) -> str:
    """A path that nothing uses yet. All paths of an application lie in one folder, which can be cleared when it has ended."""
    return f"{shared_dir(spark)}/quotelark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor repeats nothing before it.

    Nothing needs the shuffle files behind it any more; a collection on the driver lets Spark's cleaner delete them at once.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once all that is made of them has been written too."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

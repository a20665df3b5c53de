"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside these.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the cluster's shared folder, as spark.checkpoint.dir or the context names it.

    Where neither names one, a session within one process (local[n], as in tests) takes a temporary folder; on a
    cluster executors would not see the driver's folders, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/inkspan-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for these; call it once nothing unwritten reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        jvm.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(jvm, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row.

    A plain column can be inlined by the optimizer, also into a lambda, where it would be evaluated per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

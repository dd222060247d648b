"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a session that names none.
_local: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests, one machine), a local one. On a cluster it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tracelake-"))
        where = _local[0]
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once and read back: its lineage and its size estimates start anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

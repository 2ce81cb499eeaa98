"""The folder all executors share, and tables written there between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, where none is named, a temporary one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def new_path(spark: SparkSession, suffix: str = "") -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}{suffix}"


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder as Parquet, which takes a part of the room of `keep`."""
    path = new_path(df.sparkSession, ".parquet")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
